"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Samples become pitch-class frames; an integral image over them gives every filter's box
sums in four look-ups, and 16 filters of two bits pack each position into one 32-bit
integer. An inverted index joins recordings and queries on their integers; a histogram of the
offsets at which a pair shares integers gives the alignments to try, and the bit errors of the
aligned stretch choose among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices


@dataclass(frozen=True)
class Chroma:
    """How samples become fingerprints. Bands are MIDI notes; `step` is the hop between frames."""

    rate: int = 4000
    window: int = 1024
    step: int = 256
    low_note: int = 48
    high_note: int = 83
    width: int = 16
    near: float = 0.12

    def filters(self) -> list[tuple[int, int, int, int]]:
        """(kind, first pitch class, height, width) by rule: kinds take turns, places go round in fourths, boxes grow."""
        return [(i % 4, (5 * i) % 12, 2 + 2 * (i % 3), self.width >> (i // 8)) for i in range(16)]


def chroma_frames(samples: np.ndarray, c: Chroma) -> np.ndarray:
    """Energy of the 12 pitch classes in each frame, each frame scaled to length 1 (silence: zeros)."""
    n = 1 + (len(samples) - c.window) // c.step if len(samples) >= c.window else 0
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, c.window)[:: c.step][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(c.window).astype(np.float32), axis=1)) ** 2
    hz = np.fft.rfftfreq(c.window, 1 / c.rate)
    note = np.round(69 + 12 * np.log2(np.maximum(hz, 1e-9) / 440)).astype(int)
    band = (note >= c.low_note) & (note <= c.high_note)
    classes = np.zeros((len(hz), 12))
    classes[np.flatnonzero(band), note[band] % 12] = 1
    out = power @ classes
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)


def fingerprint(samples: np.ndarray, c: Chroma) -> np.ndarray:
    """One unsigned 32-bit integer for each position that the widest filter fits."""
    frames = chroma_frames(samples, c)
    n = len(frames) - c.width + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), 0), 1)  # twice, so boxes may pass B
    t = np.arange(n)

    def box(t0, t1, y0, y1):
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in c.filters():
        if kind == 0:
            a, b = box(0, w, y, y + h), box(0, w, y + h, y + 2 * h) if y + 2 * h <= 24 else box(0, w, y - h, y)
        elif kind == 1:
            a, b = box(0, w // 2, y, y + h), box(w // 2, w, y, y + h)
        elif kind == 2:
            a, b = box(w // 4, w - w // 4, y, y + h), box(0, w // 4, y, y + h) + box(w - w // 4, w, y, y + h)
        else:
            a, b = box(0, w, y, y + h // 2), box(0, w, y + h // 2, y + h)
        v = np.log((1 + a) / (1 + b))
        level = (v > -c.near).astype(np.uint32) + (v > 0) + (v > c.near)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def samples_of(raw: bytes | None) -> np.ndarray:
    """16-bit mono little-endian samples, with or without a RIFF header; null or odd bytes: what whole samples there are."""
    raw = raw or b""
    if raw[:4] == b"RIFF" and (at := raw.find(b"data")) >= 0:
        raw = raw[at + 8 :]
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768


def fingerprints(media: DataFrame, id_col: str, audio_col: str, c: Chroma = Chroma()) -> DataFrame:
    """``<id_col>, fp``: little-endian 32-bit integers of each row's audio; too short or null audio has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                fps = [fingerprint(samples_of(x), c).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["_id", "fp"])

    slim = media.select(F.col(id_col).alias("_id"), F.coalesce(F.col(audio_col), F.lit(b"")).alias("_audio"))
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, fp binary").withColumnRenamed("_id", id_col)


#: The integer of a position at which all is silent: every filter compares nothing with nothing.
SILENCE = 0x55555555


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of wrong bits where b is laid over a at an offset."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    return float(np.bitwise_count(a[low:high] ^ b[low - offset : high - offset]).sum()) / (32 * (high - low))


def search(prints: DataFrame, is_query, id_col: str, least: int = 3, most_error: float = 0.35, salts: int = 8) -> DataFrame:
    """Every recording against all queries (rows where the Column is_query holds).

    Returns ``<id_col>, n_items, fp_crc32, n_matches, best_query, best_offset, best_shared, best_error``.
    A pair aligns at each offset at which it shares at least `least` integers; the offset of least error
    counts (then of most shared integers, then the nearest to 0). n_matches counts query rows with an error
    of at most most_error, the row itself included where it is one; the best has the least error, then the
    smallest id. Silent positions are in no alignment's count but in its error. Recordings with equal
    fingerprints are compared once and each row gets its own answer. A null or too short recording has no
    integers and no match; null ids are answered like others; an empty table gives no rows.

    Integers are joined by value and one of `salts` numbers dealt to recordings, so a frequent integer is
    met by several tasks; pairs are counted before any fingerprint is looked at.
    """
    named = materialize(prints.select(F.col(id_col).alias("_id"), "fp", is_query.alias("_q"), F.unhex(F.sha2("fp", 256)).alias("_class")), "prints")
    sound = named.where(F.octet_length("fp") > 0)
    classes = materialize(sound.groupBy("_class").agg(F.first("fp").alias("fp"), F.count_if("_q").alias("nq"), F.min(F.when(F.col("_q"), F.col("_id"))).alias("q")), "print-classes")
    kind = named.schema["_id"].dataType.simpleString()

    def items(df: DataFrame, prefix: str) -> DataFrame:
        value = lambda k: F.concat(*[F.substring("fp", 4 * k + 4 - i, 1) for i in range(4)])
        places = F.transform(F.sequence(F.lit(0), (F.octet_length("fp") / 4).cast("int") - 1), lambda k: F.struct(k.alias("at"), F.conv(F.hex(value(k)), 16, 10).cast("long").alias("value")))
        rows = df.select(F.col("_class").alias(f"{prefix}_class"), F.explode(places).alias("x"))
        return rows.select(f"{prefix}_class", F.col("x.at").alias(f"{prefix}_at"), F.col("x.value").alias("value")).where(F.col("value") != SILENCE)

    recs = items(classes, "r").withColumn("salt", F.pmod(F.xxhash64("r_class"), F.lit(salts)).cast("int"))
    queries = items(classes.where("nq > 0"), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    shared = recs.join(queries, ["value", "salt"]).groupBy("r_class", "q_class", (F.col("r_at") - F.col("q_at")).alias("offset")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, qfp = ([np.frombuffer(x, "<u4") for x in batch.column(k).to_pylist()] for k in (0, 1))
            errors = [bit_error(a, b, o) for a, b, o in zip(fp, qfp, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(errors, pa.float64())], ["offset", "shared", "_class", "q_class", "q", "nq", "error"])

    side = classes.select(F.col("_class").alias("q_class"), F.col("fp").alias("q_fp"), "q", "nq").where("nq > 0")
    laid = shared.join(classes.select(F.col("_class").alias("r_class"), "fp"), "r_class").join(side, "q_class").select("fp", "q_fp", "offset", "shared", F.col("r_class").alias("_class"), "q_class", "q", "nq")
    errors = laid.mapInArrow(run, f"offset int, shared long, _class binary, q_class binary, q {kind}, nq long, error double").where(F.col("error") <= most_error)
    alignment = F.struct("error", (-F.col("shared")).alias("less"), F.abs("offset").alias("far"), "offset", "q", "nq")
    pairs = errors.groupBy("_class", "q_class").agg(F.min(alignment).alias("b")).select("_class", "b.*")
    best = pairs.groupBy("_class").agg(F.sum("nq").alias("n"), F.min(F.struct("error", "q", "offset", (-F.col("less")).alias("shared"))).alias("b"))
    matched = sound.join(materialize(best, "print-matches"), "_class", "left")
    out = matched.unionByName(named.where(F.octet_length("fp") == 0), allowMissingColumns=True)
    return out.select(
        F.col("_id").alias(id_col), (F.octet_length("fp") / 4).cast("long").alias("n_items"), F.crc32("fp").alias("fp_crc32"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"),
        F.col("b.q").alias("best_query"), F.col("b.offset").alias("best_offset"), F.col("b.shared").alias("best_shared"), F.col("b.error").alias("best_error"),
    )


def tones(vector: list[float] | None, c: Chroma = Chroma()) -> bytes:
    """A recording that plays a vector: one tone of `step` samples for each number, its pitch class by size, 16-bit samples."""
    v = np.nan_to_num(np.array(vector or [], float))
    pitch = 60 + np.mod(np.floor(v * 24), 12) + 12 * (np.arange(len(v)) % 2)
    t = np.arange(c.step) / c.rate
    wave = np.sin(2 * math.pi * (440 * 2 ** ((pitch - 69) / 12))[:, None] * t)
    return (wave * 20000).astype("<i2").tobytes()


def sonify(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", c: Chroma = Chroma()) -> DataFrame:
    """The media column of the query: ``<id_col>, audio`` for every vector (the tables hold no recordings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tones(v, c) for v in batch.column(1).to_pylist()], pa.binary())], ["_id", "audio"])

    slim = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, audio binary").withColumnRenamed("_id", id_col)


def op4_chroma(spark, sf_dir: str) -> DataFrame:
    """Recordings played from all embeddings; queries are the rows whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints = fingerprints(sonify(vectors), "vec_id", "audio")
    return search(prints, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), "vec_id")
