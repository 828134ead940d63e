"""Files, archives, uploads and embedded snippets as tables."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, extension_table, included

#: Most bytes of a file of each language.
SIZE_CAPS = {"java": 10 << 20, "javascript": 5 << 20, "python": 5 << 20, "sql": 20 << 20, "bash": 1 << 20, "php": 5 << 20, "csharp": 10 << 20, "c": 10 << 20}


def languages(spark: SparkSession, profile: str = "files") -> DataFrame:
    """(ext, language): a fixed list of a few dozen rows, by profile (files, parsers, uploads)."""
    return spark.createDataFrame(list(extension_table(profile).items()), "ext string, language string")


def inline(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Files given as (language, source) pairs, with the same columns as scan()'s."""
    rows = [(i, f"inline-{i}", language, source) for i, (language, source) in enumerate(sources)]
    return spark.createDataFrame(rows, "file_id long, path string, language string, source string")


def scan(spark: SparkSession, paths: list[str], include: list[str] = (), exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, rejected): every file below the paths as text with its language; files that are not UTF-8 are rejected with a reason."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).where(included(F.col("path"), list(include), list(exclude)))
    named = raw.withColumn("ext", extension(F.col("path"))).join(languages(spark), "ext", "left")
    cap = F.create_map(*[F.lit(x) for kv in SIZE_CAPS.items() for x in kv])[F.col("language")]
    bad = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8").when(F.col("length") > F.coalesce(cap, F.lit(10 << 20)), "too large")
    named = named.withColumn("reason", bad)
    files = named.where("reason is null").select(F.xxhash64("path").alias("file_id"), "path", "language", F.decode("content", "UTF-8").alias("source"))
    return files, named.where("reason is not null").select("path", "language", "length", "reason")


def archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, path, content) of every member file of zip, tar and tar.gz archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for member, content in members(raw):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([content], pa.binary())], ["archive", "path", "content"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    return raw.mapInArrow(run, "archive string, path string, content binary")


def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        return
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())


def upload(encoded: DataFrame, column: str = "data") -> DataFrame:
    """base64 text decoded to source text."""
    return encoded.withColumn("source", F.decode(F.unbase64(column), "UTF-8"))


def embedded(files: DataFrame, pattern: str, group: int = 1, text_col: str = "source") -> DataFrame:
    """A row for each match of a snippet pattern: number, snippet and 1-based first line of the match."""
    before = F.split(F.col(text_col), pattern)
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(group))
    lines = lambda c: F.regexp_count(c, F.lit("\n"))
    out = files.withColumns({"_b": before, "_f": found, "_i": inner})
    out = out.select("*", F.posexplode("_i").alias("ordinal", "snippet"))
    upto = F.aggregate(F.slice("_b", F.lit(1), F.col("ordinal") + 1), F.lit(0), lambda a, x: a + lines(x)) + F.aggregate(F.slice("_f", F.lit(1), F.col("ordinal")), F.lit(0), lambda a, x: a + lines(x))
    return out.withColumn("start_line", upto + 1).drop("_b", "_f", "_i")
