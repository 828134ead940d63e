"""Power-of-two packing of tokenised documents.

Each document's ids are cut into pieces whose lengths are the binary parts of its
length: as many full sequences of ``max_len`` as fit, then one piece for each bit of
the rest, longest first. Pieces of equal length form a bucket, and a sequence is one
piece of its bucket's length, so sequences need no padding and never cross documents.
Nothing is shuffled: every piece follows from its own document alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_words, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
MAX_LEN = 2048


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return [table[b] for b in range(256)]


class PairTable:
    """Open-addressed numpy table from a pair of symbol numbers to its merge rank and product."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, pairs: np.ndarray, products: np.ndarray):
        self.none = len(pairs)
        self.size = 1 << int(4 * len(pairs)).bit_length()
        keys = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1].astype(np.uint64)
        self.keys = np.full(self.size, self.EMPTY, np.uint64)
        self.values = np.full(self.size, self.none, np.int32)
        self.products = products.astype(np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):
            free = self.keys[slot[left]] == self.EMPTY
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], first
            left = np.setdiff1d(left, first, assume_unique=True)
            slot[left] = (slot[left] + 1) % self.size
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (self.size.bit_length() - 1))).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks, `none` where the pair is not in the list."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], np.int32(self.none))
        open_ = np.flatnonzero((out == self.none) & (self.keys[slot] != self.EMPTY))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % self.size
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (self.keys[slot[open_]] != self.EMPTY)]
        return out


class ChunkEncoder:
    """ids of texts by the vocabulary file, remembered per whitespace-free chunk.

    The tokenizer drops whitespace and no token crosses it, so a text's ids are its chunks'
    ids in a row. Arrow splits a slice of texts and numbers its distinct chunks; only those
    are looked up here. New chunks of plain Latin letters go through the merge list directly,
    all new words of a slice at once; any other chunk (combining marks, other scripts, special-token
    strings, over-long ones) goes through the tokenizers library. The memories are bounded:
    what comes after `most` chunks is worked out again each time.
    """

    #: Letters and numbers below U+0250, where no character combines with another.
    LETTERS, NUMBERS = "a-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
    #: As in the vocabulary file's pre-tokenizer, and the line feed that stands between chunks.
    SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|\n|[^\s{LETTERS}{NUMBERS}]+")
    LONGEST = 40  # under 64: positions take six bits in merge()

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = PairTable(np.array([(vocab[a], vocab[b]) for a, b in pairs]), np.array([vocab[a + b] for a, b in pairs]))
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int32)
        self.most = most
        self.chunks = IdPool()
        self.forget_words()

    def forget_words(self) -> None:
        self.words = IdPool()
        self.words.add(["\n"], np.empty(0, np.uint32), np.zeros(1, np.int64))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words in a row, and each word's number of ids: in every word at once, the lowest-ranked
        pair is merged, the leftmost among equals, until no pair is in the merge list."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(sizes) - sizes
        out, counts = np.empty(len(flat), np.uint32), np.empty(len(raw), np.int64)
        rank, none = self.table.rank, self.table.none
        for n in np.unique(sizes).tolist():
            where = np.flatnonzero(sizes == n)
            letters = flat[starts[where] + np.arange(n)[:, None]]
            ids = self.inner[letters]  # one row a position, one column a word
            ids[-1] = self.last[letters[-1]]
            scores = rank(ids[:-1].ravel(), ids[1:].ravel()).reshape(n - 1, len(where))
            while True:
                k = len(ids)
                # the least rank and, among equals, the least position, in one number
                first = ((scores << 6) | np.arange(k - 1, dtype=np.int32)[:, None]).min(0) if k > 1 else np.full(len(where), none << 6, np.int32)
                low, best = first >> 6, first & 63
                over = low == none
                if over.any():
                    ended = np.flatnonzero(over)
                    counts[where[ended]] = k
                    out[starts[where[ended]] + np.arange(k)[:, None]] = ids[:, ended]
                    on = np.flatnonzero(~over)
                    if not len(on):
                        break
                    where, low, best, ids, scores = where[on], low[on], best[on], ids[:, on], scores[:, on]
                for c in range(k - 1):
                    ids[c] = np.where(c <= best, ids[c], ids[c + 1])
                for c in range(k - 2):
                    scores[c] = np.where(c < best, scores[c], scores[c + 1])
                ids, scores = ids[:-1], scores[:-1]
                ids[best, np.arange(len(best))] = self.table.products[low]
                for shift in (-1, 0):  # the pairs to the left and to the right of what was merged
                    w = np.flatnonzero(best + shift >= 0 if shift else best < k - 2)
                    at = best[w] + shift
                    scores[at, w] = rank(ids[at, w], ids[at + 1, w])
        ends = np.cumsum(counts)
        return out[np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())], counts

    def plain(self, chunks: list[str]) -> np.ndarray:
        """Which of some non-empty chunks are short and of characters below U+0250 that lower() and the merge list treat as the library does."""
        b = np.frombuffer("\n".join(chunks).encode(), np.uint8)
        after = np.append(b[1:], np.uint8(10))
        bad = (b >= 0xCA) | (b < 0x21) & (b != 10) | (b == 0x7F) | (b == 0xC2) & (after <= 0xA0) | (b == 0xC9) & (after >= 0x90) | (b == 0xC4) & (after == 0xB0) | (b == 0xC8) & ((after == 0xBA) | (after == 0xBE)) | (b == 0x3C) & (after == 0x7C)
        ends = np.append(np.flatnonzero(b == 10), len(b))
        starts = np.append(0, ends[:-1] + 1)
        return (np.add.reduceat(bad, starts, dtype=np.int64) == 0) & (ends - starts <= self.LONGEST)

    def add(self, chunks: list[str]) -> None:
        """Remember the ids of new non-empty chunks."""
        if not chunks:
            return
        easy = self.plain(chunks)
        good = list(compress(chunks, easy))
        if good:
            split = self.SPLIT.findall("\n".join(good).lower())
            split.append("\n")
            if len(self.words.place) > self.most:
                self.forget_words()
            new = [w for w in set(split) if w not in self.words.place]
            self.words.add(new, *self.merge(new))
            ids, counts, at = self.words.ids(split)
            self.chunks.add(good, ids, np.add.reduceat(counts, np.append(0, np.flatnonzero(at == 0)[:-1] + 1)))
        hard = list(compress(chunks, ~easy))
        if hard:
            ids = [self.library.encode(c, add_special_tokens=False).ids for c in hard]
            self.chunks.add(hard, np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text begins and ends in it."""
        chunks, at, sizes = numbered_words(texts)
        known = len(self.chunks.place)
        self.add([c for c in chunks if c not in self.chunks.place])
        ids, counts, _ = self.chunks.ids(chunks, at)
        bounds = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(sizes))]
        self.chunks.cut(max(known, self.most))
        return ids, bounds


class IdPool:
    """Strings with their ids, all in one array; strings are numbered in the order they came in."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.pool = np.empty(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Append new distinct keys, their ids in a row and the number of each one's ids."""
        k = len(self.place)
        base = int(self.ends[k])
        while base + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while k + len(keys) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.pool[base : base + len(ids)] = ids
        self.ends[k + 1 : k + 1 + len(keys)] = base + np.cumsum(counts)
        self.place.update(zip(keys, range(k, k + len(keys))))

    def ids(self, keys: list[str], which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a row, number of ids, place) of keys, or of keys[which]."""
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        at = at if which is None else at[which]
        starts = self.ends[at]
        counts = self.ends[at + 1] - starts
        before = np.cumsum(counts) - counts
        return self.pool[np.repeat(starts - before, counts) + np.arange(counts.sum())], counts, at

    def cut(self, most: int) -> None:
        """Forget the keys that came in after the first `most`."""
        while len(self.place) > most:
            self.place.popitem()


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def binary_parts(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and length of every piece of rows of n ids: full sequences, then the bits of the rest from the highest."""
    bits = 1 << np.arange(max_len.bit_length() - 2, -1, -1)
    lengths = np.append(np.int64(max_len), bits)
    times = np.column_stack([n // max_len, (n[:, None] & bits) > 0]).astype(np.int64)
    row = np.repeat(np.arange(len(n)), times.sum(1))
    return row, np.repeat(np.tile(lengths, len(n)), times.ravel())


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and bucket; one row per piece.

    Returns ``<id_col>, start, length, doc_tokens, bucket, ids, sequence_id, offset``: ``ids`` is the
    piece as little-endian unsigned 32-bit integers, ``bucket`` its length's exponent, and each
    sequence is one piece at offset 0. max_len must be a power of two. A null or empty text is the
    one id ``end_id``; repeated rows are packed each for itself; an empty table gives no rows.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                ids, bounds = enc.encode(batch.column(1))
                total = np.diff(bounds) + 1
                ends = np.cumsum(total)
                flat = np.full(ends[-1], end_id, "<u4")
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                row, length = binary_parts(total, max_len)
                at = np.cumsum(length) - length  # pieces follow each other as the ids do
                offsets = np.append(at, len(flat)).astype(np.int32) * 4
                pieces = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                start = at - (ends - total)[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(total[row]), pieces], ["_id", "start", "length", "doc_tokens", "ids"])

    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"_id {kind}, start long, length long, doc_tokens long, ids binary")
    bucket = F.log2(F.col("length").cast("double")).cast("int")
    return out.select(F.col("_id").alias(id_col), "start", "length", "doc_tokens", bucket.alias("bucket"), "ids", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one directory a length, ready to be read as dense batches."""
    packed.write.partitionBy("bucket").parquet(path)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
