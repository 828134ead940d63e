"""Byte-level BPE as a monoid: encode halves, join neighbours, decode up the tree.

Encodings form a monoid under `join`. A token row is the encoding of its bytes exactly
when every two adjacent tokens are *compatible*, that is when encoding the two tokens'
joint bytes gives back the two (lowest-rank-first merging never crosses a boundary
between compatible tokens). `join` therefore re-encodes a window around the seam, grown
on the side that is not yet stable, until the tokens outside are compatible with the
window's ends: from there on nothing outside can change.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: White space as the vocabulary's pattern counts it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class TreeCodec:
    """Encoder and decoder for a file of ranks; all memories are bounded by `most` entries."""

    LEAF = 8
    DECODE_LEAF = 1024

    def __init__(self, path: str, pattern: str, most: int = 300_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        # runs of text between white space, each with the one blank before it: no match of the pattern crosses their ends
        self.fragments = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.most = most
        self.leaves: dict[bytes, list[int]] = {}
        self.seams: dict[tuple[int, int], list[int]] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Encoding of a short byte string: lowest rank first, leftmost among equals."""
        if len(piece) > 128:
            return self.merge_long(piece)
        ranks, none = self.ranks, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := min(scores)) < none:
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            scores.pop(i)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for windows of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not live[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            live[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def seam(self, a: int, b: int) -> list[int]:
        """Encoding of two tokens' joint bytes."""
        found = self.seams.get((a, b))
        if found is None:
            if len(self.seams) >= self.most // 2:
                self.seams.clear()
            found = self.seams[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return found

    def compatible(self, a: int, b: int) -> bool:
        return self.seam(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: encoding of the joint bytes of two encodings."""
        if not left or not right:
            return left or right
        mid = self.seam(left[-1], right[0])
        i = j = 1
        while True:
            stable_left = i == len(left) or self.compatible(left[-i - 1], mid[0])
            stable_right = j == len(right) or self.compatible(mid[-1], right[j])
            if stable_left and stable_right:
                return left[: len(left) - i] + mid + right[j:]
            if not stable_left:
                i = min(len(left), 2 * i)
            if not stable_right:
                j = min(len(right), 2 * j)
            mid = self.merge(b"".join(map(self.tokens.__getitem__, left[len(left) - i :] + right[:j])))

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Tree reduction over halves."""
        if len(piece) <= self.LEAF:
            found = self.leaves.get(piece)
            if found is None:
                if len(self.leaves) >= self.most // 2:
                    self.leaves.clear()
                found = self.leaves[piece] = self.merge(piece)
            return found
        half = len(piece) // 2
        return self.join(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def encode_fragment(self, fragment: str) -> bytes:
        ids: list[int] = []
        for match in self.pattern.findall(fragment):
            raw = match.encode()
            rank = self.ranks.get(raw)
            ids += [rank] if rank is not None else self.encode_bytes(raw)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        known = self.known
        out = []
        for f in self.fragments.findall(text):
            got = known.get(f)
            if got is None:
                got = self.encode_fragment(f)
                if len(f) <= 64 and len(known) < self.most:
                    known[f] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Concatenation up the tree over halves of the ids."""
        return self._decode(np.frombuffer(ids, "<u4").tolist())

    def _decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self._decode(ids[:half]) + self._decode(ids[half:])


_codecs: dict[tuple[str, str], TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """One per Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TreeCodec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_tokens, ids`` of every row; ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; repeated rows are encoded each for itself; an empty table
    gives no rows. Strings of special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for whole in batches:
            for batch in slices(whole, 1):
                ids = [c.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["_id", "n_tokens", "ids"])

    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, n_tokens long, ids binary").withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids") -> DataFrame:
    """All columns plus ``decoded``, the bytes of the ids (null ids: null)."""

    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for whole in batches:
            at = whole.schema.get_field_index(ids_col)
            for batch in slices(whole, at):
                raw = pa.array([None if x is None else c.decode(x) for x in batch.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decode_documents(encode_documents(docs))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
