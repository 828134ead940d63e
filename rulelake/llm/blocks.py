"""Documents in blocks of a few MB, integer arrays in few bytes, and counts of keys over all blocks.

A block is one row of a written table, so no split ever cuts it: whatever is worked out
from a block twice comes out in the same order, and answers to a block's questions can be
sent as bare counts in the order of the questions.

Counting goes in three steps. ask() sends each block's distinct keys with the block's own
counts to ranges of the key space, answer() adds up a range over all blocks and replies to
each, and meet() brings a block and its replies together. A message holds at least one key,
so there are never more messages than a groupBy of the keys would shuffle rows; with parts of
PART_BYTES of text a message of a 30 GB corpus still holds some hundred keys.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, slices

#: Bytes of text whose keys one range of the key space should hold.
PART_BYTES = 12 << 20


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an integer array, planes of equal significance together, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def expand(raw: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def write_block(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue()


def read_block(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def write_blocks(slim: DataFrame, text_at: int, block_bytes: int, name: str) -> DataFrame:
    """Table of (block, data): slim's rows in blocks of about `block_bytes` of the binary column number `text_at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def leave():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([write_block(whole)], pa.binary())], ["block", "data"])

        for whole in batches:
            for batch in slices(whole, text_at, block_bytes):
                size += batch.column(text_at).nbytes
                held.append(batch)
                if size >= block_bytes // 2:
                    yield leave()
                    k, held, size = k + 1, [], 0
        if held:
            yield leave()
        held.clear()
        give_back()

    return materialize(slim.mapInArrow(run, "block long, data binary"), name)


def n_parts(size: int) -> int:
    """Ranges of the key space for a corpus of so many bytes."""
    return max(4, math.ceil(size / PART_BYTES))


def key_bits(size: int, room: int = 10) -> int:
    """Bits of a hash at which a key of a corpus of `size` bytes shares its bits with another by a chance of 2^-room or less."""
    return min(63, max(40, math.ceil(math.log2(size / 5 + 1)) + room))


def ask(blocks: DataFrame, questions: Callable[[bytes], list[tuple[np.ndarray, np.ndarray]]], parts: int, bits: list[int]) -> DataFrame:
    """Messages (slot, block, keys, own). questions(data) gives, for each order of keys, a block's ascending distinct
    keys of bits[order] bits and its own counts of them; slot = order * parts + range of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for name, raw in zip(whole.column(0).to_pylist(), whole.column(1)):
                for order, (keys, own) in enumerate(questions(raw.as_py())):
                    part = ((keys >> np.uint64(bits[order] - 32)) * np.uint64(parts)) >> np.uint64(32)
                    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(keys)) if len(keys) else np.empty(0, np.int64)
                    cuts = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends)]
                    slots = [order * parts + int(part[c.start]) for c in cuts]
                    data = [squeeze(np.diff(keys[c], prepend=np.uint64(0))) for c in cuts]
                    counts = [squeeze(own[c].astype(np.uint32)) for c in cuts]
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([name] * len(cuts), pa.int64()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], ["slot", "block", "keys", "own"])
                give_back()

    return blocks.mapInArrow(run, "slot int, block long, keys binary, own binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches, gathered by their first column."""
    now, rows = None, []
    for batch in batches:
        for first, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if first != now and rows:
                yield now, rows
                rows = []
            now = first
            rows.append(row)
    if rows:
        yield now, rows


def answer(messages: DataFrame, slots: int, kind=np.uint64) -> DataFrame:
    """Replies (block, slot, data, types, total): the corpus counts of a message's keys as `kind`, cut off at its greatest
    value, in the order of the keys. One reply of each slot has the number of keys with a count and the sum of all counts."""
    most = np.iinfo(kind).max

    def reply(slot: int, rows: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(expand(k, np.uint64), dtype=np.uint64) for _, k, _ in rows]
        ends = np.cumsum([len(k) for k in keys])
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.zeros(len(u), np.uint64)
        for (_, _, own), end, k in zip(rows, ends, keys):
            counts[inverse[end - len(k) : end]] += expand(own, np.uint32)  # a message's keys are distinct
        data = [squeeze(np.minimum(counts[inverse[end - len(k) : end]], np.uint64(most)).astype(kind)) for end, k in zip(ends, keys)]
        n = len(rows)
        sums = [[int((counts > 0).sum())] + [0] * (n - 1), [int(counts.sum())] + [0] * (n - 1)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([slot] * n, pa.int32()), pa.array(data, pa.binary()), *(pa.array(x, pa.int64()) for x in sums)], ["block", "slot", "data", "types", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in _runs(batches):
            yield reply(slot, rows)
            give_back()

    # by the slot itself: of a hash some tasks would get several
    return messages.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot").mapInArrow(run, "block long, slot int, data binary, types long, total long")


def meet(blocks: DataFrame, replies: DataFrame, tasks: int, parts: int, orders: int, kind, use: Callable[[bytes, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """use(data, counts of each order's keys) for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            raw = rows[0][1]  # slot -1 comes first
            counts = [[expand(data, kind) for slot, data in rows[1:] if slot // parts == order] for order in range(orders)]
            yield use(raw, [np.concatenate(c) if c else np.empty(0, kind) for c in counts])
            give_back()

    both = blocks.select("block", F.lit(-1).alias("slot"), "data").unionByName(replies.select("block", "slot", "data"))
    return both.repartition(2 * tasks, "block").sortWithinPartitions("block", "slot").mapInArrow(run, schema)
