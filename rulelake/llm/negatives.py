"""Hard negatives by product quantisation with stored residual norms.

Vectors are whole numbers. A row is kept as the numbers of its nearest centroids (one for each pair of
components), the norm of what they leave over, and the vector itself. For an anchor, a table of its
products with every centroid turns a row's codes into an approximate score, and by Cauchy and Schwarz the
true score lies within the anchor's norm times the row's residual norm of it. Rows whose interval cannot
reach an anchor's window, or cannot be among the first in it, are left out for certain; the others are
scored exactly, so the result is that of scoring every row.

Rows of one vector and label form a class, of which only as many ids are kept as can ever be returned,
so thousands of copies cost one row. Classes are written in blocks, anchors in blocks of their own; each
group of row blocks meets every anchor block once and answers it with its first rows for each window, and
the answers of all groups are merged by anchor block. Nothing is gathered on the driver but counts and the
rows to fit the centroids on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import _runs
from .common import give_back, materialize, release

#: Components that share a centroid, and centroids for each such place.
WIDTH, CENTROIDS = 2, 256
#: Classes of one row block, anchors of one anchor block, and row blocks that a task holds at once (fewer while there are under LEAST_GROUPS groups).
ROW_BLOCK, ANCHOR_BLOCK, GROUP_BLOCKS, LEAST_GROUPS = 4096, 256, 8, 12
#: Anchors whose tables are looked up side by side.
SIDE_BY_SIDE = 16
#: Parts that the copies of one vector are dealt to before they are put together.
SALTS = 16


def fit(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Whole-number centroids (places, CENTROIDS, WIDTH) by Lloyd's rounds on each pair of components."""
    n, d = sample.shape
    out = np.zeros((d // WIDTH, CENTROIDS, WIDTH))
    for p in range(d // WIDTH):
        x = sample[:, p * WIDTH : (p + 1) * WIDTH].astype(np.float64)
        u = np.unique(x, axis=0)
        c = u[np.linspace(0, len(u) - 1, CENTROIDS).astype(np.int64)] if len(u) else np.zeros((CENTROIDS, WIDTH))
        if len(u) > CENTROIDS:
            for _ in range(rounds):
                near = nearest(x, c)
                sizes = np.bincount(near, minlength=CENTROIDS)
                sums = np.stack([np.bincount(near, x[:, k], CENTROIDS) for k in range(WIDTH)], 1)
                c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
        out[p] = np.rint(c)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the first of equals."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def encode(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of each place and row, residual norms, never too small)."""
    codes = np.empty((len(centroids), len(vectors)), np.uint8)
    left = np.zeros(len(vectors))
    for p, c in enumerate(centroids):
        x = vectors[:, p * WIDTH : (p + 1) * WIDTH].astype(np.float64)
        codes[p] = nearest(x, c)
        left += ((x - c[codes[p]]) ** 2).sum(1)
    return codes, np.sqrt(left) * (1 + 1e-9)


def bounds(anchors: np.ndarray, norms: np.ndarray, codes: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(approximate scores, greatest errors) of anchors x rows by lookup tables; codes are indices (places, rows)."""
    approx = np.zeros((codes.shape[1], len(anchors)))
    row = np.empty_like(approx)
    for p, c in enumerate(centroids):
        np.take(c @ anchors[:, p * WIDTH : (p + 1) * WIDTH].T, codes[p], axis=0, out=row, mode="clip")
        approx += row
    longest = np.sqrt((centroids**2).sum(2).max(1).sum())
    # the second term covers the rounding of sums of doubles, some 1e-14 of the lengths' product
    return np.ascontiguousarray(approx.T), norms[:, None] * left[None, :] + (1e-12 * longest * norms)[:, None]


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


class Rows:
    """A group of row blocks: classes in order of their labels, with their codes, norms, vectors and ids."""

    def __init__(self, rows: list[tuple], dims: int, centroids: np.ndarray):
        labels, vectors, codes, left, sizes, ids = ([np.frombuffer(r[k], t) for r in rows] for k, t in zip(range(6), ("<i8", "<i4", np.uint8, "<f8", "<i4", "<i8")))
        label = np.concatenate(labels)
        order = np.argsort(label, kind="stable")
        self.labels = label[order]
        self.vectors = np.concatenate(vectors).reshape(-1, dims)[order]
        self.codes = np.concatenate([c.reshape(len(centroids), -1) for c in codes], 1)[:, order].astype(np.intp)
        self.left = np.concatenate(left)[order]
        size, every = np.concatenate(sizes), np.concatenate(ids)
        start = np.cumsum(size) - size
        self.start, self.size, self.ids = start[order], size[order], every
        self.centroids = centroids

    def of(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.int64) @ anchor.astype(np.int64)

    def first(self, at: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the first rows of classes: by score, the highest first, then by id."""
        size = self.size[at]
        which = np.repeat(np.arange(len(at)), size)
        ids = self.ids[self.start[at][which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)]
        scores = scores[which]
        best = np.lexsort((ids, -scores))[:most]
        return ids[best], scores[best]


def nearest_same(rows: Rows, anchor: np.ndarray, approx: np.ndarray, error: np.ndarray, base: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `most` rows among candidates, given their bounds: those that may reach the most-th greatest lower bound."""
    if len(approx) > most:
        low = approx - error
        bar = np.partition(low, len(low) - most)[len(low) - most]
        at = np.flatnonzero(approx + error >= bar)
    else:
        at = np.arange(len(approx))
    at = at + base
    return rows.first(at, rows.exact(anchor, at), most)


def in_windows(rows: Rows, anchor: np.ndarray, own: slice, approx: np.ndarray, error: np.ndarray, tops: np.ndarray, low: int, high: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score p, the first `most` rows of other labels with low * p <= 100 * score <= high * p."""
    least, greatest = approx - error, approx + error
    marked, wanted = np.zeros(len(approx), bool), []
    for p in tops.tolist():
        if low * p > high * p:  # a negative score: the window is empty
            continue
        a, b = low * p / 100, high * p / 100
        slack = 1e-9 * (abs(p) + 1)
        maybe = (greatest >= a - slack) & (least <= b + slack)
        maybe[own] = False
        at = np.flatnonzero(maybe)
        sure = least[at][(least[at] >= a + slack) & (greatest[at] <= b - slack)]
        if len(sure) > most:
            at = at[greatest[at] >= np.partition(sure, len(sure) - most)[len(sure) - most]]
        marked[at] = True
    at = np.flatnonzero(marked)
    scores = rows.exact(anchor, at)
    for p in tops.tolist():
        fit_ = (low * p <= 100 * scores) & (100 * scores <= high * p)
        wanted.append(rows.first(at[fit_], scores[fit_], most))
    return wanted


def _grouped(blocks: DataFrame, n_blocks: int, tasks: int, anchors: DataFrame, run, schema: str) -> DataFrame:
    """run(row blocks of a group, anchor block) for every pair; anchor blocks are copied to each group, row blocks never.

    A block's number is that of its task in the high and of its place in the low bits; place * tasks + task has few gaps,
    so groups are near equal.
    """
    groups = max(1, math.ceil(n_blocks / GROUP_BLOCKS), min(n_blocks, LEAST_GROUPS))
    number = F.shiftright("block", 24) + F.col("block").bitwiseAND(F.lit((1 << 24) - 1)) * tasks
    filled = [c for c in blocks.columns if c != "block"]
    more = [c for c in anchors.columns if c not in ("block", *filled)]
    mine = blocks.select(F.pmod(number, F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "block", *filled, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in more])
    theirs = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *[c if c in anchors.columns else F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ["block", *filled, *more]])
    return mine.unionByName(theirs).repartition(2 * groups, "group").sortWithinPartitions("group", "kind", "block").mapInArrow(run, schema)


class Miner:
    """Rows of whole-number vectors, made ready once for many anchors."""

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float, keep: int, fit_rows: int):
        whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
        v = F.col(f"`{vector_col}`")
        good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        fit_for = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & good)
        self.slim = fit_for.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(v, whole).alias("v"))
        n, dims, greatest = self.slim.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))).first()
        self.n, self.dims = n, max(WIDTH, math.ceil((dims or 0) / WIDTH) * WIDTH)
        if n and (greatest >= 2**31 or greatest * greatest * self.dims >= 2**62):
            raise ValueError(f"a component of {greatest:.0f} is too large for whole-number scores of 64 bits")
        self.keep = keep
        self.packed = self.slim.mapInArrow(self._vectors(), "id long, label long, v binary")
        classes = self._classes()
        sample = [r.v for r in classes.orderBy(F.xxhash64("v"), "v").select("v").limit(fit_rows).collect()] if n else []
        self.centroids = fit(np.frombuffer(b"".join(sample), "<i4").reshape(-1, self.dims))
        self.blocks = materialize(classes.mapInArrow(self._encoded(), "block long, labels binary, vectors binary, codes binary, lefts binary, sizes binary, ids binary"), "pq-blocks")
        self.tasks = max(1, classes.rdd.getNumPartitions())
        release(classes)
        self.n_blocks = self.blocks.count()

    def _vectors(self):
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                out = np.zeros((batch.num_rows, dims), "<i4")
                out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in out], pa.binary())], ["id", "label", "v"])

        return run

    def _classes(self) -> DataFrame:
        """(v, label, ids): the first `keep` ids of each vector and label. Each task sends no more than so many of a class and
        part, and of a class no more than SALTS times as many meet, however often a vector repeats."""
        salted = self.packed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        order = Window.partitionBy("v", "label", "salt").orderBy("id")
        some = salted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.keep)
        return materialize(some.groupBy("v", "label").agg(F.slice(F.sort_array(F.collect_list("id")), 1, self.keep).alias("ids")), "pq-classes")

    def _encoded(self):
        dims, centroids = self.dims, self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for n, batch in enumerate(b.slice(k, ROW_BLOCK) for b in batches for k in range(0, b.num_rows, ROW_BLOCK)):
                vectors = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, dims)
                codes, left = encode(vectors, centroids)
                ids = batch.column(2)
                data = _pack(batch.column(1).to_numpy().astype("<i8"), vectors, codes, left.astype("<f8"), np.diff(ids.offsets.to_numpy()).astype("<i4"), ids.flatten().to_numpy().astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([_block_number(n)], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], ["block", "labels", "vectors", "codes", "lefts", "sizes", "ids"])

        return run

    def anchor_blocks(self, anchors: Column) -> DataFrame:
        """(block, own_ids, labels, vectors) of the rows that are anchors (a Column over id and label)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for n, batch in enumerate(b.slice(k, ANCHOR_BLOCK) for b in batches for k in range(0, b.num_rows, ANCHOR_BLOCK)):
                ids, labels = (batch.column(k).to_numpy().astype("<i8").tobytes() for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([_block_number(n)], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids, labels, b"".join(batch.column(2).to_pylist())))], ["block", "own_ids", "labels", "vectors"])

        chosen = self.packed.where(anchors)
        parts = max(1, math.ceil(self.n / 50 / (8 * ANCHOR_BLOCK)))
        return materialize(chosen.repartition(parts, F.xxhash64("id", "v")).mapInArrow(run, "block long, own_ids binary, labels binary, vectors binary"), "pq-anchors")

    def meet(self, anchors: DataFrame, answer, schema: str) -> DataFrame:
        """answer(rows, block, ids, labels, vectors, more columns) of every group of row blocks for every anchor block."""
        dims, centroids = self.dims, self.centroids
        filled = [c for c in self.blocks.columns if c != "block"]
        more = [c for c in anchors.columns if c not in ("block", "labels", "vectors")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held, rows = None, [], None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["group"] != group:
                        group, held, rows = r["group"], [], None
                    if r["kind"] == 0:
                        held.append([r[c] for c in filled])
                        continue
                    if rows is None and held:
                        rows, held = Rows(held, dims, centroids), []
                    if rows is not None:
                        labels, vectors = np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["vectors"], "<i4").reshape(-1, dims)
                        yield answer(rows, r["block"], labels, vectors, [r[c] for c in more])
            rows = None
            give_back()

        return _grouped(self.blocks, self.n_blocks, self.tasks, anchors, run, schema)


def _block_number(n: int) -> int:
    return (TaskContext.get().partitionId() << 24) + n


def _message(block: int, owner: list, ids: list, scores: list) -> pa.RecordBatch:
    join = lambda xs, t: np.concatenate(xs).astype(t).tobytes() if xs else b""
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (join(owner, "<i4"), join(ids, "<i8"), join(scores, "<i8")))], ["block", "owners", "ids", "scores"])


MESSAGE = "block long, owners binary, ids binary, scores binary"


def _sides(rows: Rows, vectors: np.ndarray, labels: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, slice]]:
    """(anchor, approximate scores, errors, own label's rows) of each anchor, for the rows of its label or for all."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    order = np.argsort(labels, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(labels[order])) + 1, len(order)) if same else [len(order)]
    low = 0
    for high in cuts:
        part = rows.of(int(labels[order[low]])) if same and len(order) else slice(0, len(rows.labels))
        for k in range(low, high, SIDE_BY_SIDE):
            some = order[k : min(k + SIDE_BY_SIDE, high)]
            approx, error = bounds(vectors[some].astype(np.float64), norms[some], rows.codes[:, part], rows.left[part], rows.centroids)
            for a, x, e in zip(some.tolist(), approx, error):
                yield a, x, e, part if same else rows.of(int(labels[a]))
        low = high


def _merged(messages: DataFrame, tasks: int, use, schema: str) -> DataFrame:
    """use(block, own ids, owners, ids, scores) for each anchor block with all answers to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _runs(batches):
            head = rows[0]
            yield use(block, head[4:], *(np.concatenate([np.frombuffer(r[k], t) for r in rows[1:]] or [np.empty(0, t)]) for k, t in ((1, "<i4"), (2, "<i8"), (3, "<i8"))))
            give_back()

    return messages.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def _best(owners: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, rank from 0, id, score) of the first `most` of every owner."""
    order = np.lexsort((ids, -scores, owners))
    owners, ids, scores = owners[order], ids[order], scores[order]
    rank = np.arange(len(owners)) - np.searchsorted(owners, owners, "left")
    keep = rank < most
    return owners[keep], rank[keep], ids[keep], scores[keep]


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, fit_rows: int = 8192) -> DataFrame:
    """Hard negatives of anchors: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row's score is the inner product of its vector with the anchor's, each component x being floor(scale * x); of
    equal scores the smaller id comes first. An anchor's positives are its first n_positives other rows of its
    label; for each, the first n_negatives rows of other labels whose score lies from low to high per cent of the positive's
    are returned (of a negative score: none). `anchors` is a condition on the columns id and label.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count
    as filled up with zeros. Repeated rows are rows of their own (a repeated anchor has its copies among its positives,
    and its results once for each copy). Ids and labels are whole numbers. Components that would let a score pass 64 bits are an error.
    Centroids are fitted on at most `fit_rows` vectors, those of the least hashes; the result does not depend on them.
    """
    spark = rows.sparkSession
    miner = Miner(rows, id_col, vector_col, label_col, scale, max(n_positives + 1, n_negatives), fit_rows)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not miner.n:
        return spark.createDataFrame([], names)
    asked = miner.anchor_blocks(anchors)
    n_anchor_blocks = max(1, asked.count())

    def same(rows: Rows, block: int, labels: np.ndarray, vectors: np.ndarray, more: list) -> pa.RecordBatch:
        owner, ids, scores = [], [], []
        for a, approx, error, part in _sides(rows, vectors, labels, True):
            got, score = nearest_same(rows, vectors[a], approx, error, part.start, n_positives + 1)
            owner.append(np.full(len(got), a)), ids.append(got), scores.append(score)
        return _message(block, owner, ids, scores)

    def positives(block: int, head: list, owners: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        own, labels, vectors = head
        mine_ = np.frombuffer(own, "<i8")
        owners, _, ids, scores = _best(owners, ids, scores, n_positives + 1)
        itself = ids == mine_[owners]
        first = itself & (np.cumsum(itself) - itself == (np.cumsum(itself) - itself)[np.searchsorted(owners, owners, "left")])  # of copies of an anchor one is itself
        owners, _, ids, scores = _best(owners[~first], ids[~first], scores[~first], n_positives)
        data = (own, labels, vectors, *_pack(owners.astype("<i4"), ids.astype("<i8"), scores.astype("<i8")))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], ["block", "own_ids", "labels", "vectors", "owners", "positives", "tops"])

    def windows(rows: Rows, block: int, labels: np.ndarray, vectors: np.ndarray, more: list) -> pa.RecordBatch:
        owners, tops = np.frombuffer(more[1], "<i4"), np.frombuffer(more[3], "<i8")
        owner, ids, scores = [], [], []
        for a, approx, error, own in _sides(rows, vectors, labels, False):
            here = slice(int(np.searchsorted(owners, a, "left")), int(np.searchsorted(owners, a, "right")))
            for k, (got, score) in enumerate(in_windows(rows, vectors[a], own, approx, error, tops[here], low, high, n_negatives)):
                owner.append(np.full(len(got), here.start + k)), ids.append(got), scores.append(score)
        return _message(block, owner, ids, scores)

    def results(block: int, head: list, owners: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        own, of, pos, tops = (np.frombuffer(x, t) for x, t in zip(head, ("<i8", "<i4", "<i8", "<i8")))
        at, rank, ids, scores = _best(owners, ids, scores, n_negatives)
        cols = (own[of[at]], pos[at], (rank + 1).astype(np.int32), ids, tops[at], scores)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    def with_heads(messages: DataFrame, heads: DataFrame, cols: list[str]) -> DataFrame:
        nulls = [F.lit(None).cast("binary").alias(c) for c in ("owners", "ids", "scores")]
        top = heads.select("block", F.lit(0).alias("kind"), *nulls, *[F.col(c).alias(f"_{c}") for c in cols])
        return top.unionByName(messages.select("block", F.lit(1).alias("kind"), "owners", "ids", "scores", *[F.lit(None).cast("binary").alias(f"_{c}") for c in cols]))

    found = with_heads(miner.meet(asked, same, MESSAGE), asked, ["own_ids", "labels", "vectors"])
    known = materialize(_merged(found, n_anchor_blocks, positives, "block long, own_ids binary, labels binary, vectors binary, owners binary, positives binary, tops binary"), "pq-positives")
    release(asked)
    found = with_heads(miner.meet(known, windows, MESSAGE), known, ["own_ids", "owners", "positives", "tops"])
    return _merged(found, n_anchor_blocks, results, names)


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; of every seventh the label is first moved on by one of ten."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 50 == 0)


OP13_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_sum([a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)])::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select * from (select anchor_id, id, score, row_number() over (partition by anchor_id order by score desc, id) as n from s where same) where n <= 5),
w as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as n
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, n::int as rank, negative_id, positive_score, negative_score from w where n <= 3"""
