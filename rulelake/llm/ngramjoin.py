"""Exact Jaccard self-join of word-shingle sets with prefix filters and prefix trees.

1. Each text becomes a set of 64-bit shingle hashes; equal sets are one node. Texts are
   written in blocks; every block asks in how many sets each of its shingles occurs.
2. Shingles have one global order, by that frequency and then by hash. A set of which under
   `percent` of the shingles occur in others links with nothing and goes no further. Sets of
   Jaccard >= t share a shingle among their rarest n - ceil(t * n) + 1. These prefixes are dealt
   by shingle in packed arrays; each shingle sends its nodes to the bucket of its least node.
   Nodes of one group of copies meet in few buckets, each node once in each.
3. A room's sets are stored in a prefix tree in the global order, frequent shingles first, and
   every set walks it: overlaps are shared along paths, and subtrees are left where what remains
   of the set or of the longest path below cannot reach the overlap that the shortest path needs.
   A bucket of up to `block` nodes is one room. A larger one is cut into rooms of so many, each
   with the bucket's own node as pivot: nodes that come to be connected with the pivot are
   connected with each other whatever their room, so only the loose rest of each room walks the
   other rooms' trees. What leaves a room is one row per node (its least linked node), never a
   row per pair.
4. Components of these links are found by alternating large and small stars on tables.

Shingles and sets are told apart by 64-bit hashes of their content. Questions use only as
many bits of a shingle as keep chance collisions rare; a collision makes a count too high,
which can send a set further than needed and changes the order for all sets alike, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import answer, ask, expand, key_bits, meet, n_parts, read_block, squeeze, write_blocks
from .common import materialize, numbered_words, release, slices, total_bytes

SHINGLE = 5
PERCENT = 75
#: Most nodes of a room.
BLOCK = 1024
#: Parts that the members of a large bucket are dealt to while its size is looked up.
SALTS = 64
BLOCK_BYTES = 5 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; one for the whole sequence where it has fewer words."""
    distinct, at, sizes = numbered_words(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[at]
    mixed = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        mixed += h[i : len(h) - k + 1 + i] * _MIX[i % len(_MIX)] + np.uint64(i)
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX[4]
    mixed ^= mixed >> np.uint64(29)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, n in enumerate(sizes.tolist()):
        if n >= k:
            out.append(np.unique(mixed[starts[i] : starts[i + 1] - k + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[starts[i] : starts[i + 1]].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """The set's 64-bit name, as a signed long."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Trie:
    """Path-compressed prefix tree over sets whose elements are ranks in a shared order."""

    def __init__(self, ranks: list[np.ndarray], lengths: np.ndarray):
        order = sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">u4").tobytes())
        self.order = np.array(order)
        rows = [ranks[i] for i in order]
        n = lengths[self.order]
        # nodes: token slice of a row, tree links, and over the sets below: fewest and most elements, longest path
        self.row, self.start, self.end, self.first, self.last = [], [], [], [], []
        children: list[list[int]] = []
        stack: list[int] = []

        def new(row, start, end, first):
            self.row.append(row)
            self.start.append(start)
            self.end.append(end)
            self.first.append(first)
            self.last.append(first)
            children.append([])
            return len(self.row) - 1

        root = new(0, 0, 0, 0)
        stack = [root]
        for i, r in enumerate(rows):
            if i:
                a = rows[i - 1]
                m = min(len(a), len(r))
                d = np.flatnonzero(a[:m] != r[:m])
                common = int(d[0]) if len(d) else m
            else:
                common = 0
            popped = -1
            while self.end[stack[-1]] > common:
                popped = stack.pop()
                self.last[popped] = i
            top = stack[-1]
            if top != root and not children[top] and self.end[top] == common:  # the last set's path ends where this one goes on
                if self.start[top] < self.end[top]:
                    mid = new(self.row[top], self.start[top], common, self.first[top])
                    children[stack[-2]][-1] = mid
                    children[mid].append(top)
                    self.start[top] = common
                    stack.insert(-1, mid)
                self.last[stack.pop()] = i
                top = stack[-1]
            if popped >= 0 and self.end[top] < common:
                mid = new(self.row[popped], self.end[top], common, self.first[popped])
                self.start[popped] = common
                children[top][-1] = mid
                children[mid].append(popped)
                stack.append(mid)
                top = mid
            leaf = new(i, common, len(r), i)
            children[top].append(leaf)
            stack.append(leaf)
        for s in stack:
            self.last[s] = len(rows)
        self.first, self.last = np.array(self.first), np.array(self.last)
        row, start, end = np.array(self.row), np.array(self.start), np.array(self.end)
        sizes = np.array([len(r) for r in rows])
        offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.tokens = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        self.at, self.size, self.depth = offsets[row] + start, end - start, end
        self.least = np.array([n[f:t].min() for f, t in zip(self.first, self.last)])
        self.most = np.array([n[f:t].max() for f, t in zip(self.first, self.last)])
        self.longest = np.array([sizes[f:t].max() for f, t in zip(self.first, self.last)])
        self.below = np.concatenate([np.array(c, np.int64) for c in children]) if len(children) > 1 else np.empty(0, np.int64)
        counts = np.array([len(c) for c in children])
        self.below_at = np.concatenate([[0], np.cumsum(counts)])
        self.leaf = counts == 0
        self.n = n

    def linked(self, x: np.ndarray, nx: int, flags: np.ndarray, percent: int) -> np.ndarray:
        """Numbers (as given to the constructor) of all stored sets at Jaccard >= percent with x."""
        flags[x] = True
        found = []
        nodes, shared = self.below[self.below_at[0] : self.below_at[1]], np.zeros(self.below_at[1], np.int64)
        while len(nodes):
            size = self.size[nodes]
            ends = np.cumsum(size)
            hits = np.zeros(len(nodes) + 1, np.int64)
            if ends[-1]:
                tokens = self.tokens[np.repeat(self.at[nodes] - (ends - size), size) + np.arange(ends[-1])]
                inside = np.concatenate([[0], np.cumsum(flags[tokens])])
                shared = shared + inside[ends] - inside[ends - size]
                lasts = tokens[np.maximum(ends - 1, 0)]
                left = np.where(size > 0, len(x) - np.searchsorted(x, lasts, "right"), len(x) - shared)
            else:
                left = len(x) - shared
            reach = shared + np.minimum(left, self.longest[nodes] - self.depth[nodes])
            alive = (100 + percent) * reach >= percent * (nx + self.least[nodes])
            alive &= 100 * self.most[nodes] >= percent * nx
            alive &= 100 * nx >= percent * self.least[nodes]
            nodes, shared = nodes[alive], shared[alive]
            leaf = self.leaf[nodes]
            if leaf.any():
                k = self.first[nodes[leaf]]
                ok = (100 + percent) * shared[leaf] >= percent * (nx + self.n[k])
                found.append(self.order[k[ok]])
            nodes, shared = nodes[~leaf], shared[~leaf]
            if not len(nodes):
                break
            a, b = self.below_at[nodes], self.below_at[nodes + 1]
            c = np.cumsum(b - a)
            shared = np.repeat(shared, b - a)
            nodes = self.below[np.repeat(a - (c - (b - a)), b - a) + np.arange(c[-1])]
        flags[x] = False
        return np.concatenate(found) if found else np.empty(0, np.int64)


class Forest:
    """Union-find; a root is the least of its set."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def link_room(nodes: np.ndarray, lengths: np.ndarray, sets: list[np.ndarray], often: list[np.ndarray], asking: np.ndarray | None, percent: int) -> np.ndarray:
    """For each of some ascending nodes, the place of the least one it is linked with in this room, itself included.

    sets: the shingles of each that occur elsewhere, with their corpus frequencies in `often`; lengths: of the whole
    sets. Where `asking` is given, its nodes walk a tree of the others; otherwise all walk a tree of all.
    """
    forest = Forest(len(nodes))
    tokens, first, inverse = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    rank = np.empty(len(tokens), np.uint32)
    rank[np.lexsort((tokens, -np.concatenate(often)[first].astype(np.int64)))] = np.arange(len(tokens), dtype=np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    ranks = [np.sort(rank[inverse[e - len(s) : e]]) for e, s in zip(ends, sets)]
    flags = np.zeros(len(tokens) + 1, bool)
    stored = np.arange(len(sets)) if asking is None else np.flatnonzero(~asking)
    if len(stored):
        trie = Trie([ranks[i] for i in stored], lengths[stored])
        for i in stored if asking is None else np.flatnonzero(asking):
            for j in stored[trie.linked(ranks[i], int(lengths[i]), flags, percent)]:
                forest.union(int(i), int(j))
    return np.array([forest.root(i) for i in range(len(nodes))])


def _pack(tokens: np.ndarray, nodes: np.ndarray) -> bytes:
    o = np.argsort(tokens, kind="stable")
    t = tokens[o]
    return zstandard.ZstdCompressor(1).compress(np.uint32(len(o)).tobytes() + np.diff(t, prepend=np.uint32(0)).tobytes() + nodes[o].tobytes())


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.uint32), np.frombuffer(raw, np.int64, n, 4 + 4 * n)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(node, least): label is the least node of its component.

    Large and small stars in turn, on edges (high, low) in tables of the shared folder: each node's higher
    neighbours are linked to its least neighbour, then its lower ones are. It ends when every node has one
    edge, to a node without a lower neighbour; the number of rounds has no limit and grows with the
    logarithm of a component's size. Nodes whose own least neighbour is themselves, hubs among them, keep their edges
    without a join, and least neighbours are aggregated before the shuffle.
    """
    ends = F.array_sort(F.array("node", "least"))
    edges = materialize(links.where("node != least").select(ends[1].alias("high"), ends[0].alias("low")).distinct(), "star-edges")
    while True:
        below = edges.groupBy("high").agg(F.min("low").alias("least"))  # least neighbour of nodes with a lower one
        large = edges.join(below.toDF("low", "least"), "low", "left").select("high", F.coalesce("least", "low").alias("low"))
        large = materialize(large.distinct(), "star-large")
        release(edges)
        below = large.groupBy("high").agg(F.min("low").alias("least"))
        moved = large.join(below, "high").where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = materialize(below.select("high", F.col("least").alias("low")).unionByName(moved).distinct(), "star-edges")
        release(large)
        twice = edges.groupBy("high").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deep = edges.select("low").distinct().join(edges.select(F.col("high").alias("low")), "low", "left_semi")
        if twice.isEmpty() and deep.isEmpty():
            break
    labels = edges.select(F.col("high").alias("node"), F.col("low").alias("label"))
    labels = labels.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("label")).distinct())
    labels._rulelake_path = edges._rulelake_path
    return labels


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row by its id and text; equal for exact repeats of a row alone."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).cast("string"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, with_keys: bool = False) -> DataFrame:
    """``<id_col>, n_shingles, component_id`` for every row.

    Rows link when 100 * |intersection| >= percent * |union| of their sets; equal sets always do.
    component_id is the smallest id reachable by links. Texts without words, null texts included,
    have an empty set, link with nothing and are components of their own. Rows with a null id take
    part; their component's id is the smallest that is not null, or null. Repeated ids are rows of
    their own. An empty table gives an empty result. with_keys adds ``row_key`` and ``component``,
    a long that names the component also where ids are null (null for empty sets).
    """
    slim = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    _, size = total_bytes(docs, text_col)
    parts, bits = n_parts(size), key_bits(size)
    tasks = max(8, math.ceil(size / (8 << 20)))
    kind = slim.schema["_id"].dataType.simpleString()
    texts = write_blocks(slim, 2, BLOCK_BYTES, "shingle-blocks")

    def load(raw: bytes):
        """A block's rows, their sets and nodes, its distinct sets, and its distinct question keys with how many sets hold each."""
        batch = read_block(raw)
        sets = shingle_sets(batch.column(2), shingle)
        nodes = [node_of(s) for s in sets]
        once = dict(zip(nodes, sets))
        return batch, sets, nodes, once, *np.unique(np.concatenate([*once.values(), np.empty(0, np.uint64)]) >> np.uint64(64 - bits), return_counts=True)

    def questions(raw: bytes):
        *_, keys, counts = load(raw)
        return [(keys, counts)]

    def describe(raw: bytes, counts: list[np.ndarray]) -> pa.RecordBatch:
        batch, sets, nodes, once, keys, _ = load(raw)
        found: dict[int, tuple[bytes, bytes, bytes]] = {}
        for node, s in once.items():
            often = counts[0][np.searchsorted(keys, s >> np.uint64(64 - bits))]
            here = often > 1
            if len(s) and 100 * int(here.sum()) >= percent * len(s):
                common, often = s[here], often[here]
                o = np.lexsort((common, often))  # rare first
                rare = prefix_length(len(s), percent) - (len(s) - len(common))
                found[node] = common[o[: max(0, rare)]].tobytes(), common[o].tobytes(), squeeze(often[o])
        shown = [found.pop(n, (None, None, None)) for n in nodes]  # a node's set once in a block
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in shown], pa.binary()) for k in range(3))],
            ["_id", "_key", "node", "n", "firsts", "shingles", "often"],
        )

    replies = answer(ask(texts, questions, parts, [bits]), parts, np.uint32)
    seen = materialize(meet(texts, replies, tasks, parts, 1, np.uint32, describe, f"_id {kind}, _key string, node long, n long, firsts binary, shingles binary, often binary"), "shingle-nodes")
    release(texts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 16 << 20):
                firsts = [np.frombuffer(f, np.uint64) for f in batch.column(1).to_pylist()]
                t = np.concatenate(firsts)
                names = np.repeat(batch.column(0).to_numpy(), [len(f) for f in firsts])
                part = ((t >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64)
                o = np.argsort(part, kind="stable")
                low, names, part = (t & np.uint64(0xFFFFFFFF)).astype(np.uint32)[o], names[o], part[o]
                cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
                rows = [(int(part[a]), _pack(low[a:b], names[a:b])) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(blobs):
            both = [_unpack(b) for b in blobs]
            t, nodes = np.concatenate([a for a, _ in both]), np.concatenate([b for _, b in both])
            o = np.lexsort((nodes, t))
            t, nodes = t[o], nodes[o]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            group = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]).astype(np.int64)]))
            least = nodes[start]
            lone = np.maximum.reduceat(nodes, start) == least
            keep = ~lone[group]
            both_ = np.unique(np.stack([least[group][keep], nodes[keep]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both_[:, 0]), pa.array(both_[:, 1])], ["bucket", "node"])

        now, blobs = None, []
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != now and blobs:
                    yield pairs(blobs)
                    blobs = []
                now = p
                blobs.append(data)
        if blobs:
            yield pairs(blobs)

    packed = seen.where("firsts is not null").select("node", "firsts").mapInArrow(prefixes, "part int, data binary").repartition(tasks, "part").sortWithinPartitions("part")
    members = materialize(packed.mapInArrow(gather, "bucket long, node long").distinct(), "buckets")
    nodes = seen.groupBy("node").agg(F.min("_id").alias("_least"), F.max("n").alias("n"))
    sets = seen.where("shingles is not null").groupBy("node").agg(F.first(F.struct("n", "shingles", "often")).alias("set")).select("node", "set.*")
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    # only large buckets have a row there; their members are dealt by bucket and one of SALTS numbers
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["bucket", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("bucket", "node", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int").alias("mine"))

    def rooms(who: DataFrame) -> DataFrame:
        """who(node, room, asking, pivot) with the nodes' sets, room by room."""
        return sets.join(who, "node").select("node", "shingles", "n", "often", "room", "asking", "pivot").repartition(tasks, "room").sortWithinPartitions("room")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leave(rows):
            once = {}
            for r in rows:
                once.setdefault(r[0], r)
            rows = [once[k] for k in sorted(once)]
            names = np.array([r[0] for r in rows], np.int64)
            asking = np.array([r[4] for r in rows])
            lengths = np.array([r[2] for r in rows], np.int64)
            least = link_room(names, lengths, [np.frombuffer(r[1], np.uint64) for r in rows], [expand(r[3], np.uint32) for r in rows], asking if asking.any() else None, percent)
            pivot = rows[0][5]
            loose = np.zeros(len(rows), bool) if pivot is None else least != least[np.searchsorted(names, pivot)]
            told = np.flatnonzero((least != np.arange(len(rows))) | loose)
            return names[told], names[least[told]], loose[told]

        now, rows, out = None, [], []
        for batch in batches:
            for slice_ in slices(batch, 1, 16 << 20):
                for node, raw, n, often, room, asking, pivot in zip(*(c.to_pylist() for c in slice_.columns)):
                    if room != now and rows:
                        if len(rows) > 1:
                            out.append(leave(rows))
                        rows = []
                    now = room
                    rows.append((node, raw, n, often, asking, pivot))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "least", "loose"])
                    out = []
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in leave(rows)], ["node", "least", "loose"])

    found = "node long, least long, loose boolean"
    one = dealt.select("node", F.xxhash64("bucket", "mine").alias("room"), F.lit(False).alias("asking"), F.when(F.col("blocks") > 1, F.col("bucket")).alias("pivot"))
    # a bucket's own node is the pivot of each of its rooms
    pivots = sizes.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"))
    one = one.unionByName(pivots.select(F.col("bucket").alias("node"), F.xxhash64("bucket", "mine").alias("room"), F.lit(False).alias("asking"), F.col("bucket").alias("pivot")))
    links = materialize(rooms(one).mapInArrow(walk, found), "room-links")
    many = dealt.where("blocks > 1")
    loose = many.join(links.where("loose").select("node").distinct(), "node", "left_semi").select("bucket", "mine", "node")
    pairs = links.where("node != least").select("node", "least")
    if not links.where("loose").isEmpty():
        # loose nodes of a room walk the trees of the bucket's other rooms
        from_ = loose.select("bucket", F.col("mine").alias("from")).distinct()
        to = from_.join(sizes, "bucket").select("bucket", "from", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine")).where("from != mine")
        stored = many.join(to, ["bucket", "mine"]).select("node", F.xxhash64("bucket", "from", "mine").alias("room"), F.lit(False).alias("asking"))
        walkers = loose.withColumnRenamed("mine", "from").join(to, ["bucket", "from"]).select("node", F.xxhash64("bucket", "from", "mine").alias("room"), F.lit(True).alias("asking"))
        two = stored.unionByName(walkers).withColumn("pivot", F.lit(None).cast("long"))
        pairs = pairs.unionByName(rooms(two).mapInArrow(walk, found).select("node", "least"))
    labels = components(pairs)
    classes = nodes.join(labels, "node", "left").select("node", "n", "_least", F.coalesce("label", "node").alias("label"))
    named = classes.groupBy("label").agg(F.min("_least").alias("component_id"))
    by_node = materialize(classes.where("n > 0").join(named, "label").select("node", "label", "component_id"), "node-components")
    release(members, links, labels)
    out = seen.select("_id", "_key", "node", "n").join(by_node, "node", "left")
    more = [F.col("_key").alias("row_key"), F.col("label").alias("component")] if with_keys else []
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), *more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id, null ids last, and of exact repeats one.

    Rows without words, null texts included, all stay, once each. All columns come back as they were,
    whatever their names; an empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, with_keys=True)
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("row_key")))["row_key"]
    linked = found.where("component is not null").groupBy("component").agg(first.alias("_key")).select("_key")
    keepers = materialize(linked.union(found.where("component is null").select(F.col("row_key").alias("_key"))).distinct(), "keepers")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)], row_key(id_col, text_col).alias("_key"))
    return rows.join(keepers, "_key", "left_semi").dropDuplicates(["_key"]).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
