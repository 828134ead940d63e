"""A Merkle manifest of a table: one tree for each source, one over the sources' roots, and a proof for every row.

Leaves are hashed by built-in functions and written with their order. The trees are then built in
supersteps over RDDs of runs, a run being the up to 16 children of one node, keyed by (tree, run):
children send their digests to their parent, a parent that has its run hashes it and sends the result on,
and a tree ends with a level of one node. Reverse supersteps open the runs from the roots down: each
sends every child the path above it, so that a path travels once a run and never once a leaf until the
last step, in which leaves are folded along their own paths.

Numbers of leaves inside their source come from a sort by ranges: what the driver sees of it is one
summary a partition. No task holds more than a part of the sorted rows, and no key more than one run.
"""

from __future__ import annotations

import hashlib
import math
import operator
from binascii import hexlify
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

FAN = 16
#: Leaves that one partition of the sort should hold.
ROWS_PER_PART = 100_000


def leaf_text(fields: list[Column]) -> Column:
    """What a leaf hashes: each field as `-` if null, else its UTF-8 byte count, a colon and its text."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.concat(*[one(c) for c in fields])


def digest_of(parts: list[bytes]) -> bytes:
    """sha256 over digests as lower-case hex text, in order."""
    return hashlib.sha256(b"".join(map(hexlify, parts))).digest()


def fold(digest: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a digest leads to along a path of (place in its run, the run's other digests)."""
    for at, others in path:
        digest = digest_of([*others[:at], digest, *others[at:]])
    return digest


def _spread(key: tuple[int, int]) -> int:
    return ((key[0] * 1_000_003 + key[1]) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 24


def _gather(rows: RDD, parts: int) -> RDD:
    """Lists of equal keys put together; what a task has of a key is put together before the exchange."""
    return rows.combineByKey(lambda v: v, operator.iadd, operator.iadd, parts, _spread)


def _lone(key: tuple[int, int], run: list) -> bool:
    """A level of one node: its only run is the first and holds one child."""
    return key[1] == 0 and len(run) == 1


def climb(nodes: RDD, most: int, parts: int) -> tuple[list[RDD], RDD]:
    """(runs of each level, roots) of the trees over nodes ((tree, run), [(place, digest, payload)]); no tree has over `most` nodes.

    Runs are ((tree, run), children in order); roots are (tree, digest). A tree that has come down to one node waits: the
    node is handed on as it is until the last level, so that all trees end there. A tree of one node is its own root.
    """

    def rise(row: tuple) -> tuple:
        (tree, run), children = row
        digest = children[0][1] if _lone((tree, run), children) else digest_of([c[1] for c in children])
        return (tree, run // FAN), [(run % FAN, digest, None)]

    levels = [_gather(nodes, parts).mapValues(sorted_children)]
    for _ in range(max(0, math.ceil(math.log(max(1, most), FAN) - 1e-9))):
        parts = max(1, math.ceil(parts / FAN))
        levels.append(_gather(levels[-1].map(rise), parts).mapValues(sorted_children))
    return levels, levels[-1].map(lambda r: (r[0][0], r[1][0][1]))


def sorted_children(run: list) -> list:
    return sorted(run, key=operator.itemgetter(0))


def descend(levels: list[RDD], starts: RDD) -> RDD:
    """Runs of the lowest level as (key, children, above): what reaches a run is ("above", path, words) with the path over its node.

    starts: (tree, (path over the root, words)); words go along unchanged.
    """
    messages = starts.map(lambda r: ((r[0], 0), [("above", *r[1])]))
    opened = None
    for level in reversed(levels):
        opened = _gather(level.union(messages).coalesce(level.getNumPartitions()), level.getNumPartitions()).map(_opened)
        messages = opened.flatMap(_messages)
    return opened


def _opened(row: tuple) -> tuple:
    key, values = row
    above = next(v for v in values if v[0] == "above")
    return key, sorted_children([v for v in values if v[0] != "above"]), above


def paths_below(key: tuple[int, int], run: list, path: list) -> list[list]:
    """The path over each child of a run: its place and siblings, then what is above the run; a root has no siblings of its own."""
    if _lone(key, run):
        return [path]
    digests = [c[1] for c in run]
    return [[(at, digests[:at] + digests[at + 1 :]), *path] for at in range(len(run))]


def _messages(row: tuple) -> Iterator[tuple]:
    (tree, run), children, (_, path, words) = row
    for at, below in enumerate(paths_below((tree, run), children, path)):
        yield (tree, run * FAN + at), [("above", below, words)]


def _summary(index: int, rows: Iterator) -> Iterator[tuple]:
    """(partition, first source, last source, its rows, most rows of one source, sources) of a sorted partition; nothing if it is empty."""
    first = last = None
    n = most = sources = 0
    for source, *_ in rows:
        if not sources:
            first, last, sources = source, source, 1
        elif source != last:
            last, n, sources = source, 0, sources + 1
        n += 1
        most = max(most, n)
    if sources:
        yield index, first, last, n, most, sources


def _starts(summaries: list[tuple]) -> tuple[dict[int, tuple[int, int]], int, int]:
    """({partition: (number of its first source, rows of that source before it)}, sources, bound on the rows of a source)."""
    out, number, before, last, bound = {}, -1, 0, None, 0
    for index, first, last_here, n, most, sources in sorted(summaries):
        goes_on = bool(out) and first == last
        number += not goes_on
        before = before if goes_on else 0
        out[index] = (number, before)
        bound = max(bound, before + most)
        number += sources - 1
        before = n + (before if sources == 1 else 0)
        last = last_here
    return out, number + 1, bound


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: list[str] | None = None, changed: DataFrame | None = None, found: dict[str, Column] | None = None, proofs: bool = False) -> DataFrame:
    """One row for each row of docs: ``<id_col>, leaf, subroot, root, proof_sha256, folded_root, verified`` (digests as hex text).

    fields: the columns a leaf hashes, in order (default: all of docs). found: for verification, columns as they
    are found now (by name, over docs); a row in which all of them are as recorded folds its recorded leaf. With
    proofs, `proof` is the path itself, array<struct<at, siblings>> from the leaf's run to the root.

    Leaves of a source stand by id, nulls first; rows of one id by their leaf; repeated rows are leaves of their own.
    A null source is a source, the first. A table without rows has no root and gives no row. Ids and fields may be null.
    """
    fields = fields or docs.columns
    now = found or {}
    col = lambda c: F.col(f"`{c}`")
    leaf = F.unhex(F.sha2(leaf_text([col(c) for c in fields]).cast("binary"), 256))
    other = F.unhex(F.sha2(leaf_text([now.get(c, col(c)) for c in fields]).cast("binary"), 256))
    same = F.lit(True)
    for c, v in now.items():
        same = same & v.eqNullSafe(col(c))
    slim = docs.select(col(source_col).cast("string").alias("source"), col(id_col).alias("id"), leaf.alias("leaf"), F.when(~same, other).alias("other"), F.monotonically_increasing_id().alias("row"))
    slim = materialize(slim, "merkle-leaves")  # texts are hashed once; the sort's sample reads digests
    spark, n_rows = docs.sparkSession, slim.count()
    kind = docs.schema[id_col].dataType
    names = [T.StructField(id_col, kind), *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())]
    if proofs:
        names.append(T.StructField("proof", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.StringType()))]))))
    if not n_rows:
        return spark.createDataFrame([], T.StructType(names))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / ROWS_PER_PART))
    order = [F.asc_nulls_first(c) for c in ("source", "id", "leaf", "row")]
    rows = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd
    starts, n_sources, most = _starts(rows.mapPartitionsWithIndex(_summary).collect())

    def number(index: int, part: Iterator) -> Iterator[tuple]:
        """A sorted partition's rows in (pieces of) runs."""
        tree, at, last, key, run = *starts.get(index, (0, 0)), None, None, []
        for k, (source, ident, leaf, other, _) in enumerate(part):
            if k and source != last:
                tree, at = tree + 1, 0
            last = source
            if key != (tree, at // FAN):
                if run:
                    yield key, run
                key, run = (tree, at // FAN), []
            run.append((at % FAN, bytes(leaf), (ident, bytes(other) if other is not None else None)))
            at += 1
        if run:
            yield key, run

    levels, subroots = climb(rows.mapPartitionsWithIndex(number), most, parts)
    tops, root = climb(subroots.map(lambda r: ((0, r[0] // FAN), [(r[0] % FAN, r[1], None)])), n_sources, max(1, math.ceil(n_sources / ROWS_PER_PART)))
    over = descend(tops, root.map(lambda r: (0, ([], r[1]))))

    def to_sources(row: tuple) -> Iterator[tuple]:
        (tree, run), children, (_, path, root) = row
        for (at, subroot, _), below in zip(children, paths_below((tree, run), children, path)):
            yield run * FAN + at, (below, (subroot, root))

    def leaves(row: tuple) -> Iterator[tuple]:
        key, children, (_, path, (subroot, root)) = row
        above = b"".join(hexlify(d) for _, others in path for d in others)  # the same for all of the run
        for (_, leaf, (ident, other)), mine in zip(children, paths_below(key, children, path)):
            own = mine[0][1] if len(mine) > len(path) else []
            folded = fold(other if other is not None else leaf, mine)
            out = (ident, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(b"".join(map(hexlify, own)) + above).hexdigest(), folded.hex(), folded == root)
            yield (*out, [(at, [d.hex() for d in others]) for at, others in mine]) if proofs else out

    return spark.createDataFrame(descend(levels, over.flatMap(to_sources)).flatMap(leaves), T.StructType(names), verifySchema=False)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against texts of which those of every fifth id (by checksum) are lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return manifest(docs, fields=["doc_id", "source", "lang", "n_chars", "text"], found={"text": text})


#: crc(doc_id, hit): whether 5 divides the CRC-32 of an id's decimal text, byte by byte, as DuckDB has no such function.
_CRC_SQL = """ids as (select distinct doc_id, doc_id::varchar as s from documents where doc_id is not null),
bytes(doc_id, s, i, c) as (select doc_id, s, 0, 4294967295::bigint from ids union all
  select doc_id, s, i + 1, list_reduce(list_prepend(xor(c, ascii(s[i + 1]))::bigint, [0::bigint for _ in range(8)]), lambda r, x: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end) from bytes where i < length(s)),
crc as (select doc_id, xor(c, 4294967295) % 5 = 0 as hit from bytes where i = length(s))"""


def op12_sql(levels: int = 6, top_levels: int = 3) -> str:
    """DuckDB SQL: every level spelt out; up to 16^levels rows a source and 16^top_levels sources."""
    one = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: f"sha256({' || '.join(one(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    out = [
        f"d as (select *, translate(text, '{_UPPER}', '{_LOWER}') as low from documents)",
        f"a as (select doc_id, {leaf('text')} as leaf, {leaf('low')} as other, dense_rank() over (order by source nulls first) - 1 as tree from d)",
        "l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from a)",
        "n0 as (select tree, idx, leaf as d from l)",
    ]

    def rise(n: str, r: str, count: int) -> None:
        for k in range(count):
            out.append(f"{r}{k} as (select tree, idx // 16 as run, list(d order by idx) as ds, any_value(c) as c from (select *, count(*) over (partition by tree) as c from {n}{k}) group by tree, idx // 16)")
            out.append(f"{n}{k + 1} as (select tree, run as idx, sha256(array_to_string(ds, '')) as d from {r}{k} where c > 1)")

    rise("n", "r", levels)
    out.append("s as (" + " union all ".join(f"select tree, ds[1] as d from r{k} where c = 1" for k in range(levels)) + ")")
    out.append("u0 as (select 0 as tree, tree as idx, d from s)")
    rise("u", "t", top_levels)
    out.append("root as (" + " union all ".join(f"select ds[1] as d from t{k} where c = 1" for k in range(top_levels)) + ")")
    out.append("p0 as (select l.doc_id, l.leaf, l.tree, l.idx, s.d as subroot, root.d as root, '' as proof, case when crc.hit then l.other else l.leaf end as f from l join s using (tree) cross join root left join crc on crc.doc_id is not distinct from l.doc_id)")
    step = 0
    for r, at, count in (("r", "idx", levels), ("t", "tree", top_levels)):
        tree = "p.tree" if r == "r" else "0"
        for k in range(count):
            place = f"(p.{at} // {16**k}) % 16"
            out.append(
                f"p{step + 1} as (select p.doc_id, p.leaf, p.tree, p.idx, p.subroot, p.root, case when q.c > 1 then p.proof || array_to_string(list_concat(q.ds[1:{place}], q.ds[{place} + 2:]), '') else p.proof end as proof, "
                f"case when q.c > 1 then sha256(array_to_string(list_concat(list_concat(q.ds[1:{place}], [p.f]), q.ds[{place} + 2:]), '')) else p.f end as f from p{step} p left join {r}{k} q on q.tree = {tree} and q.run = p.{at} // {16 ** (k + 1)})"
            )
            step += 1
    return f"with recursive {_CRC_SQL}, {', '.join(out)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from p{step}"
