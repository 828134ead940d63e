"""Longest-processing-time sharding of document groups.

Documents with equal texts form one group and stay together. Groups are placed by
descending size on the least-loaded shard of a heap. The driver never sees the
groups: it places *size classes*. A class holds the groups whose total size has the
same 12 leading bits, so there are at most 4096 + 52 * 2048 classes whatever the
corpus holds; sizes under 4096 bytes are classes of their own and exact. The plan
(class -> how many of its groups go to each shard) is what is broadcast, and its
size has the same bound times the number of shards. Groups then find their place
in the plan by a rank inside their class, numbered through sub-buckets, so no task
ever holds a whole class or a whole shard.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, text_bytes

MANTISSA_BITS = 12
ROWS_PER_BUCKET = 50_000
#: A text of over 1/HOT of all rows is hot; there are fewer than HOT of them, and each is met in parts of that share.
HOT = 2000


def place_classes(classes: list[tuple[int, float]], n_shards: int) -> list[list[int]]:
    """LPT over (count, mean size) classes given in descending size: groups of each class per shard.

    Equal groups always go to the least-loaded shard, so a class of any count is placed
    by filling all shards up to the highest common level its count allows, then by heap:
    the loads are those of the heap alone, at a cost that does not follow the count.
    """
    loads = [0.0] * n_shards
    out = []
    for count, size in classes:
        given = [0] * n_shards
        left = count
        if left > 4 * n_shards:
            low, high = min(loads), max(loads) + size * (left / n_shards + 1)
            fits = lambda level: [max(0, math.floor((level - x) / size)) for x in loads]
            for _ in range(100):
                mid = (low + high) / 2
                if sum(fits(mid)) <= count:
                    low = mid
                else:
                    high = mid
            given = fits(low)
            if sum(given) > count:
                given = [0] * n_shards
            left = count - sum(given)
            loads = [x + g * size for x, g in zip(loads, given)]
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            loads[i] += size
            given[i] += 1
        out.append(given)
    return out


def numbered(df: DataFrame, group: list[str], order: list[str], n_rows: int, name: str) -> DataFrame:
    """Add `name`: a gapless number from 0 inside each group, without one task per group.

    Rows of a group are dealt to sub-buckets by a hash of the ordering columns; bucket counts
    give offsets (one row a bucket), and rows are numbered inside their bucket.
    """
    buckets = max(1, math.ceil(n_rows / ROWS_PER_BUCKET))
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "_bucket"]
    counts = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return ranked.join(offsets, keys).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document; one row per input row.

    Returns ``<id_col>, size, text_crc32, shard, slot``. size is the text's UTF-8 bytes plus 1;
    a null text has no bytes (size 1, crc 0) and belongs to the group of empty texts. Documents
    with equal texts, repeated rows included, share a shard. ``slot`` numbers a shard's documents
    from 0 without gaps. An empty table gives an empty result; ids may be null or repeat.

    Inside a class the plan knows mean sizes only, and sizes differ from the mean by less than 1 in 2048.
    Shards therefore differ by at most the largest group (the bound of longest processing time)
    plus 1/1024 of the fullest shard; with sizes under 4096 bytes they are those of a heap over all groups.
    """
    raw = text_bytes(text_col)
    slim = materialize(
        docs.select(F.col(id_col).alias("_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("_key")),
        "shard-slim",
    )
    groups = slim.groupBy("_key").agg(F.count(F.lit(1)).alias("_members"), F.max("size").alias("_one"))
    groups = groups.withColumn("_bytes", F.col("_members") * F.col("_one"))
    shift = F.greatest(F.length(F.bin("_bytes")) - MANTISSA_BITS, F.lit(0))
    groups = materialize(groups.withColumn("_shift", shift).withColumn("_mant", F.expr("shiftright(_bytes, _shift)")).select("_key", "_members", "_bytes", "_shift", "_mant"), "shard-groups")
    classes = groups.groupBy("_shift", "_mant").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b"), F.sum("_members").alias("m")).orderBy(F.desc("_shift"), F.desc("_mant")).collect()
    plan = place_classes([(c.n, c.b / c.n) for c in classes], n_shards)
    n_groups = sum(c.n for c in classes)
    bounds = []
    for c, given in zip(classes, plan):
        start = 0
        for shard, k in enumerate(given):
            if k:
                bounds.append((c._shift, c._mant, shard, start, start + k))
                start += k
    schema = T.StructType([T.StructField(n, t) for n, t in (("_shift", T.IntegerType()), ("_mant", T.LongType()), ("shard", T.IntegerType()), ("_from", T.LongType()), ("_to", T.LongType()))])
    spark = docs.sparkSession
    ranges = spark.createDataFrame(bounds, schema).groupBy("_shift", "_mant").agg(F.sort_array(F.collect_list(F.struct("_to", "shard"))).alias("_ends"))
    ranked = numbered(groups, ["_shift", "_mant"], ["_key"], n_groups, "_place")
    # one row a class, at most 4096 + 52 * 2048 of them with n_shards ends each: bounded whatever the corpus
    placed = ranked.join(F.broadcast(ranges), ["_shift", "_mant"]).select("_key", "_members", F.expr("filter(_ends, x -> x._to > _place)[0].shard").alias("shard"))
    part = sum(c.m for c in classes) / HOT
    copies = F.when(F.col("_members") > part, F.ceil(F.col("_members") / part)).otherwise(1).cast("int")
    hot = groups.where(F.col("_members") > part).select("_key", copies.alias("_copies"))  # fewer than HOT rows
    met = placed.select("_key", "shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_part"))
    parted = slim.join(F.broadcast(hot), "_key", "left").withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_copies", F.lit(1))).cast("int"))
    # rows that are equal in all else are told apart by a number that is written with them
    dealt = materialize(parted.join(met, ["_key", "_part"]).select("_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("_row")), "shard-dealt")
    n_rows = dealt.count()
    release(slim, groups)
    out = numbered(dealt, ["shard"], ["_id", "text_crc32", "size", "_row"], n_rows, "slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def shard_loads(placed: DataFrame) -> DataFrame:
    """Bytes and rows of each shard: the report to judge a placement by."""
    return placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_documents(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
