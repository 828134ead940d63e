"""Merges of confidences, transformations and sanitizer sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a taint keeps after each kind of transformation.
KEPT = {"encode": 0.7, "validate": 0.5, "filter": 0.8}
#: How much of its effectiveness a sanitizer keeps by where data comes from.
ORIGIN_FACTORS = {"user": 1.0, "database": 0.9, "file": 0.8}


def sequential_mean(values: Column) -> Column:
    """((a + b) / 2 + c) / 2 ... over an ordered array; null for an empty one."""
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0), lambda a, x: (a + x) / 2))


def merge_sets(a: Column, b: Column, strategy: str) -> Column:
    return {"union": F.array_union, "intersection": F.array_intersect}[strategy](a, b)


def most_restrictive(rows: DataFrame, key: list[str], effects: str, order: str) -> DataFrame:
    """The row of each key with the largest sum of effects; the first of equals."""
    total = F.aggregate(F.col(effects), F.lit(0.0), lambda a, x: a + x)
    w = Window.partitionBy(*key).orderBy(F.desc("_t"), order)
    return rows.withColumn("_t", total).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_t", "_n")


def transformed(confidence: Column, kinds: Column, effects: Column) -> Column:
    """Confidence after transformations in order: sanitize keeps 1 - e, others a fixed share."""
    keep = F.create_map(*[F.lit(x) for kv in KEPT.items() for x in kv])
    return F.aggregate(F.arrays_zip(kinds.alias("k"), effects.alias("e")), confidence, lambda a, t: a * F.when(t["k"] == "sanitize", 1 - t["e"]).otherwise(F.coalesce(keep[t["k"]], F.lit(1.0))))


def significant(confidence: Column, kinds: Column, effects: Column) -> Column:
    """Surer than 0.5 and not sanitized by more than 0.8."""
    strong = F.exists(F.arrays_zip(kinds.alias("k"), effects.alias("e")), lambda t: (t["k"] == "sanitize") & (t["e"] > 0.8))
    return (confidence > 0.5) & ~strong


def best_of_each(flows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The surest flow of each key; of equals the one with the least path."""
    w = Window.partitionBy(*key).orderBy(F.desc(by), "path")
    return flows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def origin_effectiveness(effect: Column, origin: Column) -> Column:
    return effect * F.coalesce(F.create_map(*[F.lit(x) for kv in ORIGIN_FACTORS.items() for x in kv])[origin], F.lit(0.7))
