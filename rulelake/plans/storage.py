"""Tables that outlive executors, and fixpoints over them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own in local mode (tests); an error on a
    cluster, whose executors do not share the driver's disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rulelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_tables: list[tuple[SparkSession, str]] = []


def _written(df: DataFrame, name: str, compression: str = "snappy") -> str:
    path = f"{shared_folder(df.sparkSession)}/rulelake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not _tables:
        atexit.register(forget_all)
    _tables.append((df.sparkSession, path))
    return path


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and lost executors do not matter."""
    path = _written(df, name, compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rulelake_path = path
    return out


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _tables[:] = [x for x in _tables if x[1] not in paths]


def forget_all() -> None:
    """Delete what is left when the driver ends (results read lazily need their tables until then)."""
    for spark, path in list(_tables):
        try:
            forget(spark, path)
        except Exception:  # the JVM has gone first; the folder belongs to the cluster's clean-up
            break
    _tables.clear()


#: Fixed value: so many steps' tables are read side by side before they are written as one.
PARTS = 16


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """All rows reached from start by step; a row is new if its keys have not been seen. Ends when no row is new.

    Each step appends its new rows as a table of their own; every PARTS steps these become one and are deleted.
    """
    spark = start.sparkSession
    read = lambda *paths: spark.read.schema(start.schema).parquet(*paths)
    parts = [_written(start, "reached")]
    frontier = read(*parts)
    while True:
        seen = read(*parts).select(*[F.col(k).alias(f"_seen_{k}") for k in keys])
        # null-safe: a row with a null key that goes round a cycle would be new for ever
        new = _written(step(frontier).select(*start.columns).join(seen, [F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in keys], "left_anti"), "frontier")
        frontier = read(new)
        if frontier.isEmpty():
            forget(spark, new)
            break
        parts.append(new)
        if len(parts) > PARTS:
            whole = _written(read(*parts), "reached")
            forget(spark, *parts[:-1])  # the last one is the frontier of the next step
            parts = [whole]
    return read(*parts)
