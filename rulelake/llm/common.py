"""Shared helpers: durable intermediate tables, word splitting, Arrow batches.

Conventions every operator keeps:

* a null text is an empty text unless the docstring says otherwise;
* columns are taken by name (``id_col``, ``text_col``); other columns, whatever
  their names, never reach the operator's internals;
* an input column of the name of one that the operator adds is replaced by it;
* repeated rows are separate documents and each gets its own output row.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import forget, saved

#: Bytes that separate words: \x20 and \x09-\x0D; bytes.split() uses the same set.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, lost executors do not matter."""
    return saved(df, name, "zstd")


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for t in tables:
        forget(t.sparkSession, t._rulelake_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


try:
    _trim = ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library: freed memory stays with the worker
    _trim = None


def give_back() -> None:
    """Return freed memory to the system, so that a worker that is used again holds no more than its present work."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_bytes(text_col: str = "text") -> Column:
    """The text's UTF-8 bytes as a Column; a null text is empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose bytes in one column stay near `most`, so memory does not follow batch size."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    offsets = memoryview(col.buffers()[1]).cast("i")[col.offset : col.offset + len(col) + 1]
    start = 0
    for i in range(1, len(col) + 1):
        if i == len(col) or offsets[i + 1] - offsets[start] > most:
            yield batch.slice(start, i - start)
            start = i


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and bytes of a text or binary column, by one aggregation."""
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()
    return int(r[0]), int(r[1])


def numbered_words(texts: pa.Array, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in a row, words of each text); lower: A-Z are lower-cased first."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    at, sizes = coded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
    if "" in distinct:  # blanks at the ends of a text split off empty words
        e = distinct.index("")
        del distinct[e]
        keep = at != e
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        at = at[keep]
        at -= at > e
    return distinct, at, sizes
