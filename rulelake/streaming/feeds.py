"""Incremental scans, rate limits and retention on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def incremental(files: DataFrame, matcher: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that scans only files not seen before and appends their matches."""
    return matcher(files).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by kind; rows later than the watermark are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def fixed_window(times: list[float], limit: int, width: float, start: float | None = None, count: int = 0) -> tuple[list[bool], float | None, int]:
    """Admission of ordered hits: a window opens at its first hit, closes after `width`; past `limit` hits are refused, the first never."""
    out = []
    for t in times:
        if start is None or t - start > width:
            start, count = t, 1
            out.append(True)
        else:
            count += 1
            out.append(count <= limit)
    return out, start, count


def rate_limit(hits: DataFrame, limit: int, width: float = 60.0) -> DataFrame:
    """Stream of (client, ts double) with `admitted`, by a window per client kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            ok, start, count = fixed_window(pdf.ts.tolist(), limit, width, start, count)
            yield pdf.assign(admitted=ok)[["client", "ts", "admitted"]]
        state.update((start, count))

    return hits.groupBy("client").applyInPandasWithState(run, "client long, ts double, admitted boolean", "start double, count int", "append", GroupStateTimeout.NoTimeout)


def rate_limited(hits: DataFrame, limit: int, width: float = 60.0, client: str = "client", ts: str = "ts") -> DataFrame:
    """Hits of a table with `admitted`, as rate_limit() admits those of a stream: clients come sorted by time, and only the
    present one's window is held. Hits without a time are refused."""
    at = [hits.columns.index(c) for c in (client, ts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, count = None, None, 0
        for batch in batches:
            out = []
            for who, t in zip(*(batch.column(k).to_pylist() for k in at)):
                if t is None:
                    out.append(False)
                    continue
                if (who,) != now:
                    now, start, count = (who,), None, 0
                (ok,), start, count = fixed_window([t], limit, width, start, count)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "admitted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)
    return hits.repartition(client).sortWithinPartitions(client, ts).mapInArrow(run, f"{fields}, admitted boolean")


def retained(jobs: DataFrame, cutoff: str, column: str = "created_at") -> DataFrame:
    """Rows not older than the cutoff."""
    return jobs.where(F.col(column) >= F.to_timestamp_ntz(F.lit(cutoff)))
