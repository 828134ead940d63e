"""What users add: conditions, rule validators, catalog rows, parsers; and helpers around a run."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .rules import Rule, validate


@dataclass
class Extensions:
    """Named additions of a run. Conditions map a binding's Column to a boolean Column (a pandas UDF serves as well)."""

    conditions: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: {"always_true": lambda v: F.lit(True), "always_false": lambda v: F.lit(False)})
    validators: list[Callable[[Rule], str | None]] = field(default_factory=list)
    parsers: dict[str, Callable[[str], list[tuple]]] = field(default_factory=dict)
    formatters: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    stores: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)
    aggregates: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def condition(self, name: str, value: Column, unknown: bool = False) -> Column:
        """A named condition; an unknown name is `unknown`."""
        made = self.conditions.get(name)
        return F.coalesce(made(value), F.lit(False)) if made else F.lit(unknown)

    def aggregate(self, name: str, *columns: Column) -> Column:
        """A named aggregate over columns, for use in agg() (a grouped pandas UDF serves as well)."""
        if name not in self.aggregates:
            raise KeyError(f"no aggregate {name!r}; there are {sorted(self.aggregates)}")
        return self.aggregates[name](*columns)

    def format(self, findings: DataFrame, name: str) -> DataFrame:
        """Findings as lines by a named formatter."""
        if name not in self.formatters:
            raise KeyError(f"no formatter {name!r}; there are {sorted(self.formatters)}")
        return self.formatters[name](findings)

    def store(self, findings: DataFrame, name: str) -> None:
        """Hand findings to a named store, which writes them with Spark."""
        self.stores[name](findings)

    def validate(self, rule: Rule) -> list[str]:
        """The built-in checks' errors and those of the added validators."""
        return validate(rule) + [e for v in self.validators if (e := v(rule))]


def extended(catalog: DataFrame, rows: list[tuple]) -> DataFrame:
    """A catalog with rows appended after its own, so that the built-in ones win."""
    last = catalog.agg(F.coalesce(F.max("catalog_ord"), F.lit(-1))).first()[0]
    return catalog.union(catalog.sparkSession.createDataFrame([(last + 1 + i, *r) for i, r in enumerate(rows)], catalog.schema))


def option(rule: Rule, name: str, context: str | None = None, default: bool = True) -> bool:
    """A rule's own option, else the run's, else the default; 'true', '1', 'yes' and 'on' are true."""
    value = rule.options.get(name, context)
    return default if value is None else str(value).strip().lower() in ("true", "1", "yes", "on")


def recovered(action: Callable, retries: int = 0, delay: float = 0.0, fallback: Callable | None = None):
    """The action's result after at most `retries` repeats; then the fallback's, or the error."""
    for attempt in range(retries + 1):
        try:
            return action()
        except Exception:
            if attempt == retries:
                if fallback is None:
                    raise
                return fallback()
            time.sleep(delay)


@contextmanager
def timed(times: dict[str, list[float]], label: str):
    """Add a block's seconds to times[label]."""
    began = time.perf_counter()
    try:
        yield
    finally:
        times.setdefault(label, []).append(time.perf_counter() - began)


def observed(findings: DataFrame, name: str = "findings") -> tuple[DataFrame, Observation]:
    """Findings with counts by severity gathered while they are written, at no extra pass."""
    o = Observation(name)
    return findings.observe(o, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "error", "critical")]), o


class BoundedCache:
    """Persisted results of named operations, at most `most`; the one used longest ago is unpersisted first."""

    def __init__(self, most: int = 16):
        self.most = most
        self.kept: dict[str, DataFrame] = {}
        self.hits = self.misses = 0

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name in self.kept:
            self.hits += 1
            self.kept[name] = self.kept.pop(name)
            return self.kept[name]
        self.misses += 1
        while len(self.kept) >= self.most:
            self.kept.pop(next(iter(self.kept))).unpersist()
        self.kept[name] = make().persist()
        return self.kept[name]

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


class Background:
    """An action on its own thread; its Spark jobs carry a tag and end when it is cancelled or its time is up."""

    def __init__(self, spark: SparkSession, action: Callable, tag: str | None = None):
        self.spark, self.tag = spark, tag or f"rulelake-{uuid.uuid4().hex}"
        self.cancelled = False
        self._result: list = []
        self._error: list = []

        def run():
            spark.sparkContext.addJobTag(self.tag)
            try:
                self._result.append(action())
            except Exception as e:  # handed to whoever asks for the result
                self._error.append(e)
            finally:
                spark.sparkContext.removeJobTag(self.tag)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def result(self, seconds: float | None = None):
        """The action's result; TimeoutError, with its jobs ended, where it takes longer than `seconds`."""
        self._thread.join(seconds)
        if self._thread.is_alive():
            self.cancel()
            raise TimeoutError(f"not done after {seconds} s")
        if self._error:
            raise self._error[0]
        return self._result[0]
