"""Types of symbols as JSON text, and whether one fits another."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def fits(a: dict | None, b: dict | None) -> bool:
    """Unknown fits all; primitives and objects by name; arrays by their elements; a union by any member; functions never."""
    kinds = [(x or {}).get("kind", "unknown") for x in (a, b)]
    if "unknown" in kinds:
        return True
    if kinds[0] == kinds[1] in ("primitive", "object"):
        return a["name"] == b["name"]
    if kinds == ["array", "array"]:
        return fits(a["of"], b["of"])
    if kinds[0] == "union":
        return any(fits(x, b) for x in a["of"])
    if kinds[1] == "union":
        return any(fits(a, x) for x in b["of"])
    return False


@F.pandas_udf(BooleanType())
def _compatible(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fits(json.loads(x) if x else None, json.loads(y) if y else None) for x, y in zip(a, b)], dtype="boolean")


def type_compatible(a: Column, b: Column) -> Column:
    """Types are JSON objects: kind (unknown, primitive, object, array, union, function), name, and of (element or members); null is unknown."""
    return _compatible(a, b)
