"""SQL inside Java and XML sources, and SQL rules over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_sql, normalize_sql_loose, unescape_java
from ..operators.matching import evaluate
from ..plans.rules import Rule
from .files import embedded

_LITERAL = r'"((?:\\.|[^"\\]++)*+)"'
#: Where Java and MyBatis sources hold SQL (language, context, regular expression, group of the SQL).
MARKERS = [
    ("java", "@Select/@Query", r"(?s)@(?:[A-Za-z0-9_]+\.)*+(?:Select|Query)\s*\(\s*" + _LITERAL + r"\s*\)", 1),
    ("java", "JDBC", r"(?s)\b(?:prepareStatement|executeQuery|createNativeQuery)\s*\(\s*" + _LITERAL, 1),
    ("xml", "<select>", r"(?is)<\s*select\b[^>]*>(.*?)</\s*select\s*>", 1),
]
#: Looser marks, whose SQL is the next string literal whatever stands before it.
LOOSE_MARKERS = [
    ("java", "@Select/@Query", r'(?s)(?:Select\(|Query\()[^"]*+' + _LITERAL, 1),
    ("java", "JDBC", r'(?s)(?:prepareStatement\(|executeQuery\(|createNativeQuery\()[^"]*+' + _LITERAL, 1),
    ("xml", "<select>", r"(?is)<select[^>]*>(.*?)</select>", 1),
]


def sql_snippets(files: DataFrame, loose: bool = False, id_col: str = "file_id", text_col: str = "source") -> DataFrame:
    """(id, context, ordinal, sql, start_line): every SQL snippet of Java and XML files, normalized, with the 1-based line it begins on.

    loose takes the next string literal after a mark; an escaped character of it loses its backslash before escapes are read.
    """
    parts = []
    for language, context, regex, group in LOOSE_MARKERS if loose else MARKERS:
        some = files.where(F.col("language") == language).select(id_col, text_col)
        found = embedded(some, regex, group, text_col)
        sql = F.col("snippet")
        if language == "java":
            sql = unescape_java(F.regexp_replace(sql, r"(?s)\\(.)", "$1") if loose else sql)
        sql = normalize_sql_loose(sql) if loose else normalize_sql(sql)
        parts.append(found.select(id_col, F.lit(context).alias("context"), "ordinal", sql.alias("sql"), "start_line"))
    return reduce(DataFrame.unionByName, parts)


def embedded_findings(files: DataFrame, rules: list[Rule], loose: bool = False, id_col: str = "file_id", text_col: str = "source") -> DataFrame:
    """Matches of SQL rules inside Java and XML files, at the files' own lines, with the snippet's `embedded_context`.

    A rule takes part where its languages hold sql, its metadata has preprocess = embedded-sql and its
    preprocess.from names the file's language.
    """
    parts = []
    for language in ("java", "xml"):
        some = [r for r in rules if "sql" in r.languages and r.metadata.get("preprocess") == "embedded-sql" and language in r.metadata.get("preprocess.from", "").lower()]
        if not some:
            continue
        snippets = sql_snippets(files.where(F.col("language") == language), loose, id_col, text_col)
        named = snippets.where("trim(sql) != ''").select(F.struct(id_col, "context", "ordinal", "start_line").alias("_at"), "sql", F.lit("sql").alias("language"))
        found = evaluate(named, some, "_at", "sql", "language")
        shift = lambda c: (F.col(c) + F.col("_at.start_line") - 1).cast("int").alias(c)
        parts.append(found.select(F.col(f"_at.{id_col}").alias(id_col), "rule_id", shift("start_line"), "start_column", shift("end_line"), "end_column", "matched", "bindings", F.col("_at.context").alias("embedded_context")))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    empty = evaluate(files, [], id_col, text_col, "language")
    return empty.select(id_col, "rule_id", "start_line", "start_column", "end_line", "end_column", "matched", "bindings", F.lit(None).cast("string").alias("embedded_context"))
