"""Rules over numbered lines: blocks to stay out of, lines to leave out, and taint from line to line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import fixpoint
from .matching import nested

#: Conditions of `if` blocks that guard what they hold (mark in the rule, texts on the line).
GUARDS = [
    ('== "yes"', ['if [[ "$CONFIRM" == "yes" ]]', 'if [[ $CONFIRM == "yes" ]]']),
    ("sudo -n true", ["if sudo -n true", "if sudo -n true 2>/dev/null"]),
    ("=~ ^[a-zA-Z0-9_]+$", ["=~ ^[a-zA-Z0-9_]+$"]),
    ("=~ ^[a-zA-Z0-9_.-]+$", ["=~ ^[a-zA-Z0-9_.-]+$"]),
    ("=~ ^[a-zA-Z0-9_/-]+$", ["=~ ^[a-zA-Z0-9_/-]+$"]),
]


def _any(column: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(x)) for x in words])


def guarded_blocks(lines: DataFrame, pattern: str, key: str = "file_id") -> DataFrame:
    """(key, first, last) of the if blocks that a not-inside pattern stands for: from the `if` line to its fi or }.

    lines(key, line_no from 1, line). A line with `then` or `{` opens a level, one that is `fi` or `}` closes one, and
    the block ends at the first closing line on the level of its `if`: levels are running sums, and the end is
    found by an equality join on them.
    """
    texts = [t for mark, ts in GUARDS if mark in pattern for t in ts]
    if not texts:
        return lines.select(key, F.col("line_no").alias("first"), F.col("line_no").alias("last")).where("false")
    t = F.trim("line")
    w = Window.partitionBy(key).orderBy("line_no")
    opens = F.when(_any(t, ["then", "{"]), 1).otherwise(0)
    closes = F.when(t.isin("fi", "}"), 1).otherwise(0)
    level = lines.select(key, "line_no", t.alias("_t"), (F.sum(opens).over(w) - F.sum(closes).over(w)).alias("level"), (closes == 1).alias("_end"))
    starts = level.where((F.startswith("_t", F.lit("if ")) & _any(F.col("_t"), texts))).select(key, F.col("line_no").alias("first"), (F.col("level") - 1).alias("level"))
    ends = level.where("_end").select(key, "level", F.col("line_no").alias("last"))
    return starts.join(ends, [key, "level"]).where("last > first").groupBy(key, "first").agg(F.min("last").alias("last"))


def not_inside(findings: DataFrame, lines: DataFrame, pattern: str, key: str = "file_id") -> DataFrame:
    """Findings (key, start_line) outside [[ ]], (( )) and the guarded if blocks that the pattern names."""
    brackets = [(a, b) for mark, a, b in (("[[ $VAR ]]", "[[", "]]"), ("(( $VAR ))", "((", "))")) if mark in pattern]
    out = findings
    if brackets:
        hit = reduce(lambda a, b: a | b, [F.contains("line", F.lit(a)) & F.contains("line", F.lit(b)) for a, b in brackets])
        out = out.join(lines.where(hit).select(key, F.col("line_no").alias("start_line")).distinct(), [key, "start_line"], "left_anti")
    blocks = guarded_blocks(lines, pattern, key).select(key, (F.col("first") + 1).alias("_from"), (F.col("last") - 1).alias("_to"))
    lined = out.withColumns({"_from": F.col("start_line"), "_to": F.col("start_line")})
    return nested(lined, blocks, [key], False, True, "_from", "_to").drop("_from", "_to")


def not_regex(findings: DataFrame, lines: DataFrame, regex: str, key: str = "file_id") -> DataFrame:
    """Findings whose own line the expression does not match; doubled backslashes of the rule file count once."""
    for c in "sdw$":
        regex = regex.replace("\\\\" + c, "\\" + c)
    bad = lines.where(F.regexp("line", F.lit(regex))).select(key, F.col("line_no").alias("start_line")).distinct()
    return findings.join(bad, [key, "start_line"], "left_anti")


def line_taint(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, start_line, start_column, end_column, confidence) of tainted sink(..) calls.

    A variable is tainted from the line that assigns it "tainted"; an assignment of a tainted variable, after that
    line, taints another that never is assigned "tainted" itself. A sink(x) is tainted by an earlier taint of x with
    no line x = sanitize(..) strictly between; sanitizers on lines indented by over two blanks with an `if ` or
    `else` on the line or the two before do not count. sink(.."tainted"..) without sanitize( is tainted by itself.
    A variable is what stands last before the first =, and first after it, without semicolons.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    line = F.col("line")
    has = lambda x: F.contains(line, F.lit(x))
    t = F.trim("line")
    branch = F.startswith(t, F.lit("if ")) | F.startswith(t, F.lit("else"))
    near = branch | F.coalesce(F.lag(branch, 1).over(w), F.lit(False)) | F.coalesce(F.lag(branch, 2).over(w), F.lit(False))
    left = F.rtrim(F.regexp_extract(F.substring_index(line, "=", 1), r"(\S+)\s*$", 1), F.lit(";"))
    after = F.substring(line, F.instr(line, "=") + 1, F.lit(1 << 30))
    right = F.rtrim(F.regexp_extract(after, r"^\s*(\S+)", 1), F.lit(";"))
    arg = F.trim(F.regexp_extract(line, r"sink\(([^)]*)\)", 1))
    kinds = lines.select(
        key, "line_no", F.instr(line, "sink(").alias("at"), left.alias("left"), right.alias("right"), arg.alias("arg"),
        (has("sink(") & has('"tainted"') & ~has("sanitize(")).alias("direct"), (has('"tainted"') & has("=") & (left != "")).alias("source"),
        (has("=") & ~has('"') & ~has("sanitize(") & (left != "") & (right != "")).alias("move"),
        (has("sanitize(") & has("=") & (left != "") & ~((F.char_length(line) - F.char_length(F.ltrim("line")) > 2) & near)).alias("clean"),
        (has("sink(") & ~has('"tainted"') & (arg != "") & ~F.startswith(arg, F.lit('"'))).alias("sink"),
    )
    sources = kinds.where("source").select(key, F.col("left").alias("var"), F.col("line_no").alias("since"))
    own = sources.select(F.col(key).alias("_k"), F.col("var").alias("_v")).distinct()
    moves = kinds.where("move").select(F.col(key).alias("_k"), F.col("left").alias("to"), F.col("right").alias("from"), F.col("line_no").alias("line_at"))
    moves = moves.join(own.select(F.col("_k").alias("_o"), "_v"), (F.col("_k") == F.col("_o")) & (F.col("to") == F.col("_v")), "left_anti")

    def step(f: DataFrame) -> DataFrame:
        hit = f.join(moves, (F.col(key) == F.col("_k")) & (F.col("var") == F.col("from")) & (F.col("line_at") > F.col("since")))
        return hit.select(key, F.col("to").alias("var"), F.col("line_at").alias("since")).distinct()

    reached = fixpoint(sources.distinct(), step, [key, "var", "since"])
    # a variable that others taint is tainted from the first such line on; one assigned "tainted" from each of its lines
    direct = reached.join(own, (F.col(key) == F.col("_k")) & (F.col("var") == F.col("_v")), "left_semi")
    moved = reached.join(own, (F.col(key) == F.col("_k")) & (F.col("var") == F.col("_v")), "left_anti").groupBy(key, "var").agg(F.min("since").alias("since"))
    taints = direct.unionByName(moved)
    clean = kinds.where("clean").select(F.col(key).alias("_k"), F.col("left").alias("_v"), F.col("line_no").alias("cleaned"))
    sinks = kinds.where("sink").select(key, "line_no", "at", F.col("arg").alias("var"))
    hit = sinks.join(taints, [key, "var"]).where("since < line_no")
    hit = hit.join(clean, (F.col(key) == F.col("_k")) & (F.col("var") == F.col("_v")) & (F.col("cleaned") > F.col("since")) & (F.col("cleaned") < F.col("line_no")), "left_anti")
    found = hit.select(key, "line_no", "at", F.lit("medium").alias("confidence")).distinct().union(kinds.where("direct").select(key, "line_no", "at", F.lit("high")))
    return found.select(key, F.col("line_no").alias("start_line"), F.col("at").alias("start_column"), (F.col("at") + 4).alias("end_column"), "confidence")


def undeclared_prefixes(files: DataFrame, key: str = "file_id", text_col: str = "source") -> DataFrame:
    """(key, prefix): namespace prefixes that an XML text uses on elements or attributes and nowhere declares; xml and xmlns are known."""
    names = lambda regex, group: F.explode(F.regexp_extract_all(text_col, F.lit(regex), F.lit(group))).alias("prefix")
    used = files.select(key, names(r"</?([A-Za-z_][\w.-]*):[A-Za-z_]", 1)).union(files.select(key, names(r"\s([A-Za-z_][\w.-]*):[A-Za-z_][\w.-]*\s*=", 1)))
    declared = files.select(key, names(r"xmlns:([A-Za-z_][\w.-]*)\s*=", 1))
    return used.where(~F.col("prefix").isin("xml", "xmlns")).distinct().join(declared.distinct(), [key, "prefix"], "left_anti")


def unguarded(rows: DataFrame, guards: DataFrame, keys: list[str], at: str, within: int) -> DataFrame:
    """Rows without a guard of the same keys among the `within` places before theirs."""
    g = guards.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_at"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    return rows.join(g, same & (F.col(at) - F.col("_at")).between(1, within), "left_anti")


def seen_lately(test: Column, keys: list[str], order: list[str], rows: int) -> Column:
    """1 where the test holds in this row or one of the `rows` before it in order, else 0."""
    return F.max(F.when(test, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, 0))


def first_of_each(stages: list[DataFrame], keys: list[str]) -> DataFrame:
    """The findings of the first stage that has any, for each key (rule and file); `stage` numbers it from 0.

    All stages are plans over the same files: what a later one finds where an earlier one did is dropped by a join on the keys.
    """
    numbered = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    first = numbered.groupBy(*keys).agg(F.min("stage").alias("stage"))
    return numbered.join(first, [*keys, "stage"], "left_semi")
