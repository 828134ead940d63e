"""Quality rules: a threshold table compiled into one projection of built-in expressions.

`measures()` computes what a text is judged by; `compile_rules()` turns rows of
(rule, measure, low, high) into one boolean Column and one array of broken rules.
No user function runs, and no row is moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is it for on was be as with by this are at from an "
    "le la les de des du un une et en que qui dans pour sur par au avec est "
    "der die das und den von zu mit ist im für ein eine nicht sich dem auf "
    "el los las y se del con una para por su no"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A text is rejected when low <= measure <= high does not hold (None: no bound)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: n_words and repeat_ratio are the base rules; the others follow published web-corpus filters.
RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeats_itself", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_length", low=2, high=15),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_ratio", high=0.9),
    Rule("ellipses", "ellipsis_ratio", high=0.3),
)
BASE = ("too_short", "repeats_itself")


def _neighbours(keys: str, same: str) -> str:
    """Elements of a sorted array that equal the one before or after, by the given lambda body over (a, b)."""
    eq = lambda a, b: same.replace("<a>", a).replace("<b>", b)
    return f"filter({keys}, (k, j) -> (j > 0 and {eq(f'{keys}[j - 1]', 'k')}) or (j < size({keys}) - 1 and {eq('k', f'{keys}[j + 1]')}))"


def with_repeat_words(df: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Add _n_repeat: words inside 3-word windows that occur at least twice, from the array column _words.

    Windows are compared by a hash that shares a long with the window's number, so one sort of
    primitive longs finds the repeats in n log n. Should two different windows of a text ever share
    a hash, which is looked at whenever hashes are equal, the text is counted again by its window strings.
    """
    df = df.withColumn("_mask", F.expr("shiftleft(1L, length(bin(size(_words)))) - 1"))
    low = 64 - hash_bits
    cut = f"& ~(shiftleft(1L, {low}) - 1)" if low else ""
    df = df.withColumn("_keys", F.expr(f"if(size(_words) < 3, array(), sort_array(transform(sequence(0, size(_words) - 3), i -> ((xxhash64(_words[i], _words[i + 1], _words[i + 2]) {cut}) & ~_mask) | i)))"))
    df = df.withColumn("_dup", F.expr(_neighbours("_keys", "(<a> & ~_mask) = (<b> & ~_mask)")))
    at = lambda k, d: f"_words[cast(_dup[{k}] & _mask as int) + {d}]"
    differ = " or ".join(f"{at('j', d)} != {at('j + 1', d)}" for d in range(3))
    df = df.withColumn("_clash", F.expr(f"size(_dup) > 1 and exists(sequence(0, size(_dup) - 2), j -> (_dup[j] & ~_mask) = (_dup[j + 1] & ~_mask) and ({differ}))"))
    df = df.withColumn("_slow", F.expr("if(_clash, array_sort(transform(sequence(0, size(_words) - 3), i -> named_struct('s', concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]), 'i', cast(i as bigint)))), cast(array() as array<struct<s: string, i: bigint>>))"))
    df = df.withColumn("_starts", F.expr(f"sort_array(if(_clash, transform({_neighbours('_slow', '<a>.s = <b>.s')}, x -> x.i), transform(_dup, k -> k & _mask)))"))
    covered = "aggregate(_starts, named_struct('n', 0L, 'p', -3L), (a, i) -> named_struct('n', a.n + least(3L, i - a.p), 'p', i), a -> a.n)"
    return df.withColumn("_n_repeat", F.expr(covered))


def measures(docs: DataFrame, text_col: str = "text", stop_words=STOP_WORDS, hash_bits: int = 64) -> DataFrame:
    """docs plus the struct column ``quality_measures``. A null text has no words and all ratios 0.

    Write the result before filtering by the measures: a filter is pushed below the projection and works them out again.
    """
    docs = docs.drop("quality_measures", "quality_failed", "quality_kept")
    kept = [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*kept, text.alias("_text"))
    df = df.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD_REGEX), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD_REGEX)))
    df = with_repeat_words(df, hash_bits)
    stops = F.array_size(F.filter("_words", lambda w: F.lower(w).isin(list(stop_words))))
    counts = df.select(
        *[f"_in{i}" for i in range(len(kept))],
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_n_repeat").cast("long").alias("n_repeat_words"),
        stops.cast("long").alias("n_stop_words"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("_bullets"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("_ellipses"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]
    ratios = {"repeat_ratio": ("n_repeat_words", "n_words"), "mean_word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_ratio": ("_bullets", "n_lines"), "ellipsis_ratio": ("_ellipses", "n_lines")}
    packed = F.struct(*names, *[ratio(*ab).alias(k) for k, ab in ratios.items()])
    return counts.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)], packed.alias("quality_measures"))


def compile_rules(rules=RULES, measures_col: str = "quality_measures") -> tuple[Column, Column]:
    """(kept, names of broken rules) as Columns over the struct of measures."""
    broken = []
    for r in rules:
        x = F.col(f"{measures_col}.{r.measure}")
        bad = [x < r.low] if r.low is not None else []
        bad += [x > r.high] if r.high is not None else []
        broken.append(F.when(bad[0] if len(bad) == 1 else bad[0] | bad[1], F.lit(r.name)))
    failed = F.array_compact(F.array(*broken))
    return F.size(failed) == 0, failed


def judge(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """docs plus ``quality_measures``, ``quality_failed`` (broken rules) and ``quality_kept``.

    Empty and null texts break `too_short`; repeated rows are judged each for itself; an
    empty table stays empty; other columns pass through untouched.
    """
    kept, failed = compile_rules(rules)
    return measures(docs, text_col).withColumns({"quality_failed": failed, "quality_kept": kept})


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = "quality_measures"
    out = judge(docs).select("doc_id", *[F.col(f"{m}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.arrays_overlap("quality_failed", F.array(*map(F.lit, BASE))).alias("base_failed"), F.col("quality_kept").alias("kept"))
    return out


def op5_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    word = r"[^\x20\x09-\x0D]+"
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, doc_id, t, regexp_extract_all(t, '{word}') as ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{word}')] as ls from d),
g as (select k, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as g from (select k, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select k, i from (select k, i, count(*) over (partition by k, g) as n from g) where n > 1),
c as (select k, count(distinct i + o) as n from r, (values (0), (1), (2)) v(o) group by k),
m as (select doc_id, cast(len(ws) as bigint) as n_words,
  cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines,
  cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
  len([x for x in ws if lower(x) in ({stops})]) as n_stop,
  len([x for x in ls if regexp_matches(x, '^\\s*[-*•]')]) as bullets,
  len([x for x in ls if regexp_matches(x, '(\\.\\.\\.|…)\\s*$')]) as ellipses
  from w left join c using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars / n_words between 2 and 15
  and n_symbols / n_words <= 0.1 and n_stop >= 2 and n_dup_lines / n_lines <= 0.5 and bullets / n_lines <= 0.9 and ellipses / n_lines <= 0.3 as kept
from m"""
