"""Secret scans with DataFrame functions only.

Two detectors share one row: named patterns (assignments, access keys, hex runs) and a
sliding-window Shannon entropy over candidate strings. A candidate is a run of base64-like
characters of at least the window's length, cut where a segment (letters and digits between
separators) holds a placeholder word; its character class (hex, alnum, base64) sets the window
and the bits it must reach. The entropy is kept by incremental counts: a step adds the entering
character and takes the leaving one, changing two terms of sum(c log2 c). Candidates that match
an allow-list entry as a whole are not scanned. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_text, sums_before

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGN_LEAST = 6
#: Words that mark a segment as made up.
PLACEHOLDERS = "example|sample|placeholder|dummy|changeme|xxxxx"
#: Runs of separators and of segments without a placeholder, where at least a window of such characters lies ahead.
CANDIDATE = rf"(?=[A-Za-z0-9+/_=-]{{24}})(?:[+/_=-]|(?<![A-Za-z0-9])(?![A-Za-z0-9]*?(?i:{PLACEHOLDERS}))[A-Za-z0-9]++)++"
LEAST = 24


@dataclass(frozen=True)
class EntropyClass:
    """Candidates matching `pattern` (first row that matches) are hot where a window reaches `bits`."""

    name: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", "^[0-9A-Fa-f]+$", 24, 3.0),
    EntropyClass("entropy_alnum", "^[0-9A-Za-z]+$", 24, 3.75),
    EntropyClass("entropy_base64", "^[A-Za-z0-9+/_=-]+$", 24, 4.0),
)
#: Whole candidates that look random and are not secrets: no digit or no letter at all, identifiers, dates with times, paths.
ALLOWED = (
    "^[^0-9]+$",
    "^[^A-Za-z]+$",
    "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_+TZ0-9]*$",
    "^/?([A-Za-z]+[0-9]{0,3}/)+[A-Za-z]+[0-9]{0,3}/?$",
)


def _spans(df: DataFrame, name: str, text: str, regex: str, found: str, kind: str, order: str, ok: str = "true", first: str = "0", last: str | None = None) -> DataFrame:
    """Add the column `name`: spans of the matches in `found` (all matches of regex), as array<struct<s, o, e, kind>>.

    The text between matches comes from splitting by the same regex; starts follow by adding lengths up. kind, order,
    ok, first and last are SQL over the match's number j; first and last are offsets inside the match (default: all of it).
    """
    gaps, at = f"{name}_gaps", f"{name}_at"
    df = df.withColumn(gaps, F.expr(f"if(size({found}) = 0, cast(array() as array<int>), transform(split({text}, {sql_text(regex)}, -1), p -> char_length(p)))"))
    df = df.withColumn(at, F.expr(sums_before(f"transform({found}, (f, j) -> {gaps}[j] + char_length(f))")))
    end = last or f"char_length({found}[j])"
    one = f"named_struct('s', {at}[j] + {gaps}[j] + {first}, 'o', {order}, 'e', {at}[j] + {gaps}[j] + {end}, 'kind', {kind})"
    some = f"filter(sequence(0, size({found}) - 1), j -> {ok})"
    empty = "cast(array() as array<struct<s: int, o: int, e: int, kind: string>>)"
    return df.withColumn(name, F.expr(f"if(size({found}) = 0, {empty}, transform({some}, j -> {one}))")).drop(gaps, at)


def _hot(cand: str, window: str, bits: str) -> str:
    """SQL: (first hot offset, last hot end) of a candidate under a sliding window, or nulls."""
    f = lambda c: f"(if({c} > 0, {c} * log2({c}), 0D))"
    new, old = "ascii(ch[i])", f"if(i >= {window}, ascii(ch[i - {window}]), -1)"
    step = (
        "transform(array(named_struct('new', NEW, 'old', OLD)), z -> "
        "transform(array(a.sum + if(z.new = z.old, 0D, FIN1 - FIN0 + if(z.old < 0, 0D, FOUT1 - FOUT0))), s -> "
        "named_struct('n', if(z.new = z.old, a.n, transform(a.n, (c, k) -> c + if(k = z.new, 1, 0) - if(k = z.old, 1, 0))), 'sum', s, "
        "'first', if(a.first is null and HOT, i + 1 - WIN, a.first), 'last', if(HOT, i + 1, a.last)))[0])[0]"
    )
    hot = f"(i + 1 >= {window} and log2({window}) - s / {window} >= {bits} - 1e-9D)"
    for k, v in {"NEW": new, "OLD": old, "FIN1": f("(a.n[z.new] + 1)"), "FIN0": f("a.n[z.new]"), "FOUT1": f("(a.n[z.old] - 1)"), "FOUT0": f("a.n[z.old]"), "HOT": hot, "WIN": window}.items():
        step = step.replace(k, v)
    init = "named_struct('n', array_repeat(0, 128), 'sum', 0D, 'first', cast(null as int), 'last', cast(null as int))"
    return f"transform(array(split({cand}, '')), ch -> aggregate(sequence(0, char_length({cand}) - 1), {init}, (a, i) -> {step}, a -> named_struct('first', a.first, 'last', a.last)))[0]"


def scan(docs: DataFrame, text_col: str = "text", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """docs plus ``secrets``: array<struct<start, end, kind>> ordered by start, then by kind.

    Kinds are assign, access, hex and the entropy classes. A null or empty text has no spans;
    an empty table stays empty; repeated rows are scanned each for itself. Entropy spans may
    overlap named ones: both stay. Strings of under 24 base64-like characters have no window, so
    only the named patterns find them. Of a long run that joins a placeholder or a date to other
    characters, the rest is scanned. An input column ``secrets`` is replaced.
    """
    docs = docs.drop("secrets")
    kept = [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)]
    df = docs.select(*kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    every = lambda p, g=0: F.regexp_extract_all("_text", F.lit(p), F.lit(g))
    df = df.withColumns({"_fa": every(ASSIGN), "_fk": every(ACCESS), "_fh": every(HEX), "_fc": every(CANDIDATE)})
    df = df.withColumn("_g2", F.when(F.size("_fa") > 0, every(ASSIGN, 2)).otherwise(F.array().cast("array<string>")))
    skip = " or ".join([f"char_length(c) < {LEAST}", *(f"rlike(c, {sql_text(p)})" for p in allowed)])
    pick = lambda what: "case " + " ".join(f"when rlike(c, {sql_text(k.pattern)}) then {what(k)}" for k in classes) + " end"
    meta = f"named_struct('w', {pick(lambda k: str(k.window))}, 'b', {pick(lambda k: f'{k.bits}D')}, 'k', {pick(lambda k: sql_text(k.name))}, 'o', {pick(lambda k: str(3 + list(classes).index(k)))})"
    candidate = f"if({skip}, null, transform(array({meta}), m -> named_struct('h', {_hot('c', 'm.w', 'm.b')}, 'k', m.k, 'o', m.o))[0])"
    df = df.withColumn("_hot", F.expr(f"transform(_fc, c -> {candidate})"))
    df = _spans(df, "_sa", "_text", ASSIGN, "_fa", "'assign'", "0", ok=f"char_length(_g2[j]) >= {ASSIGN_LEAST}")
    df = _spans(df, "_sk", "_text", ACCESS, "_fk", "'access'", "1")
    df = _spans(df, "_sh", "_text", HEX, "_fh", "'hex'", "2")
    # most texts have no hot candidate: they are not split
    df = df.withColumn("_fe", F.expr("if(exists(_hot, h -> h.h.first is not null), _fc, cast(array() as array<string>))"))
    df = _spans(df, "_se", "_text", CANDIDATE, "_fe", "_hot[j].k", "_hot[j].o", ok="_hot[j].h.first is not null", first="_hot[j].h.first", last="_hot[j].h.last")
    df = df.withColumn("_all", F.expr("array_sort(concat(_sa, _sk, _sh, _se))"))
    out = F.expr("transform(_all, x -> named_struct('start', x.s, 'end', x.e, 'kind', x.kind))")
    return df.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)], out.alias("secrets"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that scan() reports replaced by `mark`, spans that meet or overlap by one.

    All columns, whatever their names, come back as they were but for the text; a null text stays null,
    a text without spans as it is, and an empty table empty.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    text = f"_c{docs.columns.index(text_col)}"
    df = scan(named, text)
    # spans come ordered by start: a gap begins with one that no earlier span reaches and ends where the last before the next gap does
    df = df.withColumn("_reach", F.expr(sums_before("transform(secrets, x -> x.end)", "-1", "greatest({0}, {1})")))
    df = df.withColumn("_begin", F.expr("filter(transform(secrets, (x, i) -> if(x.start > _reach[i], i, -1)), i -> i >= 0)"))
    end = "if(k < size(_begin) - 1, _reach[_begin[k + 1]], greatest(_reach[size(secrets) - 1], secrets[size(secrets) - 1].end))"
    df = df.withColumn("_gaps", F.expr(f"transform(_begin, (i, k) -> named_struct('s', secrets[i].start, 'e', {end}))"))
    before = f"transform(_gaps, (g, i) -> concat(substring({text}, if(i = 0, 0, _gaps[i - 1].e) + 1, g.s - if(i = 0, 0, _gaps[i - 1].e)), {sql_text(mark)}))"
    new = F.expr(f"if(size(_gaps) = 0, {text}, concat(array_join({before}, ''), substring({text}, element_at(_gaps, -1).e + 1)))")
    return df.select(*[(new if f"_c{i}" == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "secrets")
    base = found.withColumn("_base", F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex")))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return base.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("secrets").alias("spans"))
