"""All registered engine queries and their SQL oracles.

Each query applies an operator to whole tables; the tables hold prose, pages, events and a
star schema, so documents stand in for files, events of a user for a path through a program,
and the star schema's keys for graph edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as fx
from .operators import conditions as cond
from .operators import dataflow as flow
from .operators import flowstats, legacy, matching, nodes, tokens
from .plans.rules import load_rules, rules_frame
from .sources import files as src
from .sources import reports
from .streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = r"""
rules:
  - {id: mail.address, message: "address $1", severity: warning, confidence: high, languages: [generic], pattern-regex: '([A-Za-z0-9._]+)@[a-z0-9]+\.[a-z]{2,}'}
  - {id: license.line, message: license, severity: info, confidence: medium, languages: [generic], pattern-regex: 'Licensed under the ([A-Za-z]+) License'}
  - {id: secret.assign, message: "secret $1", severity: error, confidence: high, languages: [generic], pattern-regex: '(token|password|key) = "[^"]+"'}
"""
MAIL, LICENSE, SECRET = r"([A-Za-z0-9._]+)@[a-z0-9]+\.[a-z]{2,}", r"Licensed under the ([A-Za-z]+) License", r"(token|password|key) = \"[^\"]+\""
SQL_RULES = rf"""(values ('mail.address', '{MAIL}', 'warning', 1, 'high'), ('license.line', '{LICENSE}', 'info', 0, 'medium'), ('secret.assign', '(token|password|key) = "[^"]+"', 'error', 2, 'high')) r(rule_id, re, severity, ord, confidence)"""
SQL_FOUND = f"(select doc_id, rule_id, severity, ord, confidence, unnest(regexp_extract_all(text, re)) as matched from documents, {SQL_RULES})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rule_matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rules, _ = load_rules(RULES)
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = matching.evaluate(docs, rules, "doc_id", "text", None)
    return matching.findings(found, rules_frame(spark, rules), "doc_id"), docs


@query(f"select rule_id, severity, confidence, cast(count(*) as bigint) as n, cast(count(distinct doc_id) as bigint) as docs from {SQL_FOUND} group by all")
def scan_rules(spark, sf):
    found, _ = rule_matches(spark, sf)
    return found.groupBy("rule_id", "severity", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"select doc_id, rule_id, matched, cast(count(*) as bigint) as n from {SQL_FOUND} group by all")
def regex_scan_rows(spark, sf):
    found, _ = rule_matches(spark, sf)
    return found.groupBy("doc_id", "rule_id", "matched").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '{MAIL}')) as bigint) as n from documents")
def regex_scan_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(MAIL)).cast("long").alias("n"))


@query(f"select doc_id, rule_id, severity, cast(count(*) as bigint) as n from {SQL_FOUND} where ord >= 1 and confidence = 'high' group by all")
def severity_floor(spark, sf):
    found, _ = rule_matches(spark, sf)
    return found.where("severity_ord >= 1 and confidence_ord >= 2").groupBy("doc_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"select severity, cast(count(*) as bigint) as n, cast(count(*) filter (confidence = 'high') as bigint) as sure, bool_or(severity in ('error', 'critical')) as blocking from {SQL_FOUND} group by 1")
def severity_summary(spark, sf):
    found, _ = rule_matches(spark, sf)
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("sure"), F.bool_or(F.col("severity").isin("error", "critical")).alias("blocking"))


@query(f"select doc_id, rule_id, case when rule_id = 'mail.address' then 'address ' || regexp_extract(matched, '{MAIL}', 1) when rule_id = 'secret.assign' then 'secret ' || regexp_extract(matched, '^([a-z]+)', 1) else 'license' end as message, cast(count(*) as bigint) as n from {SQL_FOUND} group by all")
def capture_message(spark, sf):
    found, _ = rule_matches(spark, sf)
    return found.groupBy("doc_id", "rule_id", "message").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, cast(line as bigint) as line, cast(col as bigint) as col from (select doc_id, length(p) - length(replace(p, chr(10), '')) + 1 as line, length(string_split(p, chr(10))[-1]) + 1 as col from
  (select doc_id, substr(text, 1, strpos(text, 'token') - 1) as p from documents where strpos(text, 'token') > 0))""")
def line_col_of_match(spark, sf):
    d = read(spark, sf, "documents").where(F.contains("text", F.lit("token"))).withColumn("at", F.instr("text", "token"))
    return d.select("doc_id", fx.line_of(F.col("text"), F.col("at")).cast("long").alias("line"), fx.column_of(F.col("text"), F.col("at")).cast("long").alias("col"))


TWO = 'rules: [{id: either, message: m, severity: info, languages: [generic], pattern-either: [{pattern-regex: "token = .[0-9a-f]+"}, {pattern-regex: "[a-z]+ = .[0-9a-f]{8,}"}]}]'


@query("""select doc_id, matched, cast(count(*) as bigint) as n from (
  select doc_id, unnest(regexp_extract_all(text, '[a-z]+ = .[0-9a-f]{8,}')) as matched from documents
  union all select doc_id, matched from (select doc_id, unnest(regexp_extract_all(text, 'token = .[0-9a-f]+')) as matched from documents) where length(matched) < 17) group by all""")
def either_dedup(spark, sf):
    rules, _ = load_rules(TWO)
    found = matching.evaluate(read(spark, sf, "documents").select("doc_id", "text"), rules, "doc_id", "text", None)
    return found.groupBy("doc_id", "matched").agg(F.count(F.lit(1)).alias("n"))


LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line from documents)"


def lines(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def rule_counts(spark, sf, yaml: str, **how):
    """Matches of YAML rules a document, by the engine."""
    rules, _ = load_rules(yaml)
    found = matching.evaluate(read(spark, sf, "documents").select("doc_id", "text"), rules, "doc_id", "text", None, **how)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


NOT_RULE = r"""rules: [{id: no.digits, message: m, severity: info, languages: [generic], patterns: [{pattern-regex: '(?m)^.*\bthe .*$'}, {pattern-not-regex: '[0-9]'}]}]"""


@query(f"select doc_id, cast(count(*) as bigint) as n from {LINES} where regexp_matches(line, '\\bthe ') and not regexp_matches(line, '[0-9]') group by 1")
def pattern_not(spark, sf):
    return rule_counts(spark, sf, NOT_RULE)


@query(f"select doc_id, cast(count(*) as bigint) as n from {LINES} where not regexp_matches(ltrim(line, ' '), '^(#|//|/\\*)') and contains(line, '###') group by 1")
def comment_suppressed_lines(spark, sf):
    return lines(spark, sf).where(~fx.is_comment(F.col("line")) & F.contains("line", F.lit("###"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


ALL_RULE = r"""rules: [{id: all, message: m, severity: info, languages: [generic], patterns: [{pattern-regex: 'Licensed under the [A-Za-z]+ License'}, {pattern-regex: '[A-Za-z]+ License'}, {pattern-inside: {pattern-regex: '(?m)^.*Licen.e.*$'}}]}]"""


@query("select doc_id, cast(count(*) as bigint) as n from (select doc_id, unnest(regexp_extract_all(text, 'Licensed under the [A-Za-z]+ License')) from documents) group by 1")
def patterns_all(spark, sf):
    """Of a list that must all hold, the first entry's matches that overlap the others' and lie in an enclosing line."""
    return rule_counts(spark, sf, ALL_RULE)


UNION_RULE = r"""rules: [{id: union, message: m, severity: info, languages: [generic], patterns: [{pattern-regex: 'Licensed under the [A-Za-z]+ License'}, {pattern-regex: '[A-Za-z]+ License'}, {pattern-not-regex: 'License'}]}]"""


@query("select doc_id, cast(count(*) as bigint) as n from (select doc_id, unnest(regexp_extract_all(text, 'Licensed under the [A-Za-z]+ License')) from documents union all select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+ License')) from documents) group by 1")
def patterns_union(spark, sf):
    """The same kind of list read as a union: all entries' matches, and negative entries do nothing."""
    return rule_counts(spark, sf, UNION_RULE, combine="union")


TOKEN_RE = r"\.\.\.|\.\.?|[+\-*/%=<>!&|^~?:;,()\[\]{}]|[^ \t\n\r+\-*/%=<>!&|^~?:;,()\[\]{}.]+"
SQL_TOKENS = f"""(select doc_id, i, case when m = '..' then '.' else m end as tok, gap_end as s, gap_end + case when m = '..' then 1 else length(m) end as e from (
  select doc_id, i, m, sum(length(g) + length(m)) over (partition by doc_id order by i) - length(m) as gap_end from (
    select doc_id, unnest(m) as m, unnest(g[1:len(m)]) as g, unnest(range(len(m))) as i from (select doc_id, regexp_extract_all(text, '{TOKEN_RE}') as m, string_split_regex(text, '{TOKEN_RE}') as g from documents))))"""


@query(f"""with t as {SQL_TOKENS},
w as (select *, lead(tok) over x as nxt, count(*) over (partition by doc_id) as n, max(e) over (partition by doc_id) as last, min(case when tok = 'of' then e end) over (partition by doc_id order by i rows between 1 following and unbounded following) as of from t window x as (partition by doc_id order by i)),
f as (select doc_id, 'assign' as rule_id, s, last as e from w where tok = 'token' and nxt = '=' and i + 2 < n union all select doc_id, 'call', s, of from w where tok = 'the' and of is not null),
p as (select f.*, left(d.text, f.s::bigint) as before from f join documents d using (doc_id))
select doc_id, rule_id, s::bigint as "start", e::bigint as "end", (1 + length(before) - length(replace(before, chr(10), '')))::int as start_line, (length(string_split(before, chr(10))[-1]) + 1)::int as start_column from p""")
def token_sequence_match(spark, sf):
    leaves = [("assign", 0, "simple", "token = $V", ["generic"]), ("call", 1, "simple", "the ... of", ["generic"])]
    found = tokens.match_leaves(read(spark, sf, "documents"), leaves, "doc_id", "text", None)
    return found.select("doc_id", "rule_id", "start", "end", "start_line", "start_column")


@query(f"select role, cast(sum(len(t)) as bigint) as tokens, cast(sum(len([x for x in t if x in ('.', '..', ',')])) as bigint) as marks from (select role, regexp_extract_all(text, '{TOKEN_RE}') as t from conversations) group by role")
def token_stream_stats(spark, sf):
    t = tokens.token_rows(read(spark, sf, "conversations"), "role", "text")
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("token").isin(".", ",")).alias("marks"))


@query(f"select conv_id, turn, cast(s as bigint) as stmt, cast(count(*) as bigint) as n from (select conv_id, turn, coalesce(sum(case when tok in ('.', '..') then 1 else 0 end) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0) as s from (select conv_id, turn, unnest(t) as tok, unnest(range(len(t))) as i from (select conv_id, turn, regexp_extract_all(text, '{TOKEN_RE}') as t from conversations))) group by all")
def statement_windows(spark, sf):
    t = tokens.token_rows(read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text"), "k", "text")
    return tokens.statement_numbers(t, ".", "k").groupBy("k.conv_id", "k.turn", "stmt").agg(F.count(F.lit(1)).alias("n"))


BOUND = """(select doc_id, unnest(regexp_extract_all(text, 'token = "([^"]+)"', 1)) as v from documents)"""


def bindings(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([^"]+)"'), F.lit(1))).alias("v"))
    return d.withColumn("bindings", F.create_map(F.lit("$V"), F.col("v")))


@query(f"select doc_id, v from {BOUND} where regexp_matches(v, '^[0-9a-f]+$') and regexp_matches(v, 'a')")
def metavar_regex(spark, sf):
    return bindings(spark, sf).where(cond.clause_column({"kind": "metavariable-regex", "spec": {"metavariable": "$V", "regex": "^[0-9a-f]+$"}}) & cond.name_condition(cond.bound("$V"), "*a*")).select("doc_id", "v")


@query("select event_id from events where case when try_cast(cast(value as varchar) as double) > 50 then true else false end and not contains(event_type, 'err')")
def metavar_compare(spark, sf):
    b = read(spark, sf, "events").withColumn("bindings", F.create_map(F.lit("$A"), F.col("value").cast("string"), F.lit("$T"), F.col("event_type")))
    return b.where(cond.compare(cond.bound("$A"), ">", "50") & ~cond.compare(cond.bound("$T"), "contains", "err")).select("event_id")


@query("select event_id from events where cast(event_id as double) % 7 = 3 and length(event_type) > 4")
def metavar_expression(spark, sf):
    b = read(spark, sf, "events").withColumn("bindings", F.create_map(F.lit("$N"), F.col("event_id").cast("string"), F.lit("$T"), F.col("event_type")))
    return b.where(cond.expression("int($N) % 7 == 3 and len($T) > 4")).select("event_id")


@query(f"select doc_id, v, round(h, 6) as h from (select doc_id, v, -list_sum([c / strlen(v) * log2(c / strlen(v)) for c in [length(v) - length(replace(v, x, '')) for x in list_distinct(string_split(v, ''))]]) as h from {BOUND}) where h between 2.5 and 5")
def entropy_filter(spark, sf):
    h = bindings(spark, sf).withColumn("h", cond.entropy(F.col("v")))
    return h.where("h between 2.5 and 5").select("doc_id", "v", F.round("h", 6).alias("h"))


@query(f"select doc_id, v, regexp_matches(v, '^[\\p{{L}}\\p{{N}}]*$') as alnum, strlen(v) = length(v) as ascii, try_cast(v as double) is not null as number, regexp_matches(v, '^[+-]?[0-9]+$') as whole from {BOUND}")
def charset_type(spark, sf):
    v = F.col("v")
    return bindings(spark, sf).select("doc_id", "v", cond.charset(v, "alphanumeric").alias("alnum"), cond.charset(v, "ascii").alias("ascii"), cond.type_condition(v, ["number"]).alias("number"), cond.type_condition(v, ["integer"]).alias("whole"))


@query("select page_id, case when ext in ('html', 'xml') then 'xml' when ext in ('js', 'ts') then 'javascript' when ext = 'py' then 'python' when ext = 'php' then 'php' end as language from (select page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as ext from pages)")
def language_dim_join(spark, sf):
    dim = src.languages(spark).where(F.col("ext").isin("xml", "js", "ts", "py", "php")).union(spark.createDataFrame([("html", "xml")], "ext string, language string"))
    return read(spark, sf, "pages").select("page_id", fx.extension(F.col("url")).alias("ext")).join(dim, "ext", "left").select("page_id", "language")


@query("select page_id, url from pages where (starts_with(url, 'http') and ends_with(url, '1') or contains(url, '2')) and not contains(url, '33')")
def include_exclude_glob(spark, sf):
    return read(spark, sf, "pages").where(fx.included(F.col("url"), ["http*1", "2"], ["33"])).select("page_id", "url")


@query("select page_id, cast(i - 1 as int) as ordinal, m[i] as snippet from (select page_id, m, unnest(range(1, len(m) + 1)) as i from (select page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) as m from pages))")
def embedded_snippets(spark, sf):
    return src.embedded(read(spark, sf, "pages"), '<a href="([^"]*)">', 1, "html").select("page_id", "ordinal", "snippet")


@query("select page_id, tag from (select distinct page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tag from pages) o where not exists (select 1 from (select distinct page_id, unnest(regexp_extract_all(html, '</([a-z][a-z0-9]*)', 1)) as tag from pages) c where c.page_id = o.page_id and c.tag = o.tag)")
def tag_open_close_anti(spark, sf):
    tag = lambda p: read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("tag")).distinct()
    return tag("<([a-z][a-z0-9]*)").join(tag("</([a-z][a-z0-9]*)"), ["page_id", "tag"], "left_anti")


def spans(spark, sf):
    """Intervals of orders: a line item is a span of its quantity, placed by its line number."""
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("file_id"), F.lit("r").alias("rule_id"), F.col("l_linenumber").cast("long").alias("no"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("end"))


SQL_SPANS = "(select l_orderkey as file_id, cast(l_linenumber as bigint) as no, cast(l_linenumber * 10 as bigint) as s, cast(l_linenumber * 10 + l_quantity as bigint) as e from lineitem)"


@query(f"select file_id, no from {SQL_SPANS} a where not exists (select 1 from {SQL_SPANS} b where b.file_id = a.file_id and a.s <= b.s and b.e <= a.e and (a.s < b.s or b.e < a.e))")
def child_first(spark, sf):
    return matching.innermost(spans(spark, sf), ["file_id"]).select("file_id", "no")


@query(f"select file_id, no from {SQL_SPANS} a where exists (select 1 from {SQL_SPANS} b where b.file_id = a.file_id and b.e - b.s > 40 and b.s <= a.s and a.e <= b.e)")
def inside(spark, sf):
    s = spans(spark, sf)
    return matching.contained(s, s.where(F.col("end") - F.col("start") > 40), "file_id").select("file_id", "no")


@query(f"select file_id, no from {SQL_SPANS} a where not exists (select 1 from {SQL_SPANS} b where b.file_id = a.file_id and b.e - b.s > 40 and b.s <= a.s and a.e <= b.e)")
def not_inside(spark, sf):
    s = spans(spark, sf)
    return matching.contained(s, s.where(F.col("end") - F.col("start") > 40), "file_id", wanted=False).select("file_id", "no")


@query(f"""with recursive o as (select *, row_number() over (partition by file_id order by e - s, s, no) as k from {SQL_SPANS}),
r(file_id, k, chosen) as (select distinct file_id, 0::bigint, []::struct(no bigint, s bigint, e bigint)[] from o
  union all select r.file_id, o.k, case when len(list_filter(r.chosen, lambda x: o.s < x.e and x.s < o.e)) = 0 then list_append(r.chosen, {{'no': o.no, 's': o.s, 'e': o.e}}) else r.chosen end from r join o on o.file_id = r.file_id and o.k = r.k + 1)
select file_id, x.no as no, x.s as "start", x.e as "end" from (select file_id, unnest(chosen) as x from (select file_id, arg_max(chosen, k) as chosen from r group by 1))""")
def smallest_span(spark, sf):
    return matching.smallest_spans(spans(spark, sf), ["file_id", "rule_id"]).select("file_id", "no", "start", "end")


RANKED = "(select user_id, event_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as i from events)"


def ranked(spark, sf):
    return read(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"))


@query(f"select a.event_id from {RANKED} a where a.event_type = 'purchase' and not exists (select 1 from {RANKED} b where b.user_id = a.user_id and b.event_type = 'view' and a.i - b.i between 1 and 3)")
def guard_within_n(spark, sf):
    r = ranked(spark, sf)
    return legacy.unguarded(r.where("event_type = 'purchase'"), r.where("event_type = 'view'"), ["user_id"], "i", 3).select("event_id")


@query(f"select event_id, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by i rows between 2 preceding and current row) as near_error from {RANKED}")
def lookback_flag(spark, sf):
    return ranked(spark, sf).select("event_id", legacy.seen_lately(F.col("event_type") == "error", ["user_id"], ["i"], 2).alias("near_error"))


@query(f"select event_id from (select event_id, event_type, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c from {RANKED} window w as (partition by user_id order by i)) where event_type = 'click' and b = 'view' and c = 'purchase'")
def sibling_sequence(spark, sf):
    return matching.consecutive(ranked(spark, sf), ["user_id"], ["i"], "event_type", ["click", "view", "purchase"]).select("event_id")


@query("select conv_id, turn from (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as nxt from conversations) where role = 'user' and nxt = 'assistant'")
def turn_sequence(spark, sf):
    return matching.consecutive(read(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", ["user", "assistant"]).select("conv_id", "turn")


def star_edges(spark, sf):
    """region -> nation -> supplier and customer, as one id space."""
    t = lambda n: read(spark, sf, n)
    a = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    b = t("supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    c = t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return a.union(b).union(c)


SQL_EDGES = "e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier union all select 'n' || c_nationkey, 'c' || c_custkey from customer)"


@query(f"with recursive {SQL_EDGES}, w(start, node, hops) as (select 'r' || r_regionkey, 'r' || r_regionkey, 0 from region union select w.start, e.dst, w.hops + 1 from w join e on w.node = e.src) select start, node, min(hops) as hops from w group by all")
def graph_reachability(spark, sf):
    starts = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return flow.reachable(star_edges(spark, sf), starts)


@query(f"with {SQL_EDGES} select a.src as start, b.dst as target, a.src || '>' || a.dst || '>' || b.dst as path from e a join e b on a.dst = b.src where starts_with(b.dst, 's')")
def simple_paths(spark, sf):
    starts = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    targets = read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    p = flow.simple_paths(star_edges(spark, sf), starts, targets)
    return p.select(F.element_at("path", 1).alias("start"), F.col("node").alias("target"), F.array_join("path", ">").alias("path"))


@query(f"with {SQL_EDGES} select dst as node, n_name as value from e join nation on src = 'n' || n_nationkey union all select 'n' || n_nationkey, n_name from nation")
def constant_propagation(spark, sf):
    known = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("value"))
    return flow.propagate_constants(star_edges(spark, sf), known)


def event_graph(spark, sf):
    """Each user's events as one path; `graph` is the user, whom no edge leaves."""
    r = ranked(spark, sf).withColumns({"nxt": F.lead("event_id").over(Window.partitionBy("user_id").orderBy("i")), "graph": F.col("user_id")})
    edges = r.where("nxt is not null").select(F.col("event_id").alias("src"), F.col("nxt").alias("dst"), "graph")
    sources = r.where("event_type = 'signup'").select(F.col("event_id").alias("node"), F.lit("XSS").alias("vulnerability_type"), F.lit(0.9).alias("confidence"), "graph")
    clean = r.where("event_type = 'view'").select(F.col("event_id").alias("node"), F.lit(0.2).alias("effectiveness"), F.array(F.lit("XSS")).alias("vulnerability_types"), "graph")
    sinks = r.where("event_type in ('purchase', 'error')").select(F.col("event_id").alias("node"), F.lit("XSS").alias("vulnerability_type"))
    return edges, sources, clean, sinks


SQL_TAINT = f"""with recursive r as materialized {RANKED}, t(source, node, u, i, conf, n) as (
  select event_id, event_id, user_id, i, 0.9::double, 1 from r where event_type = 'signup'
  union all select source, event_id, u, i, conf, n from (select t.source, r.event_id, t.u, r.i, t.conf * case when r.event_type = 'view' then 1 - 0.2::double else 1::double end as conf, t.n + 1 as n from t join r on r.user_id = t.u and r.i = t.i + 1) where conf >= 0.1)"""


@query(SQL_TAINT + " select source, node, round(conf, 6) as confidence, n as length from t")
def taint_propagation(spark, sf):
    edges, sources, clean, _ = event_graph(spark, sf)
    t = flow.taint(edges, sources, clean, "graph")
    return t.select("source", "node", F.round("confidence", 6).alias("confidence"), F.size("path").alias("length"))


@query(SQL_TAINT + """, k as (select t.source, t.node, t.conf, (select count(*) from r v where v.user_id = t.u and v.event_type = 'view' and v.i between t.i - t.n + 1 and t.i) as views from t join r on r.event_id = t.node where r.event_type in ('purchase', 'error') and t.n > 1 and t.conf > 0.5)
select source, node as sink, round(conf * pow(0.8, views), 6) as confidence, true as vulnerable from k where conf * pow(0.8, views) > 0.5""")
def taint_flows(spark, sf):
    edges, sources, clean, sinks = event_graph(spark, sf)
    f = flow.flows(flow.taint(edges, sources, clean, "graph"), sinks, clean)
    return f.select("source", "sink", F.round("confidence", 6).alias("confidence"), "vulnerable")


@query("""select event_id, case when event_type = 'view' then 'Sanitized' when event_type = 'error' then 'Unknown' else 'Cross-Site Scripting' end as category,
  case when event_type = 'view' then 'Info' when a = 'High' and b = 'Critical' then 'Critical' when a = 'High' and b = 'High' or a = 'Medium' and b = 'Critical' then 'High' when a = 'Medium' and b = 'High' then 'Medium' else 'Low' end as severity
  from (select *, ['High', 'Medium', 'Low'][event_id % 3 + 1] as a, ['Critical', 'High', 'Medium', 'Low'][event_id // 3 % 4 + 1] as b from events)""")
def flow_severity(spark, sf):
    f = read(spark, sf, "events").select("event_id", "event_type", "value", F.when(F.col("event_type") == "error", "OTHER").otherwise("XSS").alias("vulnerability_type"), (F.col("event_type") != "view").alias("vulnerable"))
    level = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    s = flow.flow_severity(level(("High", "Medium", "Low"), F.col("event_id") % 3), level(("Critical", "High", "Medium", "Low"), F.floor(F.col("event_id") / 3) % 4), F.col("vulnerable"))
    return flow.describe_flows(f.withColumn("level", s), spark).select("event_id", "category", F.col("level").alias("severity"))


@query("select event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high, median(value) as middle from events group by 1")
def duration_stats(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.median("value").alias("middle"))


@query("select user_id, cast(count(*) filter (event_type = 'error') as bigint) as errors, cast(count(*) filter (event_type = 'view') as bigint) as views, coalesce(cast(count(*) filter (event_type = 'error') as double) / nullif(count(*), 0), 0) as rate, max_by(event_type, event_id) as last_type from events group by 1")
def rule_stats(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("views"), (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("rate"), F.max_by("event_type", "event_id").alias("last_type"))


@query("select user_id, round(0.9::double * list_reduce(list_prepend(1.0::double, list(1 - value / 1000 order by event_id)), lambda a, b: a * b), 6) as confidence from events where event_type = 'view' group by 1")
def sanitizer_decay(spark, sf):
    v = read(spark, sf, "events").where("event_type = 'view'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") / 1000).alias("e")))).alias("l"))
    return v.select("user_id", F.round(fx.remaining(F.lit(0.9), F.col("l.e")), 6).alias("confidence"))


@query("select event_id, cast(floor(90 * (1 - least(0.05::double * (event_id % 9), 0.3::double))) as int) as confidence from events")
def enhanced_confidence(spark, sf):
    return read(spark, sf, "events").select("event_id", flow.enhanced_step(F.lit(90), F.col("event_id") % 9).alias("confidence"))


@query("select p_partkey, p_name, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def marketplace_topk(spark, sf):
    return read(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name", "p_retailprice")


@query("select p_brand, round(avg(p_size) filter (p_size between 0 and 30), 6) as rating, cast(count(*) as bigint) as n from part group by 1")
def rating_avg(spark, sf):
    r = flowstats.mean_rating(read(spark, sf, "part").withColumnRenamed("p_size", "rating"), ["p_brand"], 0, 30)
    return r.select("p_brand", F.round("mean", 6).alias("rating"), "n")


@query("select tag, cast(count(*) as bigint) as n, min(p_partkey) as first_part from (select p_partkey, unnest(string_split(p_type, ' ')) as tag from part) group by 1")
def tag_index(spark, sf):
    return flowstats.tag_index(read(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.split("p_type", " ").alias("tags"))).withColumnRenamed("first_rule", "first_part")


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def job_pagination(spark, sf):
    return read(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderdate")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01'")
def retention_cutoff(spark, sf):
    return feeds.retained(read(spark, sf, "orders"), "1996-01-01", "o_orderdate").select("o_orderkey")


@query("select p_brand, p_type, cast(count(*) as bigint) as n, cast(grouping(p_brand) as int) as all_brands from part group by cube (p_brand, p_type)")
def grouping_sets(spark, sf):
    return read(spark, sf, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("p_brand").cast("int").alias("all_brands"))


@query("select conv_id, turn, cast(i - 1 as int) as position, a[i] as argument, 'p' || (i - 1) as parameter from (select conv_id, turn, a, unnest(range(1, len(a) + 1)) as i from (select conv_id, turn, string_split(text, ' ') as a from conversations))")
def call_param_zip(spark, sf):
    """Each turn calls, with its words, the function of its role that has as many parameters."""
    calls = read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("call_id"), F.col("role").alias("name"), F.lit("text").alias("language"), F.split("text", " ").alias("arguments"))
    functions = calls.select("name", "language", F.size("arguments").alias("param_count")).distinct().withColumn("parameters", F.expr("transform(sequence(0, param_count - 1), i -> concat('p', i))"))
    return flow.zip_arguments(calls, functions).select("call_id.conv_id", "call_id.turn", "position", "argument", "parameter")


@query("select doc_id, case when ends_with(s, ';') then s else s || ';' end as sql from (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '#\\{[^}]+\\}', '1', 'g'), '\\$\\{[^}]+\\}', 'T0', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as s from documents)")
def normalize_sql(spark, sf):
    """Every document; a null text stays null."""
    return read(spark, sf, "documents").select("doc_id", fx.normalize_sql(F.col("text")).alias("sql"))


@query("select o_orderkey, case when o_orderpriority like '1%' then 'error' when o_orderpriority like '2%' then 'warning' when o_orderpriority like '3%' then 'info' else 'warning' end as severity from orders")
def severity_alias(spark, sf):
    p = F.left("o_orderpriority", F.lit(1))
    word = F.when(p == "1", "HIGH").when(p == "2", "MEDIUM").when(p == "3", "LOW").otherwise("OTHER")
    return read(spark, sf, "orders").select("o_orderkey", fx.severity_alias(word).alias("severity"))


@query("select v, case when regexp_matches(v, '^-?[0-9]+$') then 'integer' when v in ('true', 'false') then 'boolean' else 'none' end as kind from (select distinct cast(l_linenumber as varchar) as v from lineitem union select distinct l_returnflag from lineitem)")
def literal_folding(spark, sf):
    li = read(spark, sf, "lineitem")
    v = li.select(F.col("l_linenumber").cast("string").alias("v")).union(li.select("l_returnflag")).distinct()
    return v.select("v", fx.literal_kind(F.col("v")).alias("kind"))


@query("""with s as (select doc_id, case when text like '%@%' then 'mail.address' end as a, regexp_extract(text, '""" + MAIL + """') as m, regexp_extract(text, '""" + LICENSE + """') as l, regexp_extract(text, '(token|password|key) = "[^"]+"') as k from documents)
select doc_id, 'mail.address' as rule_id, m as first_match from s where m <> '' union all select doc_id, 'license.line', l from s where l <> '' union all select doc_id, 'secret.assign', k from s where k <> ''""")
def first_match(spark, sf):
    found, _ = rule_matches(spark, sf)
    return nodes.dedup(found, ["doc_id", "rule_id"], ["start", "end"]).select("doc_id", "rule_id", F.col("matched").alias("first_match"))


def placed_findings(spark, sf):
    found, _ = rule_matches(spark, sf)
    return found.withColumn("path", F.concat(F.lit("documents/"), "doc_id"))


#: The same findings in SQL: the text between matches is split off by the same expression, and lengths add up.
SQL_PLACED = f"""(select doc_id, rule_id, severity, confidence, 'documents/' || doc_id as path, m as matched, message,
  (1 + length(b) - length(replace(b, chr(10), '')))::int as start_line, (length(string_split(b, chr(10))[-1]) + 1)::int as start_column,
  (1 + length(b || m) - length(replace(b || m, chr(10), '')))::int as end_line, (length(string_split(b || m, chr(10))[-1]) + 1)::int as end_column from (
  select *, left(text, (coalesce(list_sum([length(x) for x in g[1:j]]), 0) + coalesce(list_sum([length(x) for x in ms[1:j - 1]]), 0))::bigint) as b, ms[j] as m,
    case rule_id when 'mail.address' then 'address ' || regexp_extract(ms[j], '{MAIL}', 1) when 'secret.assign' then 'secret ' || regexp_extract(ms[j], '^([a-z]+)', 1) else 'license' end as message from (
    select *, unnest(range(1, len(ms) + 1)) as j from (select doc_id, text, rule_id, severity, confidence, regexp_extract_all(text, re) as ms, string_split_regex(text, re) as g from documents, {SQL_RULES}))))"""


@query(f"""select rule_id, to_json({{'ruleId': rule_id, 'level': case severity when 'critical' then 'error' when 'info' then 'note' else severity end, 'message': {{'text': message}},
  'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}}, 'region': {{'startLine': start_line, 'startColumn': start_column, 'endLine': end_line, 'endColumn': end_column}}}}}}]}})::varchar as result from {SQL_PLACED}""")
def sarif_json(spark, sf):
    return reports.sarif_results(placed_findings(spark, sf))


@query("select c_custkey as use_id, n_name as node_id from customer join nation on c_nationkey = n_nationkey")
def scope_resolution(spark, sf):
    """Customers use a name; it is defined in their nation's scope, and again further out in the region's."""
    n = read(spark, sf, "nation")
    scopes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("scope_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id")).union(n.select(F.concat(F.lit("r"), "n_regionkey"), F.lit(None).cast("string")).distinct())
    symbols = n.select(F.concat(F.lit("n"), "n_nationkey").alias("scope_id"), F.lit("x").alias("name"), F.col("n_name").alias("node_id")).union(n.select(F.concat(F.lit("r"), "n_regionkey"), F.lit("x"), F.lit("region")).distinct())
    uses = read(spark, sf, "customer").select(F.col("c_custkey").alias("use_id"), F.concat(F.lit("n"), "c_nationkey").alias("scope_id"), F.lit("x").alias("name"))
    return flow.resolve_scopes(uses, scopes, symbols).select("use_id", "node_id")



@query("select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by lang, source order by doc_id) as n from documents) where n = 1")
def finding_dedup(spark, sf):
    return nodes.dedup(read(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


@query("select event_id from events where event_type = 'error' and user_id in (select user_id from events where event_type = 'signup')")
def source_sink_semi(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type")
    return nodes.sinks_with_source(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), ["user_id"]).select("event_id")


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def baseline_anti(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return nodes.new_findings(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_custkey"]).select("o_orderkey")


@query("select doc_id, rule_id, matched from " + SQL_FOUND + " order by doc_id, rule_id, matched limit 15")
def max_findings(spark, sf):
    found, _ = rule_matches(spark, sf)
    return nodes.first_findings(found.select("doc_id", "rule_id", "matched"), 15, ["doc_id", "rule_id", "matched"])


@query("select doc_id, cast(n + 1 as int) as start_line from (select doc_id, unnest(l) as line, unnest(range(len(l))) as n from (select doc_id, string_split(text, chr(10)) as l from documents)) where regexp_matches(line, 'token\\s+=\\s+\\S+') and not regexp_matches(ltrim(line, ' '), '^(#|//|/\\*)') and not regexp_matches(line, '(#|//).*token\\s+=')")
def line_pattern(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("source"))
    return nodes.line_matches(d, "token = $VALUE").select(F.col("file_id").alias("doc_id"), "start_line")


@query("""select page_id, contains(html, 'innerHTML') or contains(html, 'outerHTML') or contains(html, 'insertAdjacentHTML') as js_sink, contains(html, 'location.search') or contains(html, 'location.hash') or contains(html, 'document.referrer') as js_source,
  case when contains(html, 'Laravel') then 'Laravel' when contains(html, 'Symfony') then 'Symfony' when contains(html, 'CodeIgniter') then 'CodeIgniter' when contains(html, 'Zend') then 'Zend' end as framework,
  contains(html, '$_GET') or contains(html, '$_POST') or contains(html, '$_REQUEST') or contains(html, '$_COOKIE') or contains(html, 'file_get_contents') or contains(html, 'fread') as tainted_input,
  concat_ws(',', case when regexp_matches(html, '(import.*react|React\\.|jsx|useState|useEffect)') then 'React' end, case when regexp_matches(html, '(Vue\\.|new Vue|v-|@click|<template>)') then 'Vue' end,
    case when regexp_matches(html, '(@Component|@Injectable|angular|ng-)') then 'Angular' end, case when regexp_matches(html, '(\\$\\(|\\$\\.|jQuery)') then 'jQuery' end) as js_frameworks, case when contains(html, '??') then '7.0+' when contains(html, '::class') then '5.5+' else '5.0+' end as php_version from pages""")
def web_features(spark, sf):
    return nodes.web_features(read(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", "js_sink", "js_source", "php_version", "framework", "tainted_input", F.concat_ws(",", "js_frameworks").alias("js_frameworks"))


@query("with recursive " + SQL_EDGES + ", w(node, source, confidence, length) as (select 'r' || r_regionkey, 'r' || r_regionkey, 90, 1 from region union all select e.dst, w.source, cast(floor(w.confidence * (1 - least(0.05::double * w.length, 0.3::double))) as int), w.length + 1 from w join e on w.node = e.src) select node, source, confidence, length from w where confidence > 30")
def enhanced_taint(spark, sf):
    starts = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(90).alias("confidence"))
    return flow.enhanced_taint(star_edges(spark, sf), starts)


@query("with recursive " + SQL_EDGES + ", w(f, s, c) as (select 'r' || r_regionkey, 'r' || r_regionkey, 0.8::double from region union all select e.dst, w.s, w.c * 0.9::double from w join e on w.f = e.src) select f as function, s as source, round(c, 6) as confidence from w")
def interprocedural_taint(spark, sf):
    starts = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("function"), F.concat(F.lit("r"), "r_regionkey").alias("source"), F.lit(0.8).alias("confidence"))
    calls = star_edges(spark, sf).toDF("caller", "callee")
    return flow.interprocedural(calls, starts).select("function", "source", F.round("confidence", 6).alias("confidence"))


@query("with " + SQL_EDGES + " select 'r' || r_regionkey as function, 'r' || r_regionkey as path from region union all select e.dst, e.src || '>' || e.dst from e where starts_with(e.src, 'r') union all select b.dst, a.src || '>' || a.dst || '>' || b.dst from e a join e b on a.dst = b.src")
def shortest_call_path(spark, sf):
    starts = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("function"))
    return flow.shortest_call_path(star_edges(spark, sf).toDF("caller", "callee"), starts).select("function", F.array_join("path", ">").alias("path"))


@query("select user_id, round(cast(count(*) filter (value > 50) as double) / count(*), 6) as hit_rate, round(max(value), 4) as peak from events group by 1")
def cache_hit_rate(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("hit_rate"), F.round(F.max("value"), 4).alias("peak"))


@query("select p_name, cast(count(*) as bigint) as n from part group by 1 having count(*) > 1")
def duplicate_rule_ids(spark, sf):
    return read(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select event_type, cast(count(distinct user_id) as bigint) as users, percentile_disc(0.5) within group (order by value) as mid from events group by 1")
def distinct_and_percentile(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.expr("percentile_disc(0.5) within group (order by value)").alias("mid"))


@query("select date_trunc('hour', ts) as hour, event_type, cast(count(*) as bigint) as n from events group by all")
def windowed_counts(spark, sf):
    return feeds.windowed_counts(read(spark, sf, "events")).select(F.col("window.start").alias("hour"), "event_type", "n")

from . import catalog_more, catalog_rules  # noqa: E402,F401  (they register their queries)
