"""Registered queries of rules by the thousand, statements of languages without semicolons, and taint over functions and labels.

As in the other catalogs each applies an operator to whole tables, and programs are written from their rows first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import ORACLES, RANKED, query, ranked, read
from .catalog_more import SQL_SNIPPETS, code_files, programs
from .functions import text as fx
from .functions.types import type_compatible
from .operators import matching, merging, nodes, syntax, taint_rules, tokens
from .plans.rules import DEFAULTS, default_rules, load_rules
from .sources import embedded_sql, plugins
from .streaming import feeds

# many rules ---------------------------------------------------------------------------------------


@query("""with b as (select item_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark),
r as (select 'item' || item_id || '.' || i as rule_id, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select item_id, w, unnest(range(1, len(w) - 1)) as i from b)),
m as (select rule_id, doc_id, len(regexp_extract_all(text, a || '[^A-Za-z]+' || b || '[^A-Za-z]+' || c)) as n from documents join r on contains(text, a) and contains(text, b) and contains(text, c))
select rule_id, sum(n)::bigint as n, count(*)::bigint as docs from m where n > 0 group by 1""")
def many_rules(spark, sf):
    """A rule for every three words in a row of every benchmark item, all at once over all documents."""
    rules = []
    for r in read(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).toLocalIterator():
        rules += [tokens.Leaf(f"item{r.item_id}.{i + 1}", 0, "regex", "[^A-Za-z]+".join(r.w[i : i + 3]), ("generic",)) for i in range(len(r.w) - 2)]
    found = tokens.match_leaves(read(spark, sf, "documents").select("doc_id", "text"), rules, "doc_id", "text", None)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


_LANGUAGES = list(DEFAULTS)
_DEFAULT_LINES = [(lang, rule_id, text) for lang, (rule_id, _, _, _, texts) in DEFAULTS.items() for text in texts]


@query("with t as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _DEFAULT_LINES) + f""" ), p as (select page_id, ([{', '.join(repr(x) for x in _LANGUAGES)}])[page_id % {len(_LANGUAGES)} + 1] as language from pages)
select page_id, language, t.col1 as rule_id, count(*) as n from p join t on language = t.col0 group by all""")
def default_rule_findings(spark, sf):
    """Each language's own rule, where no rules were loaded, on a line for each of its texts; a page gives the language."""
    language = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (F.col("page_id") % len(_LANGUAGES) + 1).cast("int"))
    text = F.lit("")
    for name in _LANGUAGES:
        wanted = "\n".join(f"x ; {t} y" for lang, _, t in _DEFAULT_LINES if lang == name)
        text = F.when(language == name, F.lit(wanted)).otherwise(text)
    pages = read(spark, sf, "pages").select("page_id", language.alias("language"), text.alias("source"))
    found = matching.evaluate(pages, [r for name in _LANGUAGES for r in default_rules(name)], "page_id")
    return found.join(pages.select("page_id", "language"), "page_id").groupBy("page_id", "language", "rule_id").agg(F.count(F.lit(1)).alias("n"))


# statements ---------------------------------------------------------------------------------------

_SHELL = """(select user_id as file_id, i, event_type as t, event_id % 4 as a, event_id // 4 % 4 as b from {ranked})"""


@query(f"""with p as {_SHELL.format(ranked=RANKED)}
select file_id, i as start_line, 'assignment' as node_type, case t when 'signup' then 'v' || a || '=$(get v' || b || ')' when 'click' then 'v' || a || '=$v' || b else 'w=' || a || ';' end as text from p where t in ('signup', 'click', 'view')
union all select file_id, i, 'if_statement', 'if [ $v' || b || ' ];' from p where t = 'view'
union all select file_id, i, 'call_expression', '$(get v' || b || ')' from p where t = 'signup'""")
def shell_statements(spark, sf):
    """Assignments, conditions and substitutions of shell programs, whose statements end with their lines."""
    v, u, t = F.concat(F.lit("v"), F.col("event_id") % 4), F.concat(F.lit("$v"), F.floor(F.col("event_id") / 4) % 4), F.col("event_type")
    bare = F.substring(u, 2, 9)
    line = F.when(t == "signup", F.concat(v, F.lit("=$(get "), bare, F.lit(")"))).when(t == "click", F.concat(v, F.lit("="), u)).when(t == "view", F.concat(F.lit("if [ "), u, F.lit(" ]; then w="), F.col("event_id") % 4, F.lit("; fi")))
    line = line.when(t == "purchase", F.concat(F.lit("run "), u, F.lit(' "a; b=1 {"'))).otherwise(F.lit("# no=1 ("))
    one = ranked(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))).alias("l"))
    files = one.select(F.col("user_id").alias("file_id"), F.lit("bash").alias("language"), F.array_join(F.col("l.line"), "\n").alias("source"))
    return syntax.parse(files).where("node_type in ('assignment', 'if_statement', 'call_expression')").select("file_id", "start_line", "node_type", "text")

# taint over labels and functions ------------------------------------------------------------------

_P = f"(select user_id, i, event_type as t, event_id, event_id % 4 as a, event_id // 4 % 4 as b, event_id // 16 % 4 as c from {RANKED})"
_V = "(select max(q.i) from p q where q.user_id = p.user_id and q.i < p.i and q.a = p.{0} and q.t in {1})"


def _programs(spark, sf, line, head=(), language=None):
    """A program a user: the head's lines, then line(event type, event id, names of three variables) of each event."""
    v = lambda n: F.concat(F.lit("v"), (F.floor(F.col("event_id") / n) % 4).cast("string"))
    rows = ranked(spark, sf).withColumn("line", line(F.col("event_type"), F.col("event_id"), v(1), v(4), v(16)))
    one = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    return one.select(F.col("user_id").alias("file_id"), (language if language is not None else F.lit("javascript")).alias("language"), F.concat_ws("\n", F.array(*map(F.lit, head)), F.col("l.line")).alias("source"))


LABEL_RULE = """rules: [{id: taint.labels, message: m, severity: error, languages: [javascript], mode: taint,
  pattern-sources: [{pattern: read(), label: A}, {patterns: [{pattern: 'get($K)'}, {metavariable-regex: {metavariable: $K, regex: 'b.*'}}], label: B}, {pattern: 'mark($X)', label: C, requires: A}],
  pattern-sinks: [{pattern: run($X), requires: '(A and not B) or C'}], pattern-sanitizers: [{pattern: clean($X)}]}]"""


@query(f"""with recursive p as materialized {_P},
d as materialized (select p.*, {_V.format('b', "('signup', 'click', 'view', 'error')")} as db, {_V.format('c', "('signup', 'click', 'view', 'error')")} as dc from p),
e as (select user_id, db as src, i as dst, t, event_id from d where (t = 'click' or t = 'view' and event_id % 3 > 0) and db is not null union select user_id, dc, i, t, event_id from d where t = 'click' and dc is not null),
r(user_id, label, i) as (select user_id, 'A', i from p where t = 'signup' union select user_id, 'B', i from p where t = 'error' and event_id % 2 = 0
  union select r.user_id, unnest(case when e.t = 'view' and r.label = 'A' then ['A', 'C'] else [r.label] end), e.dst from r join e on e.user_id = r.user_id and e.src = r.i),
s as (select d.user_id, d.i, list_sort(list(distinct r.label)) as labels from d join r on r.user_id = d.user_id and r.i = d.db where d.t = 'purchase' group by all)
select user_id as file_id, i as start_line, array_to_string(labels, ',') as labels from s where list_contains(labels, 'C') or list_contains(labels, 'A') and not list_contains(labels, 'B')""")
def taint_labels(spark, sf):
    """A rule with labels: two kinds of sources, a third where the first arrives, and sinks that ask for some and not for others."""
    rules, bad = load_rules(LABEL_RULE)
    line = lambda t, n, a, b, c: (
        F.when(t == "signup", F.concat(a, F.lit(" = read();"))).when(t == "error", F.concat(a, F.when(n % 2 == 0, " = get(bad);").otherwise(" = get(good);"))).when(t == "click", F.concat(a, F.lit(" = "), b, F.lit(" + "), c, F.lit(";")))
        .when(t == "view", F.concat(a, F.when(n % 3 == 0, " = clean(").otherwise(" = mark("), b, F.lit(");"))).otherwise(F.concat(F.lit("run("), b, F.lit(");")))
    )
    return taint_rules.evaluate_flows(_programs(spark, sf, line), rules).select("file_id", "start_line", F.array_join("labels", ",").alias("labels"))


_FUNCTIONS = [
    "function id(x) { return x; }", "function second(x, y) { return id(y); }", "function first(x, y) { var z = second(y, x); return z; }",
    "function odd(x, n) { if (n) { return even(n, x); } return x; }", "function even(n, x) { return odd(x, n); }", "function none(x) { return 0; }", "function use(z) { run(z); }", "function give() { return read(); }",
]
_N = len(_FUNCTIONS)
FUNCTION_RULE = "rules: [{id: taint.calls, message: m, severity: error, languages: [javascript], mode: taint, pattern-sources: [{pattern: read()}], pattern-sinks: [{patterns: [{pattern: run($X)}, {focus-metavariable: $X}]}], pattern-sanitizers: [{pattern: clean(...)}]}]"
_DEFS = "('signup', 'click', 'view')"


@query(f"""with recursive p as materialized {_P},
d as materialized (select p.*, {_V.format('b', _DEFS)} as db, {_V.format('c', _DEFS)} as dc from p),
e as (select user_id, case event_id % 5 when 1 then dc when 4 then null else db end as src, i as dst from d where t = 'click'),
r(user_id, i) as (select user_id, i from p where t = 'signup' union select r.user_id, e.dst from r join e on e.user_id = r.user_id and e.src = r.i),
s as (select d.user_id, d.i, d.event_id from d join r on r.user_id = d.user_id and r.i = d.db where d.t = 'purchase')
select distinct user_id as file_id, case when event_id % 2 = 0 then i + {_N} else 7 end as start_line, 8 as source_line from s""")
def taint_functions(spark, sf):
    """A source in one function, sinks in others: values go through calls by summaries, calls that recur by turns among them."""
    rules, _ = load_rules(FUNCTION_RULE)
    line = lambda t, n, a, b, c: (
        F.when(t == "signup", F.concat(a, F.lit(" = give();")))
        .when(t == "click", F.concat(a, F.lit(" = "), F.element_at(F.array(*map(F.lit, ("id(", "second(", "first(", "odd(", "none("))), (n % 5 + 1).cast("int")), b, F.when((n % 5).isin(1, 2, 3), F.concat(F.lit(", "), c)).otherwise(""), F.lit(");")))
        .when(t == "view", F.concat(a, F.lit(" = clean("), b, F.lit(");"))).when(t == "purchase", F.concat(F.when(n % 2 == 0, "run(").otherwise("use("), b, F.lit(");"))).otherwise(F.lit("log(1);"))
    )
    return taint_rules.evaluate_flows(_programs(spark, sf, line, _FUNCTIONS), rules).select("file_id", "start_line", "source_line")


# nodes --------------------------------------------------------------------------------------------

NODE_LIST_RULES = """rules:
  - {id: same.twice, message: m, severity: error, languages: [javascript], pattern: 'cmp($X, $X)'}
  - {id: not.one, message: m, severity: error, languages: [javascript], patterns: [{pattern: run(...)}, {pattern-not: run(v1)}]}
  - {id: inside.wrap, message: m, severity: info, languages: [python], patterns: [{pattern: 'get($K)'}, {pattern-inside: 'wrap($K, ...)'}]}
  - {id: any.of, message: m, severity: info, languages: [generic], pattern-either: [{pattern: run(v2)}, {pattern: 'cmp(v3, $Y)'}]}
"""


@query(f"""with p as (select user_id, i, event_type as t, event_id % 4 as a, event_id // 4 % 4 as b, user_id % 2 = 0 as js from {RANKED})
select user_id as file_id, i as start_line, 'same.twice' as rule_id, 'cmp(v' || a || ', v' || b || ')' as text from p where js and t = 'click' and a = b
union all select user_id, i, 'not.one', 'run(v' || b || ')' from p where js and t = 'purchase' and b <> 1
union all select user_id, i, 'inside.wrap', 'get(v' || a || ')' from p where not js and t = 'view' and a = b
union all select user_id, i, 'any.of', 'run(v2)' from p where t = 'purchase' and b = 2 union all select user_id, i, 'any.of', 'cmp(v3, v' || b || ')' from p where t = 'click' and a = 3""")
def node_rules_by_language(spark, sf):
    """Lists, negations and repeated metavariables on nodes of programs in two languages, each rule for its own."""
    rules, _ = load_rules(NODE_LIST_RULES)
    line = lambda t, n, a, b, c: (
        F.when(t == "click", F.concat(F.lit("cmp("), a, F.lit(", "), b, F.lit(")"))).when(t == "purchase", F.concat(F.lit("run("), b, F.lit(")")))
        .when(t == "view", F.concat(F.lit("wrap("), b, F.lit(", get("), a, F.lit("))"))).otherwise(F.lit("log(1)"))
    )
    files = _programs(spark, sf, line, language=F.when(F.col("user_id") % 2 == 0, "javascript").otherwise("python"))
    return taint_rules.evaluate_nodes(files, rules).select("file_id", "start_line", "rule_id", "text")

# merges, types, limits ----------------------------------------------------------------------------


@query("select user_id, round(list_reduce(list(value order by event_id), lambda a, x: (a + x) / 2), 6) as confidence from events group by 1")
def merged_confidence(spark, sf):
    """A user's values merged one after the other into a running mean of two."""
    one = read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return one.select("user_id", F.round(merging.sequential_mean(F.col("v.value")), 6).alias("confidence"))


@query("""with d as (select user_id, list_distinct(list(event_type) filter (event_id % 2 = 0)) as a, list_distinct(list(event_type) filter (event_id % 2 = 1)) as b from events group by 1),
e as (select user_id, coalesce(a, []) as a, coalesce(b, []) as b from d)
select user_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as everything, array_to_string(list_sort(list_intersect(a, b)), ',') as common from e""")
def merged_sets(spark, sf):
    """Two paths' transformations joined, and what both have."""
    half = lambda k: F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type")))
    one = read(spark, sf, "events").groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b"))
    return one.select("user_id", *[F.array_join(F.sort_array(merging.merge_sets(F.col("a"), F.col("b"), how)), ",").alias(n) for how, n in (("union", "everything"), ("intersection", "common"))])


SQL_KINDS = "(select o_orderkey, o_custkey, ['sanitize', 'encode', 'validate', 'filter', 'other'] as ks, o_orderkey % 5 as k, o_custkey % 5 as j, (o_orderkey % 9 + 1) / 10.0::double as e, (o_custkey % 7 + 1) / 8.0::double as f from orders)"
_KEPT = "case {0} when 0 then 1 - {1} when 1 then 0.7::double when 2 then 0.5::double when 3 then 0.8::double else 1::double end"


@query(f"select o_orderkey, round(0.9::double * {_KEPT.format('k', 'e')} * {_KEPT.format('j', 'f')}, 9) as confidence, not (k = 0 and e > 0.8 or j = 0 and f > 0.8) as significant from {SQL_KINDS}")
def transformed_confidence(spark, sf):
    """Confidence after two transformations of each order's keys, and whether a taint of 0.9 through them still counts."""
    names = F.array(*map(F.lit, ("sanitize", "encode", "validate", "filter", "other")))
    o = read(spark, sf, "orders").select("o_orderkey", F.array(*[F.element_at(names, (F.col(c) % 5 + 1).cast("int")) for c in ("o_orderkey", "o_custkey")]).alias("kinds"), F.array((F.col("o_orderkey") % 9 + 1) / 10.0, (F.col("o_custkey") % 7 + 1) / 8.0).alias("effects"))
    return o.select("o_orderkey", F.round(merging.transformed(F.lit(0.9), F.col("kinds"), F.col("effects")), 9).alias("confidence"), merging.significant(F.lit(0.9), F.col("kinds"), F.col("effects")).alias("significant"))


@query("""select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by (o_orderkey % 7) / 8.0::double + (o_orderkey % 3) / 4.0::double desc, o_orderkey) as n from orders) where n = 1""")
def most_restrictive(spark, sf):
    """Of each customer's orders the one whose effects add up to most."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.array((F.col("o_orderkey") % 7) / 8.0, (F.col("o_orderkey") % 3) / 4.0).alias("effects"))
    return merging.most_restrictive(o, ["o_custkey"], "effects", "o_orderkey").select("o_custkey", "o_orderkey")


@query("select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_discount desc, [l_suppkey, l_linenumber]) as n from lineitem) where n = 1")
def surest_of_each(spark, sf):
    """Flows that are alike become one, the surest; of equals that of the least path."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.array(F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long")).alias("path"))
    return merging.best_of_each(rows, ["l_orderkey"], "l_discount").select("l_orderkey", "l_linenumber")


@query("select event_id, round(value * case event_id % 4 when 0 then 1.0::double when 1 then 0.9::double when 2 then 0.8::double else 0.7::double end, 6) as effect from events")
def effect_by_origin(spark, sf):
    origin = F.element_at(F.array(*map(F.lit, ("user", "database", "file", "network"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", F.round(merging.origin_effectiveness(F.col("value"), origin), 6).alias("effect"))


_INT, _OBJECT = '{"kind": "primitive", "name": "int"}', '{"kind": "object", "name": "int"}'
_TYPES = [None, _INT, '{"kind": "primitive", "name": "str"}', _OBJECT, f'{{"kind": "array", "of": {_INT}}}', f'{{"kind": "union", "of": [{_OBJECT}, {_INT}]}}', '{"kind": "function"}']


@query("select p_partkey, a = 0 or b = 0 or a = b and a < 6 or a in (1, 3) and b = 5 or a = 5 and b in (1, 3) as fits from (select p_partkey, p_partkey % 7 as a, p_partkey // 7 % 7 as b from part)")
def type_fits(spark, sf):
    """Unknown, primitive, object, array, union and function types against each other."""
    at = lambda k: F.get(F.array(*map(F.lit, _TYPES)), k.cast("int"))
    p = read(spark, sf, "part")
    return p.select("p_partkey", type_compatible(at(F.col("p_partkey") % 7), at(F.floor(F.col("p_partkey") / 7) % 7)).alias("fits"))


@query("""with recursive e as materialized (select event_id, user_id, epoch(ts)::double as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
r(user_id, event_id, i, t0, n) as (select user_id, event_id, i, t, 1 from e where i = 1 union all
  select e.user_id, e.event_id, e.i, case when e.t - r.t0 > 21600 then e.t else r.t0 end, case when e.t - r.t0 > 21600 then 1 else r.n + 1 end from r join e on e.user_id = r.user_id and e.i = r.i + 1)
select event_id, n <= 2 as admitted from r""")
def rate_limit_fixed(spark, sf):
    """At most two hits of a user in a window of six hours that opens with the first."""
    e = read(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), (F.col("ts").cast("timestamp").cast("double")).alias("ts"))
    return feeds.rate_limited(e, 2, 21600.0).select("event_id", "admitted")


@query(f"""with p as {_P} select user_id as file_id, 'found' as how, count(*) filter (t = 'signup') as n from p group by 1
union all select user_id, 'other', 2 * count(*) filter (t in ('click', 'signup')) + 3 * count(*) filter (t = 'view') + 2 * count(*) filter (t = 'purchase') + count(*) filter (t = 'error') + count(*) filter (t in ('click', 'view')) from p group by 1""")
def nodes_by_regex(spark, sf):
    """Nodes whose text an expression finds, and all the others, counted by program."""
    tree = syntax.parse(programs(spark, sf)).where("depth > 0")
    count = lambda df, how: tree.select("file_id").distinct().join(df.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")), "file_id", "left").select("file_id", F.lit(how).alias("how"), F.coalesce("n", F.lit(0)).alias("n"))
    found = lambda wanted: nodes.search_regex(tree, r"^v[0-9] = read\(\)", wanted)
    return count(found(True), "found").unionByName(count(found(False), "other"))


@query(f"""with p as (select event_type as t, count(*) as n from {RANKED} group by 1), u as (select count(distinct user_id) as n from events),
k as (select 'program' as node_type, n, 0 as depth from u union all select 'assignment', n, 1 from p where t in ('signup', 'click', 'view') union all select 'call_expression', n, case t when 'signup' then 2 when 'view' then 2 else 1 end from p where t in ('signup', 'view', 'purchase', 'error')
  union all select 'identifier', case t when 'signup' then n when 'purchase' then n else 2 * n end, case t when 'view' then 3 else 2 end from p where t in ('signup', 'click', 'view', 'purchase'))
select node_type, sum(n)::bigint as n, max(depth)::int as max_depth from k group by 1""")
def node_figures(spark, sf):
    """Nodes of all programs by type, and the greatest depth of each type."""
    return syntax.node_counts(syntax.parse(programs(spark, sf)))


@query("""select doc_id, case when length(text) > 40 then text[1:37] || '...' else text end as short, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as plain from documents where text is not null""")
def short_texts(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", fx.truncate(F.col("text"), 40).alias("short"), fx.normalize_whitespace(F.col("text")).alias("plain"))


@query("""with d as (select doc_id, coalesce(source, '') || '/' || coalesce(lang, '') as path, text from documents), k as (select distinct path, text from d where doc_id % 3 = 0)
select doc_id from d where not exists (select 1 from k where k.path = d.path and k.text is not distinct from d.text)""")
def files_to_scan(spark, sf):
    """Files that no earlier run with the same rules has seen under their path."""
    files = read(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))).alias("path"), "text")
    known = files.where("doc_id % 3 = 0").withColumn("cache_key", F.xxhash64(F.lit("v1"), "path", "text"))
    return nodes.cached(files, known, "v1", "text")[0].select("doc_id")


@query(ORACLES["node_figures"])
def parsed_in_sql(spark, sf):
    """The same figures through the table function of SQL."""
    plugins.register(spark)
    return spark.sql("select n.node_type, count(*) as n, max(n.depth) as max_depth from {files} f, lateral parse_code(f.language, f.source) n group by 1", files=programs(spark, sf))


@query(r"""with l as (select doc_id, unnest(l) as line, unnest(range(len(l))) + 1 as n from (select doc_id, string_split(text, chr(10)) as l from documents)),
k as (select doc_id, n, line, least(case when contains(line, '#') then instr(line, '#') else 1000000000 end, case when contains(line, '//') then instr(line, '//') else 1000000000 end) as mark from l where not regexp_matches(ltrim(line, ' '), '^(#|//|/\*)') and regexp_matches(line, 'under\s+the\s+\S+\s+License')),
m as (select doc_id, n, mark, m[j] as matched, v[j] as name, coalesce(list_sum([length(x) for x in b[1:j]]), 0) + coalesce(list_sum([length(x) for x in m[1:j - 1]]), 0) + 1 as place from (select doc_id, n, mark, m, v, b, unnest(range(1, len(m) + 1)) as j from
  (select doc_id, n, mark, regexp_extract_all(line, 'under\s+the\s+(\S+)\s+License') as m, regexp_extract_all(line, 'under\s+the\s+(\S+)\s+License', 1) as v, string_split_regex(line, 'under\s+the\s+(\S+)\s+License') as b from k)))
select doc_id, n::int as start_line, place::int as start_column, matched, name from m where place < mark""")
def line_captures(spark, sf):
    """All matches of a line pattern in a line, with what its metavariable binds."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("source"))
    found = nodes.line_captures(d, "under the $NAME License")
    return found.select(F.col("file_id").alias("doc_id"), "start_line", "start_column", "matched", F.col("bindings")["$NAME"].alias("name"))


@query("select file_id, context, sql, start_line::int as start_line from " + SQL_SNIPPETS.replace("'delete from t where", "'delete from tn where"))
def embedded_sql_loose(spark, sf):
    """The same files read as the looser scanner does: the next string literal after a mark, without its backslashes."""
    return embedded_sql.sql_snippets(code_files(spark, sf), loose=True).select("file_id", "context", "sql", "start_line")


@query(f"""with p as {_P}, k as (select user_id, i, t, case t when 'signup' then 'v' || a || ' = read();' when 'click' then 'v' || a || ' = v' || b || ';' when 'view' then 'v' || a || ' = clean(v' || b || ');' when 'purchase' then 'run(v' || b || ');' else 'log(1);' end as text from p)
select user_id as file_id, i::int as start_line, 'assignment' as node_type, text from k where t in ('signup', 'click', 'view') union all select user_id, i, 'call_expression', text from k where t <> 'click'""")
def line_node_rows(spark, sf):
    """What the lines of programs are by simple signs: calls by their parentheses, assignments by their sign."""
    return syntax.line_nodes(programs(spark, sf)).select("file_id", F.col("start_line").cast("int").alias("start_line"), "node_type", "text")


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 'SELECT' when 1 then 'UPDATE' else 'INSERT' end as verb, 't' || o_custkey as table_name, case when o_orderkey % 3 = 0 then 'a = ' || o_custkey when o_orderkey % 3 = 1 then 'b = 1' end as condition,
  case when o_orderkey % 3 = 0 then 'a|b' || o_orderkey else '' end as columns from orders""")
def statement_parts(spark, sf):
    """Verb, columns, table and condition of a statement for each order."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    sql = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("select a,\n b"), k, F.lit(" from t"), c, F.lit(" where a = "), c, F.lit(" order by a;"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Update t"), c, F.lit(" set a = 2 where b = 1")))
    o = read(spark, sf, "orders").select("o_orderkey", sql.otherwise(F.concat(F.lit("insert into t"), c, F.lit(" values (1)"))).alias("sql"))
    return syntax.sql_statements(o).select("o_orderkey", "verb", "table_name", "condition", F.array_join("columns", "|").alias("columns"))


@query(f"""with p as {_P} select user_id as file_id, i as start_line, 'assignment' as node_type from p where t in ('signup', 'click', 'view') and (a = 1 or t <> 'signup' and b = 1)
union all select user_id, i, 'call_expression' from p where t = 'purchase' and b <> 1 or t = 'view' and b <> 1 or t = 'purchase' and b = 1""")
def node_pattern_search(spark, sf):
    """Nodes by a pattern of types, texts, alternatives and groups: assignments with v1, calls of run, and calls of clean without regard to v1."""
    tree = syntax.parse(programs(spark, sf)).where("depth > 0")
    found = nodes.search(tree, "@assignment v1 | @call_expression (run | clean)")
    skipped = found.where("node_type = 'call_expression' and text = 'clean(v1)'")
    return found.join(skipped, ["file_id", "node_id"], "left_anti").select("file_id", "start_line", "node_type")
