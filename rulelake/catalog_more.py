"""Further registered queries: sources, embedded SQL, conditions, line rules, taint rules, figures, stores and reports.

As in catalog.py each applies an operator to whole tables. Where the tables hold no source code, a query writes
code from their rows first: its SQL writes the same text and answers without the operator.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import RANKED, SQL_EDGES, SQL_PLACED, SQL_TAINT, event_graph, lines, placed_findings, query, ranked, read, rule_matches, spans, star_edges
from .functions import text as fx
from .operators import conditions as cond
from .operators import dataflow as flow
from .operators import flowstats as fs
from .operators import legacy, matching, nodes, syntax, taint_rules, tokens
from .plans.rules import LITERALS, literal_rules, load_rules
from .sources import embedded_sql, reports


def _values(rows, names: str) -> str:
    cell = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") {names}"


# sources ------------------------------------------------------------------------------------------

ENDINGS = "java js jsx ts tsx py pyw sql ddl dml sh bash zsh php phtml php3 php4 php5 cs csx c h rb rbw rake gemspec kt kts swift xml xsd xsl xslt svg pom cpp cc cxx go rs txt".split()
SQL_PATHS = f"(select doc_id, ([{', '.join(repr(e) for e in ENDINGS)}])[doc_id % {len(ENDINGS)} + 1] as ext from documents)"
BY_SCAN = [("java", "java"), ("js", "javascript"), ("jsx", "javascript"), ("ts", "javascript"), ("tsx", "javascript"), ("py", "python"), ("pyw", "python"), ("sql", "sql"), ("ddl", "sql"), ("dml", "sql"), ("sh", "bash"), ("bash", "bash"), ("zsh", "bash"), ("php", "php"), ("phtml", "php"), ("php3", "php"), ("php4", "php"), ("php5", "php"), ("cs", "csharp"), ("csx", "csharp"), ("c", "c"), ("h", "c"), ("rb", "ruby"), ("rbw", "ruby"), ("rake", "ruby"), ("gemspec", "ruby"), ("kt", "kotlin"), ("kts", "kotlin"), ("swift", "swift"), ("xml", "xml"), ("xsd", "xml"), ("xsl", "xml"), ("xslt", "xml"), ("svg", "xml"), ("pom", "xml")]
BY_NAME = [("java", "java"), ("js", "javascript"), ("jsx", "javascript"), ("ts", "typescript"), ("tsx", "typescript"), ("py", "python"), ("sql", "sql"), ("sh", "bash"), ("bash", "bash"), ("c", "c"), ("cpp", "cpp"), ("cc", "cpp"), ("cxx", "cpp"), ("cs", "csharp"), ("go", "go"), ("rs", "rust"), ("php", "php"), ("rb", "ruby"), ("kt", "kotlin"), ("kts", "kotlin"), ("swift", "swift"), ("xml", "xml")]


@query(f"select p.doc_id, a.lang as scanned, case when a.lang <> 'xml' then a.lang end as parsed, coalesce(b.lang, 'text') as uploaded from {SQL_PATHS} p left join {_values(BY_SCAN, 'a(ext, lang)')} on a.ext = p.ext left join {_values(BY_NAME, 'b(ext, lang)')} on b.ext = p.ext")
def file_languages(spark, sf):
    """A language for every path, as scans, parsers and uploads tell it."""
    names = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/F"), "doc_id", F.lit("."), F.upper(names)).alias("path"))
    return d.select("doc_id", *[fx.language_of_path(F.col("path"), p).alias(n) for p, n in (("files", "scanned"), ("parsers", "parsed"), ("uploads", "uploaded"))])


@query(f"""select doc_id, rule_id, severity, cast((length(text) - length(replace(text, lit, ''))) // length(lit) as bigint) as n from (select doc_id, text, (['java', 'javascript', 'python', 'sql', 'bash'])[doc_id % 5 + 1] as language from documents)
  join {_values([(lang, *r[:3]) for lang, rows in LITERALS.items() for r in rows], 'l(language, rule_id, lit, severity)')} using (language) where contains(text, lit)""")
def literal_patterns(spark, sf):
    """The built-in literal texts of each file's language."""
    names = F.element_at(F.array(*map(F.lit, ("java", "javascript", "python", "sql", "bash"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rules = literal_rules()
    found = matching.evaluate(read(spark, sf, "documents").select("doc_id", "text", names.alias("language")), rules, "doc_id", "text")
    named = spark.createDataFrame([(r.id, r.severity) for r in rules], "rule_id string, severity string")
    return found.join(named, "rule_id").groupBy("doc_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


PATH_RULES = r"""
rules:
  - {id: web.secret, message: m, severity: error, languages: [generic], pattern-regex: '(token|password|key) = "[^"]+"', paths: {include: ['web*'], exclude: ['7']}}
  - {id: any.license, message: m, severity: info, languages: [generic], pattern-regex: 'Licensed under', paths: {exclude: ['books/']}}
"""


@query("""with d as (select doc_id, text, source || '/' || doc_id as path from documents)
select doc_id, 'web.secret' as rule_id, cast(len(regexp_extract_all(text, '(token|password|key) = "[^"]+"')) as bigint) as n from d where starts_with(path, 'web') and not contains(path, '7') and regexp_matches(text, '(token|password|key) = "[^"]+"')
union all select doc_id, 'any.license', cast(len(regexp_extract_all(text, 'Licensed under')) as bigint) from d where not contains(path, 'books/') and contains(text, 'Licensed under')""")
def rules_by_path(spark, sf):
    """Rules hold on the paths that they include and do not exclude."""
    rules, _ = load_rules(PATH_RULES)
    d = read(spark, sf, "documents").select("doc_id", "text", F.concat_ws("/", "source", "doc_id").alias("path"))
    return matching.evaluate(d, rules, "doc_id", "text", None, path_col="path").groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


FIX_RULES = r"""
rules:
  - {id: hide, message: m, severity: error, languages: [generic], pattern-regex: '(token|password|key) = "([^"]+)"', fix-regex: {regex: '"([^"])[^"]*"', replacement: '"\1..."'}}
  - {id: note, message: m, severity: info, languages: [generic], pattern-regex: 'Licensed under the ([A-Za-z]+) License', fix: 'SPDX $1'}
"""


@query("""select doc_id, 'hide' as rule_id, m as matched, regexp_replace(m, '"([^"])[^"]*"', '"\\1..."', 'g') as fixed from (select doc_id, unnest(regexp_extract_all(text, '(token|password|key) = "([^"]+)"')) as m from documents)
union all select doc_id, 'note', m, 'SPDX ' || regexp_extract(m, 'the ([A-Za-z]+) L', 1) from (select doc_id, unnest(regexp_extract_all(text, 'Licensed under the ([A-Za-z]+) License')) as m from documents)""")
def rule_fixes(spark, sf):
    """Matched texts as their rules' fixes leave them."""
    rules, _ = load_rules(FIX_RULES)
    found = matching.evaluate(read(spark, sf, "documents").select("doc_id", "text"), rules, "doc_id", "text", None)
    return matching.fixed(found, rules).select("doc_id", "rule_id", "matched", "fixed")


# embedded SQL -------------------------------------------------------------------------------------

SQL_CODE = r"""(select conv_id || ':' || turn as file_id, case when turn % 2 = 0 then 'java' else 'xml' end as language, text, role,
  case when turn % 2 = 0 then 'class A {' || chr(10) || '@Select("select \"' || replace(text, '"', '') || '\" from ${t}  where id = #{id}")' || chr(10) || 'List f();' || chr(10) || 'c.prepareStatement("delete from t' || chr(92) || 'n where r = ' || role || '");' || chr(10) || '}'
  else '<mapper>' || chr(10) || '<select id="a">' || chr(10) || 'select * from t where x = #{x} and y = ' || replace(text, '<', '') || chr(10) || '</select></mapper>' end as source from conversations)"""


def code_files(spark, sf):
    """Java and XML files written from conversations: two embedded statements in each Java file, one in each XML file."""
    c = read(spark, sf, "conversations")
    lit = F.lit
    java = F.concat(lit('class A {\n@Select("select \\"'), F.replace("text", lit('"'), lit("")), lit('\\" from ${t}  where id = #{id}")\nList f();\nc.prepareStatement("delete from t\\n where r = '), "role", lit('");\n}'))
    xml = F.concat(lit('<mapper>\n<select id="a">\nselect * from t where x = #{x} and y = '), F.replace("text", lit("<"), lit("")), lit("\n</select></mapper>"))
    even = F.col("turn") % 2 == 0
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("file_id"), F.when(even, "java").otherwise("xml").alias("language"), F.when(even, java).otherwise(xml).alias("source"))


SQL_BLANK = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
SQL_SNIPPETS = f"""(select file_id, '@Select/@Query' as context, {SQL_BLANK.format("'select ' || chr(34) || replace(text, chr(34), '') || chr(34) || ' from T0 where id = 1;'")} as sql, 2 as start_line from {SQL_CODE} where language = 'java'
  union all select file_id, 'JDBC', 'delete from t where r = ' || role || ';', 4 + length(text) - length(replace(text, chr(10), '')) from {SQL_CODE} where language = 'java'
  union all select file_id, '<select>', {SQL_BLANK.format("'select * from t where x = 1 and y = ' || replace(text, '<', '') || ' '")} || case when ends_with(rtrim(regexp_replace(replace(text, '<', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ';') then '' else ';' end, 2 from {SQL_CODE} where language = 'xml')"""


@query(f"select file_id, context, sql, start_line::int as start_line from {SQL_SNIPPETS}")
def embedded_sql_snippets(spark, sf):
    return embedded_sql.sql_snippets(code_files(spark, sf)).select("file_id", "context", "sql", "start_line")


EMBEDDED_RULES = r"""
rules:
  - {id: sql.delete, message: m, severity: error, languages: [sql], pattern: 'delete from $T where ...', metadata: {preprocess: embedded-sql, preprocess.from: 'Java, XML'}}
  - {id: sql.star, message: m, severity: info, languages: [sql], pattern-regex: 'select \* from', metadata: {preprocess: embedded-sql, preprocess.from: xml}}
  - {id: sql.plain, message: m, severity: info, languages: [sql], pattern-regex: 'select'}
"""


@query(f"""select file_id, 'sql.delete' as rule_id, context as embedded_context, start_line::int as start_line from {SQL_SNIPPETS} where context = 'JDBC'
  union all select file_id, 'sql.star', context, start_line::int from {SQL_SNIPPETS} where context = '<select>'""")
def embedded_rule_findings(spark, sf):
    """SQL rules run on the snippets of the languages that they name; lines are the host files'."""
    rules, _ = load_rules(EMBEDDED_RULES)
    found = embedded_sql.embedded_findings(code_files(spark, sf), rules)
    return found.select("file_id", "rule_id", "embedded_context", "start_line")


@query(r"""select conv_id, turn, trim(regexp_replace('a ' || text || ' = 1 T0', '[ \t\n\x0B\f\r]+', ' ', 'g')) || ';' as sql from conversations""")
def placeholders_left_open(spark, sf):
    """Placeholders of a scanner's snippets may be empty, and one that is never closed swallows the rest."""
    s = F.concat(F.lit("a "), "text", F.lit(" = #{} ${open "), "text")
    return read(spark, sf, "conversations").select("conv_id", "turn", fx.normalize_sql_loose(s).alias("sql"))


@query(r"""select conv_id, turn, '"' || replace(text, ' ', chr(10) || 'é' || chr(9)) || chr(92) as text from conversations""")
def java_string_escapes(spark, sf):
    s = F.concat(F.lit('\\"'), F.replace("text", F.lit(" "), F.lit("\\n\\u00e9\\ud83d\\t")), F.lit("\\\\\\"))
    return read(spark, sf, "conversations").select("conv_id", "turn", fx.unescape_java(s).alias("text"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'r' || p_partkey else replace(p_type, ' ', '.') || '.r' || p_partkey end as rule_id from part")
def rule_ids_by_directory(spark, sf):
    directory = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.replace("p_type", F.lit(" "), F.lit("/"))).otherwise(F.concat(F.lit("./"), F.replace("p_type", F.lit(" "), F.lit("/"))))
    return read(spark, sf, "part").select("p_partkey", fx.rule_id_with_path(directory, F.concat(F.lit("r"), "p_partkey")).alias("rule_id"))


# predicates ---------------------------------------------------------------------------------------


@query("""select event_id, event_type = 'view' and value > 50 as both, event_type = 'view' or value > 50 as either, true as none_of_and, false as none_of_or, event_type = 'error' as in_context,
  case when value > 50 then 'x' end is not null and event_type in ('click', 'view') as typed from events""")
def condition_lists(spark, sf):
    """Conjunctions and disjunctions of conditions, empty ones included, node attributes and context values."""
    e = read(spark, sf, "events").select("event_id", "value", F.col("event_type").alias("node_type"), F.when(F.col("value") > 50, "x").alias("text"), F.create_map(F.lit("kind"), "event_type").alias("context"))
    view, big = cond.node_attribute("type", "view"), F.col("value") > 50
    typed = cond.every([cond.node_attribute("text", "x"), cond.some([cond.node_attribute("type", "click"), view, cond.node_attribute("color", "red")])])
    return e.select("event_id", cond.every([view, big]).alias("both"), cond.some([view, big]).alias("either"), cond.every([]).alias("none_of_and"), cond.some([]).alias("none_of_or"), cond.context_is("kind", "error").alias("in_context"), typed.alias("typed"))


@query("select page_id, not (url like '%#top') and (ends_with(url, 'x') or (starts_with(url, 'http://') and ends_with(url, '5'))) as open, page_id % 10 in (1, 2) and page_id % 10 <> 2 as rule_on from pages")
def editor_gates(spark, sf):
    p = read(spark, sf, "pages")
    rule = F.concat(F.lit("r"), (F.col("page_id") % 10).cast("string"))
    return p.select("page_id", fx.editor_file_gate(F.col("url"), ["**/x", "http://*5"], ["*#top"]).alias("open"), fx.editor_rule_gate(rule, ["r1", "r2"], ["r2"]).alias("rule_on"))


@query("""with d as (select doc_id, text, strpos(text, 'token = ') as a from documents)
select doc_id, (a - 1)::int as "start", (case when strpos(substr(text, a + 8), '"') > 0 then a + 7 + strpos(substr(text, a + 8), '"') else a + 7 end)::int as "end" from d where a > 0""")
def approximate_spans(spark, sf):
    """From a pattern's first literal to the next of its last one."""
    d = read(spark, sf, "documents").select("doc_id", tokens.approximate_span(F.col("text"), 'token = $VALUE"').alias("x"))
    return d.where("x is not null").select("doc_id", "x.*")


@query("select kind, v, case when kind = 'null' then 'null' when kind <> 'unknown' then v end as text, coalesce(kind in ('string', 'integer', 'boolean') and contains(v, '1'), false) as has_one, coalesce(regexp_matches(lower(v), 'password|secret|token|api_key|private_key|credential'), false) as sensitive from (select case event_id % 5 when 0 then 'integer' when 1 then 'string' when 2 then 'boolean' when 3 then 'null' else 'unknown' end as kind, case event_id % 5 when 0 then cast(event_id as varchar) when 1 then case when value > 50 then 'API_KEY' else event_type end when 2 then 'true' end as v from events)")
def constant_values(spark, sf):
    """Constants as text, what they match, and which are sensitive."""
    k = F.col("event_id") % 5
    e = read(spark, sf, "events").select(
        F.element_at(F.array(*map(F.lit, ("integer", "string", "boolean", "null", "unknown"))), (k + 1).cast("int")).alias("kind"),
        F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.when(F.col("value") > 50, "API_KEY").otherwise(F.col("event_type"))).when(k == 2, "true").alias("v"),
    )
    kind, v = F.col("kind"), F.col("v")
    return e.select("kind", "v", fx.constant_text(kind, v).alias("text"), fx.constant_matches(kind, v, "1").alias("has_one"), fx.sensitive(kind, v).alias("sensitive"))


SOURCES_SQL = [("UserInput", "High"), ("UrlParameterInput", "High"), ("HeaderInput", "High"), ("NetworkInput", "High"), ("ExternalApiInput", "High"), ("CookieInput", "High"), ("FileInput", "Medium"), ("DatabaseInput", "Medium"), ("EnvironmentInput", "Low"), ("CommandLineInput", "Low")]
SINKS_SQL = [("SqlExecution", "Critical", "SQL_INJECTION"), ("CommandExecution", "Critical", "COMMAND_INJECTION"), ("JavaScriptEvaluation", "Critical", "CODE_INJECTION"), ("FileOperation", "High", "PATH_TRAVERSAL"), ("XmlOperation", "High", "XML_INJECTION"), ("LdapOperation", "High", "LDAP_INJECTION"), ("NetworkOperation", "Medium", "SSRF"), ("HtmlOutput", "Medium", "XSS"), ("DatabaseOperation", "Medium", "SQL_INJECTION"), ("LogOutput", "Low", "LOG_INJECTION")]


@query(f"""select event_id, a.level as source_level, b.level as sink_level, b.vulnerability from events
  join {_values([(i, *r) for i, r in enumerate(SOURCES_SQL)], 'a(k, name, level)')} on a.k = event_id % 10 join {_values([(i, *r) for i, r in enumerate(SINKS_SQL)], 'b(k, name, level, vulnerability)')} on b.k = event_id // 10 % 10""")
def source_sink_levels(spark, sf):
    pick = lambda rows, k: F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (k + 1).cast("int"))
    source, sink = pick(SOURCES_SQL, F.col("event_id") % 10), pick(SINKS_SQL, F.floor(F.col("event_id") / 10) % 10)
    return read(spark, sf, "events").select("event_id", fs.source_severity(source).alias("source_level"), fs.sink_severity(sink).alias("sink_level"), fs.sink_vulnerability(sink).alias("vulnerability"))


# figures over flows -------------------------------------------------------------------------------

SQL_FLOWS = "(select event_id, user_id, (['Critical', 'High', 'Medium', 'Low', 'Info', 'Sanitized', 'Unknown'])[event_id % 7 + 1] as category, event_type as vulnerability_type, value / 100 as confidence from events)"


def category_flows(spark, sf):
    c = F.element_at(F.array(*map(F.lit, fs.CATEGORIES)), (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", "user_id", c.alias("category"), F.col("event_type").alias("vulnerability_type"), (F.col("value") / 100).alias("confidence"))


@query(f"""with n as (select {', '.join(f"cast(count(*) filter (category = '{c}') as bigint) as {c.lower()}_count" for c in fs.CATEGORIES)}, count(*)::bigint as total_flows from {SQL_FLOWS})
select *, critical_count + high_count + medium_count + low_count as vulnerable_flows, round((critical_count + high_count + medium_count + low_count) / total_flows, 6) as vulnerability_rate, round(sanitized_count / total_flows, 6) as sanitization_rate, 'Critical' as highest_severity from n""")
def flow_statistics(spark, sf):
    r = fs.flow_statistics(category_flows(spark, sf))
    return r.withColumns({c: F.round(c, 6) for c in ("vulnerability_rate", "sanitization_rate")})


@query(f"select category, event_id from {SQL_FLOWS}")
def flows_by_category(spark, sf):
    return fs.flows_by_category(category_flows(spark, sf), ["event_id"])


@query(f"select event_id, category, case category when 'Critical' then 1 when 'High' then 2 when 'Medium' then 3 else 4 end as severity_rank from {SQL_FLOWS} where category in ('Critical', 'High', 'Medium', 'Low')")
def vulnerable_flow_union(spark, sf):
    return fs.vulnerable_flows(category_flows(spark, sf), ["event_id"]).select("event_id", "category", "severity_rank")


@query("select distinct event_type as vulnerability_type from events")
def vulnerability_types(spark, sf):
    return fs.vulnerability_types(category_flows(spark, sf))


@query(f"select event_id, confidence from {SQL_FLOWS} order by confidence desc, event_id limit 25")
def surest_flows(spark, sf):
    """A report of the 25 surest flows."""
    return fs.by_confidence(category_flows(spark, sf), ["event_id"]).limit(25).select("event_id", "confidence")


@query(f"select user_id, coalesce(max(confidence), 0) as max_confidence from {SQL_FLOWS} group by 1")
def max_confidences(spark, sf):
    return fs.max_confidence(category_flows(spark, sf), ["user_id"])


@query(f"""with r as {RANKED} select (select count(*) from r) as node_count, (select count(*) from (select lead(event_id) over (partition by user_id order by i) as n from r) where n is not null) as edge_count,
  count(*) filter (event_type = 'signup') as source_count, count(*) filter (event_type in ('purchase', 'error')) as sink_count, count(*) filter (event_type = 'view') as sanitizer_count, count(*) as flow_count, count(*) filter (value > 50) as vulnerable_flow_count from r""")
def dataflow_statistics(spark, sf):
    edges, sources, clean, sinks = event_graph(spark, sf)
    e = read(spark, sf, "events")
    return fs.dataflow_statistics(e, edges, sources, sinks, clean, e.select((F.col("value") > 50).alias("vulnerable")))


@query(f"""with r as {RANKED}, p as (select event_id, user_id, i, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c, event_type as a from r window w as (partition by user_id order by i))
select event_id as path_id from p where b is not null and a <> 'error' and (c is null or b <> 'error')""")
def valid_paths(spark, sf):
    """Paths of up to three events of a user whose every hop is an edge; no edge leaves an error."""
    r = ranked(spark, sf)
    w = Window.partitionBy("user_id").orderBy("i")
    paths = r.select(F.col("event_id").alias("path_id"), F.array_compact(F.array("event_id", F.lead("event_id", 1).over(w), F.lead("event_id", 2).over(w))).alias("path"))
    edges = r.withColumn("dst", F.lead("event_id").over(w)).where("dst is not null and event_type != 'error'").select(F.col("event_id").alias("src"), "dst")
    return fs.valid_paths(paths, edges).select("path_id")


@query("select event_id from events where value > 50 and event_type in ('click', 'view') and (event_id % 7)::varchar in ('1', '3')")
def flows_of_a_rule(spark, sf):
    """Vulnerable flows whose source and sink descriptions hold a rule's sources and sinks."""
    e = read(spark, sf, "events").select("event_id", (F.col("value") > 50).alias("vulnerable"), F.concat(F.lit("from "), "event_type").alias("source_description"), F.concat(F.lit("to sink"), F.col("event_id") % 7, F.lit(".")).alias("sink_description"))
    return fs.matching_flows(e, ["click", "view"], ["sink1.", "sink3."]).select("event_id")


SQL_CONTEXT = SQL_TAINT + """, k as (select t.*, (select count(*) from r v where v.user_id = t.u and v.event_type = 'view' and v.i between t.i - t.n + 1 and t.i) as views from t join r on r.event_id = t.node where r.event_type in ('purchase', 'error') and t.n > 1 and t.conf > 0.5 and t.source % 3 = t.node % 3)
select source, node as sink, 'c' || source % 3 as context, round(conf * pow(0.8, views), 6) as confidence from k where conf * pow(0.8, views) > 0.5"""


@query(SQL_CONTEXT)
def context_taint(spark, sf):
    """Flows between sources and sinks of one context, all contexts side by side."""
    edges, sources, clean, sinks = event_graph(spark, sf)
    named = lambda df: df.withColumn("context", F.concat(F.lit("c"), F.col("node") % 3))
    return taint_rules.context_taint(edges, named(sources), named(sinks), clean, "graph").select("source", "sink", "context", F.round("confidence", 6).alias("confidence"))


# graphs and symbols -------------------------------------------------------------------------------


@query(f"with {SQL_EDGES} select src as node, dst as neighbour, 'out' as direction, left(src, 1) as edge_type from e where starts_with(src, 'n') union all select dst, src, 'in', left(src, 1) from e where starts_with(dst, 'n')")
def neighbour_nodes(spark, sf):
    edges = star_edges(spark, sf).withColumn("edge_type", F.left("src", F.lit(1)))
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return fs.neighbours(edges, n)


@query("select user_id as scope, event_type as name, max(event_id) as node from events group by all")
def last_definitions(spark, sf):
    return fs.definitions(read(spark, sf, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("name"), F.col("event_id").alias("node")))


SQL_USES = f"""with r as {RANKED}, d as (select user_id, max(event_id) as def from events where event_type = 'click' group by 1), u as (select r.user_id, r.event_id, r.i, d.def from r join d using (user_id) where r.event_type = 'purchase'),
p as (select u.user_id, u.event_id, case when b.event_id is not null then u.def || '>' || u.event_id end as one, c.event_id as mid, u.def from u join r a on a.event_id = u.def
  left join r b on b.user_id = u.user_id and b.i = a.i + 1 and b.event_id = u.event_id left join r c on c.user_id = u.user_id and c.i = a.i + 1 and c.i + 1 = u.i)
select user_id as scope, string_agg(coalesce(one, def || '>' || mid || '>' || event_id), '>' order by event_id) as path from p where one is not null or mid is not null group by 1"""


@query(SQL_USES)
def def_use_paths(spark, sf):
    """The last click of a user is a definition, purchases are uses; paths go over one or two hops of consecutive events."""
    e = read(spark, sf, "events")
    sym = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("scope"), F.lit("x").alias("name"), F.col("event_id").alias("node"))
    edges, *_ = event_graph(spark, sf)
    two = edges.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), F.array("a.src", "a.dst", "b.dst").alias("path"))
    paths = edges.select("src", "dst", F.array("src", "dst").alias("path")).union(two)
    return fs.def_use_paths(sym("click"), sym("purchase"), paths).select("scope", F.array_join("path", ">").alias("path"))


@query("select user_id as function, string_agg(distinct event_type, ',' order by event_type) as taints from events where value > 50 group by 1")
def function_entry_taints(spark, sf):
    t = read(spark, sf, "events").select(F.col("user_id").alias("function"), F.when(F.col("value") > 50, "entry").otherwise("exit").alias("at"), F.col("event_type").alias("source"))
    return fs.function_taints(t, "entry").select("function", F.array_join("taints", ",").alias("taints"))


@query("select name, value, is_constant, regexp_matches(name, 'token') as is_sensitive from (select case user_id % 2 when 0 then 'token' else 'v' end || user_id as name, arg_max(event_type, event_id) as value, not arg_max(value > 50, event_id) as is_constant from events group by 1)")
def constant_registry(spark, sf):
    c = read(spark, sf, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "token").otherwise("v"), "user_id").alias("name"), F.col("event_type").alias("value"), (F.col("value") > 50).alias("mutable"), F.col("event_id").alias("ord"))
    return fs.constants_of(c)


@query(f"select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by i) as b from {RANKED}) where b is null or b <> event_type")
def without_repeats(spark, sf):
    """Events of a user without those of the type of the one just before."""
    return fs.drop_repeats(ranked(spark, sf), ["user_id"], ["i"], "event_type").select("event_id")


# jobs and shelves ---------------------------------------------------------------------------------


@query("""select o_orderpriority, count(*) as analyses, sum(o_custkey % 5)::bigint as findings, count(*) filter (o_orderstatus = 'O') as completed, count(*) filter (o_orderstatus = 'F') as failed,
  round(count(*) filter (o_orderstatus = 'O') / nullif(count(*) filter (o_orderstatus in ('O', 'F')), 0) * 100, 6) as success_rate, round(sum(o_custkey % 5) / count(*), 6) as findings_per_analysis from orders group by 1""")
def job_rates(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    j = read(spark, sf, "orders").select("o_orderpriority", status.alias("status"), (F.col("o_custkey") % 5).alias("findings"))
    r = fs.job_rates(j, ["o_orderpriority"])
    return r.withColumns({c: F.round(c, 6) for c in ("success_rate", "findings_per_analysis")})


@query("select operation, round(total, 4) as total, calls from (select event_type || event_id % 9 as operation, sum(value) as total, count(*) as calls from events group by 1) order by total desc, operation limit 10")
def slowest_operations(spark, sf):
    t = read(spark, sf, "events").select(F.concat("event_type", F.col("event_id") % 9).alias("operation"), F.col("value").alias("seconds"))
    return fs.top_operations(t).withColumn("total", F.round("total", 4))


@query("select p_partkey from part where p_size > 10 order by p_name, p_partkey limit 500 offset 40")
def rule_page(spark, sf):
    """A page of a listing; no page holds more than 500 rows."""
    return fs.page(read(spark, sf, "part").where("p_size > 10"), ["p_name", "p_partkey"], 40, 900).select("p_partkey")


@query("select distinct 'category' as kind, p_brand as name from part union select distinct 'tag', unnest(string_split(p_type, ' ')) from part")
def shelf_keys(spark, sf):
    return fs.shelf_keys(read(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("tags")))


@query("select p_partkey as rule_id from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R')")
def shelf_after_removal(spark, sf):
    rules = read(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"))
    return fs.without_rules(rules, read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("rule_id")))


# line rules ---------------------------------------------------------------------------------------

#: A user's events as lines of code, in order: what is tainted, moved, cleaned and used.
SQL_LINES = f"""(select user_id as file_id, i as line_no, case event_type when 'signup' then 'v' || event_id % 4 || ' = "tainted";' when 'click' then 'let v' || event_id % 4 || ' = v' || event_id // 4 % 4 || ';'
  when 'view' then case when value > 50 then '    ' else '' end || 'v' || event_id % 4 || ' = sanitize(v' || event_id % 4 || ')' when 'purchase' then 'sink( v' || event_id % 4 || ' )' else case when value > 80 then 'if x' else 'x(); sink("tainted")' end end as line from {RANKED})"""


def event_lines(spark, sf):
    v, u = F.concat(F.lit("v"), F.col("event_id") % 4), F.concat(F.lit("v"), F.floor(F.col("event_id") / 4) % 4)
    t = F.col("event_type")
    line = F.when(t == "signup", F.concat(v, F.lit(' = "tainted";'))).when(t == "click", F.concat(F.lit("let "), v, F.lit(" = "), u, F.lit(";")))
    line = line.when(t == "view", F.concat(F.when(F.col("value") > 50, "    ").otherwise(""), v, F.lit(" = sanitize("), v, F.lit(")"))).when(t == "purchase", F.concat(F.lit("sink( "), v, F.lit(" )"))).otherwise(F.when(F.col("value") > 80, "if x").otherwise('x(); sink("tainted")'))
    return ranked(spark, sf).select(F.col("user_id").alias("file_id"), F.col("i").alias("line_no"), line.alias("line"))


SQL_LINE_TAINT = f"""with recursive l as materialized {SQL_LINES},
n as (select *, starts_with(trim(line), 'if ') as cond from l),
k as (select file_id, line_no, line, regexp_extract(line, '^\\s*(?:let )?(v[0-9]) =', 1) as lhs, regexp_extract(line, '= (v[0-9]);', 1) as rhs, regexp_extract(line, '^sink\\( (v[0-9]) \\)', 1) as arg,
  line like '%sanitize(%' and not (starts_with(line, '    ') and (cond or coalesce(lag(cond, 1) over w, false) or coalesce(lag(cond, 2) over w, false))) as clean from n window w as (partition by file_id order by line_no)),
s as (select file_id, lhs as var, line_no as since from k where line like '%= "tainted"%'),
t(file_id, var, since) as (select * from s union select k.file_id, k.lhs, k.line_no from t join k on k.file_id = t.file_id and k.rhs = t.var and k.line_no > t.since where not exists (select 1 from s where s.file_id = k.file_id and s.var = k.lhs)),
f as (select * from s union select file_id, var, min(since) from t where (file_id, var) not in (select file_id, var from s) group by 1, 2)
select distinct k.file_id, k.line_no as start_line, 1 as start_column, 5 as end_column, 'medium' as confidence from k join f on f.file_id = k.file_id and f.var = k.arg and f.since < k.line_no
  where not exists (select 1 from k c where c.file_id = k.file_id and c.clean and c.lhs = f.var and c.line_no > f.since and c.line_no < k.line_no)
union all select file_id, line_no, 6, 10, 'high' from l where line like '%sink("tainted")%'"""


@query(SQL_LINE_TAINT)
def line_taint(spark, sf):
    return legacy.line_taint(event_lines(spark, sf)).select("file_id", "start_line", "start_column", "end_column", "confidence")


SQL_SHELL = f"""(select user_id as file_id, i as line_no, case event_type when 'signup' then 'if sudo -n true; then' when 'click' then 'for x; do {{' when 'view' then '  fi' when 'error' then case when value > 50 then '[[ $x ]]' else 'if y; then' end else 'rm $1' end as line, event_type, value from {RANKED})"""


def shell_lines(spark, sf):
    t = F.col("event_type")
    line = F.when(t == "signup", "if sudo -n true; then").when(t == "click", "for x; do {").when(t == "view", "  fi").when(t == "error", F.when(F.col("value") > 50, "[[ $x ]]").otherwise("if y; then")).otherwise("rm $1")
    return ranked(spark, sf).select(F.col("user_id").alias("file_id"), F.col("i").alias("line_no"), line.alias("line"), "event_type", "value")


@query(f"""with l as materialized {SQL_SHELL}, c as (select *, sum(case when line like '%then%' or line like '%{{%' then 1 else 0 end) over w as o, sum(case when trim(line) = 'fi' then 1 else 0 end) over w as z from l window w as (partition by file_id order by line_no)),
b as (select s.file_id, s.line_no as a, min(e.line_no) as z from c s join c e on e.file_id = s.file_id and e.line_no > s.line_no and trim(e.line) = 'fi' and e.o - s.o - (e.z - 1 - s.z) = 0 where s.event_type = 'signup' group by 1, 2)
select file_id, line_no as start_line from l where event_type in ('purchase', 'error') and line not like '[[%' and not exists (select 1 from b where b.file_id = l.file_id and b.a < l.line_no and l.line_no < b.z)""")
def outside_guards(spark, sf):
    """Findings outside the guarded if blocks and the bracketed lines that a rule names."""
    ls = shell_lines(spark, sf)
    found = ls.where("event_type in ('purchase', 'error')").select("file_id", F.col("line_no").alias("start_line"))
    return legacy.not_inside(found, ls, "[[ $VAR ]] if sudo -n true; then ... fi").select("file_id", "start_line")


@query(f"select file_id, line_no as start_line from {SQL_SHELL} where event_type in ('purchase', 'error') and not regexp_matches(line, '\\$x\\s')")
def lines_left_out(spark, sf):
    ls = shell_lines(spark, sf)
    found = ls.where("event_type in ('purchase', 'error')").select("file_id", F.col("line_no").alias("start_line"))
    return legacy.not_regex(found, ls, r"\\$x\\s").select("file_id", "start_line")


@query("""with u as (select conv_id || ':' || turn as file_id, turn % 3 as a, conv_id % 3 as b from conversations) select distinct file_id, 'p' || a as prefix from u where a <> b union select distinct file_id, 'q' from u where a = 1""")
def undeclared_prefixes(spark, sf):
    """XML written from conversations: one prefix declared, up to two used."""
    c = read(spark, sf, "conversations")
    a, b = F.concat(F.lit("p"), F.col("turn") % 3), F.concat(F.lit("p"), F.col("conv_id") % 3)
    more = F.when(F.col("turn") % 3 == 1, F.lit('<z q:x = "1" xml:lang="en"/>')).otherwise("")
    text = F.concat(F.lit('<r xmlns:'), b, F.lit('="u"><'), a, F.lit(":e>t</"), a, F.lit(":e>"), more, F.lit("</r>"))
    return legacy.undeclared_prefixes(c.select(F.concat_ws(":", "conv_id", "turn").alias("file_id"), text.alias("source")))


@query("select user_id as rule_id, count(*) as runs, count(*) filter (event_type = 'error') as failures, sum(event_id % 4)::bigint as findings, round(sum(value), 4) as seconds, round(avg(value), 6) as mean_seconds, arg_max(case event_type when 'error' then 'failed' else event_type end, event_id) as last_status from events group by 1")
def rule_run_statistics(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("rule_id"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"), (F.col("event_id") % 4).alias("findings"), F.col("value").alias("seconds"), F.col("event_id").alias("run"))
    return fs.rule_statistics(e).withColumns({"seconds": F.round("seconds", 4), "mean_seconds": F.round("mean_seconds", 6)})


@query("""with a as (select user_id as file_id, event_id, event_type from events) select file_id, event_id, case event_type when 'signup' then 0 when 'error' then 1 else 2 end as stage from a
  where case event_type when 'signup' then 0 when 'error' then 1 when 'view' then 2 end = (select min(case event_type when 'signup' then 0 when 'error' then 1 when 'view' then 2 end) from a b where b.file_id = a.file_id)""")
def first_stage_with_findings(spark, sf):
    """Of several ways to look, the first that finds anything in a file counts."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("file_id"), "event_id", "event_type")
    stages = [e.where(F.col("event_type") == k).drop("event_type") for k in ("signup", "error", "view")]
    return legacy.first_of_each(stages, ["file_id"]).select("file_id", "event_id", "stage")


# rules over syntax --------------------------------------------------------------------------------

#: A user's events as one program: reads, moves, sanitizers and uses of four variables.
SQL_PROGRAM = f"""(select user_id, i, event_type, event_id % 4 as a, event_id // 4 % 4 as b from {RANKED})"""


def programs(spark, sf):
    v, u = F.concat(F.lit("v"), F.col("event_id") % 4), F.concat(F.lit("v"), F.floor(F.col("event_id") / 4) % 4)
    t = F.col("event_type")
    line = F.when(t == "signup", F.concat(v, F.lit(" = read();"))).when(t == "click", F.concat(v, F.lit(" = "), u, F.lit(";"))).when(t == "view", F.concat(v, F.lit(" = clean("), u, F.lit(");"))).when(t == "purchase", F.concat(F.lit("run("), u, F.lit(");"))).otherwise(F.lit("log(1);"))
    one = ranked(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))).alias("l"))
    return one.select(F.col("user_id").alias("file_id"), F.lit("javascript").alias("language"), F.array_join(F.col("l.line"), "\n").alias("source"))


TAINT_RULE = "rules: [{id: taint.run, message: m, severity: error, languages: [javascript], mode: taint, pattern-sources: [{pattern: read()}], pattern-sinks: [{pattern: run($X)}], pattern-sanitizers: [{pattern: clean($X)}]}]"


@query(f"""with recursive p as materialized {SQL_PROGRAM},
d as materialized (select p.user_id, p.i, p.event_type, p.a, (select max(q.i) from p q where q.user_id = p.user_id and q.i < p.i and q.a = p.b and q.event_type in ('signup', 'click', 'view')) as def from p),
t(user_id, source, i) as (select user_id, i, i from p where event_type = 'signup' union select t.user_id, t.source, d.i from t join d on d.user_id = t.user_id and d.def = t.i and d.event_type = 'click')
select d.user_id as file_id, 'taint.run' as rule_id, d.i as start_line, t.source as source_line from t join d on d.user_id = t.user_id and d.def = t.i and d.event_type = 'purchase'""")
def taint_rule(spark, sf):
    """A taint rule on programs: sinks that a source's value reaches over assignments, not through a sanitizer."""
    rules, _ = load_rules(TAINT_RULE)
    return taint_rules.evaluate_flows(programs(spark, sf), rules).select("file_id", "rule_id", "start_line", "source_line")


@query(f"select user_id as file_id, 'taint.run' as rule_id, i as start_line from {RANKED} where event_type = 'purchase' and user_id in (select user_id from events where event_type = 'signup')")
def taint_rule_any_source(spark, sf):
    """The plainer reading: every sink of a file that holds any source."""
    rules, _ = load_rules(TAINT_RULE)
    return taint_rules.evaluate_flows(programs(spark, sf), rules, how="exists").select("file_id", "rule_id", "start_line")


NODE_RULES = "rules: [{id: node.run, message: m, severity: error, languages: [javascript], pattern: run(...)}, {id: node.name, message: m, severity: info, languages: [javascript], pattern: v3}]"


@query(f"""select user_id as file_id, 'node.run' as rule_id, i as start_line, 'call_expression' as node_type, 'run(v' || event_id // 4 % 4 || ')' as text from {RANKED} where event_type = 'purchase'
union all select user_id, 'node.name', i, 'identifier', 'v3' from {RANKED} where event_type in ('click', 'view', 'purchase') and event_id // 4 % 4 = 3
union all select user_id, 'node.name', i, 'identifier', 'v3' from {RANKED} where event_type in ('signup', 'click', 'view') and event_id % 4 = 3""")
def syntax_rules(spark, sf):
    """Code patterns of rules on the nodes of parsed programs."""
    rules, _ = load_rules(NODE_RULES)
    return taint_rules.evaluate_nodes(programs(spark, sf), rules).select("file_id", "rule_id", "start_line", "node_type", "text")


@query(f"""with p as (select event_type, count(*) as n from {RANKED} group by 1) select class, sum(n)::bigint as n from (select unnest(['expression', 'expression']) as class, n from p where event_type = 'purchase' union all select unnest(['expression', 'expression', 'expression']), n from p where event_type in ('click', 'signup')
  union all select unnest(['expression', 'expression', 'expression', 'expression']), n from p where event_type = 'view' union all select 'expression', n from p where event_type = 'error') group by 1""")
def node_classes(spark, sf):
    """Nodes of parsed programs by class: assignments, calls, identifiers."""
    n = syntax.parse(programs(spark, sf)).where("depth > 0")
    return n.groupBy(nodes.node_class(F.col("node_type")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select l_orderkey as file_id, l_linenumber::bigint as no, l_linenumber * 10 as a, (l_linenumber * 10 + l_quantity)::bigint as z from lineitem)
select x.file_id, x.no, exists (select 1 from s y where y.file_id = x.file_id and y.z - y.a > 40 and y.a >= x.z) as followed, exists (select 1 from s y where y.file_id = x.file_id and y.z - y.a > 40 and y.z <= x.a) as preceded from s x""")
def followed_and_preceded(spark, sf):
    """Spans of orders that a long span comes after, or before."""
    s = spans(spark, sf)
    long = s.where(F.col("end") - F.col("start") > 40)
    both = matching.with_follower(matching.with_follower(s, long, ["file_id"]), long, ["file_id"], before=True, column="preceded")
    return both.select("file_id", "no", "followed", "preceded")


# reports ------------------------------------------------------------------------------------------


@query(f"""select path, rule_id, '   ❯❯❱ ' || rule_id || chr(10) || '          ' || first || chr(10) || chr(10) || block as lines from (
  select path, rule_id, arg_min(message, (start_line, start_column)) as first, string_agg('           ' || start_line || '┆ ' || trim(line), chr(10) || '            ⋮┆{'-' * 40}' || chr(10) order by start_line, start_column) as block from (
    select f.*, string_split(d.text, chr(10))[f.start_line] as line from {SQL_PLACED} f join documents d on f.path = 'documents/' || d.doc_id) group by all)""")
def grouped_report(spark, sf):
    found = placed_findings(spark, sf)
    source = lines(spark, sf).select(F.concat(F.lit("documents/"), "doc_id").alias("path"), (F.col("line_no") + 1).alias("start_line"), "line")
    return reports.grouped_report(found, source)


@query(f"""select path, start_line, rule_id, '<div class="finding ' || case when severity in ('critical', 'error') then 'error' else severity end || '"><h3>' || replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h3><p><strong>Rule:</strong> ' || rule_id || '</p><p><strong>File:</strong> ' || path || ':' || start_line || ':' || start_column
  || '</p><p><strong>Severity:</strong> ' || upper(severity[1]) || severity[2:] || '</p><p><strong>Confidence:</strong> ' || upper(confidence[1]) || confidence[2:] || '</p></div>' as html from {SQL_PLACED}""")
def html_findings(spark, sf):
    return reports.html_rows(placed_findings(spark, sf)).select("path", "start_line", "rule_id", "html")


@query(f"""with f as (select *, row_number() over (order by path, start_line, start_column, rule_id, message) as number from {SQL_PLACED})
select line from (select unnest(['=== Analysis Results ===', '', 'Found ' || (select count(*) from f) || ' issue(s):', '', '=== Summary ===', 'Files analyzed: 5', 'Rules executed: 3', 'Analysis time: 0.000s']) as line
union all select unnest([number || '. ' || message || ' (' || rule_id || ')', '   File: ' || path || ':' || start_line || ':' || start_column, '   Severity: ' || upper(severity[1]) || severity[2:] || ', Confidence: ' || upper(confidence[1]) || confidence[2:], '']) from f)""")
def text_report(spark, sf):
    return reports.text_report(placed_findings(spark, sf), 5, 3).select("line")


@query(f"""select '{{"findings": [' as line union all select case when n = 1 then '' else ',' end || j from (select to_json({{'rule_id': rule_id, 'message': message, 'severity': severity, 'confidence': confidence, 'location': {{'file': path, 'start_line': start_line, 'start_column': start_column, 'end_line': end_line, 'end_column': end_column}}}})::varchar as j,
  row_number() over (order by path, start_line, start_column, rule_id) as n from {SQL_PLACED}) union all select '], "summary": {{"total_findings": ' || count(*) || ', "files_analyzed": 5, "rules_executed": 3, "analysis_time_ms": 0}}}}' from {SQL_PLACED}""")
def json_report(spark, sf):
    return reports.json_lines(placed_findings(spark, sf), 5, 3).select("line")


@query(f"""select '{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {{"driver": {{"name": "rulelake", "version": "1.0"}}}}, "results": [' as line union all select ']}}]}}' union all select case when n = 1 then '' else ',' end || j from (select to_json({{'ruleId': rule_id, 'level': case severity when 'critical' then 'error' when 'info' then 'note' else severity end, 'message': {{'text': message}},
  'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}}, 'region': {{'startLine': start_line, 'startColumn': start_column, 'endLine': end_line, 'endColumn': end_column}}}}}}]}})::varchar as j, row_number() over (order by path, start_line, start_column, rule_id) as n from {SQL_PLACED})""")
def sarif_report(spark, sf):
    return reports.sarif_lines(placed_findings(spark, sf)).select("line")


@query(f"""select '# Analysis Report' as line union all select '' union all select '## Summary' union all select '' union all select '- **Total findings:** ' || count(*) from {SQL_PLACED} union all select '- **Files analyzed:** 5' union all select '' union all select '| severity | rule | file | line | message |' union all select '|-|-|-|-|-|'
union all select '| ' || severity || ' | ' || rule_id || ' | ' || path || ' | ' || start_line || ' | ' || replace(message, '|', '\\|') || ' |' from {SQL_PLACED}""")
def markdown_report(spark, sf):
    return reports.markdown_report(placed_findings(spark, sf), 5).select("line")


@query(f"""select 'findings_total{{severity="' || severity || '"}} ' || count(*) as line from {SQL_PLACED} group by severity union all select 'rule_findings_total{{rule_id="' || rule_id || '"}} ' || count(*) from {SQL_PLACED} group by rule_id
union all select 'jobs_total{{status="' || o_orderstatus || '"}} ' || count(*) from orders group by o_orderstatus""")
def metrics_lines(spark, sf):
    found, _ = rule_matches(spark, sf)
    return reports.prometheus_all(read(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")), found)
