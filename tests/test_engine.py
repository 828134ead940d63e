"""Rules, tokens, conditions, syntax, dataflow, sources and streams on small cases."""

import base64
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from rulelake.functions import text as fx
from rulelake.operators import conditions as cond
from rulelake.operators import dataflow, matching, merging, nodes, syntax
from rulelake.operators.tokens import TokenPattern, line_col, line_starts, tokenize
from rulelake.plans.rules import complexity, load_rules, rules_frame, validate
from rulelake.sources import files as src
from rulelake.sources import reports
from rulelake.streaming import feeds


def words(text):
    return [t for t, _, _ in tokenize(text)]


def test_tokens():
    assert words("a.b(c, 'd e')... x..y") == ["a", ".", "b", "(", "c", ",", "'d", "e'", ")", "...", "x", ".", "y"]
    assert tokenize("é =1") == [("é", 0, 1), ("=", 2, 3), ("1", 3, 4)]
    assert line_col(line_starts("ab\ncd"), 3) == (2, 1)


@pytest.mark.parametrize(
    "pattern, language, text, count",
    [
        ("eval($X)", "python", "eval(a + (b)); eval()", 1),
        ("f(...)", "python", "f(1, (2), 3) f()", 2),
        ("f(...);", "python", "f(1)", 1),
        ("$X == $X", "python", "a == a ;", 0),
        ("$X == $X ;", "python", "a == a ; a == b ;", 0),
        ("select * from $T", "sql", "SELECT * FROM users", 1),
        ("select $C from t ;", "sql", "SELECT a FROM u ; select b from t ;", 1),
        ("exec($X)", "java", "rt.exec(x); exec(y);", 1),
        ("exec($X)", "javascript", "rt.exec(x); exec(y);", 2),
        ("$A $B lit", "python", "x y lit", 0),
        ("a ... ", "python", "a", 0),
        ("a $...ARGS b", "python", "a 1 2 b", 0),
    ],
)
def test_token_patterns(pattern, language, text, count):
    assert len(TokenPattern(pattern, language).matches(text)) == count


def test_bindings_and_warnings():
    (start, end, bound), = TokenPattern("call($X, $Y)", "python").matches("z call(a.b, c[0])")
    assert (start, end) == (2, 17) and {k: "z call(a.b, c[0])"[a:b] for k, (a, b) in bound.items()} == {"$X": "a.b", "$Y": "c[0]"}
    assert TokenPattern("$A $B lit").warnings


RULES = """
rules:
  - {id: r.eval, message: "eval of $X", severity: HIGH, languages: [python], pattern: eval($X), fix: safe($X)}
  - id: r.all
    message: m
    severity: warning
    languages: [python]
    patterns:
      - pattern: open($F)
      - pattern-not: open(safe)
      - pattern-inside: 'def $N ( ... ) : ... end'
      - metavariable-regex: {metavariable: $F, regex: '^[a-z]+$'}
  - {id: "bad id", message: m, severity: error, languages: [python], pattern: x}
  - {id: r.regex, message: m, severity: error, languages: [python], pattern-regex: '['}
  - {id: r.taint, message: m, severity: critical, languages: [python], mode: taint, pattern-sources: [{pattern: input()}], pattern-sinks: [{pattern: eval($X)}], metadata: {n: 1}}
"""


def test_rules(spark):
    good, bad = load_rules(RULES)
    assert [r.id for r in good] == ["r.eval", "r.all", "r.taint"] and set(bad) == {"bad id", "r.regex"}
    assert good[0].severity == "error" and good[2].dataflow["sources"] == ["input()"] and good[2].metadata == {"n": "1"}
    with pytest.raises(ValueError):
        load_rules(RULES, strict=True)
    assert validate(good[0]) == [] and complexity("a\nb") == (pytest.approx(0.203), 1030)
    code = [(1, "python", "eval(user)\nopen(name)\ndef f ( ) : open(path) open(safe) open(P) end"), (2, "java", "eval(x)"), (3, "python", None)]
    files = spark.createDataFrame(code, "file_id long, language string, source string")
    found = matching.findings(matching.evaluate(files, good, combine="all"), rules_frame(spark, good)).collect()
    assert sorted((r.rule_id, r.matched, r.start_line) for r in found) == [("r.all", "open(path)", 3), ("r.eval", "eval(user)", 1)]
    assert {r.message for r in found if r.rule_id == "r.eval"} == {"eval of user"}
    union = matching.evaluate(files, good, combine="union").where("rule_id = 'r.all'").count()
    assert union == 3  # the clause of the list still holds, negative entries do not


def test_conditions(spark):
    df = spark.createDataFrame([({"$X": "42", "$S": "abc"},), ({"$X": "nine", "$S": "aab"},), ({},)], "bindings map<string,string>")
    run = lambda c: [r[0] for r in df.select(c).collect()]
    x = cond.bound("$X")
    assert run(cond.compare(x, ">", "7")) == [True, True, False]  # numbers, then string order, then no binding
    assert run(cond.compare(x, "eq", "42.0")) == [True, False, False]
    assert run(cond.regex_condition(x, "^n")) == [False, True, False] and run(cond.name_condition(x, "n*e")) == [False, True, False]
    assert run(F.round(cond.entropy(cond.bound("$S")), 4)) == [1.585, 0.9183, None]
    assert run(cond.expression("int($X) % 2 == 0 and $S in ['abc']")) == [True, False, False]
    assert run(cond.expression("re.match('^a+b', $S)")) == [False, True, False] or run(cond.expression("re.match('a+b', $S)")) == [True, True, False]
    with pytest.raises(ValueError):
        cond.expression("__import__('os')")
    assert run(cond.max_lines(cond.bound("$S"), 1)) == [True, True, None]


def test_syntax(spark):
    files = spark.createDataFrame([(1, "python", "def f(a):\n    x = input()\n    return eval(x)\n"), (2, "javascript", "var q = a.get(b(1));\nif (q == 1) { run(q); }"), (3, "xml", "<a><b/><c>t</c></a>"), (4, "python", "def ("), (5, "bash", "ls -l\n# no\n")], "file_id long, language string, source string")
    nodes = syntax.parse(files)
    kinds = {(r.file_id, r.node_type, r.text) for r in nodes.collect()}
    assert (1, "call_expression", "eval(x)") in kinds and (2, "call_expression", "a.get(b(1))") in kinds and (2, "call_expression", "b(1)") in kinds
    assert (3, "element", "<b />") in kinds and (4, "error", "def (") in kinds
    assert {r.text for r in syntax.inside(nodes, "call_expression", "return_statement").collect()} >= {"eval(x)"}
    assert syntax.inside(nodes.where("file_id = 1"), "call_expression", "return_statement", wanted=False).count() == 1
    edges = dataflow.build_edges(nodes.where("file_id = 1"))
    assert {r.edge_type for r in edges.collect()} == {"control_flow", "data_flow", "return"} or edges.count() > 5
    hit = dataflow.detect(nodes, dataflow.catalog(spark, dataflow.SINKS, "node_type string, name string, sink_type string, vulnerability_type string, confidence double"), ["file_id", "node_id"])
    assert {(r.text, r.vulnerability_type) for r in hit.where("file_id = 1").collect()} == {("eval(x)", "CODE_INJECTION")}
    lines = {(r.file_id, r.node_type) for r in syntax.line_nodes(files).collect()}
    assert (5, "call_expression") in lines and (2, "variable_declaration") in lines
    sql = spark.createDataFrame([("select a, b from t.u where x = 1 order by a;",), ("UPDATE v SET a = 1",)], "sql string")
    rows = syntax.sql_statements(sql).collect()
    assert (rows[0].verb, rows[0].columns, rows[0].table_name, rows[0].condition) == ("SELECT", ["a", "b"], "t.u", "x = 1") and rows[1].table_name == "v"


def test_dataflow(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 1)], "src long, dst long")
    reach = {(r.start, r.node): r.hops for r in dataflow.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert reach == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2}
    paths = {tuple(r.path) for r in dataflow.simple_paths(edges, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(4,)], "node long")).collect()}
    assert paths == {(1, 2, 3, 4), (1, 3, 4)}
    source = spark.createDataFrame([(1, "XSS", 0.9)], "node long, vulnerability_type string, confidence double")
    clean = spark.createDataFrame([(3, 0.9, ["XSS"])], "node long, effectiveness double, vulnerability_types array<string>")
    none = clean.where("node < 0")
    sink = spark.createDataFrame([(4, "XSS")], "node long, vulnerability_type string")
    assert [(r.path, r.vulnerable) for r in dataflow.flows(dataflow.taint(edges, source, none), sink, none).collect()] == [([1, 3, 4], True)]
    assert dataflow.flows(dataflow.taint(edges, source, clean), sink, clean).count() == 0
    values = {r.node: r.value for r in dataflow.propagate_constants(edges, spark.createDataFrame([(2, "x")], "node long, value string")).collect()}
    assert values == {1: "x", 2: "x", 3: "x", 4: "x"}
    calls = spark.createDataFrame([(1, "f", "py", ["a", "b"]), (2, "f", "py", ["a"])], "call_id long, name string, language string, arguments array<string>")
    functions = spark.createDataFrame([("f", 2, "py", ["p", "q"])], "name string, param_count int, language string, parameters array<string>")
    assert [(r.call_id, r.argument, r.parameter) for r in dataflow.zip_arguments(calls, functions).orderBy("position").collect()] == [(1, "a", "p"), (1, "b", "q")]


def test_merging(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.5], ["sanitize", "encode"], [0.5, 0.0])], "v array<double>, k array<string>, e array<double>")
    r = df.select(merging.sequential_mean(F.col("v")).alias("m"), merging.transformed(F.lit(1.0), F.col("k"), F.col("e")).alias("t"), merging.significant(F.lit(0.6), F.col("k"), F.col("e")).alias("s")).first()
    assert (r.m, r.t, r.s) == (0.5, pytest.approx(0.35), True)
    assert df.select(merging.sequential_mean(F.array().cast("array<double>"))).first()[0] is None
    rows = spark.createDataFrame([("a", [0.1, 0.9], 1), ("a", [0.5], 0), ("a", [1.0], 2)], "k string, e array<double>, o int")
    assert merging.most_restrictive(rows, ["k"], "e", "o").first().o == 1


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(fx.normalize_sql(F.lit("select  #{a} from ${t}\n"))) == "select 1 from T0;"
    assert get(fx.line_of(F.lit("a\nbc"), F.lit(4))) == 2 and get(fx.column_of(F.lit("a\nbc"), F.lit(4))) == 2
    assert get(fx.truncate(F.lit("abcdef"), 5)) == "ab..." and get(fx.language_of(F.lit("TS"))) == "javascript"
    assert get(fx.included(F.lit("src/a.py"), ["src*.py"], ["test"])) and not get(fx.included(F.lit("src/test.py"), [], ["test"]))


def test_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.unknown").write_text("y")
    (tmp_path / "bad.sh").write_bytes(b"\xff\xfe")
    files, rejected = src.scan(spark, [str(tmp_path)])
    assert {(r.path.rsplit("/", 1)[1], r.language) for r in files.collect()} == {("a.py", "python"), ("b.unknown", None)}
    assert [(r.language, r.reason) for r in rejected.collect()] == [("bash", "not UTF-8")]
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("m.sql", "select 1")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("n.js")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.zip").write_bytes(z.getvalue())
    (tmp_path / "arc" / "b.tgz").write_bytes(t.getvalue())
    assert {(r.path, bytes(r.content)) for r in src.archives(spark, [str(tmp_path / "arc")]).collect()} == {("m.sql", b"select 1"), ("n.js", b"hi")}
    up = spark.createDataFrame([(base64.b64encode(b"code").decode(),)], "data string")
    assert src.upload(up).first().source == "code"
    java = spark.createDataFrame([('a\n@Select("select 1")\n\n@Select("select 2")',)], "source string")
    assert [(r.snippet, r.start_line) for r in src.embedded(java, '@Select\\("([^"]*)"\\)').collect()] == [("select 1", 2), ("select 2", 4)]


def test_reports(spark):
    f = spark.createDataFrame([("r", "m|x", "critical", "high", "p", 1, 2, 3, 4)], "rule_id string, message string, severity string, confidence string, path string, start_line int, start_column int, end_line int, end_column int")
    assert '"level":"error"' in reports.sarif_results(f).first().result and '"level":"critical"' in reports.sarif_results(f, True).first().result
    assert reports.text_lines(f).first().line == "p:1:2: critical [r] m|x" and "m\\|x" in reports.markdown_rows(f).first().row
    assert '"severity":3' in reports.diagnostics(f).first().diagnostic and reports.failed(f)
    assert '"start_line":1' in reports.json_findings(f).first().finding


def test_streams(spark, tmp_path):
    assert feeds.fixed_window([0, 1, 2, 61.5], 2, 60.0)[0] == [True, True, False, True]
    spark.createDataFrame([(1, float(i)) for i in range(4)] + [(2, 0.0)], "client long, ts double").coalesce(1).write.parquet(str(tmp_path / "in"))
    hits = spark.readStream.schema("client long, ts double").parquet(str(tmp_path / "in"))
    q = feeds.rate_limit(hits, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.client, r.ts, r.admitted) for r in spark.table("limited").collect()) == [(1, 0.0, True), (1, 1.0, True), (1, 2.0, False), (1, 3.0, False), (2, 0.0, True)]
    spark.createDataFrame([("ab ab",)], "source string").write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("source string").parquet(str(tmp_path / "src"))
    for _ in range(2):  # a second run finds nothing new
        q = feeds.incremental(stream, lambda d: d.select(F.regexp_count("source", F.lit("ab")).alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_node_patterns(spark):
    files = spark.createDataFrame([(1, "python", "import os\nx = os.system(cmd)\nif x:\n    eval('1')\n# eval(a)\ny = 5  # eval(b)\n")], "file_id long, language string, source string")
    tree = syntax.parse(files)
    texts = lambda df: {r.text for r in df.collect()}
    assert texts(nodes.search(tree, "@call_expression eval")) == {"eval('1')"}
    assert texts(nodes.search(tree, "(@literal | @import_statement) $X")) == {"'1'", "5", "import os"}
    assert nodes.search(tree, "@literal $X").first().bindings.keys() == {"$X"}
    assert texts(nodes.child_first(nodes.search(tree, "eval"))) == {"eval"}
    with pytest.raises(ValueError):
        nodes.compile_node_pattern("( a")
    assert [nodes.classify(p) for p in ("'a'", "12", "import os", "$F($A)", "a.b(c)", "f(x)", "$X", "a.b", "name", "a + b")] == ["string", "number", "import", "meta_call", "method_call", "call", "metavariable", "member", "identifier", "generic"]
    find = lambda p: texts(tree.where(nodes.classified_column(p)))
    assert find("os.system(...)") == {"os.system(cmd)"} and find("$O.system(x)") == {"os.system(cmd)"} and find("import os") == {"import os"} and find("5") == {"5"}
    assert find("$F($A)") == {"os.system(cmd)", "eval('1')"}
    assert [r.start_line for r in nodes.line_matches(files, "eval($X)").collect()] == [4]
    todo, old = nodes.cached(files.withColumn("path", F.lit("p")), files.select(F.xxhash64(F.lit("v1"), F.lit("p"), "source").alias("cache_key"), F.lit("f").alias("finding")), "v1")
    assert todo.count() == 0 and old.count() == 1
    features = nodes.web_features(spark.createDataFrame([("Laravel $_GET ?? x",)], "source string")).first()
    assert (features.framework, features.tainted_input, features.php_version, features.js_sink) == ("Laravel", True, "7.0+", False)


def test_extensions(spark):
    from rulelake.plans import extensions as ext

    good, _ = load_rules(RULES)
    more = ext.Extensions(validators=[lambda r: "no fix" if r.fix is None else None])
    more.conditions["short"] = lambda v: F.char_length(v) < 3
    df = spark.createDataFrame([("ab",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(more.condition("short", F.col("v"))).collect()] == [True, False, False]
    assert df.select(more.condition("nothing", F.col("v"))).first()[0] is False
    assert more.validate(good[0]) == [] and more.validate(good[1]) == ["no fix"]
    cat = dataflow.catalog(spark, dataflow.SANITIZERS[:2], "node_type string, name string, kind string, effectiveness double, vulnerability_types array<string>")
    assert [r.catalog_ord for r in ext.extended(cat, [("call_expression", "mine", "Own", 1.0, ["XSS"])]).orderBy("catalog_ord").collect()] == [0, 1, 2]
    assert ext.option(good[0], "sql_statement_boundary") and not ext.option(good[0], "sql_statement_boundary", "off")
    calls = []
    assert ext.recovered(lambda: calls.append(1) or 1 / 0, retries=2, fallback=lambda: "f") == "f" and len(calls) == 3
    times: dict = {}
    with ext.timed(times, "x"):
        pass
    assert len(times["x"]) == 1
    seen, o = ext.observed(spark.createDataFrame([("error",), ("info",)], "severity string"))
    seen.collect()
    assert o.get["total"] == 2 and o.get["error"] == 1
