"""Rules from files to findings: sources of rules, clauses that act on matches, graphs with cycles, stores and helpers."""

import pytest
from pyspark.sql import functions as F

from rulelake.functions.types import fits, type_compatible
from rulelake.operators import conditions as cond
from rulelake.operators import dataflow, flowstats, matching, nodes, syntax, tokens
from rulelake.plans import extensions as ext
from rulelake.plans.rules import default_rules, literal_rules, load_rules, read_rule_files, select_rules
from rulelake.plans.storage import shared_folder
from rulelake.sources import files as src
from rulelake.sources import reports


def code(spark, *rows):
    return src.inline(spark, list(rows))


def texts(found):
    return sorted((r.rule_id, r.matched) for r in found.collect())


def test_rule_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.yaml").write_text("rules: [{id: one, message: m, severity: error, languages: [python], pattern: f(x)}]")
    (tmp_path / "two.yml").write_text("rules: [{id: two, message: m, severity: info, languages: [generic], pattern: g}, {id: one, message: other, severity: info, languages: [java], pattern: h}]")
    (tmp_path / "bad.yaml").write_text("rules: [")
    (tmp_path / "not.txt").write_text("rules: []")
    rules, warnings = read_rule_files(spark, [str(tmp_path)])
    assert {r.id for r in rules} == {"one", "two"} and len(warnings) == 1 and next(iter(warnings)).endswith("bad.yaml")
    assert [r.id for r in default_rules("ruby", [])] == ["ruby-puts-usage"] and [r.id for r in default_rules("ruby", rules)] == ["two"]
    assert [r.id for r in select_rules(rules, language="generic")] == ["two"] and select_rules(rules, enabled=False) == [] and len(select_rules(rules, name="O")) == 2
    found = matching.evaluate(code(spark, ("c", "gets(b); strcpy(a, b);"), ("java", 'x = "MD5";')), default_rules("c") + literal_rules(["java"]))
    assert texts(found) == [("c-buffer-overflow", "gets("), ("c-buffer-overflow", "strcpy("), ("java-weak-hash-md5", '"MD5"')]  # either of a default rule's texts
    listing = reports.rule_listing(__import__("rulelake.plans.rules", fromlist=["rules_frame"]).rules_frame(spark, rules), "markdown")
    assert "| two | two | info | generic |" in {r.line for r in listing.collect()}


def rules_of(yaml):
    return load_rules("rules:\n" + yaml)[0]


def test_rules_without_positive_entries(spark):
    files = code(spark, ("python", "def f(): open(a) close(b) end"), ("python", "open(c)"))
    around = rules_of("  - {id: r, message: m, severity: info, languages: [python], patterns: [{pattern-inside: 'def f ( ) : ... end'}, {pattern-not: 'nothing(x)'}]}")
    assert texts(matching.evaluate(files, around)) == [("r", "def f(): open(a) close(b) end")]
    alone = rules_of("  - {id: n, message: m, severity: info, languages: [python], patterns: [{pattern-not: 'open(a)'}]}")
    assert matching.evaluate(files, alone).count() == 0
    off = rules_of("  - {id: off, message: m, severity: info, languages: [python], pattern: open($X), enabled: false}\n  - {id: t, message: m, severity: info, languages: [python], mode: taint, pattern-sources: [{pattern: a}], pattern-sinks: [{pattern: b}]}")
    assert matching.evaluate(files, off).count() == 0 and matching.evaluate(files, []).count() == 0


def test_focus_options_and_where(spark):
    files = code(spark, ("python", "call(alpha, 2) call(be, 30)"), ("sql", "select a from t; delete from u where x"))
    focus = rules_of("  - {id: f, message: m, severity: info, languages: [python], pattern: 'call($A, $B)', focus-metavariable: $A}")
    assert [(r.matched, r.start, r.start_column) for r in matching.evaluate(files, focus).orderBy("start").collect()] == [("alpha", 5, 6), ("be", 20, 21)]
    where = rules_of("  - {id: w, message: m, severity: info, languages: [python], pattern: 'call($A, $B)', where: 'int($B) > 5 and len($A) < 4'}")
    assert texts(matching.evaluate(files, where)) == [("w", "call(be, 30)")]
    across = "  - {id: s, message: m, severity: info, languages: [sql], pattern: 'from $T where ...'%s}"
    assert texts(matching.evaluate(files, rules_of(across % ""))) == [("s", "from u where x")]
    whole = rules_of(across % ", options: {sql_statement_boundary: false}")
    assert len(texts(matching.evaluate(files, whole))) == 2 and len(texts(matching.evaluate(files, rules_of(across % ""), statements=False))) == 2


def test_places_of_both_matchers_agree(spark):
    """A regular expression by built-in functions, and through the Arrow pass beside a token pattern."""
    files = code(spark, ("python", "a\n\nxx=1 yy=2\n日本 zz=3\n=\nq=\n4 é=5"), ("python", "zz=1"), ("python", ""))
    regex = "pattern-regex: '(?m)([a-z]+|é)=\\s*([0-9])'"
    fast = rules_of("  - {id: r, message: m, severity: info, languages: [python], %s}" % regex)
    slow = rules_of("  - {id: r, message: m, severity: info, languages: [python], pattern-either: [{%s}, {pattern: 'no such thing here'}]}" % regex)
    key = lambda df: sorted((r.file_id, r.start, r.end, r.start_line, r.start_column, r.end_line, r.end_column, r.matched, tuple(sorted(r.bindings.items()))) for r in df.collect())
    got = key(matching.evaluate(files, fast))
    assert got == key(matching.evaluate(files, slow)) and len(got) == 6
    many = code(spark, ("python", " ".join(f"k{i}\n=" for i in range(700))))
    one = matching.evaluate(many, rules_of("  - {id: r, message: m, severity: info, languages: [generic], pattern-regex: 'k([0-9]+)\\n'}")).orderBy("start").collect()
    assert [r.bindings["$1"] for r in one] == [str(i) for i in range(700)] and (one[699].start_line, one[699].start_column) == (700, 3)


def test_equal_spans_of_alternatives_on_a_stream(spark, tmp_path):
    rules = rules_of("  - {id: e, message: m, severity: info, languages: [generic], pattern-either: [{pattern-regex: 'ab'}, {pattern-regex: 'a.'}]}")
    spark.createDataFrame([(1, "ab ac ab")], "file_id long, source string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id long, source string").parquet(str(tmp_path / "in"))
    q = matching.evaluate(stream, rules, language_col=None).writeStream.format("memory").queryName("spans").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.start, r.matched) for r in spark.table("spans").collect()) == [(0, "ab"), (3, "ac"), (6, "ab")]
    assert not q.lastProgress or not q.lastProgress.stateOperators


def test_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(130)], "src long, dst long")
    reach = dataflow.reachable(chain, spark.createDataFrame([(0,)], "node long"))
    assert reach.count() == 131 and reach.agg(F.max("hops")).first()[0] == 130
    diamond = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (3, 5), (5, 4)], "src long, dst long")
    got = {(r.node, r.source): (r.confidence, r.length) for r in dataflow.enhanced_taint(diamond, spark.createDataFrame([(1, 90), (1, 60)], "node long, confidence int").groupBy("node").agg(F.max("confidence").alias("confidence"))).collect()}
    assert got[1, 1] == (90, 1) and got[2, 1] == got[3, 1] == (85, 2) and got[4, 1] == (76, 3) and got[5, 1] == (76, 3)
    calls = diamond.select(F.concat(F.lit("f"), "src").alias("caller"), F.concat(F.lit("f"), "dst").alias("callee"))
    paths = {r.function: r.path for r in dataflow.shortest_call_path(calls, spark.createDataFrame([("f1",)], "function string")).collect()}
    assert paths["f4"] == ["f1", "f2", "f4"] and len(paths) == 5
    inter = {r.function: r.confidence for r in dataflow.interprocedural(calls, spark.createDataFrame([("f1", "s", 1.0)], "function string, source string, confidence double")).collect()}
    assert inter["f4"] == pytest.approx(0.81) and inter["f1"] == 1.0


def test_nodes_and_types(spark):
    tree = syntax.parse(code(spark, ("javascript", "x = f(1);\ny = g(x);"), ("java", "a" * 50)), id_col="file_id", caps={"java": 10})
    assert [r.node_type for r in tree.where("file_id = 1").collect()] == ["error"]
    with pytest.raises(ValueError):
        syntax.parse(code(spark, ("java", "")), caps={"java": 0})
    at = nodes.nodes_at(tree, spark.createDataFrame([(0, 2)], "file_id long, line int")).first()
    assert at.node_type in ("identifier", "call_expression") and at.text in ("x", "g(x)")
    counted = nodes.with_child_count(tree.where("file_id = 0"))
    assert {r.text for r in counted.where(cond.every([cond.node_attribute("type", "assignment"), cond.node_attribute("child_count", "2")])).collect()} == {"x = f(1);", "y = g(x);"}
    assert counted.where(cond.text_holds("g(")).count() == 3
    built = syntax.build(spark, 7, ("program", None, [("call_expression", "f(a)", [("identifier", "a")]), ("literal", "1")]))
    assert {(r.node_type, r.node_id, r.post, r.parent_id) for r in built.collect()} == {("program", 0, 3, None), ("call_expression", 1, 1, 0), ("identifier", 2, 0, 1), ("literal", 3, 2, 0)}
    assert [r.text for r in nodes.search_regex(built, "^f").collect()] == ["f(a)"] and nodes.search_regex(built, "^f", False).count() == 3
    assert [r.node_type for r in syntax.inside(built, "identifier", "call_expression").collect()] == ["identifier"]
    p, o = {"kind": "primitive", "name": "int"}, {"kind": "object", "name": "int"}
    arr, uni, fun = {"kind": "array", "of": p}, {"kind": "union", "of": [o, p]}, {"kind": "function"}
    assert fits(None, fun) and fits(p, p) and not fits(p, o) and fits(arr, {"kind": "array", "of": uni}) and fits(uni, p) and fits(p, uni) and not fits(fun, fun) and not fits(arr, p)
    df = spark.createDataFrame([('{"kind": "primitive", "name": "int"}', None)], "a string, b string")
    assert df.select(type_compatible(F.col("a"), F.col("b"))).first()[0]
    assert tokens.holds("x = eval(a);", ["eval($X);"]) and not tokens.holds("x", ["y"])


def test_stores_pages_and_reports(spark, tmp_path):
    path = str(tmp_path / "jobs")
    for status, when in (("running", 1), ("completed", 2)):
        reports.store_jobs(spark.createDataFrame([("j", status, when)], "job_id string, status string, created_at long"), path)
    assert [(r.job_id, r.status) for r in reports.read_jobs(spark, path).collect()] == [("j", "completed")] and reports.read_jobs(spark, path, "running").count() == 0
    found = spark.createDataFrame([("r", f"m|{i}", "error", "high", "p", i, 2, i, 4, None) for i in range(1, 4)], "rule_id string, message string, severity string, confidence string, path string, start_line int, start_column int, end_line int, end_column int, fix string")
    reports.store_results(found, "j", str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).where("job_id = 'j'").count() == 3
    import json

    for how in ("json", "sarif"):
        out = str(tmp_path / how)
        reports.write_report(reports.report(found, how, 1, 1), out)
        whole = json.loads("".join(r.value for r in spark.read.text(out).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()))
        assert len(whole["findings"] if how == "json" else whole["runs"][0]["results"]) == 3
    assert reports.report(found.where("false"), "yaml", 1, 1).where("line = 'No issues found!'").count() == 1
    assert reports.report(found, "html", 1, 1).where("line like '<div%'").count() == 3 and reports.report(found, "markdown", 1, 1).where("line like '| error%'").count() == 3
    assert reports.scan_summary(found, 1, 2).first().lines[-1] == "Ran 2 rules on 1 file: 3 findings."
    reports.write_table(found, "csv", str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3
    assert flowstats.page_meta(95, 40, 20) == {"page": 3, "per_page": 20, "total": 95, "total_pages": 5, "has_next": True, "has_prev": True}
    more = ext.Extensions(formatters={"count": lambda f: f.agg(F.count(F.lit(1)).cast("string").alias("line"))})
    assert more.format(found, "count").first().line == "3"
    with pytest.raises(KeyError):
        more.format(found, "none")


def test_run_helpers(spark, monkeypatch):
    cache = ext.BoundedCache(2)
    for name in ("a", "b", "a", "c", "b"):
        assert cache.get(name, lambda: spark.range(3)).count() == 3
    assert (cache.hits, cache.misses, list(cache.kept)) == (1, 4, ["c", "b"])
    cache.clear()
    assert ext.Background(spark, lambda: spark.range(5).count()).result(60) == 5
    slow = ext.Background(spark, lambda: spark.range(0, 4, 1, 4).mapInArrow(lambda bs: (__import__("time").sleep(30) or b for b in bs), "id long").count())
    with pytest.raises(TimeoutError):
        slow.result(1.0)
    assert slow.cancelled
    with pytest.raises(ZeroDivisionError):
        ext.Background(spark, lambda: 1 / 0).result(10)

    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        shared_folder(Session)
