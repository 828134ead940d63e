"""Anchors, many rules at once, one dialect of regular expressions, and spans without pairs."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulelake.operators import anchors, matching, nodes, syntax, tokens
from rulelake.plans.rules import DEFAULTS, default_rules, load_rules
from rulelake.sources import files as src

PIECES = ["ab", "c", "a?", "(bc)+", "(a|bc)", "(?:ca){0,2}", "[ab]", ".", "b{2,3}", "(?i:ab)", r"\.", r"\b", "(?=a)", "(?!b)", "^", "c*?"]


def key(df):
    return sorted((r.file_id, r.rule_id, r.pattern_no, r.start, r.end, r.start_line, r.start_column, r.end_line, r.end_column, r.matched, tuple(sorted(r.bindings.items()))) for r in df.collect())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "|"]), min_size=1, max_size=6), st.lists(st.text("abcAB.", max_size=12), min_size=4, max_size=4))
def test_an_anchor_occurs_wherever_its_pattern_matches(pieces, texts):
    pattern = "".join(pieces)
    anchor = anchors.regex_anchor(pattern)
    for t in texts:
        if anchor and re.search(pattern, t):
            assert any(a in t for a in anchor), (pattern, t, anchor)


def test_anchors_of_patterns():
    a = anchors.regex_anchor
    assert a(r"Licensed under the (\w+) License") == {"Licensed under the "} and a("(foo|bar)+x?") == {"foo", "bar"}
    assert a("(?i)abc") is None and a("a*") is None and a("a|b*") is None and a(r"\Qa.b\E") is None and a("[a[bc]]xx") is None and a("[a-z&&[^b]]yy") is None and a(r"a\vb") is None
    assert a("(?<name>ab+)cd") == {"cd"} and anchors.token_anchor(tokens.TokenPattern("$X = getenv(...)")) == {"getenv"}


def test_many_rules_equal_the_plain_way(spark):
    words = "the of token password key License under and Licensed con para una die und les".split()
    rng = random.Random(1)
    leaves = []
    for i in range(120):
        a, b = rng.choice(words), rng.choice(words)
        text = rng.choice([f"{a} +{b}", f"({a}|{b})s?\\b", f"(?i){a}x", f"{a}[a-z]*\\s+(\\w+)", f"rare{i}", f"^{a}", f"{a}*"])
        leaves.append(tokens.Leaf(f"r{i % 60}", i, "regex", text, ("generic",) if i % 3 else ("en",)))
    leaves += [tokens.Leaf(f"s{i}", 200 + i, "simple", t, ("generic",)) for i, t in enumerate(["token = ...", "$A @ $B", "no such words here", "$X = $X", "..."])]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("language"), F.col("text").alias("source"))
    once = {f"r{i}" for i in range(0, 60, 2)}
    got = key(tokens.match_leaves(docs, leaves, once=once))
    assert got == key(tokens.match_leaves(docs, leaves, once=once, plain=True)) and len(got) > 1000


def test_regular_expressions_are_the_jvms_everywhere(spark):
    """Alone, beside a token pattern, and among many, with groups, empty matches and texts that hold the marks."""
    rows = ["naïve nation", "", "aab\nba\n", "0aa0b1", "01x\n日本 k=12\nk=\n3"]
    files = src.inline(spark, [("python", t) for t in rows])
    for regex in (r"na\w+", "a*", r"(a)|(b)", r"k=(\s*)([0-9]+)", r"\b", "(?m)^", "$"):
        one = load_rules(f"rules: [{{id: r, message: m, severity: info, languages: [python], pattern-regex: '{regex}'}}]")[0]
        two = load_rules(f"rules: [{{id: r, message: m, severity: info, languages: [python], pattern-either: [{{pattern-regex: '{regex}'}}, {{pattern: no such thing}}]}}]")[0]
        alone = key(matching.evaluate(files, one))
        assert alone == key(matching.evaluate(files, two))
        many = [tokens.Leaf("r", 0, "regex", regex, ("python",)), *(tokens.Leaf(f"o{i}", i, "regex", f"never{i}", ("python",)) for i in range(1, 60))]
        assert alone == key(tokens.match_leaves(files, many, once={"r"}))
        if regex not in (r"na\w+", "$", "(?m)^"):  # the same in both dialects
            want = [(k, m.start(), m.end()) for k, t in enumerate(rows) if t for m in re.finditer(regex, t)]
            assert sorted(x[:1] + x[3:5] for x in alone) == want, regex
    assert [(r.matched, r.start, r.end_column) for r in matching.evaluate(files, load_rules("rules: [{id: r, message: m, severity: info, languages: [python], pattern-regex: 'k=(\\s*)([0-9]+)', focus-metavariable: $2}]")[0]).orderBy("start").collect()] == [(t, rows[4].index(t), c) for t, c in (("12", 8), ("3", 2))]


def test_validation_is_the_jvms(spark):
    rule = "rules: [{id: a, message: m, severity: info, languages: [x], pattern-regex: '%s'}, {id: b, message: m, severity: info, languages: [x], pattern: q}]"
    assert "a" in load_rules(rule % "(n)?(?(1)a|b)")[1] and not load_rules(rule % "a++[a-z&&[^b]]")[1]


def test_default_rules_of_every_language(spark):
    for language, (rule_id, _, _, _, wanted) in DEFAULTS.items():
        found = matching.evaluate(src.inline(spark, [(language, f"x ; {t} y") for t in wanted] + [("other", wanted[0])]), default_rules(language))
        assert {r.file_id for r in found.collect()} == set(range(len(wanted))), language


SPAN = st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from([{}, {"$X": "a"}, {"$X": "b"}, {"$X": "a", "$Y": "c"}, {"$Y": "d"}]))


@settings(max_examples=300, deadline=None)
@given(st.lists(SPAN, max_size=12), st.lists(SPAN, max_size=12))
def test_spans_against_all_pairs(left, right):
    rows = [(a, a + n, 0, b) for a, n, b in right]
    spans = matching.Spans(rows)
    agree = lambda b, o: all(o[k] == v for k, v in b.items() if k in o)
    for a, n, b in left:
        e = a + n
        assert spans.overlaps(a, e, b) == any(a < z and s < e and agree(b, o) for s, z, _, o in rows)
        assert spans.same(a, e, b) == any((s, z) == (a, e) and agree(b, o) for s, z, _, o in rows)
        assert spans.holds(a, e, b) == any(s <= a and e <= z for s, z, *_ in rows)
        assert spans.holds(a, e, b, True) == any(s <= a and e <= z and agree(b, o) for s, z, _, o in rows)
        assert spans.within(a, e, b) == any(a <= s and z <= e for s, z, *_ in rows)


def test_span_joins_against_all_pairs(spark):
    rng = random.Random(7)
    make = lambda n: [(f, i, a, a + rng.randint(1, 15), {"$X": rng.choice("ab")}) for i in range(n) for f, a in [(rng.choice([None, 1, 2]), rng.randint(0, 40))]]
    left, right = make(150), make(60)
    frame = lambda rows: spark.createDataFrame(rows, "file_id long, no long, start long, end long, bindings map<string,string>")
    nos = lambda df: sorted(r.no for r in df.collect())
    some = lambda test: [x[1] for x in left if any(x[0] == y[0] and test(*x[2:], *y[2:]) for y in right)]
    for wanted in (True, False):
        pick = lambda hit: sorted(x[1] for x in left if (x[1] in set(hit)) == wanted)
        assert nos(matching.contained(frame(left), frame(right), "file_id", wanted)) == pick(some(lambda a, e, _, s, z, __: s <= a and e <= z))
        assert nos(matching.contained(frame(left), frame(right), "file_id", wanted, "descendant")) == pick(some(lambda a, e, _, s, z, __: a <= s and z <= e))
        assert nos(matching.overlapping(frame(left), frame(right), "file_id", anti=not wanted)) == pick(some(lambda a, e, b, s, z, o: a < z and s < e and b == o))
    held = [x[1] for x in left if any(x[0] == y[0] and x[2] <= y[2] and y[3] <= x[3] and x[2:4] != y[2:4] for y in left)]
    assert nos(matching.innermost(frame(left), ["file_id"])) == sorted({x[1] for x in left} - set(held))


def test_node_joins_against_all_pairs(spark):
    tree = syntax.parse(src.inline(spark, [("javascript", "f(g(a, h(b)), g(c)); x = g(f(d), e); h(i);")]))
    rows = tree.collect()
    above = lambda o, i: o.node_id < i.node_id and i.post < o.post
    of = lambda kind: [r for r in rows if r.node_type == kind]
    for wanted in (True, False):
        want = sorted(i.node_id for i in of("identifier") if any(above(o, i) for o in of("assignment")) == wanted)
        assert sorted(r.node_id for r in syntax.inside(tree, "identifier", "assignment", wanted).collect()) == want
    calls = of("call_expression")
    assert sorted(r.node_id for r in nodes.child_first(tree.where("node_type = 'call_expression'")).collect()) == sorted(o.node_id for o in calls if not any(above(o, i) for i in calls))


def test_a_file_of_many_spans_costs_its_sorting(spark):
    """Every span lies in one outer span: pairs would be 3e10."""
    n = 300_000
    inner = spark.range(n).select(F.lit(1).alias("file_id"), (F.col("id") * 2 + 1).alias("start"), (F.col("id") * 2 + 2).alias("end"))
    outer = spark.range(100_000).select(F.lit(1).alias("file_id"), F.lit(0).cast("long").alias("start"), (F.col("id") + 2 * n).alias("end"))
    began = time.time()
    assert matching.contained(inner, outer, "file_id").count() == n and matching.innermost(inner, ["file_id"]).count() == n
    assert time.time() - began < 60


def test_many_list_rules_are_one_plan(spark):
    """Lists, negations, containment and conditions of 300 rules at once, each as it is alone."""
    one = "  - {id: r%d, message: m, severity: info, languages: [generic], patterns: [{pattern: 'call($A, %d)'}, {pattern-not: 'call(no, %d)'}, {pattern-inside: 'begin ... end'}, {metavariable-regex: {metavariable: $A, regex: '[a-z]+'}}]}\n"
    rules = load_rules("rules:\n" + "".join(one % (i, i, i) for i in range(300)))[0]
    text = "begin call(a, 1) call(no, 1) call(B, 1) call(c, 2) end call(d, 1)"
    files = src.inline(spark, [("x", text), ("x", "begin " + " ".join(f"call(v, {i})" for i in range(300)) + " end")])
    got = sorted((r.file_id, r.rule_id, r.matched) for r in matching.evaluate(files, rules).collect())
    assert got == sorted([(0, "r1", "call(a, 1)"), (0, "r2", "call(c, 2)"), *((1, f"r{i}", f"call(v, {i})") for i in range(300))])


def test_followed_and_preceded_clauses(spark):
    files = src.inline(spark, [("x", "open(a) use(a) close(a)"), ("x", "close(b) open(b)"), ("x", "open(c)")])
    for clause, want in (("pattern-followed-by: close($Y)", ["open(a)"]), ("pattern-preceded-by: close($Y)", ["open(b)"])):
        rules = load_rules("rules: [{id: r, message: m, severity: info, languages: [generic], patterns: [{pattern: open($X)}, {%s}]}]" % clause)[0]
        assert [r.matched for r in matching.evaluate(files, rules).collect()] == want


def test_focus_in_lists(spark):
    rules = load_rules("rules: [{id: f, message: m, severity: info, languages: [python], patterns: [{pattern: 'call($A, $B)'}, {pattern-not: 'call($A, 1)'}, {focus-metavariable: $B}]}]")[0]
    found = matching.evaluate(src.inline(spark, [("python", "call(b, 1)\n call(bb, c:b)\ncall(x, y)")]), rules).orderBy("start").collect()
    assert [(r.matched, r.start, r.start_line, r.start_column, r.end_column, r.bindings) for r in found] == [("c:b", 21, 2, 11, 14, {"$A": "bb", "$B": "c:b"}), ("y", 34, 3, 9, 10, {"$A": "x", "$B": "y"})]


def test_custom_conditions_of_rules(spark):
    from rulelake.plans.extensions import Extensions

    more = Extensions(conditions={"short": lambda v: F.char_length(v) < 3}, aggregates={"spread": lambda c: F.max(c) - F.min(c)})
    one = "{id: a, message: m, severity: info, languages: [python], pattern: call($A), custom-condition: {name: short, metavariable: $A}}"
    two = "{id: b, message: m, severity: info, languages: [python], patterns: [{pattern: call($A)}, {pattern-not: call(x)}, {custom-condition: {name: short, metavariable: $A}}]}"
    rules = load_rules(f"rules: [{one}, {two}]")[0]
    files = src.inline(spark, [("python", "call(x) call(yy) call(zzz)")])
    assert sorted((r.rule_id, r.matched) for r in matching.evaluate(files, rules, extensions=more).collect()) == [("a", "call(x)"), ("a", "call(yy)"), ("b", "call(yy)")]
    with pytest.raises(KeyError):
        matching.evaluate(files, rules)
    assert spark.range(5).agg(more.aggregate("spread", F.col("id"))).first()[0] == 4
    with pytest.raises(KeyError):
        more.aggregate("none")


def test_lines_with_captures(spark):
    files = spark.createDataFrame([(1, "set a = b; set c = c; # set d = d\n// set e = e\nset f = f")], "file_id long, source string")
    key = lambda p: sorted((r.start_line, r.start_column, r.matched, tuple(sorted(r.bindings.items()))) for r in nodes.line_captures(files, p).collect())
    assert key("set $X = $X;") == [(1, 12, "set c = c;", (("$X", "c"),))]
    assert [x[2:] for x in key("set $X = $Y")] == [("set a = b;", (("$X", "a"), ("$Y", "b;"))), ("set c = c;", (("$X", "c"), ("$Y", "c;"))), ("set f = f", (("$X", "f"), ("$Y", "f")))]
