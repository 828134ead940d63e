"""Rules with nested roles, labels and functions; what languages, scopes and calls keep apart."""

import random

import pytest

from rulelake.operators import matching, summaries, taint_rules
from rulelake.plans.rules import load_rules, parse_requires, satisfied
from rulelake.sources import files as src

HEAD = "{id: t, message: m, severity: error, languages: [%s], mode: taint, pattern-sources: [{pattern: read()}], pattern-sinks: [{pattern: run($X)}]%s}"


def lines(spark, rule, *files):
    rules, bad = load_rules("rules: [" + rule + "]")
    assert not bad
    found = taint_rules.evaluate_flows(src.inline(spark, list(files)), rules).collect()
    return sorted((r.file_id, r.start_line, r.source_line) for r in found)


def plain(language="javascript", more=""):
    return HEAD % (language, more)


def test_requires():
    e = parse_requires("(A and not B) or C")
    assert [satisfied(e, s) for s in ({"A"}, {"A", "B"}, {"B", "C"}, set())] == [True, False, True, False]
    assert satisfied(None, {"__SOURCE__"}) and not satisfied(None, {"A"}) and satisfied(parse_requires("True"), set())
    for bad in ("A +", "A + B", "f(A)", "1"):
        with pytest.raises(ValueError):
            parse_requires(bad)
    role = "{id: r, message: m, severity: error, languages: [x], mode: taint, pattern-sources: [{pattern: a, label: A, requires: %s}], pattern-sinks: [{pattern: b, requires: A}]}"
    good = "{id: q, message: m, severity: error, languages: [x], pattern: q}"
    assert "r" in load_rules(f"rules: [{role % 'not B'}, {good}]")[1] and "r" in load_rules(f"rules: [{role % 'B or'}, {good}]")[1] and not load_rules(f"rules: [{role % 'B'}, {good}]")[1]


def test_the_rule_file_format_with_labels(spark):
    rule = "{id: tainting, mode: taint, languages: [python], message: m, severity: ERROR, pattern-sinks: [{requires: TAINTED, pattern: sink(...)}], pattern-sources: [{label: TAINTED, pattern: source(...)}]}"
    assert lines(spark, rule, ("python", "x = source(1)\nsink(x)\nsink(y)"), ("javascript", "x = source(1);\nsink(x);")) == [(0, 2, None)]


def test_rules_look_at_files_of_their_languages(spark):
    text = "x = read()\nrun(x)"
    assert lines(spark, plain(), ("javascript", text), ("python", text)) == [(0, 2, 1)]
    assert lines(spark, plain("generic"), ("javascript", text), ("python", text)) == [(0, 2, 1), (1, 2, 1)]
    off = load_rules("rules: [" + plain("javascript", ", dataflow: {must_flow: false}").replace("pattern-sources", "pattern-sources") + "]")[0]
    assert taint_rules.evaluate_flows(src.inline(spark, [("javascript", "read()\nrun(1)"), ("python", "read()\nrun(1)")]), off).count() == 1


def test_nested_sources_and_sinks(spark):
    rule = """{id: os, languages: [java], message: m, severity: WARNING, mode: taint,
      pattern-sinks: [{patterns: [{pattern-inside: $R.exec($SINK)}, {pattern: $SINK}]}],
      pattern-sources: [{patterns: [{pattern: $F()}, {pattern-not: safe()}, {metavariable-regex: {metavariable: $F, regex: 's.*|get'}}]}, {pattern-either: [{pattern: 'a(...)'}, {pattern-regex: 'b_[0-9]+'}]}]}"""
    code = 'String x = get();\nr.exec(x);\nString y = safe();\nr.exec(y);\nString z = a(1);\nr.exec(z);\nString w = b_7;\nr.exec(w);\nString v = c(2);\nr.exec(v);'
    assert lines(spark, rule, ("java", code)) == [(0, 2, 1), (0, 6, 5), (0, 8, 7)]


def test_functions_of_python(spark):
    code = "def give():\n    return read()\ndef both(a, b):\n    if a:\n        return both(b, a)\n    return b\ndef none(a):\n    return 1\nx = give()\ny = both(1, x)\nrun(y)\nrun(none(x))\ndef deep(q):\n    run(q)\ndeep(x)"
    assert lines(spark, plain("python"), ("python", code)) == [(0, 11, 2), (0, 14, 2)]


def test_calls_return_to_their_own_callers(spark):
    code = "function id(x) { return x }\na = id(read())\nb = id(1)\nrun(b)\nrun(a)"
    assert lines(spark, plain(), ("javascript", code)) == [(0, 5, 2)]


def test_scopes(spark):
    code = "function f(x) {\n  y = read()\n  return 1\n}\nfunction g(y) {\n  run(y)\n}\nrun(y)\nz = read()\nfunction h() {\n  run(z)\n}"
    assert lines(spark, plain(), ("javascript", code)) == [(0, 11, 9)]


def test_depth_is_a_bound_only_where_it_is_named(spark):
    chain = "v0 = read()\n" + "\n".join(f"v{i} = v{i - 1}" for i in range(1, 80)) + "\nrun(v79)"
    assert lines(spark, plain(), ("javascript", chain)) == [(0, 81, 1)]
    short = plain("javascript", ", dataflow: {max_depth: 20}")
    assert lines(spark, short, ("javascript", chain)) == [] and lines(spark, short, ("javascript", "a = read()\nrun(a)")) == [(0, 2, 1)]


def test_focus_moves_the_sink(spark):
    rule = "{id: f, message: m, severity: error, languages: [python], mode: taint, pattern-sources: [{pattern: read()}], pattern-sinks: [{patterns: [{pattern: 'run($A, $B)'}, {focus-metavariable: $B}]}]}"
    assert lines(spark, rule, ("python", "x = read()\nrun(x, y)\nrun(y, x)")) == [(0, 3, 1)]


def test_sanitizers_and_labels_meet(spark):
    rule = """{id: l, message: m, severity: error, languages: [python], mode: taint, pattern-sources: [{pattern: a(), label: A}, {pattern: b(), label: B}, {pattern: both($X), label: C, requires: A and B}],
      pattern-sinks: [{pattern: run($X), requires: C}], pattern-sanitizers: [{pattern: clean($X)}]}"""
    code = "x = a()\ny = b()\nrun(both(x + y))\nrun(both(x))\nrun(both(x + clean(y)))\nz = x\nrun(both([z, y]))"
    assert [x[1] for x in lines(spark, rule, ("python", code))] == [3]  # a list is no holder of values


def test_node_rules(spark):
    rules = load_rules("rules: [{id: r, message: m, severity: info, languages: [javascript], patterns: [{pattern: run(...)}, {pattern-not: run(1)}]}]")[0]
    files = src.inline(spark, [("javascript", "run(1); run(2);"), ("python", "run(2)")])
    assert [r.text for r in taint_rules.evaluate_nodes(files, rules).collect()] == ["run(2)"]
    same = sorted(r.matched for r in matching.evaluate(files, rules).collect())
    assert same == ["run(2)"]
    body = load_rules("rules: [{id: b, message: m, severity: info, languages: [python], patterns: [{pattern: open($X)}, {pattern-inside: 'def $F(...): ...'}, {pattern-not-inside: 'with $Y: ...'}]}]")[0]
    code = "def f(a):\n    open(1)\n    with b:\n        open(2)\nopen(3)"
    assert [r.text for r in taint_rules.evaluate_nodes(src.inline(spark, [("python", code)]), body).collect()] == ["open(1)"]


def walk_stacks(edges, calls, returns, sources, sinks, clean):
    """Every path by hand: a value that goes into a call comes back to it only."""
    out = set()
    for s in sources:
        seen, work = set(), [(s, (), True)]
        while work:
            n, stack, fresh = work.pop()
            if (n, stack, fresh) in seen or len(stack) > 6 or (n in clean and not (n == s and fresh)):
                continue
            seen.add((n, stack, fresh))
            if n in sinks and not (n == s and fresh):
                out.add((s, n))
            work += [(m, stack, False) for m in edges.get(n, ())]
            work += [(p, (*stack, (c, f)), False) for a, c, f, p in calls if a == n]
            for f, rs in returns.items():
                if n in rs:
                    if stack and stack[-1][1] == f:
                        work.append((stack[-1][0], stack[:-1], False))
                    elif not stack:
                        work += [(c, (), False) for c in {c for _, c, g, _ in calls if g == f}]
    return out


def test_walk_against_every_path():
    rng = random.Random(11)
    hits = 0
    for _ in range(150):
        n_functions, size = rng.randint(1, 4), 5
        program, calls, returns, edges = summaries.Program(), [], {}, {}
        nodes = {f: list(range(f * 100, f * 100 + size)) for f in range(n_functions + 1)}  # 0: outside
        for f, own in nodes.items():
            for _ in range(rng.randint(2, 6)):
                a, b = rng.sample(own, 2)
                program.next[a].append(b)
                edges.setdefault(a, []).append(b)
            if f:
                program.parameters[f] = own[:1]
                program.returns[f] = own[-1:]
                returns[f] = own[-1:]
        for _ in range(rng.randint(1, 4)):
            g, f = rng.randint(0, n_functions), rng.randint(1, n_functions)
            a, c = rng.sample(nodes[g][1:], 2)
            if any(x[1] == c for x in calls):
                continue
            calls.append((a, c, f, nodes[f][0]))
            program.arguments.append(calls[-1])
            program.calls[f].append(c)
            program.called_in[g].add(f)
        every = [n for own in nodes.values() for n in own]
        sources, sinks, clean = rng.sample(every, 2), rng.sample(every, 3), set(rng.sample(every, 1))
        got = {(sources[i], n) for n, bits in summaries.tainted(program, [(s, "L", None) for s in sources], [(n, parse_requires("L")) for n in sinks], clean, None) for i in bits}
        want = walk_stacks(edges, calls, returns, sources, sinks, clean)
        assert got == want
        hits += len(want)
    assert hits > 50
