"""Walks over graphs deeper than the bounds that the operators once had."""

from rulelake.operators import dataflow


def test_scopes_deeper_than_fifty(spark):
    depth = 53
    scopes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(depth)], "scope_id long, parent_id long")
    symbols = spark.createDataFrame([(0, "x", "root")], "scope_id long, name string, node_id string")
    uses = spark.createDataFrame([(1, depth - 1, "x")], "use_id long, scope_id long, name string")
    assert [r.node_id for r in dataflow.resolve_scopes(uses, scopes, symbols).collect()] == ["root"]


def test_simple_paths_longer_than_eight_with_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(10, 0)], "src long, dst long")
    at = lambda n: spark.createDataFrame([(n,)], "node long")
    assert [r.path for r in dataflow.simple_paths(edges, at(0), at(10)).collect()] == [list(range(11))]


def test_null_source_on_a_cycle_ends(spark):
    calls = spark.createDataFrame([("f", "g"), ("g", "f")], "caller string, callee string")
    taints = spark.createDataFrame([("f", None, 1.0)], "function string, source string, confidence double")
    assert {(r.function, r.confidence) for r in dataflow.interprocedural(calls, taints).collect()} == {("f", 1.0), ("g", 0.9)}


def plain_scopes(uses, parent, symbols):
    out = {}
    for u, s, name in uses:
        seen = set()
        while s is not None and s not in seen and (s, name) not in symbols:
            seen.add(s)
            s = parent.get(s)
        out[u] = symbols.get((s, name))
    return out


def test_scopes_against_a_walk(spark):
    import random

    rng = random.Random(5)
    parent = {i: rng.choice([None, *range(max(0, i - 6), i)]) if i else None for i in range(120)}
    symbols = {(rng.randrange(120), rng.choice("xyz")): f"n{i:03d}" for i in range(60)}
    uses = [(i, rng.randrange(120), rng.choice("xyzw")) for i in range(300)]
    got = dataflow.resolve_scopes(
        spark.createDataFrame(uses, "use_id long, scope_id long, name string"), spark.createDataFrame([(k, v) for k, v in parent.items()], "scope_id long, parent_id long"),
        spark.createDataFrame([(s, n, v) for (s, n), v in symbols.items()], "scope_id long, name string, node_id string"),
    )
    want = plain_scopes(uses, parent, symbols)
    assert {r.use_id: r.node_id for r in got.collect()} == want and len(set(want.values())) > 20


def test_a_chain_of_ten_thousand_scopes_takes_few_jobs(spark):
    n = 10_000
    scopes = spark.range(n).selectExpr("id as scope_id", "if(id = 0, null, id - 1) as parent_id")
    symbols = spark.createDataFrame([(0, "x", "root"), (7000, "x", "deep")], "scope_id long, name string, node_id string")
    uses = spark.createDataFrame([(1, 6999, "x"), (2, n - 1, "x"), (3, 7000, "x"), (4, 5, "y")], "use_id long, scope_id long, name string")
    rounds = []
    real = dataflow.saved
    dataflow.saved = lambda df, name: rounds.append(name) or real(df, name)
    try:
        got = {r.use_id: r.node_id for r in dataflow.resolve_scopes(uses, scopes, symbols).collect()}
    finally:
        dataflow.saved = real
    assert got == {1: "root", 2: "deep", 3: "deep", 4: None} and len(rounds) < 20
