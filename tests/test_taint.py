"""The taint queries against a walk by hand: no step limit, ended by the confidence alone."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from rulelake import catalog

USERS = {
    1: ["signup", "click", "click", "error", "click", "click", "purchase", "click", "error"],
    2: ["signup"] + ["view"] * 11 + ["purchase"],
    3: ["click", "signup", "view", "click", "click", "click", "click", "purchase", "signup", "view", "error"],
}


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    rows = [(u * 100 + i, u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), e, 1.0) for u, es in USERS.items() for i, e in enumerate(es)]
    pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(d / "events.parquet")
    return str(d)


def walked():
    for u, es in USERS.items():
        for i in (i for i, e in enumerate(es) if e == "signup"):
            conf, views = 0.9, 0
            for j in range(i, len(es)):
                if j > i and es[j] == "view":
                    conf, views = conf * 0.8, views + 1
                if conf < 0.1:
                    break
                yield u * 100 + i, u * 100 + j, conf, j - i + 1, views, es[j]


def test_taint_propagation_ends_by_confidence_only(spark, events):
    got = {(r.source, r.node): (r.confidence, r.length) for r in catalog.taint_propagation(spark, events).collect()}
    assert got == {(s, n): (round(c, 6), length) for s, n, c, length, _, _ in walked()}
    assert (200, 209) in got and (200, 210) not in got  # 0.1208 and 0.0966
    sql = duckdb.sql(catalog.ORACLES["taint_propagation"].replace("from events", f"from '{events}/events.parquet'")).fetchall()
    assert {(s, n): (c, k) for s, n, c, k in sql} == got


def test_taint_flows_of_any_length(spark, events):
    got = {(r.source, r.sink): (r.confidence, r.vulnerable) for r in catalog.taint_flows(spark, events).collect()}
    want = {(s, n): (round(c * 0.8**v, 6), True) for s, n, c, k, v, e in walked() if k > 1 and e in ("purchase", "error") and c > 0.5 and c * 0.8**v > 0.5}
    assert got == want and (100, 108) in got and (301, 307) in got


def test_walks_of_small_and_large_graphs_agree(spark, monkeypatch):
    """Random graphs with cycles, ties, repeated edges and several sanitizers: in one task, step by step, and some of each."""
    import random

    from rulelake.operators import dataflow

    rng = random.Random(3)
    edges, sources, clean = [], [], []
    for g in range(12):
        nodes = [g * 50 + k for k in range(rng.randint(3, 14))]
        edges += [(rng.choice(nodes), rng.choice(nodes), g) for _ in range(3 * len(nodes))]
        sources += [(n, rng.choice("XY"), rng.choice([0.9, 0.7]), g) for n in rng.sample(nodes, 2)]
        clean += [(rng.choice(nodes), rng.choice([0.2, 0.5, 0.95]), rng.choice([["X"], ["X", "Y"], []]), g) for _ in range(4)]
    tables = (
        spark.createDataFrame(edges, "src long, dst long, graph int"), spark.createDataFrame(sources, "node long, vulnerability_type string, confidence double, graph int"),
        spark.createDataFrame(clean, "node long, effectiveness double, vulnerability_types array<string>, graph int"),
    )
    key = lambda df: sorted((r.source, r.node, r.vulnerability_type, r.confidence, tuple(r.path)) for r in df.collect())
    want = key(dataflow.taint(*tables))
    near = dataflow.taint(*tables, "graph")
    assert key(near) == want and len(want) > 60
    held = {n for n, *_ in clean}
    assert all(r.passed == [n for n in r.path if n in held] for r in near.collect())
    sinks = spark.createDataFrame([(n, v) for n in {b for _, b, _ in edges} for v in "XY"], "node long, vulnerability_type string")
    flows = lambda t: sorted(map(str, dataflow.flows(t, sinks, tables[2]).collect()))
    assert flows(near) == flows(dataflow.taint(*tables))
    monkeypatch.setattr(dataflow, "LOCAL", 20)
    assert key(dataflow.taint(*tables, "graph")) == want
