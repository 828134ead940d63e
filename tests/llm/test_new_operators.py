"""URL filters, Merkle manifests and hard negatives against brute force and SQL, and at their edges."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelake.llm import merkle, negatives, registry, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_urls", "op12_merkle", "op13_negatives"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


# URL filters


def fits(host, path, rule):
    h, p = rule[0], rule[1]
    return bool(h) and (host == h or host.endswith("." + h)) and path.startswith(p)


def plain_verdict(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host) :]))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in rules if fits(host, path, r)), key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_urls_against_every_rule(spark):
    rng = random.Random(3)
    labels = ["a", "b", "net", "é", "a-b", "x/y"[:1], ""]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    paths = ["/" + "/".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(20)] + [""]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(120)]
    rules += [(rules[0][0], rules[0][1], v) for v in ("allow", "block")]
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#f'])}", "h") for i in range(600)]
    pages += [(i, "https://A.net/a/b", None) for i in range(300)]  # a hot address
    pages += [(None, None, "x"), (1, "", "x"), (1, "net/a", "x"), (1, "net/a", "x"), (2, "://", "x"), (3, "HTTP://B.NET", "x"), (4, "http://" + "a." * 5000 + "net/" + "b/" * 20000, "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("no"), "rule": F.lit(1), "key": F.lit(2)})
    made = spark.createDataFrame([*rules, (None, "/", "block"), ("", "", "block")], "host string, path string, verdict string")
    want = sorted(((i, *plain_verdict(u, rules, "maybe")) for i, u, _ in pages), key=str)
    for ranges in (1, 7, 40):
        got = urls.judge(table, made, default="maybe", ranges=ranges).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_urls_empty_and_missing(spark):
    rules = spark.createDataFrame([("net", None, None)], "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, rules).count() == 0
    page = spark.createDataFrame([(1, "http://x.net"), (2, "http://net.x/")], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in urls.judge(page, rules).collect()} == {(1, "net", "block"), (2, None, "allow")}
    assert {r.verdict for r in urls.judge(page, rules.limit(0)).collect()} == {"allow"}


def test_a_hot_host_is_cut_into_ranges(spark):
    table = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://one.net/same").alias("url"))
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    out = urls.judge(table, rules, ranges=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500 and {r.verdict for r in out.collect()} == {"block"}


# Merkle manifest


def text_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, now):
    """rows of (id, source, *fields); now(row) gives the row as it is found."""
    leaf = lambda r: digest([text_of(v) for v in r])
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([digest(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def path(levels, i):
        for level in levels[:-1]:
            k = i // 16 * 16
            yield i - k, level[k:i] + level[i + 1 : k + 16]
            i //= 16

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    for n, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, n)]
            folded = leaf(now(r))
            for at, others in steps:
                folded = digest([*others[:at], folded, *others[at:]])
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], digest([d for _, o in steps for d in o]), folded, folded == top[-1][0], steps


def low(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def check_manifest(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, source string, text string, row long").withColumns({"leaf": F.lit(1), "other": F.lit("x"), "id": F.lit("y")})
    got = merkle.manifest(table, fields=["doc_id", "source", "text"], found={"text": F.translate("text", merkle._UPPER, merkle._LOWER)}, proofs=True).collect()
    want = [(*r[:7], [(at, others) for at, others in r[7]]) for r in plain_manifest([r[:3] for r in rows], lambda r: (r[0], r[1], low(r[2])))]
    assert sorted(((*r[:7], [(p.at, p.siblings) for p in r.proof]) for r in got), key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 4097])
def test_manifest_of_one_source(spark, n):
    check_manifest(spark, [(i * 7 % n, "s", f"Text {i}" if i % 3 else f"text {i}", i) for i in range(n)])


def test_manifest_edges(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "B", "é", "😀", "￿", "hot", "hot", "hot"]), rng.choice([None, "", "x", "UPPER", "q" * 50000]), i) for i in range(700)]
    rows += [rows[3][:3] + (9,)] * 40 + [(None, None, None, 1), (None, "a", "T", 1), (None, "a", "T", 2)]
    rows += [(i, f"alone {i}", "Z", 1) for i in range(300)]
    got = check_manifest(spark, rows)
    assert len({r.root for r in got}) == 1 and {r.verified for r in got} == {True, False}
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_a_proof_stands_on_its_own(spark):
    table = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}") for i in range(100)], "doc_id long, source string, text string")
    for r in merkle.manifest(table, proofs=True).collect():
        path = [(p.at, [bytes.fromhex(d) for d in p.siblings]) for p in r.proof]
        assert merkle.fold(bytes.fromhex(r.leaf), path).hex() == r.root and r.verified
        assert merkle.fold(hashlib.sha256(b"other").digest(), path).hex() != r.root


def test_op12_tampers_every_fifth_checksum(spark):
    ids = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in merkle.op12_merkle(spark, SF).collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and low(ids[r.doc_id].text) != ids[r.doc_id].text
        assert r.verified == (not hit)


# hard negatives


def plain_negatives(rows, n_pos, n_neg, dims):
    ok = [(i, [int(np.floor(256.0 * x)) for x in v] + [0] * (dims - len(v)), y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(ok):
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(ok) if b != a]
        for p, j, _ in sorted(x for x in scored if x[2] == y)[:n_pos]:
            near = sorted((s, k) for s, k, z in scored if z != y and 50 * -p <= 100 * -s <= 95 * -p)[:n_neg]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(near, 1)]
    return sorted(out)


def mined(table, **kw):
    return sorted(map(tuple, negatives.mine(table, F.col("id") % 50 == 0, **kw).collect()))


def test_negatives_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (900, 7)).astype("f4")
    v[300:600] = v[300]  # a hot vector, with several labels
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 3))) for i in range(900)]
    rows += [(900, [0.0] * 7, 1), (950, [1.0, 2.0], 1), (951, [], 1), (1000, [0.0] * 7, None), (1001, None, 1), (1050, [float("nan")] * 7, 1), (1051, [float("inf")] * 7, 2), (1052, [None] * 7, 2), (None, [0.1] * 7, 1)]
    rows += [rows[50], rows[50], rows[301], rows[301]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "v": F.lit(1), "block": F.lit(0)})
    for n_pos, n_neg in ((5, 3), (1, 1), (3, 9)):
        assert mined(table, n_positives=n_pos, n_negatives=n_neg) == plain_negatives(rows, n_pos, n_neg, 8)
    assert mined(table, fit_rows=3) == mined(table)  # poor centroids: wider bounds, the same rows


def test_negatives_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for name, value in (("ROW_BLOCK", 64), ("ANCHOR_BLOCK", 3), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 16)], int(rng.integers(0, 4))) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(table) == plain_negatives(rows, 5, 3, 16)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mined(empty) == []
    one = spark.createDataFrame([(1, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert mined(one) == []  # no anchor
    assert mined(one.withColumn("vec_id", F.lit(50))) == []  # no other row
    with pytest.raises(ValueError):
        mined(one.withColumn("embedding", F.array(F.lit(1e12))))


def test_bounds_hold_and_leave_few(spark):
    rng = np.random.default_rng(4)
    rows = np.floor(256 * rng.normal(0, 0.125, (20000, 64))).astype("<i4")
    centroids = negatives.fit(rows[:8192])
    codes, left = negatives.encode(rows, centroids)
    some = rows[:16].astype(float)
    approx, error = negatives.bounds(some, np.sqrt((some**2).sum(1)), codes.astype(np.intp), left, centroids)
    exact = some @ rows.T
    assert (np.abs(exact - approx) <= error).all()
    assert np.median(error) < 0.1 * np.sqrt((some**2).sum(1)).max() ** 2
