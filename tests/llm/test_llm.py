"""The training-data operators against brute force, the libraries and SQL, and at their edges."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulelake.llm import audio, blocks, bytebpe, chat, lmscore, ngramjoin, packing, quality, secrets, sharding, toxicity

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30", "changed")
TEXTS = [None, "", " \t\n", "one", "a b c d", BASE, BASE, NEAR, BASE.upper(), LONG, "token = abcdef123456 and AKIA" + "Q7" * 8, "you 1d10t, i d i o t", "naïve Ünïcode – 日本語 text 😀 here", "a a a a a a a a"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("_key", T.IntegerType()), T.StructField("size", T.StringType()), T.StructField("secrets", T.StringType()), T.StructField("shard", T.StringType())])


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, a very long text, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, "x", None, i, "s", "q", "z") for i, t in enumerate(TEXTS)]
    rows += [(5, BASE, "x", None, 5, "s", "q", "z"), (None, NEAR, None, "t", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def check_shards(rows, n):
    by_text = collections.defaultdict(set)
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        by_text[r.text_crc32, r.size].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [loads[i] for i in range(n)]


def test_sharding(docs, nothing, real):
    rows = sharding.shard_documents(docs, 3).collect()
    assert len(rows) == docs.count()
    check_shards(rows, 3)
    rows = sharding.shard_documents(real, 4).collect()
    loads = check_shards(rows, 4)
    groups = collections.Counter()
    for r in rows:
        groups[r.text_crc32, r.size] += r.size
    heap = [0] * 4
    for size in sorted(groups.values(), reverse=True):  # every group on its own, by its exact size
        heap[heap.index(min(heap))] += size
    assert max(loads) - min(loads) <= max(groups.values()) + max(loads) / 1024
    assert max(loads) <= max(heap) * (1 + 1 / 1024) + max(groups.values()) / 1024
    same = real.sparkSession.createDataFrame([(None, "same")] * 300 + [(i, "") for i in range(50)], "doc_id long, text string")
    check_shards(sharding.shard_documents(same, 3).collect(), 3)
    assert sharding.shard_documents(nothing, 3).count() == 0


def test_lpt_plan_equals_a_heap():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 60, 400).tolist(), reverse=True)
        counts = sorted(collections.Counter(sizes).items(), reverse=True)
        plan = sharding.place_classes([(c, s) for s, c in counts], 5)
        loads = [sum(g[i] * s for (s, _), g in zip(counts, plan)) for i in range(5)]
        heap = [0] * 5
        for s in sizes:
            heap[heap.index(min(heap))] += s
        assert sorted(loads) == pytest.approx(sorted(heap))


def test_packing(docs, nothing, real):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.TOKENIZER)
    for table in (docs.withColumn("doc_id", F.monotonically_increasing_id()), real):
        texts = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}
        table = table.sparkSession.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
        pieces = collections.defaultdict(list)
        rows = packing.pack_documents(table).collect()
        for r in rows:
            pieces[r.doc_id].append(r)
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and 1 << r.bucket == r.length
        assert len({r.sequence_id for r in rows}) == len(rows) and pieces.keys() == texts.keys()
        for i, ps in pieces.items():
            ps.sort(key=lambda r: r.start)
            ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in ps]).tolist()
            assert ids == lib.encode(texts[i], add_special_tokens=False).ids + [1] and all(r.doc_tokens == len(ids) for r in ps)
            assert [r.start for r in ps] == [0, *itertools.accumulate(r.length for r in ps)][:-1]
    assert packing.pack_documents(nothing).count() == 0


def test_chunk_encoder_equals_the_library():
    rng = np.random.default_rng(3)
    enc = packing.ChunkEncoder(packing.TOKENIZER, most=300)
    for signs in ("ȺȾabcdeABCDEÀÉßÿĀİıɏɐ 0123²½'’.,;<|>_-\t\n\x0b\x1c\x7f\x85\xa0\xad日本\u0301µªº𝔘🙂ΣςǅŉſK", "the and ing ed 's don't we'll ɏ "):
        texts = ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(0, 60))) for _ in range(1500)]
        texts += ["a" * 500 + " " + "b." * 300, "<|endoftext|> x<|startoftext|>", ""]
        for part in (texts[:700], texts[700:]):
            ids, bounds = enc.encode(pa.array(part))
            assert len(enc.chunks.place) <= 300
            for i, t in enumerate(part):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_binary_parts():
    row, length = packing.binary_parts(np.array([1, 5, 16, 35]), 16)
    assert list(zip(row, length)) == [(0, 1), (1, 4), (1, 1), (2, 16), (3, 16), (3, 16), (3, 2), (3, 1)]


def candidates(text):
    """(start, string) of runs of base64-like characters, cut where a segment of letters and digits holds a placeholder."""
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        start, held = m.start(), ""
        for part in re.finditer(r"[A-Za-z0-9]+|[+/_=-]", m[0]):
            if re.search(secrets.PLACEHOLDERS, part[0], re.IGNORECASE):
                yield start, held
                start, held = m.start() + part.end(), ""
            else:
                held += part[0]
        yield start, held


def entropy_spans(text):
    out = []
    for at, c in candidates(text):
        if len(c) < 24 or any(re.search(p, c) for p in secrets.ALLOWED):
            continue
        k = next(k for k in secrets.CLASSES if re.search(k.pattern, c))
        hot = []
        for i in range(len(c) - k.window + 1):
            n = collections.Counter(c[i : i + k.window])
            h = -sum(v / k.window * math.log2(v / k.window) for v in n.values())
            if h >= k.bits - 1e-9:
                hot.append(i)
        if hot:
            out.append((at + hot[0], 3 + secrets.CLASSES.index(k), at + hot[-1] + k.window, k.name))
    return out


def all_spans(text):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(base), sorted(base + entropy_spans(text))


EXTRA = ["é😀 token: 'Zx9/Qw+8Er7_Ty6-Ui5=Op4As3' x", "PASSWORD=\"hunter2\" api_key : a1b2c3d4e5f6", "0123456789abcdef0123456789abcdef0123 tail", "123e4567-e89b-12d3-a456-426614174000", "tokentoken=ab secret = abcdefg", "A1b2C3d4E5f6G7h8I9j0K1l2M3n4" * 3]
RANDOM = "q7Zp0Lx9Vb3Tn6Wk1Rf8Ym4Hc2Jd5Gs"
EXTRA += ["2024-01-05_" + RANDOM + "Qa8", "example_" + RANDOM, RANDOM + "=placeholder/" + RANDOM[::-1], "2024-01-05T10-20-30Z_0000000000000000", "sample" + RANDOM, " ".join(f"token={RANDOM[i % 20:]}{i}" for i in range(700)), "key_dummy_" + RANDOM + "_changeme-" + RANDOM.lower()]


def test_secrets(spark, docs, nothing, real):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    seen = 0
    for table in (docs, real, more):
        for r in secrets.scan(table).select("text", F.col("secrets").alias("s")).collect():
            got = [(x.start, x.end, x.kind) for x in r.s]
            assert got == [(a, e, k) for a, _, e, k in all_spans(r.text or "")[1]], r.text
            seen += len(got)
    assert seen >= 10
    assert secrets.scan(nothing).count() == 0
    for table in (more, docs):
        for r, t in zip(secrets.redact(table).collect(), table.collect()):
            spans = [(a, e) for a, _, e, _ in all_spans(t.text or "")[1]]
            want, at = "", 0
            for a, e in spans:
                if a > at or not want and a == at == 0 and not want.endswith("]"):
                    want += (t.text[at:a] if t.text else "") + "[SECRET]"
                at = max(at, e)
            assert r.text == (t.text if not spans else want + t.text[at:])
            assert all(r[c] == t[c] for c in table.columns if c != "text")


def test_secrets_beside_placeholders_and_dates(spark):
    found = {r.doc_id: [(x.start, x.end) for x in r.secrets if x.kind.startswith("entropy")] for r in secrets.scan(spark.createDataFrame(list(enumerate(EXTRA)), "doc_id long, text string")).collect()}
    at = {t[:12]: i for i, t in enumerate(EXTRA)}
    assert found[at["2024-01-05_q"]] and found[at["example_q7Zp"]] == [(7, 8 + len(RANDOM))]
    assert found[at["2024-01-05T1"]] == found[at["sampleq7Zp0L"]] == []
    assert len(found[at[RANDOM[:12]]]) == 2


def test_quality_against_sql(docs, nothing, real, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(quality.op5_sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = quality.op5_quality(real.sparkSession, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count() and not any(r.quality_kept for r in rows if not r.text)
    assert [r.quality_measures.n_repeat_words for r in rows if r.text == "a a a a a a a a"] == [8]
    assert quality.judge(nothing).where("quality_kept").count() == 0
    # a few hash bits force different windows to share one: the count stays exact
    few = quality.measures(real, hash_bits=8).select("doc_id", "quality_measures.n_repeat_words").toPandas().sort_values("doc_id")
    assert (few.n_repeat_words.values == want.n_repeat_words.values).all()


def brute_lm(texts, train, discounts=lmscore.DISCOUNTS):
    """Counts and scores by dictionaries: (n_tokens, n_known, train_tokens, base_score, score) of each text."""
    rows = [(t or "").encode().lower().split() + [None] for t in texts]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for ws, yes in zip(rows, train):
        if yes:
            one.update(ws)
            two.update(zip(["start", *ws[:-1]], ws))
            three.update(zip(["start", *ws[:-2]], ws[:-1], ws[1:]))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))

    def share(c, k):
        return discounts[k][0] + discounts[k][1] * c

    out = []
    for ws in rows:
        score = 0
        for i, w in enumerate(ws):
            h = ws[i - 1] if i else "start"
            c = one[h] if i else one[None]
            q = (two[h, w] + share(c, 0) * p(w)) / (c + share(c, 0))
            if i:
                g = (ws[i - 2] if i > 1 else "start", h)
                q = (three[*g, w] + share(two[g], 1) * q) / (two[g] + share(two[g], 1))
            score += math.log10(q)
        out.append((len(ws), sum(one[w] > 0 for w in ws), n, sum(math.log10(p(w)) for w in ws), score))
    return out


def test_lm_score(docs, nothing, real):
    for table in (docs, real):
        table = table.withColumn("k", F.monotonically_increasing_id()).withColumn("score", F.lit("clash"))
        table = table.sparkSession.createDataFrame(table.collect(), table.schema)
        got = {r.k: r for r in lmscore.score_documents(table, F.col("k") % 5 != 1, "k", block_bytes=200_000).collect()}
        rows = table.collect()
        want = brute_lm([r.text for r in rows], [r.k % 5 != 1 for r in rows])
        assert len(got) == len(rows)
        for r, (n, known, train, base, score) in zip(rows, want):
            g = got[r.k]
            assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, train)
            assert g.base_score == pytest.approx(base) and g.score == pytest.approx(score)
    assert lmscore.score_documents(nothing, F.lit(True)).count() == 0
    none = lmscore.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert len(none) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def lm_block(texts):
    return lmscore.Block(pa.array(texts), np.ones(len(texts), bool), 60)


def test_lm_probabilities_sum_to_one():
    b = lm_block(["a b a c", "b a", "c c a b", "a b a b"])
    counts = [c.astype(np.uint64) for c in b.own]
    n, v = int(counts[0].sum()), int((counts[0] > 0).sum())
    auto = b.automaton(counts, n, v)
    unknown = 0.5 / (n + 0.5 * (v + 1))

    arcs = {}
    word, pair = b.at[0], b.at[1]
    for j, at in enumerate(b.place[0]):
        arcs[auto.n if b.first[at] else word[at - 1], word[at]] = auto.weight2[j]
    for k, at in enumerate(b.place[1]):
        arcs[auto.n + 2 + pair[at - 1], word[at]] = auto.weight3[k]

    def step(state, w):
        total = 0.0
        while state != auto.n + 1:
            if not math.isnan(arcs.get((state, w), math.nan)):
                return total + arcs[state, w]
            total += auto.fail[state]
            state = auto.fail_to[state]
        return total + auto.root[w]

    ended = {auto.n + 2 + j for j in range(len(counts[1])) if auto.fail_to[auto.n + 2 + j] == b.end_word} | {b.end_word}  # nothing follows an end
    chains = 0
    for state in set(range(len(auto.fail))) - ended:
        given_up, s = 0.0, state
        while s != auto.n + 1:
            given_up, s, chains = given_up + auto.fail[s], auto.fail_to[s], chains + 1
        assert sum(10 ** step(state, w) for w in range(auto.n)) + 10**given_up * unknown == pytest.approx(1)
    assert chains > len(auto.fail)


def test_lm_orders_help_and_twice_stands_out(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    mean = {}
    for name, d in {"two": (lmscore.DISCOUNTS[0], (1e12, 0.0)), "three": lmscore.DISCOUNTS}.items():
        r = lmscore.score_documents(big, ~held, discounts=d).where("not in_training").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        mean[name], mean["one"] = r[0], r[1]
    assert mean["one"] < mean["two"] < mean["three"]
    texts = [" ".join(f"w{k}" for k in range(100 * i, 100 * i + 80)) for i in range(20)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in lmscore.score_documents(table, F.lit(True)).collect()}
    assert min(got[i] for i in (0, 1, 2, 20, 21, 22)) > max(got[i] for i in range(3, 20))


def test_counts_over_four_billion(spark):
    """Corpus counts are 64-bit: two blocks' messages add up beyond 2^32, and narrower kinds stop at their greatest value."""
    key, own = np.array([7], np.uint64), np.array([3_000_000_000], np.uint32)
    rows = [(0, b, bytearray(blocks.squeeze(key)), bytearray(blocks.squeeze(own))) for b in (1, 2)]
    messages = spark.createDataFrame(rows, "slot int, block long, keys binary, own binary")
    got = blocks.answer(messages, 2).collect()
    assert [blocks.expand(bytes(r.data), np.uint64).tolist() for r in got] == [[6_000_000_000]] * 2 and sum(r.total for r in got) == 6_000_000_000
    assert [blocks.expand(bytes(r.data), np.uint16).tolist() for r in blocks.answer(messages, 2, np.uint16).collect()] == [[65535]] * 2


def test_toxicity(spark, docs, nothing, real):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scorer = toxicity.train(big.where(toxicity.bucket("doc_id", 5) != 0), labels)
    held = toxicity.score_documents(big.where(toxicity.bucket("doc_id", 5) == 0), scorer).join(labels, "doc_id").select("toxicity", "toxic").collect()
    right = sum((r.toxicity >= 0.5) == (r.toxic == 1) for r in held)
    assert right / len(held) > 0.9
    rows = toxicity.score_documents(docs, scorer).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.score_documents(nothing, scorer).count() == 0
    empty = toxicity.train(nothing.select("doc_id", "text"), labels)
    assert empty.score(b"anything") == pytest.approx(0.5)


def test_training_does_not_depend_on_partitions(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made.append(toxicity.train(big, labels))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    a, b = made
    assert a.chars == b.chars and a.names == b.names and a.names and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)
    rows = big.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").where("y is not null").select("text", "y").collect()
    chars = collections.Counter(t for r in rows for tok in toxicity.tokens((r.text or "").encode()) for w in toxicity.restore(tok, None) for t in toxicity.trigrams(w))
    assert a.chars == chars
    n1, n0 = sum(r.y == 1 for r in rows), sum(r.y == 0 for r in rows)
    stats = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        for f in {f for tok in set(toxicity.tokens((r.text or "").encode())) for f in toxicity.features(toxicity.restore(tok, None))}:
            stats[f][r.y == 1] += 1

    def bound(name):
        q, p = stats[name][0] + n0 / (n1 + n0), stats[name][1] + n1 / (n1 + n0)
        return math.log(p / q) + math.log((n0 + 1) / (n1 + 1)) - 1.64 * math.sqrt(1 / p + 1 / q)

    assert all(stats[x][1] >= max(1, 0.001 * n1) for x in a.names)  # a share of the toxic rows, not a number of them
    sure = [x for x in stats if stats[x][1] >= max(1, 0.001 * n1) and bound(x) >= 0.75]
    # every sure prefix is there or stands for one of its stem
    assert all(any(x.startswith(k) or k.startswith(x) for k in a.names) for x in sure)
    assert not any(x != k and x.startswith(k) for x in a.names for k in a.names)


def test_small_tables_learn_too(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.train(docs.where(toxicity.bucket("doc_id", 5) != 0), labels).names


def brute_decode(observed, model):
    """Every path of the lattice, one by one."""
    seen = re.sub(r"(.)\1{3,}", r"\1\1\1", observed)
    best = (-math.inf, "")

    def go(i, a, b, score, text):
        nonlocal best
        if i == len(seen):
            best = max(best, (score + model.log_prob(a, b, "$"), text), key=lambda x: x[0])
            return
        c = seen[i]
        options = [(c, 0.0)] if c not in toxicity.LEET and c not in toxicity.SEPARATORS else [(x, toxicity.LEET_COST) for x in toxicity.LEET.get(c, "")]
        for h, cost in options:
            go(i + 1, b, toxicity.symbol(h), score + cost + model.log_prob(a, b, toxicity.symbol(h)), text + h)
        if c in toxicity.SEPARATORS:
            go(i + 1, a, b, score + toxicity.DROP_COST, text)
        elif c in toxicity.LEET and not c.isalnum():
            go(i + 1, a, b, score + 3 * toxicity.LEET_COST, text)
        elif text and i and seen[i - 1] == c:
            go(i + 1, a, b, score + toxicity.REPEAT_COST, text)

    go(0, "^", "^", 0.0, "")
    return best


def test_viterbi_finds_the_best_path_of_the_lattice():
    rng = np.random.default_rng(4)
    words = ["idiot", "stupid", "moron", "clown", "loser", "little", "the"]
    model = toxicity.CharModel(collections.Counter(t for w in words for t in toxicity.trigrams(w)))
    signs = "idotlowner10!|3$.- aé"
    for _ in range(150):
        seen = "".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(1, 9)))
        score, text = brute_decode(seen, model)
        got = toxicity.decode(seen, model)
        s, (a, b) = 0.0, ("^", "^")
        assert got == text or brute_decode(seen, model)[0] == pytest.approx(score), (seen, got, text)


def test_deobfuscation():
    model = toxicity.CharModel(collections.Counter(t for w in ["idiot", "stupid", "moron", "clown", "worthless", "the", "thing", "another"] for t in toxicity.trigrams(w)))
    for seen, want in [("1d10t", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("c|0wn", "clown")]:
        assert toxicity.decode(seen, model) == want
    assert toxicity.tokens(b"see i d i o t now") == [b"see", b"i d i o t", b"now"]
    assert toxicity.restore(b"plain", model) == ["plain"] and toxicity.restore("ünïcode".encode(), model) == ["ünïcode"]
    assert len(toxicity.decode("a" * 5000, model)) <= 3


def brute_links(texts, k=5, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return sets, [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [2048, 3])
def test_ngram_join(spark, nothing, real, block):
    rng = np.random.default_rng(1)
    texts = [r.text for r in real.orderBy("doc_id").collect()] + TEXTS
    for t in (texts[0], BASE, texts[3]):  # groups of copies around the threshold
        words = t.split()
        for _ in range(12):
            w = list(words)
            for i in rng.integers(0, len(w), rng.integers(0, 4)):
                w[i] = f"edit{rng.integers(9)}"
            texts.append(" ".join(w))
    sets, comps = brute_links(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngramjoin.near_duplicates(table, block=block).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == comps
    kept = {r.doc_id for r in ngramjoin.keep_one(table).collect()}
    assert kept == {i for i, c in enumerate(comps) if i == c}


def test_components_of_a_long_path(spark):
    """The order 0, n, n - 1, .., 1 along a path gains one node a round where labels only spread to neighbours."""
    n = 300
    path = [(0, n)] + [(i, i - 1) for i in range(n, 1, -1)]
    rows = path + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    got = {r.node: r.label for r in ngramjoin.components(spark.createDataFrame(rows, "node long, least long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(50)} | {5000: 5000, 5001: 5000, 5002: 5000}


def test_keep_one_returns_clashing_columns(docs):
    kept = {r.doc_id: r for r in ngramjoin.keep_one(docs).collect()}
    assert kept[5]._key == 5 and kept[5]._id == "x" and kept[5].size == "s"


def test_ngram_join_edges(docs, nothing):
    rows = ngramjoin.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id in (5, 6, 7, 8)} == {5}
    assert [r.component_id for r in rows if r.doc_id is None and r.n_shingles] == [5]
    assert ngramjoin.near_duplicates(nothing).count() == 0
    assert sorted(r.doc_id for r in ngramjoin.keep_one(docs).where("doc_id between 5 and 8").collect()) == [5]


def test_byte_bpe(docs, nothing, real):
    import tiktoken

    codec = bytebpe.codec(bytebpe.RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for table in (docs, real):
        for r in bytebpe.decode_documents(bytebpe.encode_documents(table.withColumn("doc_id", F.col("text")))).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(r.doc_id or "")
            assert r.decoded == (r.doc_id or "").encode() and r.n_tokens == len(r.ids) // 4
    for t in ["a" * 3000, " " * 999 + "x", "=-" * 500, "<|endoftext|>", "\x1c \x1d x", "é" * 500 + "0" * 700]:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == lib.encode_ordinary(t)
    assert bytebpe.encode_documents(nothing).count() == 0


def test_chroma(spark):
    rng = np.random.default_rng(0)
    c = audio.Chroma()
    v = [rng.normal(0, 0.12, 64).tolist() for _ in range(40)]
    a = audio.samples_of(audio.tones(v[0], c))
    noisy = a + rng.normal(0, 0.05, len(a)).astype(np.float32)
    f, g = audio.fingerprint(a, c), audio.fingerprint(noisy[10 * c.step :], c)
    assert audio.bit_error(g, f, -10) < 0.05 and audio.bit_error(f, f, 0) == 0 and audio.bit_error(g, f, 3) > 0.2
    rows = [(i, x) for i, x in enumerate(v)] + [(40, v[7]), (41, v[0][10:] + v[1][:10]), (42, None), (43, []), (50, v[7]), (None, v[3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    prints = audio.fingerprints(audio.sonify(table), "vec_id", "audio")
    got = audio.search(prints, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), "vec_id", salts=3).collect()
    assert len(got) == len(rows)
    fps = {i: audio.fingerprint(audio.samples_of(audio.tones(x, c)), c) for i, x in rows}
    for r in got:
        best = []
        for q in (0, 50):
            x, y = fps[r.vec_id], fps[q]
            hist = collections.Counter(i - j for i, p in enumerate(x) for j, s in enumerate(y) if p == s and p != audio.SILENCE)
            errors = [audio.bit_error(x, y, o) for o, n in hist.items() if n >= 3]
            if errors and min(errors) <= 0.35:
                best.append((min(errors), q))
        assert r.n_matches == len(best) and (not best or r.best_error == pytest.approx(min(best)[0]))
    assert audio.search(audio.fingerprints(spark.createDataFrame([], "vec_id long, audio binary"), "vec_id", "audio"), F.col("vec_id") == 0, "vec_id").count() == 0


def test_fingerprint_filters_are_sums_of_boxes():
    """The integral image against sums taken cell by cell."""
    rng = np.random.default_rng(5)
    c = audio.Chroma()
    samples = (rng.normal(0, 0.2, 9000) * np.repeat(rng.integers(0, 2, 9), 1000)).astype(np.float32)
    frames = audio.chroma_frames(samples, c)
    twice = np.hstack([frames, frames])
    total = lambda t, a, b, y0, y1: sum(twice[i, y] for i in range(t + a, t + b) for y in range(y0, y1))
    want = []
    for t in range(len(frames) - c.width + 1):
        x = 0
        for kind, y, h, w in c.filters():
            if kind == 0:
                a, b = total(t, 0, w, y, y + h), total(t, 0, w, y + h, y + 2 * h) if y + 2 * h <= 24 else total(t, 0, w, y - h, y)
            elif kind == 1:
                a, b = total(t, 0, w // 2, y, y + h), total(t, w // 2, w, y, y + h)
            elif kind == 2:
                a, b = total(t, w // 4, w - w // 4, y, y + h), total(t, 0, w // 4, y, y + h) + total(t, w - w // 4, w, y, y + h)
            else:
                a, b = total(t, 0, w, y, y + h // 2), total(t, 0, w, y + h // 2, y + h)
            v = math.log((1 + a) / (1 + b))
            level = int(v > -c.near + 1e-12) + int(v > 1e-12) + int(v > c.near + 1e-12)
            x = x << 2 | (level ^ level >> 1)
        want.append(x)
    got = audio.fingerprint(samples, c)
    assert len(got) == len(want) and (np.bitwise_count(got ^ np.array(want, np.uint32)) > 0).mean() < 0.02  # rounding at a threshold
    assert set(audio.fingerprint(np.zeros(9000, np.float32), c).tolist()) == {audio.SILENCE}


def test_silence_does_not_hide_an_alignment(spark):
    """Long silences at different places share more integers than the common passage does."""
    rng = np.random.default_rng(9)
    passage = [int(x) for x in rng.integers(0, 1 << 32, 12)]
    other = lambda n: [int(x) for x in rng.integers(0, 1 << 32, n)]
    a, b = [audio.SILENCE] * 30 + passage + other(5), passage + other(4) + [audio.SILENCE] * 30
    rows = [(0, bytearray(np.array(a, "<u4").tobytes())), (1, bytearray(np.array(b, "<u4").tobytes())), (2, bytearray()), (None, bytearray(np.array(a, "<u4").tobytes()))]
    got = audio.search(spark.createDataFrame(rows, "k long, fp binary"), F.coalesce(F.col("k") == 0, F.lit(False)), "k", most_error=0.5).collect()
    r = {x.k: x for x in got}
    assert len(got) == 4 and r[1].best_offset == -30 and r[1].best_shared == 12 and r[0].best_error == 0 and r[None].best_query == 0
    assert r[2].n_items == 0 and r[2].n_matches == 0 and r[2].best_query is None


def test_long_recording_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    long = (rng.normal(0, 0.2, 400_000) * 32768).clip(-32768, 32767).astype("<i2").tobytes()
    table = spark.createDataFrame([(1, bytearray(long), "x", 1), (2, bytearray(b"\x00"), "y", 2), (3, None, None, None)], "fp long, audio binary, _id string, _audio int")
    got = {r.fp: r for r in audio.fingerprints(table.withColumnRenamed("fp", "k"), "k", "audio").withColumnRenamed("fp", "bytes").withColumnRenamed("k", "fp").collect()}
    assert len(got[1].bytes) > 4 * 1500 and got[2].bytes == b"" and got[3].bytes == b""


def test_pairs_of_conversations(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "m"), (1, 3, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "z"), (3, 0, "user", "q"), (4, 0, "user", "alone"), (4, 1, "assistant", "x"), (4, 2, "assistant", "y"), (5, 0, None, None), (6, 0, "user", ""), (6, 0, "user", ""), (None, 0, "user", "q"), (None, 5, "system", "s"), (7, 0, "user", "long " * 50_000), (7, 1, "assistant", "ok")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.format_preferences(chat.preference_pairs(table)).collect()
    assert len(got) == 9
    r = {x.conv_id: x for x in got if x.conv_id is not None}
    assert (r[1].rejected_id, r[1].n_common) == (3, 1) and (r[2].rejected_id, r[2].n_common) == (1, 2) and (r[3].rejected_id, r[3].n_common) == (1, 1)
    assert r[4].rejected_id is None and r[4].n_common == 2 and r[4].rejected_text.count("x") == 1 and (r[5].rejected_id, r[6].rejected_id) == (6, 5)
    assert r[6].n_common == 1 and r[7].n_common == 1 and len(r[7].prompt) > 250_000
    assert {x.rejected_id: x.n_common for x in got if x.conv_id is None} == {1: 1, None: 1}
    assert chat.preference_pairs(table.where("false")).count() == 0
    sides = [(t, [(x.role, x.text) for x in row.chosen]) for t, row in ((x.conv_id, x) for x in chat.preference_pairs(table).collect()) if t == 1]
    assert sides[0][1] == [("user", "q"), ("assistant", "a"), ("user", "m"), ("assistant", "b")]


def test_chat(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = con.sql(chat.OP10_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = chat.op10_preferences(spark, sf_dir).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    t = lambda *x: [(r, s) for r, s in x]
    pairs = [(1, t(("user", "q"), ("assistant", "yes")), t(("user", "q"), ("assistant", "no")), "k"), (2, None, None, None), (3, t(("user", "q")), t(("user", "q")), "k"), (4, t((None, None)), t(("user", "other")), "k"), (5, t(("user", "a"), ("assistant", "b")), t(("user", "a")), "k")]
    df = spark.createDataFrame(pairs, "pair long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, _c string")
    r = {x.pair: x for x in chat.format_preferences(df).collect()}
    assert (r[1].n_common, r[1].prompt) == (1, "<|user|>\nq<|end|>\n") and r[1].chosen_text[slice(*map(int, r[1].chosen_mask.split(":")))] == "yes"
    assert r[1].rejected_text[slice(*map(int, r[1].rejected_mask.split(":")))] == "no" and r[1]._c == "k"
    assert (r[2].n_common, r[2].prompt, r[2].chosen_text) == (0, "", "") and (r[3].n_common, r[3].chosen_text) == (1, "")
    assert r[4].n_common == 0 and r[4].chosen_mask == "" and (r[5].n_common, r[5].rejected_text) == (1, "")


def test_pipeline_stages_at_their_edges(spark, docs, nothing, real, tmp_path):
    """Nulls, repeated rows, an empty table and columns of internal names, for each stage on its own."""
    import corpus_pipeline

    folder = tmp_path / "sf"
    labels = [(i, 1, int(i % 3 == 0)) for i in range(40)] + [(None, None, None), (1, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    clash = docs.withColumnsRenamed({"_id": "_gaps", "_text": "_in0"}).withColumns({"_c0": F.lit(7), "toxicity": F.lit("t"), "quality_kept": F.lit("q"), "n_chars": F.lit(3).cast("long")})
    for name, stage in corpus_pipeline.STAGES:
        for table in (clash, nothing.withColumn("n_chars", F.lit(0).cast("long"))):
            out = stage(spark, table, str(folder))
            rows = out.collect()
            if name != "packing":
                assert out.columns == table.columns, name
                known = {tuple(r[c] for c in table.columns if c not in ("text", "n_chars")) for r in table.collect()}
                assert all(tuple(r[c] for c in table.columns if c not in ("text", "n_chars")) in known for r in rows), name
            assert rows or table is not clash or name in ("quality rules",), name
    assert {r.doc_id for r in corpus_pipeline.keep_quality(spark, clash, str(folder)).collect()} <= {5, 6, 7, 8, 9, None}


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    good = {r.doc_id: r.text for r in quality.judge(docs).collect() if r.quality_kept}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = docs.where(F.col("doc_id").isin(list(good)))
    scorer = toxicity.train(kept.where(toxicity.bucket("doc_id", 5) != 0), labels)
    civil = sorted(i for i, t in good.items() if scorer.score(t.encode()) < 0.5)
    _, comps = brute_links([good[i] for i in civil])
    single = [i for k, i in enumerate(civil) if comps[k] == k]
    assert {r.doc_id for r in out} == set(single)
    sample = [r for r in out if r.start == 0]
    assert len(sample) == len(single) and sum(r.length for r in out) == sum(r.doc_tokens for r in sample)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "secret scans", "packing"]


def test_digest_columns(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in secrets.op3_secrets(spark, sf_dir).collect():
        base, every = all_spans(texts[r.doc_id])
        line = lambda s: ",".join(f"{k}:{a}:{e}" for a, _, e, k in s)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(line(base).encode()).hexdigest(), line(every))
    for r in sharding.op1_sharding(spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")


@pytest.mark.parametrize("name", ["op3_secrets", "op8_ngram_join"])
def test_queries_against_sql(spark, sf_dir, name):
    from rulelake.llm import registry

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(registry.ORACLES[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = registry.QUERIES[name](spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
