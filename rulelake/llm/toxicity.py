"""Toxicity of deobfuscated text.

Noisy channel: an observed token is a lattice of hidden characters. Leetspeak characters
stand for the letters they imitate, separators and blanks inside a spelled-out word for
nothing, and repeats for one letter. Viterbi finds the hidden word of the lattice that is
likeliest under a character trigram model. The model and the features' statistics are
counted over every word of all labelled training rows; a logistic model over the selected features
is fitted on a bounded sample of them (`fit_rows`) and scores the restored text of every row.

A feature is the prefix of a word that tells toxic rows best among the prefixes of its stem. It is
chosen by the lower confidence bound of its smoothed log-odds, which depends on rates and their
sampling error: a bar that is the same at every size. A least share of the toxic rows bounds the model that
is sent to the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, text_bytes

#: Letters that each leetspeak character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'’·, "
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PREFIXES = (5, 6, 7)
TIMES = (1, 2, 4)
LEET_COST, DROP_COST, REPEAT_COST = math.log(0.15), math.log(0.3), math.log(0.3)

_plain = re.compile(r"[^\W\d_]+")
_trimmed = re.compile(r"[\s.,;:?\"'()\[\]{}*#%&<>|~^=/\\!$+-]*$")
_lead = re.compile(r"^[\s.,;:?\"'\[\]{}*#%&<>~^=/\\-]*")
_run3 = re.compile(r"(.)\1\1")


@dataclass
class CharModel:
    """Interpolated character trigrams over LETTERS; ^ pads the front, $ ends a word, ? is any other letter."""

    counts: dict[str, int]
    cache: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.one: Counter = Counter()
        self.two: Counter = Counter()
        self.ctx1: Counter = Counter()
        self.ctx2: Counter = Counter()
        for t, n in self.counts.items():
            self.one[t[2]] += n
            self.two[t[1:]] += n
            self.ctx1[t[1]] += n
            self.ctx2[t[:2]] += n
        self.total = sum(self.one.values())

    def log_prob(self, a: str, b: str, c: str) -> float:
        t = a + b + c
        found = self.cache.get(t)
        if found is None:
            p = (self.one[c] + 0.1) / (self.total + 6.0)
            p = (self.two[b + c] + 8 * p) / (self.ctx1[b] + 8)
            p = (self.counts.get(t, 0) + 4 * p) / (self.ctx2[a + b] + 4)
            found = self.cache[t] = math.log(p)
        return found


def symbol(c: str) -> str:
    return c if c in LETTERS else "?"


def trigrams(word: str) -> list[str]:
    s = "^^" + "".join(map(symbol, word)) + "$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


def decode(observed: str, model: CharModel) -> str:
    """Likeliest hidden word of a token's lattice.

    A run of one character beyond three adds only repeat arcs of equal cost, so it is cut to three first.
    """
    seen = re.sub(r"(.)\1{3,}", r"\1\1\1", observed)
    paths = {("^", "^"): (0.0, "")}
    for i, c in enumerate(seen):
        options = [(c, 0.0)] if c not in LEET and c not in SEPARATORS else [(x, LEET_COST) for x in LEET.get(c, "")]
        nxt: dict[tuple[str, str], tuple[float, str]] = {}

        def put(state, score, text):
            if state not in nxt or nxt[state][0] < score:
                nxt[state] = (score, text)

        for (a, b), (score, text) in paths.items():
            for h, cost in options:
                s = symbol(h)
                put((b, s), score + cost + model.log_prob(a, b, s), text + h)
            if c in SEPARATORS:
                put((a, b), score + DROP_COST, text)
            elif c in LEET and not c.isalnum():
                put((a, b), score + 3 * LEET_COST, text)
            elif text and i and seen[i - 1] == c:
                put((a, b), score + REPEAT_COST, text)
        paths = nxt or paths
    return max(((s + model.log_prob(a, b, "$"), t) for (a, b), (s, t) in paths.items()), default=(0.0, ""))[1]


def tokens(text: bytes) -> list[bytes]:
    """Words, and each run of three or more one-character words once more as one spelled-out token."""
    words = text.split()
    out, run = [], []
    for w in words:
        if len(w) == 1 or len(w) <= 3 and len(w.decode()) == 1:
            run.append(w)
            continue
        if run:
            if len(run) > 2:
                out.append(b" ".join(run))
            run = []
        out.append(w)
    if len(run) > 2:
        out.append(b" ".join(run))
    return out


def restore(token: bytes, model: CharModel | None) -> list[str]:
    """The plain words of a token, and its decoded form where it looks obfuscated."""
    word = token.decode().lower()
    if word.isalpha() and not _run3.search(word):
        return [word]
    core = _lead.sub("", _trimmed.sub("", word))
    words = [x for x in _plain.findall(core) if len(x) > 2]
    if model is None or core in words and not _run3.search(core):
        return words
    letters = sum(map(str.isalpha, core))
    if letters and len(core) - letters <= 2 * letters + 1:
        if not core.isalpha() or _run3.search(core):
            words.append(decode(core, model))
    return words


def features(words: list[str]) -> set[str]:
    """Prefixes of the given lengths, and short words whole."""
    return {w[:n] for w in words for n in PREFIXES if len(w) >= n} | {w for w in words if 2 < len(w) < PREFIXES[0]}


@dataclass
class Scorer:
    """What is sent to the executors: prefixes of which each has its share of the toxic rows (see train) and 60^3 character trigrams."""

    chars: dict[str, int]
    names: list[str]
    weights: np.ndarray
    bias: float
    MOST = 300_000

    def __post_init__(self):
        self.model = CharModel(self.chars)
        self.index = {n: i for i, n in enumerate(self.names)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def hits(self, token: bytes) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            index = self.index
            found = tuple(sorted({index[f] for f in features(restore(token, self.model)) if f in index}))
            if len(self.known) < self.MOST and len(token) < 64:
                self.known[token] = found
        return found

    def count(self, text: bytes) -> Counter:
        c: Counter = Counter()
        for h in filter(None, map(self.hits, tokens(text))):
            c.update(h)
        return c

    def score(self, text: bytes) -> float:
        z = self.bias
        for i, n in self.count(text).items():
            for k, least in enumerate(TIMES):
                if n >= least:
                    z += self.weights[i, k]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit_logistic(row: np.ndarray, column: np.ndarray, columns: int, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton steps for a ridge-penalised logistic model over the ones (row, column) of a sparse matrix; the bias is not penalised.

    A step's equations are solved by conjugate gradients, so memory follows the ones and never the square of the columns.
    """
    times = lambda w: np.bincount(row, weights=w[column], minlength=len(y)) + w[-1]
    back = lambda v: np.append(np.bincount(column, weights=v[row], minlength=columns), v.sum())
    penalty = np.append(np.full(columns, ridge), 1e-6)
    squares = np.append(np.bincount(column, minlength=columns), len(y)).astype(float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.append(np.zeros(columns), math.log(rate / (1 - rate)))

    def loss(w):
        z = times(w)
        return np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        d = p * (1 - p)
        grad = back(y - p) - penalty * w
        scale = squares * d.mean() + penalty
        step, left = np.zeros_like(w), grad.copy()
        way = near = left / scale
        least = 1e-20 * (left @ near + 1e-300)
        for _ in range(500):
            if left @ near <= least:
                break
            curved = back(d * times(way)) + penalty * way
            far = (left @ near) / (way @ curved)
            step = step + far * way
            after = left - far * curved
            ahead = after / scale
            way = ahead + way * ((after @ ahead) / (left @ near))
            left, near = after, ahead
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w[:-1], float(w[-1])


def one_a_stem(names: list[str]) -> list[str]:
    """The first `most` names of which none is a prefix of an earlier one or has an earlier one as its prefix."""
    chosen: list[str] = []
    heads: set[str] = set()
    taken: set[str] = set()
    for x in names:
        if x in heads or any(x[:k] in taken for k in range(1, len(x) + 1)):
            continue
        chosen.append(x)
        taken.add(x)
        heads.update(x[:k] for k in range(1, len(x)))
    return chosen


def bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000, least_share: float = 0.001, bar: float = 0.75) -> Scorer:
    """Learn from the rows of docs whose id has a label (repeated label rows: the largest; null labels are left out).

    Character and feature statistics cover every word of all such rows, whatever their partitions; the
    logistic weights are fitted on about `fit_rows` of them, chosen by a hash of the id. A feature needs
    a share of `least_share` of the toxic rows and log-odds of at least `bar` at their lower confidence bound; every feature that has
    both is taken. As a row holds a bounded number of features on average, the share bounds their number by that
    number over `least_share`, whatever the corpus. Without labelled rows every score is 0.5 or the labels' base rate.
    """
    ones = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    slim = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_text"))
    # always by shuffle: labels grow with the corpus
    rows = materialize(slim.join(ones.hint("merge"), "_id").select("_id", "_text", "_y"), "toxic-labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        said: Counter = Counter()
        plain: dict[bytes, tuple[tuple[str, ...], tuple[str, ...]]] = {}
        totals = [0, 0]

        def flush():
            chars: Counter = Counter()
            for w, n in said.items():
                for t in trigrams(w):
                    chars[t] += n
            pairs = [*counts.items(), *((f"\x01{t}", [n, 0, 0, 0, 0, 0]) for t, n in chars.items()), ("\x02", [totals[0], totals[1], 0, 0, 0, 0])]
            cols = [pa.array([v[k] for _, v in pairs], pa.int64()) for k in range(6)]
            counts.clear()
            said.clear()
            totals[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), *cols], ["key", "a0", "a1", "a2", "b0", "b1", "b2"])

        for whole in batches:
            for batch in slices(whole, 1):
                for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    seen: Counter = Counter()
                    for token, n in Counter(tokens(text)).items():
                        found = plain.get(token)
                        if found is None:
                            words = restore(token, None)
                            found = tuple(words), tuple(features(words))
                            if len(plain) < 200_000:  # remembers what a token splits into; every occurrence counts
                                plain[token] = found
                        for w in found[0]:
                            said[w] += n
                        for f in found[1]:
                            seen[f] += n
                    base = 0 if y else 3
                    totals[0 if y else 1] += 1
                    for f, n in seen.items():
                        got = counts.get(f)
                        if got is None:
                            got = counts[f] = [0] * 6
                        for k, least in enumerate(TIMES):
                            if n >= least:
                                got[base + k] += 1
                if len(counts) + len(said) > 500_000:
                    yield flush()
        yield flush()

    cols = ["a0", "a1", "a2", "b0", "b1", "b2"]
    stats = materialize(rows.select("_id", "_text", "_y").mapInArrow(tally, "key string, " + ", ".join(f"{c} long" for c in cols)).groupBy("key").agg(*[F.sum(c).alias(c) for c in cols]), "toxic-stats")
    total = stats.where(F.col("key") == "\x02").first()
    n1, n0 = (int(total.a0), int(total.a1)) if total else (0, 0)
    chars = {r.key[1:]: int(r.a0) for r in stats.where(F.col("key").startswith("\x01")).select("key", "a0").collect()}
    if not n1 or not n0:
        release(rows, stats)
        rate = (n1 + 0.5) / (n1 + n0 + 1)
        return Scorer(chars, [], np.zeros((0, len(TIMES))), math.log(rate / (1 - rate)))

    def odds(a: str, b: str):
        """Log-odds of a feature in toxic against clean rows, less by 1.64 standard errors; one row more of either kind's share is added."""
        p, q = F.col(a) + n1 / (n1 + n0), F.col(b) + n0 / (n1 + n0)
        return F.log(p / q) + math.log((n0 + 1) / (n1 + 1)) - 1.64 * F.sqrt(1 / p + 1 / q)

    def z(a: str, b: str):
        p, q = (F.col(a) + 0.5) / (n1 + 1), (F.col(b) + 0.5) / (n0 + 1)
        return (p - q) / F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0 + F.lit(1e-12))

    words = stats.where(~F.col("key").startswith("\x01") & (F.col("key") != "\x02"))
    good = [(F.col(f"a{k}") >= max(1.0, least_share * n1)) & (odds(f"a{k}", f"b{k}") >= bar) for k in range(len(TIMES))]
    best = F.greatest(*[F.when(g, z(f"a{k}", f"b{k}")) for k, g in enumerate(good)])
    ranked = words.select("key", F.round(best, 9).alias("z")).where("z is not null").orderBy(F.desc("z"), "key")
    names = one_a_stem([r.key for r in ranked.collect()])
    draft = Scorer(chars, names, np.zeros((len(names), len(TIMES))), 0.0)
    share = max(1, math.ceil((n1 + n0) / fit_rows))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                found = [draft.count(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([list(c.keys()) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["y", "i", "n"])

    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(share)) == 0).mapInArrow(seen, "y int, i array<int>, n array<int>").toPandas()
    row = np.repeat(np.arange(len(sample)), [len(i) for i in sample["i"]])
    of, n = (np.concatenate([np.asarray(v, np.int64) for v in sample[c]] or [np.empty(0, np.int64)]) for c in "in")
    ones = [(row[n >= least], of[n >= least] * len(TIMES) + k) for k, least in enumerate(TIMES)]
    w, bias = fit_logistic(np.concatenate([r for r, _ in ones]), np.concatenate([c for _, c in ones]), len(names) * len(TIMES), (sample["y"].to_numpy() > 0).astype(float))
    release(rows, stats)
    return Scorer(chars, names, w.reshape(len(names), len(TIMES)), bias)


def score_documents(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of docs plus ``toxicity`` (0 to 1). A null text is an empty one and scores the base rate.

    Only the text's bytes reach the score. Repeated rows score alike; an empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]
    state = docs.sparkSession.sparkContext.broadcast((scorer.chars, scorer.names, scorer.weights, scorer.bias))
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*state.value)
        for whole in batches:
            last = whole.num_columns - 1
            for batch in slices(whole, last):
                scores = pa.array([s.score(t) for t in batch.column(last).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], scores], [*names, "toxicity"])

    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], text_bytes(text_col).alias("_text"))
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    return slim.mapInArrow(run, ", ".join(filter(None, [fields, "toxicity double"]))).toDF(*keep, "toxicity")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = train(docs.where(bucket("doc_id", 5) != 0), labels)
    out = score_documents(docs, scorer, keep=["doc_id"])
    return out.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
