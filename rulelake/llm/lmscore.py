"""Scoring by a weighted backoff automaton over a trigram model of all training texts.

The model grows with the corpus, so it is never in one place. Texts are written once in
blocks of a few MB. Each block asks for the corpus counts of exactly its own n-grams
(blocks.ask, blocks.answer) and builds from them the part of the global automaton that its
texts can reach: a state for every word, for every bigram seen in training and for the start of
a text; an arc for every bigram and trigram seen in training; a failure arc from each bigram's
state to its last word's, from each word's state to the root; and the root's arcs for words. One
left-to-right walk per text carries the state and adds the arcs' log-probabilities.

Smoothing is a chain of discounts, each order giving up the share m(h) / (c(h) + m(h)) of a
history h to the next lower one: P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and P(w | h) =
(c(h, w) + m(h) P(w | h')) / (c(h) + m(h)), with h' the history without its first word, c
training counts and m(h) = prior + weight * c(h) of the order. That share is the weight of h's
failure arc, so probabilities sum to one in every state.

n-grams are counted by hashes: words by 64 bits, bigrams and trigrams by as many bits as leave a
chance under 2^-10 that one shares its bits with another of the corpus; its count is then too high.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answer, ask, key_bits, meet, n_parts, read_block, write_blocks
from .common import materialize, numbered_words, total_bytes

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
BLOCK_BYTES = 4 << 20
#: (prior, weight) of histories of one word and of two.
DISCOUNTS = ((5.0, 1.0), (1.0, 0.25))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _packed(x: np.ndarray, kind: str) -> array:
    return array(kind, x.astype(kind).tobytes())


class BackoffAutomaton:
    """States with arcs and failure arcs; weights are log10 probabilities.

    States 0 to n - 1 are the words', n is the start of a text, n + 1 the root (reached by failure
    alone), and n + 2 + j bigram j's. The root has an arc for every word. The arc out of a word's state, or out of the
    start, that makes bigram j leads to that bigram's state; the arc out of a bigram's state that makes trigram k leads to the
    state of k's last two words. Arcs are named by the n-gram they make, and a weight that is not a number is no arc.
    """

    def __init__(self, root: np.ndarray, fail: np.ndarray, fail_to: np.ndarray, weight2: np.ndarray, weight3: np.ndarray, to3: np.ndarray):
        self.n = len(root)
        self.root, self.fail, self.weight2, self.weight3 = (_packed(x, "d") for x in (root, fail, weight2, weight3))
        self.fail_to, self.to3 = _packed(fail_to, "q"), _packed(to3, "q")

    def score(self, words: list[int], pairs: list[int], triples: list[int]) -> float:
        """Log10 probability of a text's words, its end included; pairs and triples number the n-grams that end at each word."""
        n, root, fail, fail_to, weight2, weight3, to3 = self.n, self.root, self.fail, self.fail_to, self.weight2, self.weight3, self.to3
        total, state, bottom = 0.0, n, n + 1
        for w, j, k in zip(words, pairs, triples):
            if state > bottom:
                weight = weight3[k]
                if weight == weight:
                    total += weight
                    state = to3[k]
                    continue
                total += fail[state]
                state = fail_to[state]
            weight = weight2[j]
            if weight == weight:
                total += weight
                state = n + 2 + j
            else:
                total += fail[state] + root[w]
                state = w
        return total


class Block:
    """A block's texts as word numbers, and its distinct n-gram keys with its own training counts of them.

    keys, at and own have one entry an order: ascending keys, each position's number among them,
    and counts. Trigrams stand at the positions `inner`, which are not the first of their text.
    """

    def __init__(self, texts: pa.Array, train: np.ndarray, bits: int, orders: int = 3):
        distinct, at, words = numbered_words(texts, lower=True)
        hashes = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)), END)
        self.sizes = words + 1
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = int(self.sizes.sum())
        h = np.full(n, len(distinct), np.int64)
        body = np.ones(n, bool)
        body[self.ends - 1] = False
        h[body] = at
        u, inverse = np.unique(hashes, return_inverse=True)
        self.end_word = int(inverse[-1])
        self.keys, self.at = [u], [inverse[h]]
        trained = np.repeat(train, self.sizes)
        self.own = [np.bincount(self.at[0][trained], minlength=len(u))]
        if orders == 1:
            return
        first = np.zeros(n, bool)
        first[self.starts] = True
        self.inner = np.flatnonzero(~first)
        before = np.full(n, START)
        before[self.inner] = hashes[h[self.inner - 1]]
        pair = mix(before, hashes[h])
        self.place = []
        for key, where in ((pair, slice(None)), (mix(pair[self.inner - 1], hashes[h[self.inner]]), self.inner)):
            u, place, inverse = np.unique(key >> np.uint64(64 - bits), return_index=True, return_inverse=True)
            self.keys.append(u)
            self.at.append(inverse)
            self.place.append(np.arange(n)[where][place])
            self.own.append(np.bincount(inverse[trained[where]], minlength=len(u)))
        self.first = first

    def automaton(self, counts: list[np.ndarray], n_tokens: int, n_types: int, discounts=DISCOUNTS) -> BackoffAutomaton:
        """The automaton from the corpus counts of this block's keys."""
        one, two, three = (c.astype(float) for c in counts)
        word, n = self.at[0], len(one)
        p1 = (one + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        history = np.append(one, one[self.end_word])  # texts start as often as they end
        m1 = discounts[0][0] + discounts[0][1] * history
        m2 = discounts[1][0] + discounts[1][1] * two
        at = self.place[0]
        state1 = np.where(self.first[at], n, word[at - 1])
        p2 = (two + m1[state1] * p1[word[at]]) / (history[state1] + m1[state1])
        at3 = self.place[1]
        pair = self.at[1]
        before, now = pair[at3 - 1], pair[at3]
        # a shared hash may show a trigram more often than its history
        p3 = (three + m2[before] * p2[now]) / (np.maximum(two[before], three) + m2[before])
        seen2, seen3 = two > 0, (three > 0) & (two[before] > 0) & (two[now] > 0)
        return BackoffAutomaton(
            np.log10(p1),
            np.concatenate([np.log10(m1 / (history + m1)), [0.0], np.log10(m2 / (two + m2))]),
            np.concatenate([np.full(n + 2, n + 1), word[at]]),
            np.where(seen2, np.log10(p2), np.nan),
            np.where(seen3, np.log10(p3), np.nan),
            n + 2 + now,
        )

    def scores(self, automaton: BackoffAutomaton) -> list[float]:
        triples = np.zeros(len(self.first), np.int64)  # never looked at where a text begins
        triples[self.inner] = self.at[2]
        return [automaton.score(*(x[a:b].tolist() for x in (self.at[0], self.at[1], triples))) for a, b in zip(self.starts, self.ends)]


def score_documents(docs: DataFrame, train: "F.Column", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, discounts=DISCOUNTS) -> DataFrame:
    """``<id_col>, in_training, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    `train` is a boolean Column over docs: rows where it is true are what the model learns from.
    A null or empty text is its end token alone. Repeated rows count and score each for itself.
    Without training rows every probability is the unknown word's. Null ids are ids like others.
    An empty table gives no rows. A very long text is one row of a block of its own.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(train, F.lit(False)).alias("_train"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    _, size = total_bytes(docs, text_col)
    parts, bits = n_parts(size), key_bits(size)
    tasks = max(4, math.ceil(3 * size / block_bytes))
    texts = write_blocks(slim, 2, block_bytes, "lm-blocks")

    def load(raw: bytes, orders: int) -> tuple[pa.RecordBatch, Block]:
        batch = read_block(raw)
        return batch, Block(batch.column(2), np.array(batch.column(1).to_pylist(), bool), bits, orders)

    def words(raw: bytes):
        _, b = load(raw, 1)
        return [(b.keys[0], b.own[0])]

    def ngrams(raw: bytes):
        _, b = load(raw, 3)
        return list(zip(b.keys[1:], b.own[1:]))

    one = materialize(answer(ask(texts, words, parts, [64]), parts), "lm-words")
    sums = one.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    n_types, n_tokens = int(sums[0]), int(sums[1])
    more = answer(ask(texts, ngrams, parts, [bits, bits]), 2 * parts)

    def walk(raw: bytes, counts: list[np.ndarray]) -> pa.RecordBatch:
        batch, b = load(raw, 3)
        auto = b.automaton(counts, n_tokens, n_types, discounts)
        c = counts[0][b.at[0]]
        base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        scores = b.scores(auto)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(b.sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), b.starts)), pa.array([n_tokens] * len(scores), pa.int64()), pa.array(np.add.reduceat(base, b.starts)), pa.array(scores, pa.float64())],
            ["_id", "in_training", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    replies = one.unionByName(more.withColumn("slot", F.col("slot") + parts))
    out = meet(texts, replies, tasks, parts, 3, np.uint64, walk, f"_id {kind}, in_training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("_id", id_col)


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    out = score_documents(docs, remainder != 1)
    return out.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
