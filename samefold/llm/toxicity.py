"""Toxicity by multiple-instance learning: a text is a bag of sentences, only the bag has a label.

A sentence's score is a logistic function of the weights of its words and their beginnings; the text's score is the noisy-or of
its sentences, 1 - prod(1 - p). Training lowers the log-loss of the texts' labels through the
noisy-or, so a toxic text's gradient goes to the sentences that explain it, and the sentence scores
locate the offending sentences afterwards.

The model is fitted on a bounded sample of labelled rows: at most `SAMPLE` of each class, those with
the smallest hash of doc_id, in one task. Several labels of one document count as their maximum;
null labels and null texts don't train. Null and empty texts score 0. Every whole text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.llm.common import arrow_map, documents, folded_words, small_batches, table, utf8

#: The bound of the training sample, for each class.
SAMPLE = 3_000
#: A feature needs so many training texts to get a weight.
MIN_TEXTS = 4
EPOCHS = 120
L1 = 2e-4
THRESHOLD = 0.7

_SENTENCE = re.compile(rb"[^.!?\n]+")


def sentences(text: str | None) -> list[bytes]:
    return _SENTENCE.findall(utf8(text))


def features(words) -> set[bytes]:
    """Words, and what longer words begin with (marked by *), so inflected and unseen forms count."""
    words = set(words)
    return words.union([w[:4] + b"*" for w in words if len(w) > 4], [w[:5] + b"*" for w in words if len(w) > 5])


def bag(text: str | None) -> list[list[bytes]]:
    """The features of each sentence that has a word."""
    return [sorted(features(w)) for s in sentences(text) if (w := folded_words(s.decode()))]


def fit(texts: list[str], labels: list[int]) -> tuple[dict[bytes, float], float]:
    """Word weights (those that aren't 0) and the bias."""
    bags = [bag(t) for t in texts]
    seen = Counter(w for b in bags for w in {w for s in b for w in s})
    vocab = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_TEXTS))}
    y = np.array(labels, float)
    bias, weights = -6.0, np.zeros(len(vocab))
    if not vocab or not 0 < y.sum() < len(y):
        return {}, bias
    word, sent, owner = [], [], []
    for k, b in enumerate(bags):
        for s in b:
            ids = [vocab[w] for w in s if w in vocab]
            word += ids
            sent += [len(owner)] * len(ids)
            owner.append(k)
    word, sent, owner = np.array(word, np.int32), np.array(sent, np.int32), np.array(owner, np.int32)
    cost = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both classes weigh the same
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        z = bias + np.bincount(sent, weights[word], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of 1 - noisy-or
        whole = np.clip(-np.expm1(none), 1e-9, 1)
        # d loss / d z of a sentence: p for a clean text, -p (1 - P) / P for a toxic one
        g = p * (cost * np.where(y == 1, -np.exp(none) / whole, 1.0))[owner]
        gw, gb = np.bincount(word, g[sent], len(vocab)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.3
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        weights -= step * m / (1 - 0.9**t)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * L1, 0)
        bias -= rate * mb / (1 - 0.9**t) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-5)
    return {w: float(weights[k]) for w, k in vocab.items() if weights[k]}, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[bytes, float], float]:
    """Fit on at most `sample` labelled rows of each class. labels: doc_id, toxic."""
    spark = docs.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("y"))
    part = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = part(0).unionByName(part(1))
    # at most 2 * sample rows of two numbers, so this side may be broadcast
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        weights, bias = fit([g[1] for g in got], [g[2] for g in got])
        yield pa.RecordBatch.from_arrays([pa.array([b"", *weights], pa.binary()), pa.array([bias, *weights.values()], pa.float64())], ["word", "weight"])

    small_batches(spark)
    found = {bytes(r.word): r.weight for r in rows.repartition(1).mapInArrow(fitted, "word binary, weight double").collect()}
    bias = found.pop(b"", -6.0)
    return found, bias


def score_sentences(text: str | None, weights: dict[bytes, float], bias: float) -> list[tuple[float, int, int]]:
    """Score, start and end (bytes of UTF-8) of each sentence with a word."""
    out = []
    for m in _SENTENCE.finditer(utf8(text)):
        if words := folded_words(m[0].decode()):
            z = bias + sum(weights.get(w, 0.0) for w in features(words))
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), m.start(), m.end()))
    return out


def score(docs: DataFrame, model: tuple[dict[bytes, float], float]) -> DataFrame:
    """doc_id, score, worst_start, worst_end (code points of the sentence with the largest score; null
    without one), worst_score. No shuffle."""
    weights, bias = model
    known = frozenset(weights)
    idle = math.log1p(-1 / (1 + math.exp(-bias)))  # log of 1 - p for a sentence without a known word

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            if not text:
                rows.append((0.0, None, None, None))
            elif known.isdisjoint(features(folded_words(text))):  # every sentence scores alike
                n = sum(1 for s in sentences(text) if folded_words(s.decode()))
                rows.append((-math.expm1(n * idle), None, None, None))
            else:
                parts = score_sentences(text, weights, bias)
                top, data = max(parts, key=lambda s: (s[0], -s[1])), utf8(text)
                whole = -math.expm1(sum(math.log1p(-min(s[0], 1 - 1e-12)) for s in parts))
                rows.append((whole, len(data[: top[1]].decode()), len(data[: top[2]].decode()), top[0]))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, score double, worst_start long, worst_end long, worst_score double", one)


def held_out():
    """Rows kept from training: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "worst_start", "worst_end", "worst_score",
    )
