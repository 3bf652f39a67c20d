"""Toxicity of texts by a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of longer words, lower-cased (A-Z) and hashed. Beside a weight each
term has a vector, and the inner product of two terms' vectors is added for every pair that a text holds together: an
insult counts otherwise beside a mention of a group than beside that of a game, which additive weights can't express.

A bounded sample of labelled rows (at most ``per_class`` of each class, drawn by hash) is tokenised; the buckets that
enough of its texts hold, the most frequent ``features`` at most, become features whose value is the smoothed logarithm
of the ratio of their shares in the two classes, less where chance may explain it, so that the thousands of words that say nothing weigh little in long
texts. Spark's ``FMClassifier`` fits the machine on all executors; its intercept is set to the classes' true shares.
Scoring passes every whole text through one task's Arrow batches, without a shuffle; the model is a few hundred
kilobytes, whatever the tables.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm.common import grown, stored, without
from starflow.llm.lexical import terms_of

BUCKETS = 1 << 22
STARTS = (4, 6)  # bytes of a longer word that are a term of their own
ROWS_AT_ONCE = 512
SURE = 6  # deviations from chance at which a feature's ratio counts in full


def held_out() -> Column:
    """Whether a document's labels may not be learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def buckets_of(text: bytes) -> set[int]:
    """The hashed terms of a text in UTF-8."""
    words = set(terms_of(text))
    for n in STARTS:
        words |= {w[:n] + b"*" for w in words if len(w) > n and not w.endswith(b"*")}
    return {zlib.crc32(w) % BUCKETS for w in words}


class Machine:
    """A fitted machine: features by bucket, their values, weights and vectors."""

    def __init__(self, slots: dict[int, int], values: np.ndarray, intercept: float, weights: np.ndarray, vectors: np.ndarray):
        self.slots, self.values, self.intercept, self.weights, self.vectors = slots, values, intercept, weights, vectors

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, a few hundred texts at once."""
        found = [[self.slots[b] for b in buckets_of(t) & self.slots.keys()] for t in texts]
        sizes = np.array([len(f) for f in found])
        flat = np.array([i for f in found for i in sorted(f)], np.int64)
        row, x = np.repeat(np.arange(len(texts)), sizes), self.values[flat]
        total = lambda v: np.bincount(row, v, minlength=len(texts))
        scaled = self.vectors[flat] * x[:, None]
        pairs = sum(total(scaled[:, k]) ** 2 - total(scaled[:, k] ** 2) for k in range(scaled.shape[1])) / 2
        return 1 / (1 + np.exp(-np.clip(self.intercept + total(self.weights[flat] * x) + pairs, -500, 500)))


def _hashed(rows: DataFrame) -> DataFrame:
    """``(label, buckets)`` of ``(text, label)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(buckets_of(t or b"")) for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "buckets"])

    return rows.select("text", F.col("label").cast("double").alias("label")).mapInArrow(run, "label double, buckets array<int>")


def _sample(labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, list[float]]:
    """At most about ``per_class`` labels of each class, by hash, and the share of each that was taken."""
    sizes = dict.fromkeys((0, 1), 0) | {r.label: r["count"] for r in labels.groupBy("label").count().collect()}  # two rows
    shares = [min(1.0, per_class / max(1, sizes[c])) for c in (0, 1)]
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labels.where(draw < F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])), shares


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000, features: int = 1 << 14, factors: int = 4, rounds: int = 40, rate: float = 0.3, seed: int = 7) -> Machine:
    """A machine learnt from ``docs(doc_id, text)`` and ``labels(doc_id, label)``, 0 or 1; rows with other labels or
    without an id or document are left out, repeated rows count each.

    ``per_class`` bounds the labels of each class that are learnt from. Without labels of both classes every score is
    that of the one class seen, smoothed (1/2 if there is none).
    """
    usable = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    drawn, shares = _sample(usable, per_class, seed)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # ``per_class`` rows of each class
    held = stored(_hashed(texts))
    n, positive = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = math.log((positive / shares[1] + 0.5) / ((n - positive) / shares[0] + 0.5))
    none = Machine({}, np.zeros(0), prior, np.zeros(0), np.zeros((0, 1)))
    if not 0 < positive < n:
        return none
    least = max(2, n // 1000)  # texts that hold a feature
    counts = held.select("label", F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).where(F.col("n") >= least)
    kept = counts.orderBy(F.desc("n"), "b").limit(features).collect()  # ``features`` rows
    kept.sort(key=lambda r: r.b)
    both, hit = np.array([(r.n, r.p) for r in kept], float).reshape(-1, 2).T
    values = np.abs(np.log((hit + 1) / (positive + 2)) - np.log((both - hit + 1) / (n - positive + 2)))
    share = positive / n
    values *= np.minimum(1, np.abs(hit - both * share) / np.sqrt(both * share * (1 - share)) / SURE)
    telling = values > 0
    slots = {r.b: i for i, r in enumerate(r for r, t in zip(kept, telling) if t)}
    values = values[telling] / values.max(initial=1e-300)
    if not slots:
        return none
    sent = held.sparkSession.sparkContext.broadcast((slots, values))

    def packed(buckets: list[int]):
        slots, values = sent.value
        own = sorted(slots[b] for b in buckets if b in slots)
        return Vectors.sparse(len(values), own, values[own])

    rows = held.select("label", F.udf(packed, VectorUDT())("buckets").alias("features"))
    made = FMClassifier(featuresCol="features", labelCol="label", factorSize=factors, maxIter=rounds, stepSize=rate, seed=seed, tol=1e-9).fit(rows)
    return Machine(slots, values, made.intercept - math.log(shares[1] / shares[0]), made.linear.toArray(), made.factors.toArray())


def predict(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """``docs`` without its text, and with ``score`` (0 to 1), the probability of label 1, and ``predicted``, 1 from 0.5
    on. Every row is scored by its whole text; null and empty texts have the score of a text without known terms.
    Columns of ``docs`` that are named ``score`` or ``predicted`` are replaced."""
    rows = without(docs, ("score", "predicted"))
    others = [c for c in rows.columns if c != text]
    schema = grown(rows.select(*[f"`{c}`" for c in others]), ("score", T.DoubleType()), ("predicted", T.IntegerType()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                scores = sent.value.scores([t or b"" for t in part.column(0).cast(pa.large_binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names)

    return rows.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in others]).mapInArrow(run, schema)
