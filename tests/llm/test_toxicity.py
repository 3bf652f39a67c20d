"""The factorization machine: held-out accuracy, interactions, odd rows."""

import random
import zlib

import numpy as np
import pytest

from starflow.llm import queries, toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, label int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op12_toxicity(spark, folder)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    caught, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    # about a tenth of the toxic labels here are of texts without any insult: repeated words, tables, capitals
    assert sum(caught) / len(caught) >= 0.87 and sum(clean) / len(clean) <= 0.02


def pairs(n, seed):
    """Toxic if an insult meets its own group; either word alone, or with the other's, is clean."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        words, kind = [f"filler{draw.randint(0, 40)}" for _ in range(12)], draw.randint(0, 9)
        if kind < 4:
            a, b = kind // 2, kind % 2
            words += [f"insult{'xy'[a]}", f"group{'xy'[b]}"]
            rows.append((i, " ".join(draw.sample(words, len(words))), int(a == b)))
        else:
            rows.append((i, " ".join(words), 0))
    return rows


def test_learns_pairs_that_additive_weights_miss(spark):
    rows = pairs(3000, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    model = toxicity.fit(docs, labels, rounds=80)
    fresh = pairs(600, 2)
    right = lambda m: np.mean([(s >= 0.5) == y for s, (_, _, y) in zip(m.scores([t.encode() for _, t, _ in fresh]), fresh)])
    assert right(model) >= 0.97
    flat = toxicity.Machine(model.slots, model.values, model.intercept, model.weights, np.zeros_like(model.vectors))
    assert right(flat) < 0.9


def test_score_equals_pairwise_sum():
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(9)]
    slots = {zlib.crc32(w.encode()) % toxicity.BUCKETS: i for i, w in enumerate(words)}
    model = toxicity.Machine(slots, draw.random(9), -0.3, draw.normal(size=9), draw.normal(size=(9, 3)))
    held = [0, 3, 4, 8]
    z = -0.3 + sum(model.weights[i] * model.values[i] for i in held)
    z += sum(model.vectors[i] @ model.vectors[j] * model.values[i] * model.values[j] for i in held for j in held if i < j)
    texts = [" ".join(words[i] for i in [*held, 3]), "", "W0!w3,W4 w8", "unknown"]
    assert model.scores([t.encode() for t in texts]) == pytest.approx([1 / (1 + np.exp(-z)), 1 / (1 + np.exp(0.3)), 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(0.3))])


def test_odd_rows(spark):
    rows = pairs(400, 4)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "insultx groupx"), (7, rows[7][1]), (9000, None), (9001, ""), (9002, "insultx groupx " * 50_000), (9003, "z" * 300_000)], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (6, 7), (8, rows[8][2]), (99_999, 1)], LABELS)
    model = toxicity.fit(docs, labels, rounds=10)
    wide = docs.selectExpr("doc_id", "'s' AS score", "text", "9 AS `Predicted`", "struct(1 AS a) AS other")
    out = toxicity.predict(wide, model)
    assert out.columns == ["doc_id", "other", "score", "predicted"]
    got = out.collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[9000] == by[9001] == by[9003]


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], DOCS)
    score = lambda labels: [r.score for r in toxicity.predict(docs, toxicity.fit(docs, spark.createDataFrame(labels, LABELS))).collect()]
    assert score([]) == [0.5, 0.5] and score([(1, 1), (2, 1)])[0] > 0.7 and score([(1, 0)])[0] < 0.3
    assert toxicity.predict(docs.limit(0), toxicity.fit(docs.limit(0), spark.createDataFrame([], LABELS))).count() == 0


def test_bounded_sample_keeps_true_shares(spark):
    """A tenth of the clean labels: the mean score stays near the true share of toxic texts."""
    rows = pairs(4000, 6)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    model = toxicity.fit(docs, labels, per_class=320, rounds=60)
    assert abs(np.mean(model.scores([t.encode() for _, t, _ in rows])) - np.mean([r[2] for r in rows])) < 0.06
