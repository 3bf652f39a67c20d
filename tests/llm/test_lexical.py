"""Ranked lexical search against a brute-force version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from starflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, items, k=10):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(TERM.findall(t.translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in held:
            m, score = 10 + 90 * sum(c.values()) * n // total, 0
            for t in terms:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in held) + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def ranked(spark, docs, items, **options):
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.rank(a, b, **options).collect()))


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{j}" for j in range(60)]
    weights = [1 / (j + 1) for j in range(60)]
    return [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 23)
    docs, items = corpus(seed, 300), [(i, t) for i, t in corpus(seed + 10, 12)]
    assert ranked(spark, docs, items) == slow(docs, items)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " \n!?"), (4, "Alpha beta"), (4, "Alpha beta"), (5, "alpha BETA"), (None, "alpha alpha"), (6, "ÀLPHA àlpha \x00alpha\x7fbeta_gamma"),
        (7, "alpha " * 30_000 + "rare"), (8, "x" * 200_000), (9, "delta"),
    ]
    items = [(1, "ALPHA, alpha beta rare"), (1, "àlpha"), (2, None), (None, "alpha"), (3, "nowhere"), (4, ""), (5, "delta " * 50), (6, "x" * 200_000)]
    found = ranked(spark, docs, items)
    assert found == slow(docs, items)
    assert [r[2] for r in found if r[0] == 1].count(4) == 2 and all(r[2] is not None for r in found)


def test_ties_and_item_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_PAIRS", 2)
    docs = [(i, "same words here") for i in range(50)] + [(100 + i, "others") for i in range(60)]
    items = [(1, "same words"), (2, "here"), (3, "others"), (4, "none")]
    found = ranked(spark, docs, items, k=7)
    assert found == slow(docs, items, 7)
    assert [r[2] for r in found if r[0] == 1] == list(range(7))


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a b")], []) == []


def test_clashing_columns(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text, 5 AS score, 6 AS rank, 7 AS item_id UNION ALL SELECT 2L, 'c', 1, 1, 1")
    items = spark.sql("SELECT 9L AS item_id, 'a' AS text, 'z' AS doc_id, 1 AS rank")
    assert [r[:3] for r in lexical.rank(docs, items).collect()] == [(9, 1, 1)]


def test_accumulators_are_limited():
    """A rare list fills the accumulators; a long common list makes none and still updates the scores."""
    rare, common = np.arange(0, 20), np.arange(1000)
    lists = [(rare, np.full(20, 900), 900), (common, np.arange(1000) % 50, 49)]
    rows, scores, made = lexical.accumulate(lists, 1000, 5, 0)
    assert made == 20 and dict(zip(rows.tolist(), scores.tolist())) == {i: 900 + i % 50 for i in range(20)}
    assert lexical.accumulate(lists, 1000, 25, 0)[2] == 1000  # fewer than k partial scores: any document may qualify
    assert lexical.accumulate(lists, 1000, 5, 2000)[2] == 0  # the border of earlier blocks can't be reached
    assert lexical.accumulate([(rare, np.full(20, 9), 9), (common, np.full(1000, 9), 9)], 1000, 5, 0)[2] == 1000  # a tie may still qualify


def test_large_masses():
    """Lengths whose products pass 64 bits."""
    block = lexical.Lists.of([1, 2], [1 << 40, 3], [0, 0], [0, 1], [5, 1])
    rows, adds, top = block.impacts(np.array([700]), 1 << 30, 1 << 45)[0]
    m = [10 + 90 * n * (1 << 30) // (1 << 45) for n in (1 << 40, 3)]
    assert adds.tolist() == [700 * (1_000_000_000 * c // (1000 * c + 8 * x)) for c, x in zip((5, 1), m)] and top == adds.max()
