import hashlib
import random
import re

import numpy as np
import pytest

from starflow.llm import common, substrings


def brute(rows, width=13):
    """(doc, n_words, n_removed, sha) of rows with distinct keys."""
    split = {d: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for d, t in rows}
    first = {}
    for d in sorted(split):
        for i in range(len(split[d]) - width + 1):
            first.setdefault(tuple(split[d][i : i + width]), d)
    out = {}
    for d, words in split.items():
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", "É", "x\x1cy"]) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 40, 200)]
    rows = []
    for d in range(120):
        body = [word() for _ in range(rng.randrange(0, 60))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = p
        rows.append((d * 3, rng.choice([" ", "\n", "\t "]).join(body)))
    rows += [(1000 + k, rows[5][1]) for k in range(20)] + [(2000, "go " * 500), (2001, "go " * 30), (2002, None), (2003, ""), (2004, " \n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most,batches,fanout", [(20_000, 2, 4), (10**9, 3, 2)])
def test_matches_brute_force(spark, monkeypatch, most, batches, fanout):
    monkeypatch.setattr(common, "MOST_HOT", most)
    rows = corpus(batches)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.dedup_substrings(df, batches=batches, fanout=fanout).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == brute(rows)


def test_smallest():
    x = np.random.default_rng(0).integers(0, 1000, 50).astype(np.uint64)
    for k in (1, 2, 3, 5, 9, 16, 50):
        assert substrings.smallest(x, k).tolist() == [int(x[i : i + k].min()) for i in range(51 - k)]
    assert len(substrings.smallest(x, 51)) == 0


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(20))
    rows = [(None, long, "x"), (3, long, "x"), (3, long, "x"), (1, "a " + long, None), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept_Text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.dedup_substrings(df).collect())
    assert got == [(0, 20, 0), (1, 21, 0), (2, 0, 0), (3, 20, 20), (3, 20, 20)]
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def test_batches_meet_the_runs_and_runs_are_merged(spark):
    index = substrings.FingerprintIndex(spark, fanout=2)
    entries = lambda *rows: spark.createDataFrame(rows, "h long, doc long")
    found = [sorted(map(tuple, index.add(entries(*rows)).collect())) for rows in (
        [(1, 10), (2, 10), (2, 11), (3, 11)], [(3, 20), (4, 20)], [(1, 30), (4, 31), (5, 31)], [(5, 40), (6, 40)])]
    assert found == [[(2, 10), (2, 11)], [(3, 11), (3, 20)], [(1, 10), (1, 30), (4, 20), (4, 31)], [(5, 31), (5, 40)]]
    assert {level: len(names) for level, names in index.levels.names.items() if names} == {2: 1}
    assert index.levels.runs()[0].count() == 11
    index.levels.remove()


def test_very_long_text(spark):
    body = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, body), (2, "x " + body + " y"), (3, "own words only")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (200_000, 0), 2: (200_002, 200_000), 3: (3, 0)}
