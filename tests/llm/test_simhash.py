import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from starflow.llm import simhash
from starflow.llm.components import components


def groups(ids, links):
    """Smallest member of each id's component."""
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in links:
        x, y = root(x), root(y)
        label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute(values, budget):
    fps = np.array(values, np.uint64)
    return [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= budget) if i < j]


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one Two", "a b c", "À Ab\x1cc d e f f f f f f", "x " * 3000])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_trie_walk_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 64, (30, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), np.arange(300, dtype=np.uint64)]))
    found = {(i, j) for ii, jj in simhash.trie_links(fps, fps, 2) for i, j in zip(ii.tolist(), jj.tolist()) if i < j}
    assert found == set(brute(fps, 2))


@pytest.mark.parametrize("leaf", [4, 64, 5000])
def test_near_links_connect_like_brute_force(spark, leaf):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base[:20] for x, y in rng.integers(0, 64, (6, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), np.arange(40, dtype=np.uint64)]))
    rep = rng.permutation(len(fps))
    df = spark.createDataFrame([(int(np.int64(f)), int(r)) for f, r in zip(fps.view(np.int64), rep)], "fp long, rep long")
    links = simhash.near_links(df, 2, leaf)
    got = {r.node: r.component for r in components(links).collect()}
    want = groups(range(len(fps)), [(rep[i], rep[j]) for i, j in brute(fps, 2)])
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_components_of_long_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 400)}, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two three four", "x"), (4, "one two three four", None), (4, "one two three four", "y"), (None, "other words stand here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Fingerprint string")
    out = simhash.near_duplicates(df)
    got = sorted((r.doc_id or 0, r.component_id, r.fingerprint) for r in out.collect() if r.doc_id)
    fp = f"{slow_fingerprint('one two three four'):016x}"
    assert got == [(1, 1, "0" * 16), (2, 1, "0" * 16), (3, 3, fp), (4, 3, fp), (4, 3, fp)]
    assert out.where(F.col("doc_id").isNull()).first().component_id is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_key_with_another_text(spark):
    rows = [(5, "one two three four"), (5, "quite another text of words"), (3, "one two three four"), (7, "quite another text of words"), (9, "w" * 200_000)]
    got = {(r.doc_id, r.text[:3]): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, "one"): 3, (3, "one"): 3, (5, "qui"): 5, (7, "qui"): 5, (9, "www"): 9}
