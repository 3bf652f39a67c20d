import numpy as np
import pytest

from starflow.llm import topk


def brute(rows, queries, k):
    out = []
    for qi, q in queries:
        scored = sorted((-int(np.dot(np.floor(256 * np.array(q)), np.floor(256 * np.array(x)))), i) for i, x in rows if i != qi)
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(7, 2), (4096, 4096)])
def test_matches_brute_force(spark, block, query_block):
    rng = np.random.default_rng(block)
    x = rng.standard_normal((300, 12)).astype(np.float32)
    x[50:80] = x[20]
    x[100] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [None] * 12), (903, [float("inf")] * 12), (None, [1.0] * 12), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows + bad], "vec_id long, embedding array<float>, Score string, rank int")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert topk.top_k(df, df.where("vec_id = 905")).count() == 0


def test_reading_stops_early():
    """Bounds of partly read lists settle the answer, and what they leave is all that is resolved."""
    rng = np.random.default_rng(1)
    xs = np.floor(40 * rng.standard_normal((4096, 64))).astype(np.int64)
    lists = topk.Lists.of(np.arange(4096), xs)
    own, qs = np.arange(0, 4096, 200), xs[::200]
    rows, cols, scores, share = topk.best(lists, own, qs, 5, np.full(len(qs), -np.inf))
    assert share < 1 and len(rows) <= 4 * 5 * len(qs)
    full = xs @ qs.T
    full[own, np.arange(len(own))] = -(1 << 60)
    for q in range(len(qs)):
        top = np.lexsort((np.arange(4096), -full[:, q]))[:5]
        assert set(top) <= set(rows[cols == q])
    assert (full[rows, cols] == scores).all()
    fewer, _, _, again = topk.best(lists, own, qs, 5, np.sort(full, 0)[-1].astype(float))  # with the border of better blocks
    assert again < share and len(fewer) <= 4 * 5 * len(qs)
    spread = np.concatenate([xs[:8] * 50, xs[8:]])
    assert topk.best(topk.Lists.of(np.arange(4096), spread), np.array([0]), spread[:1], 1, np.full(1, -np.inf))[3] <= 0.25


def test_large_components_and_copies():
    xs = np.array([[1 << 60, 3], [1 << 60, 4], [-(1 << 61), 1], [5, 5]], np.int64)
    q, ids, scores = topk.search([topk.Lists.of(np.arange(4), xs)], np.array([3]), xs[3:], 2)
    assert list(ids) == [1, 0] and list(scores) == [5 * (1 << 60) + 20, 5 * (1 << 60) + 15]
    same = np.ones((500, 3), np.int64)
    q, ids, scores = topk.search([topk.Lists.of(np.arange(k, 1000, 2), same) for k in (0, 1)], np.array([0, 7]), same[:2], 3)
    assert list(ids) == [1, 2, 3, 0, 1, 2] and set(scores) == {3}


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (1, [0.5]), (2, [0.5])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in topk.top_k(twice, twice.where("vec_id = 0"), k=3).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 2)]


def test_saturated_components(spark):
    """Components beyond a long stand at its ends, on the right side."""
    rows = [(0, [1.0]), (1, [-1e17]), (2, [-1.0]), (3, [2.0]), (4, [1e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    for ends in ([-(1 << 63), 0], [-(1 << 15), 5], [-(1 << 31) - 1, 1], [(1 << 63) - 1, 2], [1 << 15, -1]):
        xs = np.array(ends, np.int64)[:, None]
        lists = topk.Lists.of(np.arange(2), xs)
        assert sorted(lists.values[0].tolist()) == sorted(ends)
