import numpy as np
import pytest

from starflow.llm import vectordedup


def expected(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= threshold
    label = np.array([i for i, _ in ok])
    for _ in range(len(ok)):
        label = np.array([label[near[k]].min() for k in range(len(ok))])
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (int(near[k].sum()) - 1, int(label[k])) for k, (i, _) in enumerate(ok)}


def clusters(seed, spread, groups=15, each=12, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, dim))
    x = np.concatenate([b + spread * rng.standard_normal((each, dim)) * np.linalg.norm(b) / dim**0.5 for b in base] + [rng.standard_normal((40, dim))])
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]


@pytest.mark.parametrize("spread", [0.05, 0.2])
def test_tight_groups_are_exact(spark, spread):
    rows = clusters(3, spread) + [(1000, [0.0] * 24), (1001, None), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [])]
    rows += [(2000 + k, rows[0][1]) for k in range(30)] + [(3000, [2 * x for x in rows[1][1]])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, Kept string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectordedup.near_duplicates(df).collect()}
    assert got == expected(rows)


def test_given_vectors_are_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = expected([(r.vec_id, r.embedding) for r in df.collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectordedup.near_duplicates(df).collect()} == want


def test_exact_links_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(8) + 0.25 * rng.standard_normal((300, 8))
    n = rng.integers(1, 4, 300)
    df = spark.createDataFrame([(i, int(n[i]), x[i].tobytes(), 0) for i in range(300)], "id long, n long, v binary, group long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.9) @ n).tolist()
    got = {r.id: r.links for r in vectordedup.exact_links(df, 0.9, 32).collect()}
    assert [got[i] for i in range(300)] == want


def test_empty(spark):
    assert vectordedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_and_small_components_repeated_and_null_keys(spark):
    rows = [(1, [1e200, 2e200, 3e200]), (2, [1e200, 2e200, 3.1e200]), (3, [1.0, 2.0, 3.0]), (4, [-5.0, 1.0, 0.0]), (5, [1e-200, 2e-200, 3e-200]),
            (6, [0.0, 0.0, 1.0]), (6, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.01]), (None, [1.0, 2.0, 3.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectordedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 3, 1, False), (6, 0, 6, True), (6, 1, 6, True),
                          (7, 1, 6, False), (0, 0, None, False), (8, 0, 8, True)], key=str)


def test_passes():
    assert vectordedup.passes_of(2048, 2048, 0.9, 0.001) == (1, 0)
    passes, bits = vectordedup.passes_of(100_000, 2048, 0.9, 0.001)
    assert bits == 6 and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes <= 0.001


def planted(n, pairs, cosine, dim=64, seed=11):
    """Vectors a third of which share a cone of mutual cosine 0.75, with pairs of a given cosine in and out of it."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[: n // 3] = x[: n // 3] / np.linalg.norm(x[: n // 3], axis=1, keepdims=True) * 0.5 + np.eye(dim)[0] * 0.75**0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    twins = np.r_[np.arange(pairs // 2), n // 3 + np.arange(pairs - pairs // 2)]
    across = rng.standard_normal((pairs, dim))
    across -= (across * x[twins]).sum(1, keepdims=True) * x[twins]
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    return np.concatenate([x, cosine * x[twins] + (1 - cosine**2) ** 0.5 * across])


@pytest.mark.parametrize("window", [64, 2048])
def test_recall_in_a_crowd(spark, window):
    x = planted(6000, 300, 0.905)
    x = x[np.random.default_rng(1).permutation(len(x))]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectordedup.near_duplicates(df, window=window).collect()}
    label = np.arange(len(x))
    while (new := np.array([min(label[k], label[near[k]].min(initial=label[k])) for k in range(len(x))])).tolist() != label.tolist():
        label = new
    assert near.sum() >= 600 and all(n <= near[i].sum() for i, (n, _) in got.items())
    right = sum(got[i] == (int(near[i].sum()), int(label[i])) for i in range(len(x)) if near[i].any())
    assert right >= 0.99 * near.any(1).sum()


def test_windows_of_runs(spark):
    keys = [[0, 1]] * 3 + [[1, 1]] * 2 + [[2, 1]] + [[3, 0]] * 9 + [[4, 1]]
    got = {(r["pass"], r.key): (r.tile, r.parts) for r in vectordedup._windows(spark.createDataFrame([(k,) for k in keys], "keys array<long>"), 4).collect()}
    assert got == {(0, 0): (0, 1), (0, 1): (0, 1), (0, 2): (1, 1), (0, 3): (-4, 3), (0, 4): (3, 1), (1, 0): (-1, 3), (1, 1): (2, 1)}
