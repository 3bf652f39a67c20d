"""The map's parts against sums over all rows, and how well it keeps neighbours."""

import math
import pickle
import random

import numpy as np
import pytest

from starflow.operators import embedding


def test_field_equals_sums_over_all_rows():
    draw = np.random.default_rng(2)
    for scale in (1e-4, 0.3, 4.0, 25.0):
        y = draw.normal(scale=scale, size=(700, 2))
        field = embedding.Field.of(y)
        apart = y[:, None] - y[None]
        kernel = 1 / (1 + (apart**2).sum(2))
        np.fill_diagonal(kernel, 0)
        assert field.total == pytest.approx(kernel.sum(), rel=5e-3)
        want = (kernel[:, :, None] ** 2 * apart).sum(1)
        assert np.abs(field.push(y) - want).max() < 0.02 * np.abs(want).max()


def test_affinities_have_the_perplexity():
    draw = np.random.default_rng(3)
    for n in (2, 40, 105):
        p = embedding.affinities(draw.exponential(size=n) * 50, 35.0)
        assert p.sum() == pytest.approx(1) and math.exp(-(p * np.log(np.maximum(p, 1e-300))).sum()) == pytest.approx(min(35.0, n), rel=1e-3)
    assert embedding.affinities(np.zeros(5), 3.0) == pytest.approx(np.full(5, 0.2)) and len(embedding.affinities(np.zeros(0), 3.0)) == 0


def clusters(spark, n, width=8, repeats=0):
    draw = random.Random(1)
    rows = [(i, *[8.0 * ((i % 4) == c) + draw.gauss(0, 1) for c in range(width)]) for i in range(n)]
    rows += [(n + i, *rows[0][1:]) for i in range(repeats)]
    names = [f"c{k}" for k in range(width)]
    return spark.createDataFrame(rows, ", ".join(["id long", *(f"{c} double" for c in names)])), names, np.array([r[1:] for r in rows])


def test_neighbours(spark, monkeypatch):
    df, names, x = clusters(spark, 900, repeats=100)
    rows = df.selectExpr("id AS i", f"array({', '.join(names)}) AS x")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :10]
    exact = {r.i: [v.d for v in r.near] for r in embedding.nearest_rows(rows, 8, 10).collect()}
    assert all(exact[i] == pytest.approx(want[i].tolist(), abs=1e-9) for i in range(1000))
    monkeypatch.setattr(embedding, "CELL", 100)
    parted = embedding.nearest_rows(rows, 8, 10, passes=8).collect()
    reach = np.mean([np.mean(np.array([v.d for v in r.near]) <= want[r.i, -1] + 1e-9) for r in parted])
    assert len(parted) == 1000 and all(len({v.j for v in r.near}) == 10 for r in parted) and reach > 0.6


def kept(x, y, k=10):
    near = lambda a: np.argsort(((a[:, None] - a[None]) ** 2).sum(2) + np.eye(len(a)) * 1e18, 1)[:, :k]
    return np.mean([len({*a} & {*b}) / k for a, b in zip(near(x).tolist(), near(y).tolist())])


def test_map_keeps_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 64)
    df, names, x = clusters(spark, 240)
    out = embedding.tsne(df.repartition(3), names, perplexity=15, rounds=120).orderBy("id").collect()
    y = np.array([(r.x, r.y) for r in out])
    assert [r.id for r in out] == list(range(240)) and np.isfinite(y).all()
    assert kept(x, y) > 3 * kept(x, np.random.default_rng(0).permutation(y)) and kept(x, y) > 0.3
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(2) + np.eye(240) * 1e18, 1)[:, :5]
    assert np.mean(near % 4 == (np.arange(240) % 4)[:, None]) > 0.95  # the clusters stay apart


def test_few_rows(spark, monkeypatch):
    df, names, _ = clusters(spark, 3)
    assert embedding.tsne(df, names, rounds=4).count() == 3
    assert [tuple(r) for r in embedding.tsne(df.limit(1), names).collect()] == [(0, 0.0, 0.0)] and embedding.tsne(df.limit(0), names).count() == 0
    twice = df.unionByName(df).withColumn("c0", __import__("pyspark").sql.functions.lit(None).cast("double"))
    assert embedding.tsne(twice, names, rounds=2).count() == 6
    monkeypatch.setattr(embedding, "MOST", 2)
    with pytest.raises(ValueError, match="representative"):
        embedding.tsne(df, names)


def test_rounds_send_no_rows_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 64)
    df, names, _ = clusters(spark, 240)
    sent, kind = [], type(df)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [r for r in [collect(self)] if sent.append(len(pickle.dumps([tuple(v) for v in r]))) is None][0])
    context, broadcast = spark.sparkContext, spark.sparkContext.broadcast
    monkeypatch.setattr(context, "broadcast", lambda value: [sent.append(len(pickle.dumps(value))), broadcast(value)][1])
    out = embedding.tsne(df.repartition(3), names, perplexity=15, rounds=6)
    assert sum(sent) < 6 * 240 * 8  # once 48 bytes a row and round came and 24 went
    assert out.count() == 240 and out.selectExpr("count(DISTINCT x)").first()[0] == 240


def test_affinities_travel_packed(spark, monkeypatch):
    """Edges equal those of all pairs, and neither they nor neighbours are rows of a shuffle or compared one by one."""
    monkeypatch.setattr(embedding, "BLOCK", 64)
    monkeypatch.setattr(embedding, "cut", lambda df: df)
    df, names, x = clusters(spark, 150, repeats=10)
    blocks = embedding._blocks(df.selectExpr("id AS i", f"array({', '.join(names)}) AS x").repartition(3), 8, 10.0, 6, 1, 160)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "array_distinct" not in plan
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.zeros((160, 160))
    for i, row in enumerate(d[:140]):
        near = np.argsort(row, kind="stable")[:30]
        want[i, near] = embedding.affinities(row[near], 10.0)
    got, rows = np.zeros((160, 160)), 0
    for r in blocks.collect():
        degree, to, p = (np.frombuffer(r[c], t) for c, t in (("degree", np.int32), ("to", np.int32), ("p", np.float32)))
        got[r.block * 64 + np.repeat(np.arange(len(degree)), degree), to] = p
        rows += len(degree)
    assert rows == 160 and np.abs(got - got.T).max() == 0 and got.sum() == pytest.approx(1, abs=1e-5)
    few = slice(1, 140)  # the copies of row 0 may be one another's neighbours in any order
    want = (want + want.T) / 320
    assert np.abs(got[few, few] - want[few, few]).max() < 1e-6


def test_affinities_of_many_rows():
    draw = np.random.default_rng(8)
    d = np.sort(draw.exponential(size=(40, 30)) * 10.0 ** draw.integers(-8, 8, (40, 1)), 1)
    d[3], d[4, 12:], d[5], d[6, 1:] = 0.0, np.inf, np.inf, np.inf
    got = embedding.affinities_of(d, 7.0)
    for row, p in zip(d, got):
        held = row < np.inf
        assert p[held] == pytest.approx(embedding.affinities(row[held], 7.0), rel=1e-9) and (p[~held] == 0).all()


def test_field_is_not_read_at_all_rows(monkeypatch):
    monkeypatch.setattr(embedding.Field, "at", None)
    y = np.random.default_rng(4).normal(scale=9.0, size=(300, 2))
    kernel = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
    assert embedding.Field.of(y).total == pytest.approx(kernel.sum() - 300, rel=5e-3)
    assert all(embedding._even(n) >= n and embedding._even(n) % 2 == 0 for n in range(2, 400))
