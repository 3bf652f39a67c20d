"""The fast periodogram against the join of points and frequencies, and against sums as they stand."""

import math
import random
import time

import numpy as np
import pytest

from starflow.operators import periods, spectrum
from starflow.plans import catalog


@pytest.mark.parametrize("n", [5, 49, 400, 3000])
def test_fourier_sums(n):
    draw = np.random.default_rng(n)
    turn, weights, most = draw.uniform(-0.3, 1.7, n), draw.normal(size=(n, 2)), 200
    want = np.exp(2j * np.pi * np.outer(np.arange(most + 1), turn)) @ weights
    assert np.abs(spectrum.fourier_sums(turn, weights, most) - want).max() < 1e-11 * np.abs(weights).sum()


def points(spark, sizes, bands=False):
    draw, rows = random.Random(5), []
    for lc, n in enumerate(sizes):
        for i in range(n):
            t = draw.uniform(0, 40)
            rows.append((lc, i, t, 2 + math.sin(2 * math.pi * t / 3.7) + draw.gauss(0, 0.2), draw.choice([0.1, 0.3, 0.0]), "gri"[i % 3]))
    return spark.createDataFrame(rows, "lc_id long, seq long, time double, x double, e double, band string")


@pytest.mark.parametrize("bands", [False, True])
def test_equals_the_join(spark, bands):
    df = points(spark, [1, 2, 3, 12, 60, 200, 350])
    sql = periods.multiband_sql("{p}") if bands else periods.periodogram_sql("{p}")
    want = {(r.lc_id, r.k): r for r in spark.sql(f"WITH {sql} SELECT lc_id, k, frequency, power FROM power", p=df).collect()}
    got = {(r.lc_id, r.k): r for r in spectrum.fast_periodogram(df, band="band" if bands else None).collect()}
    assert got.keys() == want.keys() and len(got) > 4000
    for key, w in want.items():
        g = got[key]
        assert g.frequency == pytest.approx(w.frequency)
        if g.power is None or w.power is None:
            assert key[0] < 3  # series that a sinusoid always or never fits
        elif key[0] > 2:
            assert g.power == pytest.approx(w.power, abs=1e-6)


def test_a_long_series(spark):
    """100,000 points on 750,000 frequencies; twice the points take about twice the time."""
    draw = np.random.default_rng(1)

    def timed(n):
        t = np.sort(draw.uniform(0, 1000, n))
        began = time.time()
        gain, scatter = spectrum.explained(t, np.sin(2 * np.pi * t / 0.731) + draw.normal(size=n), np.ones(n), t[0], 5 * (t[-1] - t[0]), spectrum.steps_of(n))
        return time.time() - began, (5 * (t[-1] - t[0])) / (1 + np.nanargmax(gain)), np.nanmax(gain) / scatter

    short, long = timed(50_000), timed(100_000)
    assert long[1] == pytest.approx(0.731, rel=1e-3) and long[2] == pytest.approx(1 / 3, abs=0.02) and long[0] < 5 * short[0] + 1
    df = spark.range(100_000).selectExpr("1L AS lc_id", "rand(3) * 500 AS time", "id * 0 + rand(4) AS x", "0.1 AS e")
    assert spectrum.fast_periodogram(df).count() == 750_000


def test_odd_rows(spark):
    rows = [("a", 1.0, 2.0, 0.1, "g"), ("a", 1.0, 3.0, 0.1, "g"), ("b", 1.0, 2.0, 0.0, "g"), ("b", 2.0, 2.0, 0.0, None), (None, 1.0, 2.0, 0.1, "g"), ("c", None, 1.0, 0.1, "g"), ("d", 1.0, 5.0, 1.0, "g"), ("d", 2.0, 5.0, 1.0, "g")]
    df = spark.createDataFrame(rows, "lc_id string, time double, x double, e double, band string")
    got = spectrum.fast_periodogram(df).collect()
    assert {r.lc_id for r in got} == {"d"} and all(r.power is None for r in got)
    assert {r.lc_id for r in spectrum.fast_periodogram(df, band="band").collect()} == {"d"}
    assert spectrum.fast_periodogram(df.limit(0)).count() == 0


@pytest.mark.parametrize("bands", [False, True])
def test_blocks_equal_the_join(spark, bands, monkeypatch):
    monkeypatch.setattr(periods, "CELLS", 100)
    rng = np.random.default_rng(5)
    rows = [(i, "gri"[j % 3], j, float(rng.uniform(0, 9)), float(rng.normal()), float(rng.uniform(0.1, 1))) for i, n in enumerate((1, 2, 9, 40)) for j in range(n)]
    rows += [(7, "g", j, 2.0 + j, None if j == 2 else 1.0 * j * j, 0.0 if j == 3 else None if j == 4 else 0.5) for j in range(8)] + [(8, "g", j, 1.0 * j, 2.0, 0.0) for j in range(4)]
    df = spark.createDataFrame(rows, "lc_id long, band string, seq long, time double, x double, e double")
    sql = periods.multiband_sql("{p}") if bands else periods.periodogram_sql("{p}")
    want = {(r.lc_id, r.k): r for r in spark.sql(f"WITH {sql} SELECT * FROM power", p=df).collect()}
    found = periods.periodogram(df, band="band" if bands else None)
    got = {(r.lc_id, r.k): r for r in found.collect()}
    assert got.keys() == want.keys() and {i for i, _ in got} == {1, 2, 3, 7}
    for at, r in want.items():
        assert got[at].frequency == pytest.approx(r.frequency, rel=1e-14)
        if at[0] > 1:  # two points are fitted by any sinusoid
            assert (got[at].power is None) == (r.power is None) and got[at].power == pytest.approx(r.power, rel=1e-7, abs=1e-12)
    if not bands:
        peaks = [(r.lc_id, r["rank"], r.period, r.power) for r in periods.periodogram(df, peaks=3).orderBy("lc_id", "rank").collect() if r.lc_id > 1]
        best = [(r.lc_id, r["rank"], r.period, r.power) for r in periods.best_periods(found, 3).orderBy("lc_id", "rank").collect() if r.lc_id > 1]
        assert peaks == best


@pytest.mark.parametrize("name", ["lc_periods", "lc_periodogram", "lc_periodogram_full", "lc_multiband"])
def test_no_pair_of_point_and_frequency_is_a_row(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "Generate" not in plan
