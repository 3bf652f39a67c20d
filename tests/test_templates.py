"""Template fits of several bands against a search of all parameters, and planted periods."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starflow.operators import templates

SHAPES = {"saw": templates.saw(), "sine": [math.sin(2 * math.pi * i / 40) for i in range(40)]}


@pytest.mark.parametrize("degree", [3, 5])
def test_splines_go_through_their_values_and_are_smooth(degree):
    values = np.random.default_rng(1).normal(size=17)
    made = templates.Spline(values, degree)
    assert made.at(np.arange(17) / 17)[0] == pytest.approx(values) and made.at(np.arange(17) / 17 + 3)[0] == pytest.approx(values)
    phase = np.linspace(-1, 2, 3001)
    value, slope = made.at(phase)
    assert (made.at(phase + 1e-6)[0] - made.at(phase - 1e-6)[0]) / 2e-6 == pytest.approx(slope, abs=1e-3)
    sine = templates.Spline(SHAPES["sine"], degree)
    assert np.abs(sine.at(phase)[0] - np.sin(2 * np.pi * phase)).max() < (1e-4 if degree == 3 else 1e-6)
    assert templates.Spline([1.0, 1.0], degree).at(phase)[0] == pytest.approx(np.ones(3001))


def planted(seed, period=2.7, noise=0.05):
    draw, rows, t = random.Random(seed), [], 0.0
    shapes = {n: templates.Spline(v) for n, v in SHAPES.items()}
    for i in range(90):
        t += draw.uniform(0.05, 0.9)
        band, name, offset, amplitude = [("g", "saw", 3.0, 0.8), ("r", "sine", 5.0, 0.4)][i % 2]
        rows.append((seed, band, t, offset + amplitude * float(shapes[name].at(np.array([t / period + 0.3]))[0][0]) + draw.gauss(0, noise), noise))
    return rows


SCHEMA = "lc_id long, band string, time double, x double, e double"


def test_planted_periods_and_parameters(spark):
    df = spark.createDataFrame(planted(1) + planted(2, 3.3), SCHEMA)
    trials = spark.createDataFrame([(lc, p) for lc in (1, 2) for p in (2.5, 2.7, 3.0, 3.3, 5.4)], "lc_id long, period double")
    fits = templates.fit_band_templates(df, trials, SHAPES)
    assert fits.count() == 2 * 5 * 2
    best = {(r.lc_id, r.band): r for r in templates.best_template_periods(fits).collect()}
    assert {(k, r.period, r.template) for k, r in best.items()} == {((1, "g"), 2.7, "saw"), ((1, "r"), 2.7, "sine"), ((2, "g"), 3.3, "saw"), ((2, "r"), 3.3, "sine")}
    for (lc, band), r in best.items():
        offset, amplitude = (3.0, 0.8) if band == "g" else (5.0, 0.4)
        assert abs(r.offset - offset) < 0.03 and abs(r.amplitude - amplitude) < 0.04 and abs(r.phase - 0.3) < 0.01 and r.score > 0.95
    again = templates.predict_band_templates(templates.best_template_periods(fits), df, SHAPES)
    assert again.agg(F.avg(F.abs(F.col("x") - F.col("model")))).first()[0] < 0.06
    lost = templates.predict_band_templates(templates.best_template_periods(fits), spark.createDataFrame([(1, "z", 1.0), (9, "g", 1.0)], "lc_id long, band string, time double"), SHAPES)
    assert [r.model for r in lost.collect()] == [None, None]


@pytest.mark.parametrize("shared", [True, False])
def test_equals_a_dense_search(spark, shared):
    """Chi-square and score against 4,000 shifts with least squares by a solver."""
    rows = planted(4, noise=0.3)
    got = templates.fit_band_templates(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(4, 2.9)], "lc_id long, period double"), SHAPES, {"saw": "g", "sine": "r"}, shared).collect()
    grid, total, null = np.arange(4000) / 4000, {}, 0.0
    for band, name in (("g", "saw"), ("r", "sine")):
        t, x = (np.array([r[c] for r in rows if r[1] == band]) for c in (2, 3))
        spline, own = templates.Spline(SHAPES[name]), []
        for shift in grid:
            m = np.stack([np.ones(len(t)), spline.at(t / 2.9 + shift)[0]], 1)
            fit, *_ = np.linalg.lstsq(m, x, rcond=None)
            own.append(((x - m @ fit) ** 2).sum() if fit[1] >= 0 else ((x - x.mean()) ** 2).sum())
        total[band] = np.array(own) / 0.09
        null += ((x - x.mean()) ** 2).sum() / 0.09
    least = (total["g"] + total["r"]).min() if shared else total["g"].min() + total["r"].min()
    found = sum(r.chi2 for r in got)
    assert least * (1 - 1e-4) <= found <= least * (1 + 1e-9)
    assert all(r.score == pytest.approx(1 - found / null, rel=1e-9) for r in got) and len({r.phase for r in got}) == (1 if shared else 2)


def test_odd_rows(spark):
    rows = [(1, "g", 1.0, 2.0, 0.1), (2, "g", 1.0, 5.0, 0.1), (2, "g", 2.0, 5.0, 0.1), (3, "g", None, 1.0, 0.1), (4, None, 1.0, 1.0, 0.1), (5, "g", 1.0, 1.0, 0.0), (5, "g", 1.5, 2.0, 0.0)]
    trials = spark.createDataFrame([(1, 1.5), (1, 1.5), (2, 0.7), (2, -1.0), (5, 1.2), (3, 1.0), (None, 2.0)], "lc_id long, period double")
    got = {r.lc_id: r for r in templates.fit_band_templates(spark.createDataFrame(rows, SCHEMA), trials, SHAPES).collect()}
    assert set(got) == {1, 2, 5} and got[1].score == got[2].score == 0.0 and got[2].amplitude == 0.0
    none = templates.fit_band_templates(spark.createDataFrame(rows, SCHEMA), trials, SHAPES, {"saw": "z", "sine": "z"})
    assert none.count() == 0 and templates.fit_band_templates(spark.createDataFrame([], SCHEMA), trials, SHAPES).count() == 0


def test_noise_of_the_users(spark):
    from starflow.operators import simulate

    df = spark.range(4000).selectExpr("id % 5 AS lc_id", "id AS seq", "IF(id = 7, NULL, 18D) AS mag", "'x' AS other")
    native = simulate.add_noise(df, lambda m: 0.03 + 0 * m)
    assert native.columns == ["lc_id", "seq", "mag", "other", "noisy_mag", "magerr"]
    rows = {r.seq: r for r in native.collect()}
    assert {r.magerr for s, r in rows.items() if s != 7} == {0.03} and rows[7].noisy_mag is None and rows[7].magerr is None
    away = np.array([r.noisy_mag - 18 for s, r in rows.items() if s != 7])
    assert abs(away.mean()) < 0.003 and abs(away.std() - 0.03) < 0.002
    again = {r.seq: r.noisy_mag for r in simulate.add_noise(df.repartition(7), lambda m: m * 0 + 0.03, vectorised=True).collect()}
    assert all(again[s] == r.noisy_mag for s, r in rows.items())
    assert {r.magerr for r in simulate.add_noise(df.where("seq = 1"), lambda m: m * 0 - 1).collect()} == {1e-5}


def test_series_of_a_task_are_fitted_at_once(spark, monkeypatch):
    """Forty series need as many template evaluations as one; their fits are those of each alone, whatever they share a chunk with."""
    import pandas as pd

    calls = []
    splines, value = {n: templates.Spline(v) for n, v in SHAPES.items()}, templates.Spline.value
    monkeypatch.setattr(templates.Spline, "value", lambda self, phase: calls.append(len(phase)) or value(self, phase))

    def rows(lc):
        points = [r for r in planted(lc, 2.3 + 0.01 * lc, 0.2)][: 30 + lc]
        return sorted([(lc, None, p, None, None) for p in (2.5, 2.9, 4.0)[: 1 + lc % 3]] + [(lc, b, t, x, e) for _, b, t, x, e in points], key=lambda r: (r[1] or "", r[2]))

    table = lambda found: pd.DataFrame(found, columns=["lc_id", "band", "time", "x", "e"])
    alone = [templates._fits(table(rows(lc)), splines, {}, True, 20) for lc in range(40)]
    calls.clear()
    together = templates._fits(table([r for lc in range(40) for r in rows(lc)]), splines, {}, True, 20)
    assert len(calls) == 20 * 2 * 3
    order = ["lc_id", "period", "band"]
    pd.testing.assert_frame_equal(together.sort_values(order, ignore_index=True), pd.concat(alone).sort_values(order, ignore_index=True), rtol=1e-6, atol=1e-7)
    monkeypatch.undo()
    many = [(lc, b, t, x, e) for lc in range(250) for _, b, t, x, e in planted(lc)]
    fits = templates.fit_band_templates(spark.createDataFrame(many, SCHEMA).coalesce(1), spark.createDataFrame([(lc, 2.7) for lc in range(250)], "lc_id long, period double"), SHAPES)
    assert fits.count() == fits.select("lc_id", "band").distinct().count() == 500 and fits.agg(F.min("score")).first()[0] > 0.9
