import datetime
import random
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from series_oracle import derivative, features as expected

from starflow.functions import features, grouped, registry
from starflow.operators.extract import extract
from starflow.plans import catalog


def series(seed):
    """Curves of several lengths: unsorted, with tied values and times, flat stretches and a zero error."""
    rng = np.random.default_rng(seed)
    rows = []
    for lc, n in enumerate((16, 31, 40, 75)):
        t = np.sort(rng.uniform(0, 50, n))
        step = 0.13 if lc % 2 else 1e-6  # steps of which no number makes a power of ten in flux
        x = np.round((20 + 3 * np.sin(t / 3) + rng.normal(0, 1, n)) / step) * step
        e = rng.uniform(0.05, 0.6, n)
        order = rng.permutation(n)
        rows += [(lc, int(k), float(t[k]), float(x[k]), float(e[k])) for k in order]
    return rows


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(series(4), "lc_id long, seq long, time double, mag double, magerr double").cache()


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("convert", [True, False])
def test_all_features_match_numpy(spark, points, weighted, convert):
    names = [n for n in features.all_names() if n not in ("shapiro_wilk", "prominence_peaks", "number_cwt_like_peaks")]
    got = {r["lc_id"]: r.asDict() for r in extract(points, [*names, *[f"{n}_deriv" for n in names]], weighted, convert).collect()}
    wrong = []
    for lc in range(4):
        t, m, s = np.array(sorted((r[2], r[3], r[4]) for r in series(4) if r[0] == lc)).T
        r = 10 ** (-(m - 24) / 2.5) if convert else m
        re = s * r / 2.5 * np.log(10) if convert else s
        x, e = r / r.max(), re / r.max()
        raw, normal = derivative(t, r, re, e)
        for suffix, flux, norm in (("", (t, r, re), (t, x, e)), ("_deriv", raw, normal)):
            want = expected(*norm, weighted)
            want |= {k: v for k, v in expected(*flux, weighted).items() if k in features.RAW}
            for name in names:
                a, b = got[lc][name + suffix], want[name]
                b = None if not np.isfinite(b) else max(-1e10, min(1e10, b))
                if (a is None) != (b is None) or (a is not None and not np.isclose(a, b, rtol=1e-7, atol=1e-9)):
                    wrong.append((lc, name + suffix, a, b))
    assert not wrong


def test_columns_and_pruning(spark, points):
    every = extract(points)
    names = features.all_names()
    assert len(names) == 84 and every.columns == ["lc_id", *names, *[f"{n}_deriv" for n in names]]
    assert extract(points, ["meanMag", "c3_deriv"]).columns == ["lc_id", "meanMag", "c3_deriv"]
    plan = extract(points, ["meanMag"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lead" not in plan and "percentile" not in plan


def test_short_and_odd_series(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 1.0, 5.0, 0.1), (2, 0, 1.0, 5.0, 0.1), (2, 1, 2.0, 6.0, 0.1), (3, 0, nan, 1.0, 0.1), (3, 1, 1.0, inf, 0.1), (3, 2, 1.0, 1.0, None)]
    rows += [(4, k, float(k), 3.0, 0.1) for k in range(15)] + [(5, k, float(k), float(k % 3), 0.0) for k in range(20)]
    df = spark.createDataFrame(rows, "lc_id long, seq long, time double, mag double, magerr double")
    got = {r.lc_id: r.asDict() for r in extract(df, convert=False).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert all(v is None for k, v in got[1].items() if k != "lc_id")
    assert got[4]["variance"] == 0 and got[4]["kurtosis"] == 0 and got[4]["shapiro_wilk"] is None
    assert extract(df.limit(0)).count() == 0


def test_registered_features(spark, points):
    registry.register_sql("range_of", lambda weighted: "max(x) - min(x)" if weighted else "max(x)")
    registry.register_series("spread_of", lambda x, e, weighted: float(np.ptp(x)))
    try:
        assert {"range_of", "spread_of"} < set(features.all_names()) and len(features.all_names()) == 86
        rows = extract(points, ["range_of", "spread_of", "range_of_deriv"]).collect()
        assert all(np.isclose(r.range_of, r.spread_of) and r.range_of_deriv > 0 for r in rows)
        with pytest.raises(ValueError):
            registry.register_sql("c3", lambda weighted: "1")
        with pytest.raises(ValueError):
            registry.register_series("a b", len)
    finally:
        registry.unregister("range_of"), registry.unregister("spread_of")
    assert len(features.all_names()) == 84


def test_special_functions():
    z = np.array([-40.0, -21, -19, -5, 0, 2])
    assert np.allclose(grouped.log_normal_cdf(z)[2:], np.log(grouped.normal_cdf(z[2:])))
    assert np.allclose(grouped.log_normal_cdf(z)[:2], [-804.6084420137538, -224.4663405], rtol=1e-4)
    assert np.allclose(grouped.inverse_gaussian_cdf(np.array([0.0, 1.0, 1e9]), 1.0), [0, 0.6681020012231706, 1])


def test_shapiro_wilk():
    # Shapiro and Wilk's published example: W = 0.79 to two digits
    w = grouped.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float), None, False)
    assert round(w, 2) == 0.79
    # three points: the coefficients are 1 / sqrt(2), so that W is half of the squared range over the squared scatter
    assert grouped.shapiro_wilk(np.array([1.0, 2.0, 4.0]), None, False) == pytest.approx(0.5 * 9 / (14 / 3))
    rng = np.random.default_rng(0)
    scores = [grouped.shapiro_wilk(np.sort(rng.normal(size=n)), None, False) for n in (5, 6, 50, 500)]
    assert all(0.85 < w <= 1 for w in scores) and grouped.shapiro_wilk(rng.exponential(size=500), None, False) < 0.9
    exact = np.array([NormalDist().inv_cdf((i - 0.375) / 500.25) for i in range(1, 501)])
    assert grouped.shapiro_wilk(exact, None, False) > 0.998
    x = rng.normal(size=40)
    assert grouped.shapiro_wilk(3 * x - 7, None, False) == pytest.approx(grouped.shapiro_wilk(x, None, False))
    assert grouped.shapiro_wilk(np.ones(9), None, False) is None and grouped.shapiro_wilk(np.ones(2), None, False) is None


@pytest.mark.parametrize("x,apart,want", [
    ([0, 1, 1, 0, 0, 2, 0], 1, 2), ([0, 1, 0, 0, 2, 0], 25, 1), ([0, 5, 0, 1, 0, 5, 0], 1, 2), ([3, 3, 3], 1, 0), ([0, 1, 2, 3], 1, 0), ([0, 2, 0, 3, 0, 2, 0], 2, 1), ([1, 2, 2, 2, 1], 1, 1),
])
def test_prominence_peaks(x, apart, want):
    assert grouped.prominence_peaks(np.array(x, float), np.ones(len(x)), False, apart=apart) == want / len(x)


def test_prominence_peaks_are_weighed():
    x, e = np.array([0, 4, 0, 0, 0, 4, 0.0]), np.array([1, 1, 1, 1, 1, 10, 1.0])
    assert grouped.prominence_peaks(x, e, False, apart=1) == 2 / 7 and grouped.prominence_peaks(x, e, True, apart=1) == 1 / 7


def test_wide_peaks():
    y = np.r_[np.linspace(0, 9, 10), np.linspace(8, 0, 9)]  # a triangle, 9 high and as wide at half its height
    one = np.ones(19)
    assert grouped.cwt_like_peaks(y, one, False) == 1 / 19
    assert grouped.cwt_like_peaks(y, one, False, width=9.0) == 1 / 19 and grouped.cwt_like_peaks(y, one, False, width=9.1) == 0
    assert grouped.cwt_like_peaks(y, 20 * one, True) == 0  # below a prominence of 0.5 after division by the errors
    two = np.r_[y, y[1:]]
    assert grouped.cwt_like_peaks(two, np.ones(len(two)), False) == 2 / len(two)
    flat = np.array([0, 1, 3, 3, 3, 3, 3, 3, 1, 0.0])
    assert grouped.cwt_like_peaks(flat, np.ones(10), False) == 1 / 10
    assert grouped.cwt_like_peaks(np.array([0, 9, 0, 9, 0.0]), np.ones(5), False) == 0  # high but narrow


@pytest.mark.parametrize("name", ["lc_features_basic", "lc_features_independent", "lc_features_weighted_independent", "lc_features_weighted_levels"])
def test_points_of_zero_flux_keep_their_errors(spark, tmp_path, name):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=rng.randrange(40_000)), k % 2, "click", 0.0 if k in (8, 21) else round(rng.expovariate(0.02), 2), "{}") for k in range(120)]
    table = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    table["ts"] = table["ts"].astype("datetime64[us]")
    table.to_parquet(tmp_path / "events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas().sort_values("lc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(catalog.ORACLES[name]).df().sort_values("lc_id").reset_index(drop=True)[list(got.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_shares_of_no_point_are_those_of_the_sql(spark, tmp_path):
    """Series without a point so far below the median, one of them without scatter."""
    days = [(0, v) for v in (10, 10, 10, 10, 10, 90)] + [(1, v) for v in (10, 20, 30, 40, 50, 90)] + [(2, 7)] * 6 + [(3, v) for v in (80, 90, 90, 90, 90, 90)]
    rows = [(k, f"2024-01-0{1 + k % 6}", u, float(v)) for k, (u, v) in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    shares = ["lc_id", "above3", "above5", "below1", "below3", "below5", "count_above", "count_below"]
    got = catalog.QUERIES["lc_features_weighted_levels"](spark, str(tmp_path)).select(*shares)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.execute(f"SELECT {', '.join(shares)} FROM ({catalog.ORACLES['lc_features_weighted_levels']})").fetchall())
    assert sorted(map(tuple, got.collect())) == want and None in want[0] and want[1].count(None) == 0


def test_leading_digits_of_converted_magnitudes_are_those_of_the_sql(spark, tmp_path):
    """Fluxes at a whole share of the largest, where the last bit decides the digit."""
    cases = {43.28: 0.2, 149.51: 0.5, 113.97: 0.5, 76.24: 0.5, 68.88: 0.5, 109.13: 0.5, 15.12: 0.05, 81.9: 0.5, 120.12: 0.4}
    rows = [(v, (1 + v) / share - 1) for v, share in cases.items()]
    rows = [(8 * u + k, f"2024-01-0{1 + k}", u, round(value, 2)) for u, pair in enumerate(rows) for k, value in enumerate((*pair, 1.5, 7.25))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog._features(spark, str(tmp_path), view="mag", wanted=["benford_correlation"], weighted=False, space="flux")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert dict(map(tuple, got.collect())) == dict(duck.execute(catalog._features_sql("mag", ["benford_correlation"], False, "flux")).fetchall())


@pytest.mark.parametrize("weighted", [True, False])
def test_quantiles_are_read_by_rank(spark, weighted):
    """No aggregate gathers values, which would sort the widened points again, nor are the points joined with themselves."""
    rng = np.random.default_rng(9)
    rows = []
    for lc, n in enumerate((1, 2, 3, 5, 21, 101, 101, 60, 60)):
        x = np.round(rng.normal(5, 2, n), 1) if lc != 6 else np.full(n, 2.5)
        e = rng.uniform(0.1, 0.5, n) * (rng.random(n) > (0.3 if lc == 7 else 0)) * (lc != 8)
        rows += [(lc, k, float(k // 2), float(x[k]), float(e[k])) for k in range(n)]
    relation = spark.createDataFrame(rows, "lc_id long, seq long, time double, x double, e double")
    relation.createOrReplaceTempView("ranked_points")
    ranked_points = relation.toPandas()  # noqa: F841  read by DuckDB
    names = ["FluxPercentileRatioMid20", "Gskew", "PercentDifferenceFluxPercentile", "amplitude", "medianAbsDev", "median_buffer_range", "median_distance", "quantile_25", "quantile_95", "symmetry_looking"]
    result = spark.sql(features.query(names, weighted, features.SPARK, "ranked_points"))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "Join" not in plan
    want = duckdb.sql(features.query(names, weighted, features.DUCKDB, "ranked_points")).df().sort_values("lc_id")
    got = result.toPandas().sort_values("lc_id")
    for name in names:
        np.testing.assert_allclose(got[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-12, atol=1e-12, err_msg=name)


def test_values_on_the_borders_of_the_buffer_range_are_those_of_the_sql(spark):
    """Cents whose distance from the median is a tenth of the range but for the last bit of an interpolated quantile."""
    cents = [
        [49, 102, 112, 147, 208, 282, 290, 751, 972, 1153, 1395, 1742, 1817, 1935, 1997, 2044, 2245, 2265, 2317, 2319, 2460, 2500, 2791, 2905, 3267, 3367, 3484, 3525, 3964, 4068, 4218, 4253, 4253, 4494, 4698, 4741, 4986, 4992, 5229, 5416, 5630, 5736, 6698, 7159, 7308, 8177, 8214, 9462, 9885, 10012, 10452, 10551, 11939, 12040, 12331, 13229, 13327, 14604, 17222, 19422, 20394],
        [7, 7, 47, 201, 248, 284, 288, 405, 453, 643, 646, 767, 873, 919, 1080, 1137, 1339, 1447, 1458, 1545, 1686, 1859, 1865, 1867, 2057, 2131, 2226, 2241, 2290, 2559, 2592, 2905, 3116, 3147, 3211, 3262, 3362, 4070, 4158, 4650, 4716, 5013, 5111, 5130, 5340, 5433, 5435, 5509, 5519, 6325, 6957, 7157, 7801, 7847, 8742, 9016, 9367, 9385, 10343, 11061, 11668, 12280, 13027, 14658, 15106, 15931, 16073, 18757, 21778, 25178],
    ]
    rows = [(lc, k, float(k), v / 100, 1.0) for lc, values in enumerate(cents) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "lc_id long, seq long, time double, x double, e double").createOrReplaceTempView("border_points")
    border_points = pd.DataFrame(rows, columns=["lc_id", "seq", "time", "x", "e"])  # noqa: F841  read by DuckDB
    query = lambda d: features.query(["median_buffer_range"], False, d, "border_points")
    got, want = dict(map(tuple, spark.sql(query(features.SPARK)).collect())), dict(duckdb.sql(query(features.DUCKDB)).fetchall())
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_points_of_a_task_are_bounded(spark, points, monkeypatch):
    """Parts grow with the points, whatever adaptive execution would gather."""
    from starflow.operators import extract as module

    names = ["meanMag", "amplitude", "sample_entropy", "kurtosis_deriv"]
    want = sorted(map(tuple, extract(points, names).collect()))
    monkeypatch.setattr(module, "POINTS", 20)
    result = extract(points, names)
    assert "9), REPARTITION_BY_NUM" in result._jdf.queryExecution().executedPlan().toString()  # 162 points
    np.testing.assert_allclose(np.array(sorted(map(tuple, result.collect())), float), np.array(want, float), rtol=1e-12)
