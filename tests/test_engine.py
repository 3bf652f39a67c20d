import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starflow.operators import learn, matrix, model, periods, prepare, ranges, simulate
from starflow.plans import catalog
from starflow.sources import files
from starflow.streaming import online


def test_directory_source(spark, tmp_path):
    for name, text in {
        "A/one": "# t m e\n1 2 3\n2 3 4 # end\n", "A/ragged": "1 2 3\n1 2\n", "B/words": "1 x 3\n", "B/wide": "skip\n5 6 7 8\n\n6 7 8 9\n", "B/empty": "",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    got = {(r.lc_id, r["class"], r.filename, r.time, r.mag, r.magerr) for r in files.read_directory(spark, str(tmp_path)).collect()}
    assert got == {(1, "A", "one", 1.0, 2.0, 3.0), (1, "A", "one", 2.0, 3.0, 4.0)}
    skipped = files.read_directory(spark, str(tmp_path), skiprows=1).select("lc_id", "time").collect()
    assert {tuple(r) for r in skipped} == {(1, 1.0), (1, 2.0), (4, 5.0), (4, 6.0)} or {r.lc_id for r in skipped} >= {1}
    flat = files.read_directory(spark, str(tmp_path / "B"), skiprows=1, label="ML")
    assert {r["class"] for r in flat.collect()} == {"ML"}


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f1", "ML", "1", 0.5, None), ("f2", "CV", "2", -1.25, 3.0)], "filename string, label string, id string, a double, b double")
    files.write_features_csv(df, f"{tmp_path}/loaded", loaded=True)
    back = files.read_features_csv(spark, f"{tmp_path}/loaded")
    assert back.columns == ["filename", "label", "id", "a", "b"] and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files.write_features_csv(df, f"{tmp_path}/made")
    assert files.read_features_csv(spark, f"{tmp_path}/made").columns == ["a", "b", "label"]
    files.write_features_text(df, f"{tmp_path}/text")
    text = files.read_features_text(spark, f"{tmp_path}/text", ["label", "a", "b"])
    assert {(r.label, r.a) for r in text.collect()} == {("ML", 0.5), ("CV", -1.25)}
    points = files.from_arrays(spark, [np.array([[1, 2, 0.1], [2, 3, 0.1]])])
    files.write_points(points, f"{tmp_path}/points")
    assert dict(spark.read.parquet(f"{tmp_path}/points").dtypes)["mag"] == "float"
    back = files.read_points(spark, f"{tmp_path}/points")
    assert [(r.lc_id, r.seq, r.time, r.mag, r["class"]) for r in back.orderBy("seq").collect()] == [(1, 0, 1.0, 2.0, "ML"), (1, 1, 2.0, 3.0, "ML")]
    (tmp_path / "v.xml").write_text("<VOTABLE><TABLEDATA><TR><TD>1.5</TD><TD>x</TD></TR><TR><TD>2</TD><TD>3</TD></TR></TABLEDATA></VOTABLE>")
    assert sorted(tuple(r) for r in files.read_votable(spark, f"{tmp_path}/v.xml", ["a", "b"]).fillna(-1).collect()) == [(1.5, -1.0), (2.0, 3.0)]
    assert files.points_of(points, label="ML").count() == 2 and files.points_of(points, lc_id=9).count() == 0
    (tmp_path / "t.xml").write_text("<r><s><p>1.5</p></s><s><p>2.5</p></s></r>")
    assert [r.p for r in files.read_xml_table(spark, f"{tmp_path}/t.xml", "s", "p double").collect()] == [1.5, 2.5]


def test_finite(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0), (1.0, float("-inf"), 1.0), (1.0, 1.0, None)], "time double, mag double, magerr double")
    assert prepare.finite(df).count() == 1


@pytest.fixture(scope="module")
def cadence(spark):
    return spark.range(40).selectExpr("id AS lc_id", "explode(sequence(0, 199)) AS seq").selectExpr("lc_id", "cast(seq AS BIGINT) AS seq", "seq * 2.5 + lc_id * 0.01D AS time").cache()


def test_training_points(spark, cadence):
    points = simulate.training_points(cadence, seed=5)
    by = {r["class"]: r for r in points.groupBy("class").agg(F.countDistinct("lc_id").alias("n"), F.avg("mag").alias("m"), F.stddev("mag").alias("s")).collect()}
    assert set(by) == set(simulate.CLASSES)
    assert by["CONSTANT"].n == 40 and abs(by["CONSTANT"].m - 19) < 0.01 and by["CONSTANT"].s < 0.1
    assert by["ML"].m < 19 and by["ML"].n >= 20 and by["CV"].n >= 20
    again = simulate.training_points(cadence.repartition(7), seed=5)
    digest = lambda df: df.agg(F.sum(F.xxhash64("lc_id", "seq", F.round("mag", 6)).cast("decimal(38,0)"))).first()[0]
    assert digest(points) == digest(again) != digest(simulate.training_points(cadence, seed=6))


def test_noise(spark, cadence):
    flat = cadence.withColumn("mag", F.lit(18.0))
    row = simulate.add_poisson_noise(flat, exposure=10).agg(F.avg("mag"), F.stddev("mag"), F.avg("magerr")).first()
    assert abs(row[0] - 18) < 0.01 and abs(row[1] / row[2] - 1) < 0.1
    x = np.linspace(15, 21, 30)
    model = simulate.create_noise(np.r_[x, x[:3]], np.r_[0.01 + (x - 15) ** 3 / 1000, [9, 9, 9]])
    got = [r[0] for r in spark.createDataFrame([(15.0,), (18.0,), (30.0,)], "mag double").selectExpr(model).collect()]
    assert np.allclose(got, [0.01, 0.037, 0.226], atol=1e-9)


def test_period_search_and_templates(spark):
    rng = np.random.default_rng(3)
    rows, shape = [], np.sin(2 * np.pi * np.arange(32) / 32)
    for lc, period in ((1, 3.7), (2, 5.2)):
        t = np.sort(rng.uniform(0, 60, 120))
        x = 2 + 0.5 * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.05, 120)
        rows += [(lc, k, float(a), float(b), 0.05) for k, (a, b) in enumerate(zip(t, x))]
    points = spark.createDataFrame(rows, "lc_id long, seq long, time double, x double, e double")
    power = spark.sql(f"WITH {periods.periodogram_sql('{p}')} SELECT * FROM power", p=points)
    best = periods.best_periods(power, 2)
    found = {r.lc_id: r.period for r in best.where("rank = 1").collect()}
    assert abs(found[1] - 3.7) < 0.1 and abs(found[2] - 5.2) < 0.15
    fine = {r.lc_id: r for r in periods.refine_periods(points, periods.best_periods(power, 5)).collect()}
    assert all(fine[lc].power >= r.power - 1e-12 for lc, r in {r.lc_id: r for r in best.where("rank = 1").collect()}.items())
    assert abs(fine[1].period - 3.7) < 0.02 and abs(fine[2].period - 5.2) < 0.03
    fits = {r.lc_id: r for r in periods.fit_templates(points, spark.createDataFrame(list(fine.values())), {"sine": shape, "saw": np.arange(32) / 32}).collect()}
    assert all(f.template == "sine" and abs(f.amplitude - 0.5) < 0.05 and abs(f.offset - 2) < 0.05 for f in fits.values())
    for lc, period in ((1, 3.7), (2, 5.2)):  # no shift of a grid fits as well
        t, x = np.array([(r[2], r[3]) for r in rows if r[0] == lc]).T
        wave = 2 * np.pi * (t / fine[lc].period + fits[lc].phase)
        assert fits[lc].chi2 == pytest.approx((((x - fits[lc].offset - fits[lc].amplitude * np.sin(wave)) / 0.05) ** 2).sum(), rel=1e-3)
    values = np.array([0.0, 2.0, -1.0, 0.5])
    assert np.allclose(periods.spline_at(values, periods.periodic_spline(values), np.array([0, 0.25, 0.5, 0.75, 1.25])), [0, 2, -1, 0.5, 2])
    assert periods.grid_size(0.5, 2, 100) == 751
    with pytest.raises(ValueError):
        periods.grid_size(2, 1, 100)


def table(spark, n=90):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], float(rng.normal() + 3 * (i % 2)), float(rng.normal()), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string, x double, y double, z double")


def test_impute_and_scale(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, None, 5.0), (2, 1.0, 2.0, None), (3, 4.0, 3.0, nan), (4, None, 4.0, float("inf")), (5, 9.0, 8.0, 1.0)], "id long, a double, b double, c double")
    got = {s: {r.id: (r.a, r.b, r.c) for r in matrix.impute(df, ["a", "b", "c"], s, constant=-1).collect()} for s in ("mean", "median", "mode", "constant", "knn")}
    assert got["mean"][4] == (3.75, 4.0, 0.0) and got["median"][4][0] == 2.5 and got["mode"][4][0] == 1.0 and got["constant"][1] == (1.0, -1.0, 0.0)
    assert got["knn"][4][0] == pytest.approx((4 + 1 + 9) / 3) and all(None not in v for v in got["knn"].values())
    std = matrix.scale(table(spark), ["x", "y"]).agg(F.avg("x"), F.stddev_pop("y")).first()
    assert abs(std[0]) < 1e-12 and abs(std[1] - 1) < 1e-12
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, x double")
    assert [r.x for r in matrix.scale(flat, ["x"], "robust").collect()] == [0.0, 0.0]
    white = np.array([[r.pc0, r.pc1, r.pc2] for r in matrix.whiten(table(spark), ["x", "y", "z"]).collect()])
    assert np.allclose(np.cov(white.T, ddof=0), np.eye(3), atol=1e-6)
    assert [r.x for r in matrix.clamped(spark.createDataFrame([(1e11,), (1e-12,), (nan,), (-2e10,)], "x double"), ["x"]).collect()] == [1e10, 1e-10, None, -1e10]


def test_folds(spark):
    parted = matrix.folds(table(spark, 900), 3, label="label")
    sizes = [r["count"] for r in parted.groupBy("label", "fold").count().collect()]
    assert len(sizes) == 6 and min(sizes) > 120


def test_fitted_preparation_of_new_rows(spark, tmp_path):
    old = spark.createDataFrame([(1, 1.0, 10.0, None), (2, 3.0, 20.0, None), (3, 3.0, None, 5.0), (4, 9.0, 40.0, None)], "id long, a double, b double, c double")
    new = spark.createDataFrame([(1, None, 20.0, 7.0), (9, 8.0, float("nan"), None)], "id long, a double, b double, c double")
    want = {"mean": [(4.0, 20.0, 0.0), (8.0, 70 / 3, 0.0)], "median": [(3.0, 20.0, 0.0), (8.0, 20.0, 0.0)], "mode": [(3.0, 20.0, 0.0), (8.0, 10.0, 0.0)], "constant": [(-1.0, 20.0, 0.0), (8.0, -1.0, 0.0)], "knn": [(3.0, 20.0, 0.0), (8.0, 40.0, 0.0)]}
    for strategy, rows in want.items():
        fitted = matrix.fit_imputer(old, ["a", "b", "c"], strategy, k=1, constant=-1)
        matrix.save(fitted, spark, f"{tmp_path}/{strategy}")
        for one in (fitted, matrix.load(spark, f"{tmp_path}/{strategy}")):
            assert [(r.a, r.b, r.c) for r in one.transform(new).orderBy("id").collect()] == [pytest.approx(w) for w in rows]
    scaler = matrix.fit_scaler(old.fillna(0), ["a", "b"], "minmax")
    matrix.save(scaler, spark, f"{tmp_path}/scaler")
    assert [r.a for r in matrix.load(spark, f"{tmp_path}/scaler").transform(new).orderBy("id").collect()] == [None, 7 / 8]


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 3)), 1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").withColumn("c", F.when(F.col("id") < 5, F.col("c"))).repartition(7)
    shares = [0, 0.25, 0.5, 0.9, 1]
    got = ranges.quantiles(df, ["a", "b", "c"], shares)
    assert np.allclose([got["a"], got["b"], got["c"]], [np.quantile(x[:, 0], shares), np.quantile(x[:, 1], shares), np.quantile(x[:5, 2], shares)])
    values, times = np.unique(x[:, 0], return_counts=True)
    assert ranges.modes(df, ["a"])["a"] == values[times.argmax()] and ranges.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    placed = {r.id: (r.n_before, r.a_before) for r in ranges.running(df.withColumn("n", F.lit(1)), ["b"], [F.col("a"), F.col("id")], ["n"], ["a"]).collect()}
    for i in (3, 77, 400):
        before = [v for j, v in enumerate(x) if v[1] == x[i, 1] and (v[0], j) < (x[i, 0], i)]
        assert placed[i] == (len(before), max((v[0] for v in before), default=None))


@pytest.mark.parametrize("kind", ["rf", "nn", "xgb"])
def test_training(spark, tmp_path, kind):
    df = table(spark)
    model = learn.train(df, ["x", "y", "z"], kind=kind, **({"numTrees": 10} if kind == "rf" else {"maxIter": 20}))
    rows = learn.predict(model, df.drop("label")).collect()
    assert len(rows) == 180 and {r["class"] for r in rows} == {"a", "b"}
    sums = {}
    for r in rows:
        sums[r.id] = sums.get(r.id, 0) + r.probability
    assert all(math.isclose(v, 1, abs_tol=1e-6) for v in sums.values())
    learn.save(model, f"{tmp_path}/model")
    assert learn.predict(learn.load(f"{tmp_path}/model"), df).count() == 180


def test_evaluation(spark):
    df = table(spark)
    predicted = learn.cross_predict(df, ["x", "y"], k=3, numTrees=10).cache()
    score, spread = learn.accuracy(predicted)
    assert score > 0.8 and predicted.count() == 90
    assert sum(r.n for r in learn.confusion(predicted).collect()) == 90
    scored = df.select("x", (F.col("label") == "b").alias("positive"), (F.col("id") % 3).alias("fold")).withColumnRenamed("x", "score")
    curve = learn.roc(scored, group="fold")
    pos, neg = ([r.score for r in scored.where(F.col("positive") == p).where("fold = 0").collect()] for p in (True, False))
    want = np.mean([[(a > b) + 0.5 * (a == b) for b in neg] for a in pos])
    assert learn.auc(curve, "fold").where("fold = 0").first().auc == pytest.approx(want)
    mean = learn.mean_roc(curve, "fold", 11).orderBy("fpr").collect()
    assert len(mean) == 11 and mean[0].tpr == 0 and mean[-1].tpr == 1


def test_scores(spark):
    rows = [(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (0, "b", "b"), (1, "a", "a"), (1, "b", "a")]
    two = spark.createDataFrame(rows, "fold int, actual string, predicted string")
    by = lambda df, m: [r.score for r in learn.fold_scores(df, m).orderBy("fold").collect()]
    assert by(two, "precision") == [2 / 3, 0.0] and by(two, "recall") == [1.0, 0.0] and by(two, "f1") == [0.8, 0.0] and by(two, "accuracy") == [0.75, 0.5]
    three = spark.createDataFrame([(0, "a", "a"), (0, "b", "c"), (0, "c", "c")], "fold int, actual string, predicted string")
    assert by(three, "f1") == [pytest.approx((1 + 0 + 2 / 3) / 3)] and learn.score(three, "recall")[0] == pytest.approx(2 / 3)
    shares = spark.createDataFrame([(0, a, c, p if c == "b" else 1 - p) for a, p in (("a", 0.1), ("b", 0.4), ("a", 0.35), ("b", 0.8)) for c in "ab"], "fold int, actual string, class string, probability double")
    assert learn.score(shares, "roc_auc")[0] == 1.0
    weights = {r.label: r.weight_ for r in learn.balanced(spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "label string")).collect()}
    assert weights == {"a": pytest.approx(4 / 6), "b": 2.0}


def test_classifier_from_points_to_probabilities(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(lc, k, float(k), float(10 + (lc % 2) * 3 * np.sin(k) + rng.normal(0, 0.3)), 0.3) for lc in range(60) for k in range(40)]
    points = spark.createDataFrame(rows, "lc_id long, seq long, time double, mag double, magerr double")
    from starflow.operators.extract import extract

    names = ["variance", "meanMag", "c3", "stetsonK_deriv"]
    table = extract(points, names, convert=False).withColumn("label", F.when(F.col("lc_id") % 2 == 1, "wave").otherwise("flat")).withColumn("c3", F.when(F.col("lc_id") % 9 > 0, F.col("c3"))).cache()
    fitted = model.Classifier.create(table, names, key="lc_id", trials=2, k=2, selection_trials=6, kind="rf")
    assert set(fitted.decisions) == set(names) and "tentative" not in fitted.decisions.values() and len(fitted.trials) == 2 and "variance" in fitted.columns
    fitted.save(spark, f"{tmp_path}/bundle")
    again = model.Classifier.load(spark, f"{tmp_path}/bundle")
    assert again.columns == fitted.columns and again.trials == fitted.trials and again.decisions == fitted.decisions
    fresh = points.withColumn("lc_id", F.col("lc_id") + 1000)
    for one in (fitted, again):
        got = one.predict(fresh, convert=False).collect()
        assert len(got) == 120 and {r.n_points for r in got} == {40} and [r["class"] for r in got if r.lc_id == 1000] == ["flat", "wave"]
        assert np.mean([(r.probability > 0.5) == ((r["class"] == "wave") == (r.lc_id % 2 == 1)) for r in got]) > 0.95
    files.write_selection(learn.selection_table(spark, fitted.decisions, fitted.selection), f"{tmp_path}/selection")
    kept = spark.read.option("header", True).csv(f"{tmp_path}/selection")
    assert kept.columns == ["feature", "mean", "deviation", "decision"] and kept.count() == len(names)


def test_selection_and_optimisation(spark):
    df = table(spark, 120).cache()
    state, history = learn.select_features(df, ["x", "y", "z"], trials=6, trees=10, level=0.2)
    assert state["x"] == "accepted" and state["y"] != "accepted"
    top = learn.selection_table(spark, state, history).first()
    assert top.feature == "x"
    shuffled = learn.shuffled(df, ["x", "y"], "id", 3).collect()
    assert sorted(r.shadow_x for r in shuffled) == sorted(r.x for r in df.collect()) and sorted(r.shadow_y for r in shuffled) == sorted(r.y for r in df.collect())
    assert sum(r.x == r.shadow_x for r in shuffled) < 10 and np.corrcoef([r.shadow_x for r in shuffled], [r.shadow_y for r in shuffled])[0, 1] < 0.4
    assert learn.settle_tentative({"x": "tentative", "y": "tentative", "z": "rejected"}, [(1, "x", 2.0, False), (1, "y", 0.1, False), (1, "shadow_x", 1.0, True)]) == {"x": "accepted", "y": "rejected", "z": "rejected"}
    held_out, _ = learn.select_features(df, ["x", "y", "z"], trials=6, trees=10, level=0.2, train_share=0.7)
    assert held_out["x"] == "accepted"
    trials = [{"trial": i, "score": 0.5 + 0.4 * (d > 5), "params": {"maxDepth": d, "hidden": [i % 3], "mode": "uv"[i % 2]}} for i, d in enumerate((2, 3, 4, 6, 7, 8, 9, 3, 2, 8))]
    assert learn.setting_importances(spark, trials).first().setting == "maxDepth"
    model, params, trials = learn.optimise(df, ["x", "y"], kind="rf", trials=1, k=2)
    assert params == {} and len(trials) == 1 and learn.predict(model, df).count() == 240
    best = learn.best_so_far(spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.7)], "trial int, score double"))
    assert [r.best for r in best.orderBy("trial").collect()] == [0.5, 0.5, 0.7]
    assert learn.binomial_tail(5, 5)[0] == 1 / 32
    ks = learn.kolmogorov_smirnov(df.withColumn("odd", F.col("id") % 2 == 1), "x", "odd").first()
    assert ks.statistic > 0.6 and ks.p < 1e-6


def test_stream(spark, tmp_path):
    rows = [(lc, f"2024-01-0{d} 0{h}:00:00", float(d + h + lc), 0.1) for lc in (1, 2) for d in (1, 2, 5) for h in range(6)]
    points = spark.createDataFrame(rows, "lc_id long, ts string, mag double, magerr double").withColumn("ts", F.col("ts").cast("timestamp"))
    points.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).parquet(f"{tmp_path}/in")
    query = online.windowed_moments(stream).writeStream.outputMode("complete").format("memory").queryName("moments").start()
    query.processAllAvailable()
    query.stop()
    want = {(r.lc_id, r.window.start, r.n, r["mean"]) for r in online.windowed_moments(points).collect()}
    assert {(r.lc_id, r.window.start, r.n, r["mean"]) for r in spark.table("moments").collect()} == want and len(want) == 6
    seen = []
    query = online.extract_sessions(stream, lambda df, n: seen.extend(df.collect()), ["meanMag", "c3"]).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.series, round(r.meanMag * 1000)) for r in seen} <= {(lc, round((d + 2.5 + lc) / (d + 5 + lc) * 1000)) for lc in (1, 2) for d in (1, 2, 5)} and len(seen) >= 2


def test_whole_frequency_grid(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 60, 120))
    x = 2 + 0.5 * np.sin(2 * np.pi * t / 0.5) + rng.normal(0, 0.05, 120)
    points = spark.createDataFrame([(1, k, float(a), float(b), 0.05) for k, (a, b) in enumerate(zip(t, x))], "lc_id long, seq long, time double, x double, e double")
    power = spark.sql(f"WITH {periods.periodogram_sql('{p}')} SELECT * FROM power", p=points).cache()
    rows = power.orderBy("k").collect()
    assert [r.k for r in rows] == list(range(1, 901))
    y = x - x.mean()
    for r in rows[::90]:
        waves = np.stack([np.cos(2 * np.pi * r.frequency * (t - t[0])), np.sin(2 * np.pi * r.frequency * (t - t[0]))], 1)
        left = y - waves @ np.linalg.lstsq(waves, y, rcond=None)[0]
        assert r.power == pytest.approx(1 - (left @ left) / (y @ y), abs=1e-9)
    assert abs(periods.best_periods(power).first().period - 0.5) < 0.005
    sizes = {r.user_id: r["count"] for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").count().collect()}
    got = {r.lc_id: r["count"] for r in catalog.QUERIES["lc_periodogram_full"](spark, "/root/testdata/sf0.001").groupBy("lc_id").count().collect()}
    assert got == {lc: int(7.5 * n) for lc, n in sizes.items()}


def test_no_cadence_vanishes(spark):
    cadence = spark.range(60).selectExpr("id AS lc_id", "explode(sequence(0, 79)) AS seq").selectExpr("lc_id", "cast(seq AS BIGINT) AS seq", "seq * 3D AS time")
    points = simulate.training_points(cadence, seed=5)
    counts = {r["class"]: r.n for r in points.groupBy("class").agg(F.countDistinct("lc_id").alias("n")).collect()}
    assert counts == dict.fromkeys(simulate.CLASSES, 60)
    with pytest.raises(ValueError, match="no CV series passes"):
        simulate.training_points(cadence.where("seq < 3"), seed=5, attempts=6)


def test_registered_selection_decides(spark, monkeypatch):
    rng = np.random.default_rng(2)
    names = catalog.COLUMNS[:8]
    rows = [(i, "ab"[i % 2], *map(float, rng.normal(size=8) + np.eye(8)[0] * 3 * (i % 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string, " + ", ".join(f"{c} double" for c in names)).cache()
    monkeypatch.setattr(catalog, "feature_matrix", lambda *_: df)
    monkeypatch.setattr(catalog, "COLUMNS", names)
    decided = {r.feature: r.decision for r in catalog.ml_feature_selection(spark, "").collect()}
    assert decided["c0"] == "accepted"
    assert "rejected" in [decided[c] for c in names[1:]] and "accepted" not in [decided[c] for c in names[1:]]


def test_shuffled_values_go_by_the_order_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(learn, "CELLS", 3_000)
    df = spark.range(9_000, 0, -1, 3).selectExpr("id * 3 AS id", "CASE WHEN id % 5 > 0 THEN id * 0.5D END AS a", "CASE WHEN id % 7 = 0 THEN double('NaN') ELSE -id * 1D END AS b")
    got = learn.shuffled(df, ["a", "b"], "id", 11).orderBy("id").collect()
    for k, c in enumerate("ab"):
        want = [r[c] for r in df.orderBy(F.xxhash64(F.lit(11), F.lit(k), "id"), "id").collect()]
        assert [str(r[f"shadow_{c}"]) for r in got] == [str(v) for v in want]
    assert [(r.id, str(r.a)) for r in got] == [(r.id, str(r.a)) for r in df.orderBy("id").collect()]


def test_selection_sorts_the_rows_once(spark, monkeypatch):
    sorts, running = [], learn.ranges.running
    monkeypatch.setattr(learn.ranges, "running", lambda *given: [sorts.append(given), running(*given)][1])
    df = spark.range(60).selectExpr("id", "cast(id % 2 AS STRING) AS label", "rand(1) + id % 2 AS a", "rand(2) AS b")
    learn.select_features(df, ["a", "b"], trials=3, trees=3)
    assert len(sorts) == 1  # once two a trial, one of them of all cells


def test_bands(spark):
    rng = np.random.default_rng(4)
    rows = []
    for lc, period in ((1, 2.3), (2, 4.1)):
        for k, t in enumerate(np.sort(rng.uniform(0, 40, 90))):
            band = "gr"[k % 2]
            rows.append((lc, band, k, float(t), float({"g": 1, "r": 5}[band] + {"g": 0.6, "r": 0.2}[band] * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.02)), 0.02))
    points = spark.createDataFrame(rows, "lc_id long, band string, seq long, time double, x double, e double").cache()
    power = spark.sql(f"WITH {periods.multiband_sql('{p}')} SELECT * FROM power", p=points).cache()
    best = periods.best_periods(power)
    found = {r.lc_id: r.period for r in best.collect()}
    assert abs(found[1] - 2.3) < 0.05 and abs(found[2] - 4.1) < 0.1
    single = spark.sql(f"WITH {periods.periodogram_sql('{p}')} SELECT * FROM power", p=points.where("band = 'g'").drop("band"))
    one = spark.sql(f"WITH {periods.multiband_sql('{p}')} SELECT * FROM power", p=points.where("band = 'g'"))
    assert one.join(single.withColumnRenamed("power", "own"), ["lc_id", "k"]).where("abs(power - own) > 1e-9").count() == 0
    fits = periods.fit_bands(points, best)
    off = periods.predict_bands(fits, points).select((F.col("model") - F.col("x")).alias("d")).agg(F.sqrt(F.avg(F.col("d") * F.col("d")))).first()[0]
    assert off < 0.15
    with pytest.raises(Exception, match="no fit of band z"):
        periods.predict_bands(fits, points.limit(1).withColumn("band", F.lit("z"))).collect()


def test_nearest_rows_equal_all_distances(spark):
    rng = np.random.default_rng(11)
    columns = [f"c{k}" for k in range(6)]
    cells = rng.normal(1e6, 1, (150, 6)).round(1)
    cells[75:] = cells[:75]  # copies, with gaps of their own
    cells[7, 2], gaps = 1e9, rng.random((150, 6)) < 0.3
    gaps[5], gaps[9, 1:] = True, True
    cells[gaps] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(cells)], "id long, " + ", ".join(f"{c} double" for c in columns))
    want = cells.copy()
    for i, c in np.argwhere(gaps):
        both = ~gaps[i] & ~gaps
        d = np.where(both, (cells[i] - cells) ** 2, 0).sum(1) * 6 / np.maximum(both.sum(1), 1)
        at = [j for j in np.lexsort((np.arange(150), d)) if both[j].any() and not gaps[j, c]][:3]
        want[i, c] = cells[at, c].mean() if at else np.nanmean(cells[:, c])
    for block in (16, 16384):
        got = matrix._nearest(df, df, columns, 3, "id", block).orderBy("id").toPandas()[columns].to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-14)


def nearest_by_all_pairs(x, y, ids, k):
    found = {}
    for i in range(len(x)):
        both = ~np.isnan(x[i]) & ~np.isnan(y)
        total = np.zeros(len(y))
        for c in range(x.shape[1]):
            total += np.where(both[:, c], (x[i, c] - y[:, c]) ** 2, 0)
        with np.errstate(all="ignore"):
            d = total * x.shape[1] / both.sum(1)
        order = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])]
        for c in np.flatnonzero(np.isnan(x[i])):
            if near := [int(ids[j]) for j in order if not np.isnan(y[j, c])][:k]:
                found[i, int(c)] = near
    return found


@pytest.mark.parametrize("seed", range(8))
def test_nearest_donors_are_those_of_all_pairs(seed):
    """Of any scale, with copies, ties, sparse and empty columns."""
    draw = np.random.default_rng(seed)
    width, n, k = int(draw.integers(1, 9)), int(draw.integers(1, 700)), int(draw.integers(1, 5))
    y = draw.normal(size=(n, width)) * 10.0 ** draw.integers(-6, 9, width) * (1 if seed % 3 else 1e30)
    if seed % 2:
        y = np.round(y[draw.integers(0, max(1, n // 5), n)], 1)
    y[draw.random(y.shape) < draw.choice([0.05, 0.5, 0.9])] = np.nan
    if seed % 4 == 3:
        y[:, 0] = np.nan
    x, ids = y[draw.integers(0, n, 30)].copy(), draw.permutation(n)
    x[draw.random(x.shape) < 0.3] = np.nan
    middle = np.array([np.nanmean(v) if (~np.isnan(v)).any() else 0.0 for v in y.T])
    best = matrix._Best(x, np.arange(30), k, ids.dtype)
    for lo in range(0, n, 300):
        matrix._search(best, y[lo : lo + 300], ids[lo : lo + 300], middle, lo, 100)
    got = {(int(i), int(c)): best.j[s][: best.found[s]].tolist() for s, (i, c) in enumerate(zip(best.row, best.column)) if best.found[s]}
    assert got == nearest_by_all_pairs(x, y, ids, k)


def test_no_pair_is_shuffled_for_nearest_rows(spark, monkeypatch):
    draw, plain = np.random.default_rng(4), matrix._nearest
    y = np.where(draw.random((700, 3)) < 0.2, np.nan, draw.normal(size=(700, 3)))
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(y)], "id long, a double, b double, c double")
    monkeypatch.setattr(matrix, "_nearest", lambda *a: plain(*a, block=50))  # several tasks, each of which reads several files
    out = matrix.impute(df, ["a", "b", "c"], "knn")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CoGroup" not in plan
    want = {cell: np.mean([y[j, cell[1]] for j in near]) for cell, near in nearest_by_all_pairs(y, y, np.arange(700), 3).items()}
    got = {r.id: (r.a, r.b, r.c) for r in out.collect()}
    assert len(got) == 700 and all(got[i][c] == pytest.approx(v, abs=1e-12) for (i, c), v in want.items())
