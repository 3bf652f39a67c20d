"""Forests as arrays, Shapley values, permutation importance and isolation forests against slow versions."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starflow.operators import learn, trees

COLUMNS = ["a", "b", "c", "d"]


def rows(n, seed, classes=3):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c, d = (draw.gauss(0, 1) for _ in range(4))
        out.append((i, a, b, round(c, 1), d, "xyz"[min(classes - 1, int((a > 0) + (a + b > 0.5)))]))
    return out


def table(spark, n=400, seed=1, classes=3):
    return spark.createDataFrame(rows(n, seed, classes), "id long, a double, b double, c double, d double, label string")


def known_output(tree, x, known):
    """The tree's output when only some columns of ``x`` are known: both branches, by cover, where it isn't."""

    def walk(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return walk(left if x[f] <= tree.threshold[node] else right)
        return (walk(left) * tree.cover[left] + walk(right) * tree.cover[right]) / tree.cover[node]

    return walk(0)


def slow_shapley(forest, x, width):
    out = np.zeros((width, forest.outputs))
    for i in range(width):
        others = [j for j in range(width) if j != i]
        for n in range(width):
            weight = math.factorial(n) * math.factorial(width - n - 1) / math.factorial(width)
            for known in itertools.combinations(others, n):
                for tree, w in zip(forest.trees, forest.weights):
                    out[i] += weight * w * (known_output(tree, x, {*known, i}) - known_output(tree, x, set(known)))
    return out


@pytest.mark.parametrize("kind,params", [("rf", {"numTrees": 4, "maxDepth": 4}), ("xgb", {"maxIter": 3, "maxDepth": 3}), ("rf", {"numTrees": 2, "maxDepth": 9, "minInstancesPerNode": 2})])
def test_shapley_values_equal_enumeration(spark, kind, params):
    df = table(spark, classes=2 if kind == "xgb" else 3)
    model = learn.train(df, COLUMNS, kind=kind, **params)
    (forest,) = trees.forests(spark, model)
    x = np.array([r[1:5] for r in rows(6, 7)])
    got = forest.explainer(4)(x)
    for i in range(len(x)):
        assert got[i] == pytest.approx(slow_shapley(forest, x[i], 4), abs=1e-9)
    assert got.sum(1) == pytest.approx(forest.values(x) - forest.base, abs=1e-9)


def test_forest_predicts_as_spark(spark):
    df = table(spark)
    for kind, classes, params in (("rf", 3, {"numTrees": 10}), ("xgb", 2, {"maxIter": 4}), ("xgb", 3, {"maxIter": 3})):
        data = table(spark, classes=classes)
        model = learn.train(data, COLUMNS, kind=kind, **params)
        out = model.transform(data).select("id", *COLUMNS, vector_to_array("rawPrediction").alias("raw"), "prediction").orderBy("id").collect()
        x = np.array([[r[c] for c in COLUMNS] for r in out])
        values = np.concatenate([f.values(x) for f in trees.forests(spark, model)], 1)
        raw = np.array([r.raw for r in out])[:, : 2 if classes == 2 else 3]  # without the class of unknown labels
        values = values[:, :3]
        assert values == pytest.approx(raw / 10 if kind == "rf" else raw[:, 1:] if classes == 2 else raw, abs=1e-9)
        if kind == "rf" or classes == 2:
            assert (trees.forests(spark, model)[0].classes(values) == [r.prediction for r in out]).all()
    assert df.count() == 400


def test_shapley_tables(spark):
    df = table(spark, 300)
    model = learn.train(df, COLUMNS, numTrees=5)
    (forest,) = trees.forests(spark, model)
    each = trees.shapley(df.repartition(3), COLUMNS, model)
    assert each.count() == 300 * 4 * 3
    sums = {(r.id, r.output): r.s for r in each.groupBy("id", "output").agg(F.sum("value").alias("s")).collect()}
    held = rows(300, 1)
    values = forest.values(np.array([r[1:5] for r in held])) - forest.base
    assert all(sums[i, k] == pytest.approx(values[i, k], abs=1e-9) for i in range(300) for k in range(3))
    mean = {r.feature: r.m for r in each.groupBy("feature").agg((F.sum(F.abs("value")) / 300).alias("m")).collect()}
    found = {r.feature: r.importance for r in trees.shapley_importances(df, COLUMNS, model).collect()}
    assert found == pytest.approx(mean) and max(found, key=found.get) == "a" and min(found["a"], found["b"]) > max(found["c"], found["d"])
    assert trees.shapley_importances(df.limit(0), COLUMNS, model).count() == 0


def slow_f1(pairs):
    classes = sorted({a for a, _ in pairs})
    score = lambda c: 2 * sum(a == p == c for a, p in pairs) / (sum(a == c for a, _ in pairs) + sum(p == c for _, p in pairs))
    return score(classes[-1]) if len(classes) == 2 else sum(map(score, classes)) / len(classes)


@pytest.mark.parametrize("classes", [2, 3])
def test_permutation_importance(spark, classes):
    df = table(spark, 300, classes=classes)
    model = learn.train(df, COLUMNS, numTrees=8)
    got = {r.feature: (r.importance, r.deviation) for r in learn.permutation_importances(df, COLUMNS, model, repeats=2).collect()}
    base, drops = None, {c: [] for c in COLUMNS}
    for repeat in range(2):
        mixed = learn.shuffled(df, COLUMNS, "id", learn.SEED + repeat)
        score = lambda d: slow_f1([(r.label, r["class"]) for r in model.transform(d).collect()])
        base = score(df)
        for c in COLUMNS:
            drops[c].append(base - score(mixed.withColumn(c, F.col(f"shadow_{c}"))))
    for c in COLUMNS:
        assert got[c] == pytest.approx((np.mean(drops[c]), np.std(drops[c])), abs=1e-9)
    assert max(got, key=got.get) == "a"


def slow_isolation(held, columns, seed, tree):
    """The depth of every row of ``held`` in one tree, by recursion over the drawn sample and all rows at once."""

    def crc(*parts):
        return zlib.crc32(":".join(map(str, parts)).encode()) / 4294967296

    def depths(sample, others, node, depth, limit):
        spread = [j for j in range(columns) if min(r[j] for r in sample) < max(r[j] for r in sample)] if len(sample) > 1 else []
        if not spread or depth == limit:
            m = len(sample)
            more = 0 if m < 2 else 1 if m == 2 else 2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m
            return {i: depth + more for i, _ in others}
        j = spread[int(crc(seed, tree, node, "column") * len(spread))]
        lo, hi = min(r[j] for r in sample), max(r[j] for r in sample)
        t = lo + crc(seed, tree, node, "place") * (hi - lo)
        out = depths([r for r in sample if r[j] <= t], [(i, r) for i, r in others if r[j] <= t], 2 * node, depth + 1, limit)
        return out | depths([r for r in sample if r[j] > t], [(i, r) for i, r in others if r[j] > t], 2 * node + 1, depth + 1, limit)

    return lambda sample: depths(sample, list(enumerate(held)), 1, 0, math.ceil(math.log2(len(sample))))


def test_isolation_forest_equals_slow_version(spark):
    """Samples that hold all rows: every tree is grown on the whole table."""
    held = [r[1:5] for r in rows(60, 3)] + [(9.0, -9.0, 9.0, 9.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(held)], "id long, a double, b double, c double, d double")
    found = trees.isolation_forest(df, COLUMNS, trees=7, sample=256, seed=5)
    got = {r.id: r.score for r in found.transform(df).collect()}
    slow = [slow_isolation(held, 4, 5, t)(held) for t in range(7)]
    unit = 2 * (math.log(60) + 0.5772156649015329) - 2 * 60 / 61
    want = {i: -(2 ** -(sum(s[i] for s in slow) / 7 / unit)) for i in range(61)}
    assert got == pytest.approx(want) and min(got, key=got.get) == 60


def test_isolation_samples(spark):
    """Each tree has a sample of its own of the stated size; outliers score lowest."""
    held = rows(3000, 4)
    df = spark.createDataFrame([r[:5] for r in held] + [(10_000 + i, 8.0 + i, 8.0, -8.0, 8.0) for i in range(5)], "id long, a double, b double, c double, d double")
    found = trees.isolation_forest(df, COLUMNS, trees=30, sample=64)
    assert len(found.forest.trees) == 30 and found.size == 64
    scores = found.transform(df).orderBy("score").collect()
    assert {r.id for r in scores[:5]} == set(range(10_000, 10_005)) and all(-1 <= r.score < 0 for r in scores)
    assert trees.isolation_forest(df.limit(0), COLUMNS).transform(df.limit(3)).count() == 3
    one = trees.isolation_forest(df.where("id = 1"), COLUMNS).transform(df.limit(2)).collect()
    assert {r.score for r in one} == {-0.5}


def test_representative_sample(spark):
    df = spark.createDataFrame([(i, random.Random(i).gauss(0, 1)) for i in range(4000)], "id long, score double")
    sample, how = trees.representative(df)
    got, full = sorted(r.score for r in sample.collect()), sorted(r.score for r in df.collect())
    both = sorted(set(got) | set(full))
    share = lambda held: np.searchsorted(held, both, "right") / len(held)
    assert how["statistic"] == pytest.approx(np.abs(share(full) - share(got)).max()) and how["p"] > 0.95
    assert abs(len(got) / 4000 - how["share"]) < 0.05 and how["share"] < 0.5
    few = spark.createDataFrame([(1, 0.5), (2, None)], "id long, score double")
    assert trees.representative(few)[1]["share"] <= 1.0


@pytest.mark.parametrize("importance,sample", [("shap", True), ("perm", False)])
def test_selection_by_other_importances(spark, importance, sample):
    state, history = learn.select_features(table(spark, 400), COLUMNS, trials=8, trees=15, level=0.2, importance=importance, sample=sample)
    assert state["a"] == "accepted" and state["d"] != "accepted" and len({h[0] for h in history}) == 8
