"""Training, prediction and what evaluation plots are drawn from."""

from __future__ import annotations

import math
import statistics
import time
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.operators import ranges, search, trees
from starflow.operators.matrix import folds
from starflow.operators.search import Choice, Number
from starflow.operators.trees import Forest, isolation_forest, representative, shapley_importances
from starflow.session import cut

SEED = 1909


def classifier(kind: str, inputs: int, classes: int, weights: str | None = None, **params):
    """``rf`` a random forest, ``nn`` a perceptron (which takes no weights), ``xgb`` boosted trees, one against the rest
    beyond two classes."""
    common = {"featuresCol": "features_", "labelCol": "label_"}
    if weights and kind != "nn" and not (kind == "xgb" and classes > 2):
        params["weightCol"] = weights
    if kind == "rf":
        return RandomForestClassifier(**common, seed=SEED, **({"numTrees": 100} | params))
    if kind == "nn":
        hidden = params.pop("hidden", [32])
        return MultilayerPerceptronClassifier(**common, seed=SEED, layers=[inputs, *hidden, classes], **({"maxIter": 200} | params))
    if kind == "xgb":
        boosted = GBTClassifier(**common, seed=SEED, **({"maxIter": 20} | params))
        return boosted if classes == 2 else OneVsRest(classifier=boosted, **common)
    raise ValueError(f"no such classifier: {kind}")


def balanced(df: DataFrame, label: str = "label", column: str = "weight_") -> DataFrame:
    """``df`` with the weight of each row's class: all rows over its rows and the number of classes."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_"))
    total, classes = sizes.agg(F.sum("n_"), F.count(F.lit(1))).first()
    weights = sizes.select(F.col(label).alias("class_"), (F.lit(total) / (F.col("n_") * classes)).alias(column))  # a row a class
    return df.join(F.broadcast(weights), F.col(label) == F.col("class_"), "left").drop("class_")


def train(df: DataFrame, columns: list[str], label: str = "label", kind: str = "rf", **params) -> PipelineModel:
    """A fitted pipeline: labels indexed in alphabetical order, features assembled, classifier, label names. ``weights``
    names a column of row weights."""
    assembler = VectorAssembler(inputCols=columns, outputCol="features_")
    kept = [label, *([params["weights"]] if params.get("weights") else [])]
    rows = assembler.transform(df).select(*kept, "features_").persist()  # a classifier reads it several times
    try:
        indexer = StringIndexer(inputCol=label, outputCol="label_", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
        names = list(indexer.labels)
        fitted = classifier(kind, len(columns), len(names), **params).fit(indexer.transform(rows))
    finally:
        rows.unpersist()
    return PipelineModel([indexer, assembler, fitted, IndexToString(inputCol="prediction", outputCol="class", labels=names)])


def predict(model: PipelineModel, df: DataFrame, key: str = "id") -> DataFrame:
    """``(id, class, probability)``: a row per class, in alphabetical order. One-against-the-rest models, which have no
    probabilities, give the logistic of their margins, normed."""
    names = model.stages[-1].getLabels()
    if not isinstance(model.stages[0], StringIndexer) and model.stages[0].getInputCol() not in df.columns:
        df = df.withColumn(model.stages[0].getInputCol(), F.lit(names[0]))
    out = model.transform(df)
    if "probability" in out.columns:
        shares = vector_to_array("probability")
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-v)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
        shares = F.transform(raw, lambda v: v / total)
    return out.select(F.col(key), F.posexplode(F.slice(shares, 1, len(names))).alias("k_", "probability")).select(key, F.array(*map(F.lit, names))[F.col("k_")].alias("class"), "probability")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def cross_predict(df: DataFrame, columns: list[str], label: str = "label", kind: str = "rf", k: int = 10, key: str = "id", **params) -> DataFrame:
    """``(id, fold, actual, predicted)``: each row predicted by the model trained on the other folds."""
    parted, out = cut(folds(df, k, key, label)), None
    for f in range(k):
        model = train(parted.where(F.col("fold") != f), columns, label, kind, **params)
        part = model.transform(parted.where(F.col("fold") == f)).select(key, "fold", F.col(label).alias("actual"), F.col("class").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def scored_predictions(df: DataFrame, columns: list[str], label: str = "label", kind: str = "rf", k: int = 10, key: str = "id", **params) -> DataFrame:
    """``(id, fold, actual, class, probability)``: the probability of each class for each row, from the model trained on
    the other folds."""
    parted, out = cut(folds(df, k, key, label)), None
    for f in range(k):
        model, held = train(parted.where(F.col("fold") != f), columns, label, kind, **params), parted.where(F.col("fold") == f)
        part = predict(model, held, key).join(held.select(key, "fold", F.col(label).alias("actual")), key)
        out = part if out is None else out.unionByName(part)
    return out


def accuracy(predicted: DataFrame) -> tuple[float, float]:
    """Mean and deviation of the folds' accuracies."""
    return score(predicted, "accuracy")


def fold_scores(predicted: DataFrame, metric: str = "accuracy") -> DataFrame:
    """``(fold, score)``: ``accuracy``, or ``precision``, ``recall`` or ``f1``. These are of the class last in order
    where there are two, else the means over all classes (macro). A class without predictions or rows scores 0."""
    if metric == "accuracy":
        return predicted.groupBy("fold").agg(F.avg(F.when(F.col("actual") == F.col("predicted"), 1.0).otherwise(0.0)).alias("score"))
    one = lambda c, hit, said, there: F.struct(c.alias("c"), F.lit(hit).alias("hit"), F.lit(said).alias("said"), F.lit(there).alias("there"))
    right = F.col("actual") == F.col("predicted")
    marks = F.when(right, F.array(one(F.col("actual"), 1, 1, 1))).otherwise(F.array(one(F.col("actual"), 0, 0, 1), one(F.col("predicted"), 0, 1, 0)))
    by = predicted.select("fold", F.explode(marks).alias("m")).groupBy("fold", "m.c").agg(F.sum("m.hit").alias("hit"), F.sum("m.said").alias("said"), F.sum("m.there").alias("there"))
    rate = {"precision": ("hit", F.col("said")), "recall": ("hit", F.col("there")), "f1": ("hit", (F.col("said") + F.col("there")) / 2)}[metric]
    classes = by.withColumn("rate", F.coalesce(F.try_divide(F.col(rate[0]).cast("double"), rate[1]), F.lit(0.0)))
    names = predicted.agg(F.max("actual"), F.count_distinct("actual")).first()
    classes = classes.where(F.col("c") == names[0]) if names[1] == 2 else classes
    return classes.groupBy("fold").agg(F.avg("rate").alias("score"))


def auc_scores(probabilities: DataFrame) -> DataFrame:
    """``(fold, score)``: area under the ROC curve of the class last in order where there are two, else the mean of the
    areas of each class against the rest; over ``(fold, actual, class, probability)``."""
    names = probabilities.agg(F.max("class"), F.count_distinct("class")).first()
    kept = probabilities.where(F.col("class") == names[0]) if names[1] == 2 else probabilities
    marked = kept.select(F.struct("fold", "class").alias("task"), F.col("probability").alias("score"), (F.col("actual") == F.col("class")).alias("positive"))
    return auc(roc(marked, group="task"), "task").groupBy("task.fold").agg(F.avg("auc").alias("score"))


def score(predicted: DataFrame, metric: str = "accuracy") -> tuple[float, float]:
    """Mean and deviation of the folds' scores; ``roc_auc`` needs the rows of ``scored_predictions``."""
    by_fold = auc_scores(predicted) if metric == "roc_auc" else fold_scores(predicted, metric)
    row = by_fold.agg(F.avg("score"), F.stddev_pop("score")).first()
    return row[0], row[1]


def confusion(predicted: DataFrame) -> DataFrame:
    """``(actual, predicted, n, share)``: counts and their shares of the actual class, for all pairs of classes."""
    counts = cut(predicted.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")))
    names = F.array_distinct(F.flatten(F.collect_set(F.array("actual", "predicted"))))  # of the classes, one row
    grid = counts.agg(names.alias("c")).select(F.explode("c").alias("actual"), "c").select("actual", F.explode("c").alias("predicted"))
    filled = grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("actual"))), F.lit(0.0)))


def roc(scored: DataFrame, score: str = "score", positive: str = "positive", group: str | None = None) -> DataFrame:
    """``(threshold, tpr, fpr)`` of every distinct score, by falling score, in each ``group`` (such as the fold). Scores
    are sorted by ranges, so that no task holds all of them."""
    keys = [group] if group else []
    steps = scored.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("n"))
    placed = ranges.running(steps, keys, [F.desc("threshold")], ["p", "n"])
    totals = placed.groupBy(*[F.col(k).alias("group_") for k in keys]).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    joined = placed.join(F.broadcast(totals), F.col(group).eqNullSafe(F.col("group_")) if group else F.lit(True))
    rate = lambda c: F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(f"all_{c}"))
    return joined.select(*keys, "threshold", rate("p").alias("tpr"), rate("n").alias("fpr"))


def auc(curve: DataFrame, group: str | None = None) -> DataFrame:
    """Area under each ROC curve, by trapezoids from (0, 0); rates only rise along a curve, so that a point's
    predecessor has the largest rates before it."""
    keys = [group] if group else []
    placed = ranges.running(curve, keys, [F.desc("threshold")], [], ["tpr", "fpr"])
    before = lambda c: F.coalesce(F.col(f"{c}_before"), F.lit(0.0))
    area = (F.col("fpr") - before("fpr")) * (F.col("tpr") + before("tpr")) / 2
    return placed.select(*keys, area.alias("a")).groupBy(*keys).agg(F.sum("a").alias("auc"))


def mean_roc(curve: DataFrame, group: str, points: int = 100) -> DataFrame:
    """``(fpr, tpr, deviation)``: the folds' curves interpolated at evenly spaced rates, their mean and deviation."""
    step = F.ceil(F.col("fpr") * (points - 1) - 1e-9).cast("int")
    ends = curve.groupBy(group, step.alias("i")).agg(F.max(F.struct("fpr", "tpr")).alias("last"), F.min(F.struct("fpr", "tpr")).alias("first"))
    grid = curve.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    along = Window.partitionBy(group).orderBy("i")  # a row a rate
    placed = grid.join(ends, [group, "i"], "left").select(
        group, (F.col("i") / (points - 1)).alias("at"),
        F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("lo"), F.first("first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("hi"),
    )
    x, y = F.coalesce("lo.fpr", F.lit(0.0)), F.coalesce("lo.tpr", F.lit(0.0))
    between = F.coalesce(y + F.try_divide((F.col("hi.tpr") - y) * (F.col("at") - x), F.col("hi.fpr") - x), y)
    by_fold = placed.select(group, "at", F.when(F.col("at") == 0, 0.0).otherwise(between).alias("tpr"))
    return by_fold.groupBy(F.col("at").alias("fpr")).agg(F.avg("tpr").alias("tpr"), F.stddev_pop("tpr").alias("deviation"))


_deep = lambda n: lambda p: p["layers"] >= n
SPACES: dict[str, search.Space] = {
    "rf": {"numTrees": Number(20, 150, whole=True), "maxDepth": Number(3, 12, whole=True), "minInstancesPerNode": Number(1, 5, whole=True), "featureSubsetStrategy": Choice(("sqrt", "log2", "onethird"))},
    "xgb": {"maxIter": Number(5, 40, whole=True), "maxDepth": Number(2, 8, whole=True), "stepSize": Number(0.01, 0.5, log=True), "subsamplingRate": Number(0.5, 1.0), "minInfoGain": Number(0.0, 0.1)},
    "nn": {
        "layers": Number(1, 3, whole=True), "width_1": Number(8, 128, whole=True, log=True), "width_2": Number(8, 128, whole=True, log=True, when=_deep(2)), "width_3": Number(8, 128, whole=True, log=True, when=_deep(3)),
        "maxIter": Number(50, 300, whole=True), "solver": Choice(("l-bfgs", "gd")), "stepSize": Number(0.001, 0.1, log=True, when=lambda p: p["solver"] == "gd"),
    },
}


def model_params(settings: dict) -> dict:
    """What ``train`` takes for settings of a space: a perceptron's layers become its list of widths."""
    widths = [settings[f"width_{k}"] for k in range(1, settings.get("layers", 0) + 1)]
    rest = {n: v for n, v in settings.items() if n != "layers" and not n.startswith("width_")}
    return rest | ({"hidden": widths} if widths else {})


def optimise(
    df: DataFrame, columns: list[str], label: str = "label", kind: str = "rf", trials: int = 10, k: int = 3, key: str = "id", seed: int = SEED, metric: str = "accuracy", balance: bool = False,
    start: int = 10, space: search.Space | None = None,
) -> tuple[PipelineModel, dict, list[dict]]:
    """The best model of ``trials`` settings by their cross-validated ``metric`` (``accuracy``, ``precision``, ``recall``,
    ``f1``, ``roc_auc``), what ``train`` was given for it, and the trials: number, score, settings, seconds.

    All trials use the same folds, which share each class evenly. The default settings are the first trial; a trial that
    doesn't beat the best so far changes nothing. The next ``start`` settings are random, the others drawn by Parzen
    estimators of good and bad trials, see ``search.suggest`` (``start`` of ``trials`` or more: random search). No
    trials give the default model. ``balance`` weights the rows of two unequal classes by their sizes.
    """
    history, fixed = [], {}
    if balance:
        sizes = [r["count"] for r in df.groupBy(label).count().collect()]  # a row a class
        if len(sizes) == 2 and sizes[0] != sizes[1]:
            df, fixed = balanced(df, label), {"weights": "weight_"}
    found = scored_predictions if metric == "roc_auc" else cross_predict

    def trial(settings: dict) -> float:
        began = time.time()
        value, _ = score(found(df, columns, label, kind, k, key, **fixed, **model_params(settings)), metric)
        history.append({"trial": len(history) + 1, "score": value, "params": settings, "seconds": time.time() - began})
        return value

    done = search.searched(trial, space or SPACES[kind], trials, seed, first=[{}], start=start)
    best = model_params(max(done, key=lambda t: t[1])[0]) if done else {}
    return train(df, columns, label, kind, **fixed, **best), best, history


def _settings_forest(spark: SparkSession, history: list[dict], target: str) -> tuple[list[str], Forest, np.ndarray] | None:
    """The settings that all trials have, a forest of the trials' ``target`` over them, and their values."""
    rows = [t for t in history if t["params"]]
    names = sorted(set.intersection(*(set(t["params"]) for t in rows))) if rows else []
    if len(rows) < 2 or not names:
        return None
    words = {n: sorted({str(t["params"][n]) for t in rows}) for n in names}
    number = lambda n, v: float(sum(v)) if isinstance(v, list) else float(words[n].index(v)) if isinstance(v, str) else float(v)
    values = np.array([[number(n, t["params"][n]) for n in names] for t in rows])
    varied = [j for j in range(len(names)) if values[:, j].min() < values[:, j].max()]
    if not varied:
        return None
    names, values = [names[j] for j in varied], values[:, varied]
    table = spark.createDataFrame([(Vectors.dense(v), float(t[target])) for v, t in zip(values, rows)], ["features_", "target"])  # a row a trial
    fitted = RandomForestRegressor(featuresCol="features_", labelCol="target", numTrees=64, maxDepth=10, maxBins=max(32, len(rows)), featureSubsetStrategy="all", seed=SEED).fit(table)
    return names, trees.forests(spark, fitted)[0], values


def setting_importances(spark: SparkSession, history: list[dict], target: str = "score") -> DataFrame:
    """``(setting, importance)``: the share of the variance of the trials' scores (or ``seconds``) that each setting has
    alone, by the decomposition of a forest that predicts them from the settings that all trials have; lists count by
    their sum, names by their place in order. Shares are taken over the box of the values tried; settings that never
    varied have none."""
    return _shares(spark, history, target, lambda names, single, double: [(n, float(v)) for n, v in zip(names, single)])


def setting_interactions(spark: SparkSession, history: list[dict], target: str = "score") -> DataFrame:
    """``(setting, importance)`` for pairs of settings, ``a x b``: what both have together beyond what each has alone."""
    return _shares(spark, history, target, lambda names, single, double: [(f"{names[j]} x {names[i]}", float(double[i, j])) for i in range(len(names)) for j in range(i)])


def _shares(spark: SparkSession, history: list[dict], target: str, rows) -> DataFrame:
    names = sorted({p for t in history for p in t["params"]})
    found = _settings_forest(spark, history, target)
    if found is None:
        made = rows(names, [0.0] * len(names), np.zeros((len(names), len(names))))
    else:
        own, forest, values = found
        single, double = search.variance_shares(forest, values.min(0), values.max(0))
        every = np.zeros(len(names)), np.zeros((len(names), len(names)))
        at = [names.index(n) for n in own]
        every[0][at], every[1][np.ix_(at, at)] = single, double
        made = rows(names, *every)
    return spark.createDataFrame(made, "setting string, importance double").orderBy(F.desc("importance"))


def best_so_far(history: DataFrame) -> DataFrame:
    """``history(trial, score)`` with the best score up to each trial."""
    return history.withColumn("best", F.max("score").over(Window.orderBy("trial")))  # a row a trial


def binomial_tail(hits: int, trials: int) -> tuple[float, float]:
    """Probability of at least, and of at most, so many hits in fair trials."""
    up = sum(math.comb(trials, j) for j in range(hits, trials + 1)) / 2**trials
    return up, sum(math.comb(trials, j) for j in range(hits + 1)) / 2**trials


def permutation_importances(df: DataFrame, columns: list[str], model: PipelineModel, label: str = "label", key: str = "id", repeats: int = 5, metric: str = "f1", seed: int = SEED) -> DataFrame:
    """``(feature, importance, deviation)``: by how much a fitted model's score over ``df`` falls, in the mean of ``repeats``,
    when the values of one column are dealt anew among the rows. ``metric`` as in ``fold_scores``."""
    out = None
    for repeat in range(repeats):
        part = trees.permuted_counts(shuffled(df, columns, key, seed + repeat, "other_"), columns, model, label, "other_").withColumn("repeat", F.lit(repeat))
        out = part if out is None else out.unionByName(part)
    scores = count_scores(cut(out), ["feature", "repeat"], metric)
    base = F.max(F.when(F.col("feature").isNull(), F.col("score"))).over(Window.partitionBy("repeat"))  # columns + 1 rows a repeat
    drops = scores.withColumn("drop_", base - F.col("score")).where("feature IS NOT NULL")
    return drops.groupBy("feature").agg(F.avg("drop_").alias("importance"), F.stddev_pop("drop_").alias("deviation"))


def count_scores(counts: DataFrame, by: list[str], metric: str) -> DataFrame:
    """``fold_scores`` from ``(*by, actual, predicted, n)``, a score for each of ``by``."""
    right = F.col("actual") == F.col("predicted")
    if metric == "accuracy":
        return counts.groupBy(*by).agg((F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
    one = lambda c, hit, said, there: F.struct(F.col(c).alias("c"), hit.alias("hit"), said.alias("said"), there.alias("there"))
    n, none = F.col("n"), F.lit(0).cast("long")
    marks = F.when(right, F.array(one("actual", n, n, n))).otherwise(F.array(one("actual", none, none, n), one("predicted", none, n, none)))
    sums = counts.select(*by, F.explode(marks).alias("m")).groupBy(*by, "m.c").agg(F.sum("m.hit").alias("hit"), F.sum("m.said").alias("said"), F.sum("m.there").alias("there"))
    under = {"precision": F.col("said"), "recall": F.col("there"), "f1": (F.col("said") + F.col("there")) / 2}[metric]
    rates = sums.withColumn("rate", F.coalesce(F.try_divide(F.col("hit").cast("double"), under), F.lit(0.0)))
    names = counts.agg(F.max("actual"), F.count_distinct("actual")).first()
    return (rates.where(F.col("c") == names[0]) if names[1] == 2 else rates).groupBy(*by).agg(F.avg("rate").alias("score"))


def select_features(
    df: DataFrame, columns: list[str], label: str = "label", trials: int = 20, key: str = "id", level: float = 0.05, trees: int = 50, seed: int = SEED, train_share: float = 1.0,
    importance: str = "gini", sample: bool = False,
) -> tuple[dict[str, str], list[tuple]]:
    """Decisions ``accepted``, ``rejected`` or ``tentative`` for each feature, and the history
    ``(trial, feature, importance, shadow)``.

    In each trial, shadows (columns shuffled among the rows) compete with the features left in a forest, which is fitted
    on ``train_share`` of the rows (0.7 holds out 30 %, drawn anew by hash in each trial); a feature hits if its
    standardised importance exceeds that of every shadow. A feature whose hits are too many or too few for chance, by the
    binomial test with Bonferroni's correction, is decided; rejected features leave the trials.

    ``importance``: ``gini``, the trees' gain of purity; ``shap``, the mean absolute Shapley value over the trial's rows;
    ``perm``, the fall of f1 when a column is permuted. ``sample`` takes Shapley values of a representative sample only,
    whose isolation scores are distributed as those of all rows.
    """
    hits, state, history, within = dict.fromkeys(columns, 0), dict.fromkeys(columns, "tentative"), [], None
    if sample and importance == "shap":
        scored = cut(isolation_forest(df, columns, key=key, seed=seed).transform(df, "typical_").select(key, "typical_"))
        within = cut(representative(scored, "typical_", key, seed=seed)[0].select(key))
    rows = cut(numbered(df, key))
    for trial in range(1, trials + 1):
        left = [c for c in columns if state[c] != "rejected"]
        if not left:
            break
        mixed = shuffled(rows, left, key, seed + trial)
        if train_share < 1:
            mixed = mixed.where(F.pmod(F.xxhash64(F.lit(seed + trial), key), F.lit(10_000)) < train_share * 10_000)
        shadows = [f"shadow_{c}" for c in left]
        if importance != "gini":
            mixed = cut(mixed)
        fitted = train(mixed, [*left, *shadows], label, "rf", numTrees=trees)
        if importance == "gini":
            weights = fitted.stages[2].featureImportances.toArray()
        else:
            found = shapley_importances(mixed if within is None else mixed.join(within, key, "left_semi"), [*left, *shadows], fitted) if importance == "shap" else permutation_importances(mixed, [*left, *shadows], fitted, label, key, seed=seed + trial)
            named = {r.feature: r.importance for r in found.collect()}  # a row a column
            weights = np.array([named.get(c, 0.0) for c in [*left, *shadows]])
        z = (weights - weights.mean()) / (weights.std() or 1.0)
        ceiling = z[len(left) :].max()
        for c, own in zip(left, z):
            history.append((trial, c, float(own), False))
            hits[c] += bool(own > ceiling)
        history += [(trial, s, float(v), True) for s, v in zip(shadows, z[len(left) :])]
        for c in left:
            up, down = binomial_tail(hits[c], trial)
            if state[c] == "tentative":
                state[c] = "accepted" if up * len(columns) < level else "rejected" if down * len(columns) < level else "tentative"
    return state, history


def settle_tentative(state: dict[str, str], history: list[tuple]) -> dict[str, str]:
    """The decisions with those that are left open made: accepted if a feature's median importance is above the median
    of the trials' best shadows, else rejected."""
    best: dict[int, float] = {}
    own: dict[str, list[float]] = {}
    for trial, name, value, shadow in history:
        if shadow:
            best[trial] = max(best.get(trial, -math.inf), value)
        else:
            own.setdefault(name, []).append(value)
    bar = statistics.median(best.values()) if best else math.inf
    return {c: d if d != "tentative" else "accepted" if c in own and statistics.median(own[c]) > bar else "rejected" for c, d in state.items()}


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``r_``, the places of its rows by ``key``, in a range-partitioned order."""
    return ranges.running(df.withColumn("one_", F.lit(1)), [], [F.col(key)], ["one_"]).drop("one_").withColumnRenamed("one__before", "r_")


def shuffled(df: DataFrame, columns: list[str], key: str, seed: int, prefix: str = "shadow_") -> DataFrame:
    """``df`` with ``shadow_<column>`` (or another prefix): each column's values dealt anew among all rows.

    Rows are numbered by their key (here, unless they have ``r_``), the values of each column in the order of their own
    hash; they meet by number. Cells travel packed: a task sorts a range of hashes of one column, whose values then
    belong to consecutive rows, and another puts the columns of some thousands of rows together.
    """
    rows = df if "r_" in df.columns else numbered(df, key)
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / CELLS)))
    hashes = [F.xxhash64(F.lit(seed), F.lit(k), key).alias(f"h{k}") for k in range(len(columns))]
    given = rows.select(F.col("r_").cast("long"), *hashes, *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    packed = given.mapInArrow(partial(_parted, width=len(columns), bits=bits), "c int, part int, cells binary")
    ordered = cut(packed.groupBy("c", "part").applyInArrow(lambda key, cells: _ordered(key, cells), "c int, part int, n long, cells binary"))
    starts, at = {}, 0
    for r in ordered.select("c", "part", "n").orderBy("c", "part").collect():  # a row a range
        at = at if r.part and r.c in {c for c, _ in starts} else 0
        starts[r.c, r.part] = at
        at += r.n
    names = [f"{prefix}{c}" for c in columns]
    pieces = ordered.mapInArrow(partial(_pieces, starts=starts), "span long, c int, at long, cells binary")
    wide = pieces.groupBy("span").applyInArrow(lambda cells: _wide(cells, names), T.StructType([T.StructField("r_", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]]))
    cells = n * len(columns)
    parts = max(1, math.ceil(cells / GATHERED), min(2 * df.sparkSession.sparkContext.defaultParallelism, cells // FEW))
    return rows.join(wide.hint("merge"), "r_").drop("r_").coalesce(parts)  # each part costs a forest the statistics of all its nodes


CELLS = 131_072  # of a column that a task sorts, about
GATHERED = 8_000_000  # dealt values of a part of the result, at most
FEW = 100_000  # and at least, unless all are fewer
SPAN = 8_192  # rows whose dealt values a task puts together
CELL = np.dtype([("h", np.uint64), ("r", np.int64), ("v", np.float64), ("null", np.bool_)])
DEALT = np.dtype([("v", np.float64), ("null", np.bool_)])


def _parted(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each column's cells by the first bits of their hashes."""
    for batch in batches:
        out = []
        for c in range(width):
            cells, values = np.empty(batch.num_rows, CELL), batch.column(1 + width + c)
            cells["h"] = batch.column(1 + c).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)  # in the order of signed numbers
            cells["r"], cells["v"], cells["null"] = batch.column(0).to_numpy(), values.to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
            part = cells["h"] >> np.uint64(64 - bits) if bits else np.zeros(len(cells), np.uint64)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            out += [(c, int(k), held.tobytes()) for k, held in zip(found, np.split(cells[order], first[1:]))]
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["c", "part", "cells"])


def _ordered(key: tuple, packed: pa.Table) -> pa.Table:
    """The values of a range of hashes in their order."""
    cells = np.frombuffer(b"".join(packed["cells"].to_pylist()), CELL)
    cells = cells[np.lexsort((cells["r"], cells["h"]))]
    held = np.empty(len(cells), DEALT)
    held["v"], held["null"] = cells["v"], cells["null"]
    return pa.table({"c": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(cells)], pa.int64()), "cells": pa.array([held.tobytes()], pa.binary())})


def _pieces(batches: Iterator[pa.RecordBatch], starts: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    """Ordered values, parted by the spans of rows they are dealt to."""
    for batch in batches:
        for row in batch.to_pylist():
            held, lo = np.frombuffer(row["cells"], DEALT), starts[row["c"], row["part"]]
            ends = [lo, *range((lo // SPAN + 1) * SPAN, lo + len(held), SPAN), lo + len(held)]
            out = [(a // SPAN, row["c"], a, held[a - lo : b - lo].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["span", "c", "at", "cells"])


def _wide(packed: pa.Table, names: list[str]) -> pa.Table:
    """A span's rows with a value of each column."""
    pieces = [(r["c"], r["at"], np.frombuffer(r["cells"], DEALT)) for r in packed.to_pylist()]
    lo = min(at for _, at, _ in pieces)
    held = np.empty((len(names), max(at + len(p) for _, at, p in pieces) - lo), DEALT)
    for c, at, piece in pieces:
        held[c, at - lo : at - lo + len(piece)] = piece
    return pa.table({"r_": pa.array(np.arange(lo, lo + held.shape[1])), **{n: pa.array(v["v"], mask=v["null"]) for n, v in zip(names, held)}})


def selection_table(spark, state: dict[str, str], history: list[tuple]) -> DataFrame:
    """``(feature, mean, deviation, decision)`` by falling mean importance."""
    rows = spark.createDataFrame(history, "trial int, feature string, importance double, shadow boolean")
    decided = spark.createDataFrame(list(state.items()), "feature string, decision string")
    found = rows.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("deviation"))
    return found.join(decided, "feature", "left").withColumn("decision", F.coalesce("decision", F.lit("shadow"))).orderBy(F.desc("mean"))


def selection_summary(spark: SparkSession, state: dict[str, str], history: list[tuple], top: int | None = None, other: bool = True, shadow: bool = True, rejected: bool | int = False) -> DataFrame:
    """``(place, feature, mean, deviation, kind)``: what a chart of a selection shows, in its order.

    The ``top`` accepted features by mean importance (all, if None or more than there are); ``other``: the accepted ones
    beyond them as one row ``Other Accepted``, the means of their means and deviations; ``shadow``: ``Mean Shadow``, the mean
    and deviation over the trials of the shadows' mean; ``rejected``: the rejected features, all or so many of the best.
    """
    by_mean = selection_table(spark, state, history).where("decision <> 'shadow'").withColumn("r", F.row_number().over(Window.partitionBy("decision").orderBy(F.desc("mean"), "feature")))
    row = lambda df, order, kind: df.select(F.lit(order).alias("o"), F.col("r").cast("long").alias("r"), "feature", "mean", "deviation", F.lit(kind).alias("kind"))
    best = F.lit(True) if top is None else F.col("r") <= top
    accepted = by_mean.where("decision = 'accepted'")
    out = row(accepted.where(best), 0, "accepted")
    if other and top is not None:
        rest = accepted.where(~best).agg(F.avg("mean").alias("mean"), F.avg("deviation").alias("deviation")).where("mean IS NOT NULL")
        out = out.unionByName(row(rest.withColumn("feature", F.lit("Other Accepted")).withColumn("r", F.lit(1)), 1, "other"))
    if shadow:
        trials = spark.createDataFrame([h for h in history if h[3]], "trial int, feature string, importance double, shadow boolean").groupBy("trial").agg(F.avg("importance").alias("m"))
        found = trials.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("deviation")).where("mean IS NOT NULL")
        out = out.unionByName(row(found.withColumn("feature", F.lit("Mean Shadow")).withColumn("r", F.lit(1)), 2, "shadow"))
    if rejected is not False:
        lost = by_mean.where("decision = 'rejected'")
        out = out.unionByName(row(lost if rejected is True else lost.where(F.col("r") <= rejected), 3, "rejected"))
    placed = F.row_number().over(Window.orderBy("o", "r")).alias("place")  # of the chart's rows
    return out.select(placed, "feature", "mean", "deviation", "kind")


def kolmogorov_smirnov(df: DataFrame, value: str, sample: str) -> DataFrame:
    """``(statistic, p)`` of the two-sample test between the rows for which ``sample`` holds and all others."""
    steps = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v_")).agg(F.sum(F.when(F.col(sample), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(sample), 0).otherwise(1)).alias("b"))
    placed = ranges.running(steps, [], [F.col("v_")], ["a", "b"])
    n, m = placed.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    share = lambda c, of: F.try_divide(F.col(f"{c}_before") + F.col(c), F.lit(of))
    found = placed.agg(F.max(F.abs(share("a", n) - share("b", m))).alias("statistic"))
    size = F.lit(math.sqrt(n * m / (n + m)) if n and m else None).cast("double")
    x = (size + 0.12 + 0.11 / size) * F.col("statistic")
    terms = [2 * (-1) ** (j - 1) * F.exp(-2 * j * j * x * x) for j in range(1, 40)]
    return found.select("statistic", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(terms[1:], terms[0])))).alias("p"))
