"""Fitted forests as arrays: predictions of changed rows, Shapley values, permutation importance; isolation forests.

A forest of Spark's is read from its saved nodes once. Its arrays (trees x nodes) are sent to the tasks, which work on
batches of rows and return sums, so that importances of any number of rows cost one pass and a few rows a task.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.operators import ranges
from starflow.session import checkpoint_dir

BATCH = 256  # rows whose Shapley values are held at once
LEAVES = 64  # leaves whose paths are taken at once


@dataclass
class Tree:
    """Nodes of a binary tree: rows with ``x[feature] <= threshold`` go left; leaves have feature -1. ``value`` is a row
    of outputs a node, ``cover`` the weight of the rows it was fitted on."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            goes = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A row a leaf, a column a feature of its path: features, the ends of the interval that leads there, and the
        share of the rows that the feature's splits let pass; and the leaves' values. Rows are padded by shares of 1."""
        found, stack = [], [(0, {})]
        while stack:
            node, held = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                found.append((held, self.value[node]))
                continue
            lo, hi, z = held.get(f, (-math.inf, math.inf, 1.0))
            t = float(self.threshold[node])
            for child, ends in ((self.left[node], (lo, min(hi, t))), (self.right[node], (max(lo, t), hi))):
                share = float(self.cover[child] / self.cover[node])
                if share > 0:
                    stack.append((int(child), held | {f: (*ends, z * share)}))
        depth = max(1, *(len(h) for h, _ in found)) if found else 1
        features, lows, highs, shares = np.zeros((len(found), depth), np.int64), np.full((len(found), depth), -math.inf), np.full((len(found), depth), math.inf), np.ones((len(found), depth))
        for i, (held, _) in enumerate(found):
            for j, (f, (lo, hi, z)) in enumerate(held.items()):
                features[i, j], lows[i, j], highs[i, j], shares[i, j] = f, lo, hi, z
        return features, lows, highs, shares, np.array([v for _, v in found])


@dataclass
class Forest:
    """Trees and their weights; the forest's outputs are the weighted sum of the trees'. ``by_sign``: one output, a
    margin, decides between two classes; else the largest output does."""

    trees: list[Tree]
    weights: list[float]
    by_sign: bool = False

    @property
    def outputs(self) -> int:
        return self.trees[0].value.shape[1]

    def values(self, x: np.ndarray) -> np.ndarray:
        return sum(w * t.values(x) for t, w in zip(self.trees, self.weights))

    def classes(self, values: np.ndarray) -> np.ndarray:
        return (values[:, 0] > 0).astype(np.int64) if self.by_sign else values.argmax(1)

    @property
    def base(self) -> np.ndarray:
        """The outputs' means over the rows of the fit: what Shapley values are added to."""
        return sum(w * (t.value * np.where(t.feature < 0, t.cover, 0)[:, None]).sum(0) / t.cover[0] for t, w in zip(self.trees, self.weights))

    def explainer(self, columns: int) -> Callable[[np.ndarray], np.ndarray]:
        """Shapley values ``(row, column, output)`` of batches, path-dependent: what a row's columns add to the base.

        A leaf counts by the product, over the columns of its path, of whether the row passes (known columns) or the share
        of fitted rows that do (unknown ones). The mean over all orders of learning the columns is the integral over t
        of the product of ``t * passes + (1 - t) * share``, a polynomial that Gauss's rule integrates exactly."""
        held = []
        for tree, weight in zip(self.trees, self.weights):
            features, lows, highs, shares, values = tree.paths()
            nodes, rule = np.polynomial.legendre.leggauss(-(-features.shape[1] // 2))
            for part in (slice(lo, lo + LEAVES) for lo in range(0, len(values), LEAVES)):
                f, v = features[part], values[part] * weight
                spread = np.zeros((f.size, columns * v.shape[1]))
                row = np.arange(f.size)
                for o in range(v.shape[1]):
                    spread[row, f.ravel() * v.shape[1] + o] = np.repeat(v[:, o], f.shape[1])
                held.append((f, lows[part], highs[part], shares[part], (nodes + 1) / 2, rule / 2, spread))
        outputs = self.outputs

        def explain(x: np.ndarray) -> np.ndarray:
            total = np.zeros((len(x), columns * outputs))
            for f, lo, hi, z, nodes, rule, spread in held:
                own = x[:, f]
                passes = ((own <= hi) | np.isinf(hi)) & (~(own <= lo) | np.isinf(lo))
                weight = np.zeros(passes.shape)
                for t, w in zip(nodes, rule):
                    each = t * passes + (1 - t) * z
                    weight += w * each.prod(2, keepdims=True) / each
                total += ((passes - z) * weight).reshape(len(x), -1) @ spread
            return total.reshape(len(x), columns, outputs)

        return explain


def _nodes(spark, model) -> tuple[dict[int, list], dict[int, float]]:
    """Saved nodes and weights of a model's trees, by tree."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    model.write().save(path)
    data, trees, weights = spark.read.parquet(f"{path}/data"), {}, {0: 1.0}
    if "treeID" in data.columns:
        weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}  # a row a tree
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    for r in data.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split").collect():  # a row a node
        trees.setdefault(r.treeID, []).append(r)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return trees, weights


def forests(spark, model) -> list[Forest]:
    """Spark's forest, boosted trees or tree as arrays: one forest, or one a class where one is fitted against the rest.

    Forests of classifiers put out the mean of their trees' class shares, boosted classifiers a margin that is positive
    for the second class."""
    if isinstance(model, PipelineModel):
        model = next(s for s in model.stages if hasattr(s, "featureImportances") or isinstance(s, OneVsRestModel))
    if isinstance(model, OneVsRestModel):
        return [f for m in model.models for f in forests(spark, m)]
    trees, weights = _nodes(spark, model)
    boosted, shares = "GBT" in type(model).__name__, "Classification" in type(model).__name__ and "GBT" not in type(model).__name__
    out, classes = [], max((i + 1 for own in trees.values() for r in own for i, n in enumerate(r.impurityStats) if n), default=1)  # without an empty class for unknown labels
    for name in sorted(trees):
        nodes = sorted(trees[name], key=lambda r: r.id)
        place = {r.id: i for i, r in enumerate(nodes)} | {-1: 0}
        if any(r.split.numCategories >= 0 for r in nodes):
            raise ValueError("splits of categories have no threshold")
        stats = [np.array(r.impurityStats) for r in nodes]
        out.append(Tree(
            np.array([r.split.featureIndex for r in nodes]), np.array([(list(r.split.leftCategoriesOrThreshold) or [0.0])[0] for r in nodes]),
            np.array([place[r.leftChild] for r in nodes]), np.array([place[r.rightChild] for r in nodes]),
            np.array([s[:classes] / max(s.sum(), 1e-300) for s in stats]) if shares else np.array([[r.prediction] for r in nodes]),
            np.array([s.sum() if shares else s[0] for s in stats]),
        ))
    return [Forest(out, [weights[n] if boosted else 1 / len(trees) for n in sorted(trees)], boosted)]


def _rows(df: DataFrame, columns: Sequence[str]):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column of doubles, nulls as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def shapley(df: DataFrame, columns: Sequence[str], model, key: str = "id") -> DataFrame:
    """``(key, feature, output, value)``: what each column adds to each output of each row; outputs are numbered (classes
    in order of their labels; models of one class against the rest one after the other). Values of a row sum to the
    forest's output less its base."""
    spark, width, names = df.sparkSession, len(columns), list(columns)
    sent = spark.sparkContext.broadcast(forests(spark, model))
    schema = T.StructType([df.schema[key], T.StructField("feature", T.StringType()), T.StructField("output", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explain = [f.explainer(width) for f in sent.value]
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                values = np.concatenate([e(_matrix(part.column(1), width)) for e in explain], 2)
                n, _, k = values.shape
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(n), width * k))), pa.array(names * n).take(pa.array(np.repeat(np.arange(n * width), k))),
                    pa.array(np.tile(np.arange(k, dtype=np.int32), n * width)), pa.array(values.ravel()),
                ], names=schema.names)

    return df.select(F.col(f"`{key}`"), _rows(df, columns).alias("x_")).mapInArrow(run, schema)


def shapley_importances(df: DataFrame, columns: Sequence[str], model) -> DataFrame:
    """``(feature, importance)``: the mean over rows of the absolute Shapley values, summed over outputs. A task returns
    sums, a row a column. No rows give zeros' absence: no rows."""
    spark, width, names = df.sparkSession, len(columns), list(columns)
    sent = spark.sparkContext.broadcast(forests(spark, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explain, total, n = [f.explainer(width) for f in sent.value], np.zeros(width), 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for lo in range(0, len(x), BATCH):
                total += sum(np.abs(e(x[lo : lo + BATCH])).sum((0, 2)) for e in explain)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(np.full(width, n))], names=["feature", "total", "n"])

    sums = df.select(_rows(df, columns).alias("x_")).mapInArrow(run, "feature string, total double, n long")
    return sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))


def permuted_counts(mixed: DataFrame, columns: Sequence[str], model: PipelineModel, label: str, shadow: str = "shadow_") -> DataFrame:
    """``(feature, actual, predicted, n)`` of a fitted pipeline over rows whose ``feature`` has the value of its shadow
    column; feature null: the rows as they are. One pass; only trees that split by a column are walked again for it."""
    spark, width, names, known = mixed.sparkSession, len(columns), list(columns), list(model.stages[-1].getLabels())
    found = forests(spark, model)
    if len(found) > 1:
        raise ValueError("permutation importance needs one forest")
    uses = [[i for i, t in enumerate(found[0].trees) if (t.feature == c).any()] for c in range(width)]
    sent = spark.sparkContext.broadcast((found[0], uses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (forest, uses), counts = sent.value, {}

        def count(feature: int, actual: np.ndarray, predicted: np.ndarray) -> None:
            for (a, p), n in pd.DataFrame({"a": actual, "p": predicted}).value_counts().items():
                counts[feature, a, int(p)] = counts.get((feature, a, int(p)), 0) + int(n)

        for batch in batches:
            actual, x, y = np.array(batch.column(0).to_pylist(), object), _matrix(batch.column(1), width), _matrix(batch.column(2), width)
            own = [w * t.values(x) for t, w in zip(forest.trees, forest.weights)]
            total = sum(own)
            count(-1, actual, forest.classes(total))
            for c in range(width):
                swapped = x.copy()
                swapped[:, c] = y[:, c]
                count(c, actual, forest.classes(total + sum(forest.weights[i] * forest.trees[i].values(swapped) - own[i] for i in uses[c])))
        rows = [(None if f < 0 else names[f], a, known[p], n) for (f, a, p), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["feature", "actual", "predicted", "n"])

    rows = mixed.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("actual"), _rows(mixed, columns).alias("x_"), _rows(mixed, [shadow + c for c in columns]).alias("y_"))
    return rows.mapInArrow(run, "feature string, actual string, predicted string, n long").groupBy("feature", "actual", "predicted").agg(F.sum("n").alias("n"))


# --- isolation -----------------------------------------------------------------------------------------------------

NODE = "tree int, node int, feature int, threshold double, low int, high int, depth double"


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def chance(*parts) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    return zlib.crc32(":".join(map(str, parts)).encode()) / 2**32


def isolation_tree(x: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes ``(tree, node, feature, threshold, low, high, depth)`` of random splits of a sample, down to single or equal
    rows or the depth of the binary logarithm of its size. Nodes are numbered as in a heap from 1; column and threshold
    depend on seed, tree and node only. Leaves have feature -1 and the depth that is expected below them added."""
    limit, out, stack = math.ceil(math.log2(max(2, len(x)))), [], [(1, 0, np.arange(len(x)))]
    while stack:
        node, depth, rows = stack.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(low < high) if len(rows) > 1 and depth < limit else ()
        if not len(open_):
            out.append((tree, node, -1, 0.0, 0, 0, depth + expected_depth(len(rows))))
            continue
        f = int(open_[int(chance(seed, tree, node, "column") * len(open_))])
        t = float(low[f] + chance(seed, tree, node, "place") * (high[f] - low[f]))
        t = t if t < high[f] else float(low[f])
        goes = x[rows, f] <= t
        out.append((tree, node, f, t, 2 * node, 2 * node + 1, 0.0))
        stack += [(2 * node, depth + 1, rows[goes]), (2 * node + 1, depth + 1, rows[~goes])]
    return out


@dataclass
class Isolation:
    """A fitted isolation forest of tables with these columns."""

    columns: list[str]
    forest: Forest
    size: int

    def transform(self, df: DataFrame, column: str = "score") -> DataFrame:
        """``df`` with each row's score, below 0: minus two to the power of minus its mean depth over the expected one.
        The higher, the more typical. Nulls and NaN go to the right of every split."""
        width, unit, sent = len(self.columns), expected_depth(self.size), df.sparkSession.sparkContext.broadcast(self.forest)

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), float).reshape(-1, width)
            depth = sent.value.values(x)[:, 0]
            return pd.Series(-(2.0 ** -(depth / unit if unit else np.ones(len(x)))))

        return df.withColumn(column, score(_rows(df, self.columns)))


def isolation_forest(df: DataFrame, columns: Sequence[str], trees: int = 100, sample: int = 256, key: str = "id", seed: int = 1909) -> Isolation:
    """A forest of random trees, each grown by a task of its own on ``sample`` rows (all, if fewer), drawn by hashes of
    the key without repetition. All rows are read once to draw; at most about ``4 * trees * sample`` are candidates."""
    n = df.count()
    hashed = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts, F.col(f"`{key}`")), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, 4 * trees * sample / max(1, n))
    candidates = df.where(hashed(F.lit(-1)) < share).select(_rows(df, columns).alias("x_"), F.col(f"`{key}`").alias("key_"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "tree", "key_"), F.lit(1 << 30)) / float(1 << 30)
    chosen = candidates.withColumn("draw_", draw).where(F.col("draw_") < min(1.0, 2 * sample / max(1.0, n * share) + 0.02))
    width = len(columns)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw_", "key_"]).head(sample)
        x = np.array(rows["x_"].tolist(), float).reshape(-1, width)
        return pd.DataFrame(isolation_tree(x, seed, int(rows["tree"].iloc[0])), columns=[c.split()[0] for c in NODE.split(", ")])

    nodes = chosen.groupBy("tree").applyInPandas(grow, NODE).collect()  # at most two nodes a row of the samples
    grown, by = [], {}
    for r in nodes:
        by.setdefault(r.tree, []).append(r)
    for tree in sorted(by):
        own = sorted(by[tree], key=lambda r: r.node)
        place = {r.node: i for i, r in enumerate(own)} | {0: 0}
        field = lambda name: np.array([getattr(r, name) for r in own])
        grown.append(Tree(field("feature"), field("threshold"), np.array([place[r.low] for r in own]), np.array([place[r.high] for r in own]), field("depth")[:, None], np.ones(len(own))))
    grown = grown or [Tree(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros((1, 1)), np.ones(1))]
    return Isolation(list(columns), Forest(grown, [1 / len(grown)] * len(grown)), min(n, sample))


def kolmogorov_p(statistic: float, n: int, m: int) -> float:
    """Chance of a larger distance between two samples of one distribution."""
    size = math.sqrt(n * m / (n + m)) if n and m else 0.0
    x = (size + 0.12 + 0.11 / size) * statistic if size else 0.0
    return 1.0 if x < 0.2 else min(1.0, max(0.0, sum(2 * (-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 40))))


def representative(scored: DataFrame, score: str = "score", key: str = "id", tries: int = 20, level: float = 0.95, seed: int = 1909) -> tuple[DataFrame, dict]:
    """A random sample of rows whose scores are distributed as all rows' are, and how it was found.

    Samples of a tenth of the rows are drawn, then larger ones in steps of a twentieth, ``tries`` of each size; the first
    whose Kolmogorov-Smirnov test against all rows has p above ``level`` is taken (all rows, if none has). One sort by
    ranges tests all samples of a size. The second value has ``share``, ``number``, ``statistic`` and ``p``.
    """
    drawn = lambda share, number: F.pmod(F.xxhash64(F.lit(seed), F.lit(share), F.lit(number), F.col(f"`{key}`")), F.lit(1 << 30)) < int(share * (1 << 30))
    for share in range(10, 100, 5):
        flags = [f"s{j}_" for j in range(tries)]
        held = scored.where(F.col(score).isNotNull())
        steps = held.groupBy(F.col(score).alias("v_")).agg(F.count(F.lit(1)).alias("n_"), *[F.sum(drawn(share / 100, j).cast("long")).alias(f) for j, f in enumerate(flags)])
        placed = ranges.running(steps, [], [F.col("v_")], ["n_", *flags])
        sizes = placed.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_", *flags)]).first()
        part = lambda c, of: (F.col(f"{c}_before") + F.col(c)) / F.lit(float(max(1, of)))
        apart = placed.agg(*[F.max(F.abs(part("n_", sizes[0]) - part(f, m))) for f, m in zip(flags, sizes[1:])]).first()
        for j, (statistic, m) in enumerate(zip(apart, sizes[1:])):
            if m and (p := kolmogorov_p(statistic, sizes[0], m)) > level:
                return scored.where(drawn(share / 100, j)), {"share": share / 100, "number": j, "statistic": statistic, "p": p}
    return scored, {"share": 1.0, "number": 0, "statistic": 0.0, "p": 1.0}
