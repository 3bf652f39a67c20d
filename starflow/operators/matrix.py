"""Preparation of feature tables: clamping, imputation, scaling, folds. A table has an id column and value columns.

Imputers and scalers are fitted on one table and applied to others; they are small records of numbers (and, for the
nearest rows, a reference table) that ``save`` writes and ``load`` reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs, parquet
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starflow.operators import ranges
from starflow.operators.extract import clamp_sql
from starflow.session import checkpoint_dir, cut
from starflow.sources.fits import open_path


def _each(df: DataFrame, columns: list[str], change) -> DataFrame:
    return df.select(*[change(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def finite_or_null(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clamped(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-finite values become null, others lie within the bounds of the feature table."""
    return _each(df, columns, lambda c: F.expr(clamp_sql(f"cast(`{c}` AS DOUBLE)")))


@dataclass
class Imputer:
    """What fills the nulls of a table, learnt from a (training) table: a number a column, or the nearest rows of it.
    The ``empty`` columns had too many nulls and are 0 throughout."""

    columns: list[str]
    fills: dict[str, float | None]
    strategy: str = "mean"
    k: int = 3
    key: str = "id"
    reference: DataFrame | None = None
    empty: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` without nulls in the fitted columns; NaN and infinities count as nulls."""
        df = _each(df, self.columns, finite_or_null)
        near = [c for c in self.columns if c not in self.empty] if self.strategy == "knn" else []
        if near:
            df = _nearest(df, self.reference, near, self.k, self.key)
        value = lambda c: F.lit(0.0) if c in self.empty else F.col(c) if c in near else F.coalesce(F.col(c), F.lit(self.fills[c]))
        return _each(df, self.columns, value)


def fit_imputer(df: DataFrame, columns: list[str], strategy: str = "mean", k: int = 3, constant: float = 0.0, null_share: float = 0.5, key: str = "id") -> Imputer:
    """Learn what fills nulls (NaN and infinities count as such).

    Columns with more than ``null_share`` nulls become 0. Others are filled with their mean, their median, their most
    frequent value (the smallest of equals), a constant, or (``knn``) the mean of the ``k`` nearest rows of ``df`` that
    have the value, by the distance over the columns that both rows have, scaled up to all columns; a column's mean
    where there is no such row.
    """
    df = _each(df, columns, finite_or_null)
    shares = df.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in columns]).first().asDict()
    empty = tuple(c for c in columns if (shares[c] or 0) > null_share)
    if strategy == "knn":
        return Imputer(columns, {c: 0.0 if c in empty else None for c in columns}, strategy, k, key, df.select(key, *columns), empty)
    found = {
        "mean": lambda: df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict(),
        "median": lambda: {c: v[0] for c, v in ranges.quantiles(df, columns, [0.5]).items()},
        "mode": lambda: ranges.modes(df, columns),
        "constant": lambda: dict.fromkeys(columns, float(constant)),
    }[strategy]()
    return Imputer(columns, {c: 0.0 if c in empty else found[c] for c in columns}, strategy, k, key, None, empty)


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", k: int = 3, constant: float = 0.0, null_share: float = 0.5, key: str = "id") -> DataFrame:
    """``df`` filled by what ``fit_imputer`` learns from it."""
    return fit_imputer(df, columns, strategy, k, constant, null_share, key).transform(df)


class _Best:
    """The ``k`` nearest donors so far of every cell that some rows lack: distances, donors and values."""

    def __init__(self, x: np.ndarray, own: np.ndarray, k: int, kind: np.dtype) -> None:
        self.x, self.own, self.k, self.has = x, own, k, ~np.isnan(x)
        self.row, self.column = np.nonzero(~self.has)
        self.first = np.concatenate([[0], np.cumsum((~self.has).sum(1))])
        self.d, self.j, self.v = np.full((len(self.row), k), np.inf), np.empty((len(self.row), k), kind), np.zeros((len(self.row), k))
        self.found = np.zeros(len(self.row), int)
        self.cell = np.zeros(x.shape, int)
        self.cell[self.row, self.column] = np.arange(len(self.row))

    def reach(self) -> np.ndarray:
        """How far donors may be that still matter to a row: the farthest of its full cells."""
        out = np.full(len(self.x), -1.0)
        full = self.found == self.k
        np.maximum.at(out, self.row[full], self.d[full, -1])
        return out

    def open(self) -> np.ndarray:
        """Cells that lack donors, as a matrix."""
        out = np.zeros(self.x.shape, np.float32)
        short = self.found < self.k
        out[self.row[short], self.column[short]] = 1
        return out

    def take(self, i: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of rows ``i`` with the donors ``y``."""
        total, shared, n = np.zeros(len(i)), np.zeros(len(i)), self.x.shape[1]
        with np.errstate(all="ignore"):
            for c in range(n):  # the distance itself, column by column
                apart = self.x[i, c] - y[:, c]
                both = ~np.isnan(apart)
                total += np.where(both, apart * apart, 0)
                shared += self.has[i, c] & ~np.isnan(y[:, c])
            d = total * n / shared
        given = ~self.has[i] & ~np.isnan(y) & (np.isfinite(d) & (shared > 0))[:, None]
        pair, c = np.nonzero(given)
        cell = self.cell[i[pair], c]
        near = d[pair] <= self.d[cell, -1]
        pair, c, cell = pair[near], c[near], cell[near]
        if not len(pair):
            return
        touched = np.unique(cell)
        old = np.arange(self.k)[None] < self.found[touched, None]
        at = np.concatenate([np.broadcast_to(touched[:, None], old.shape)[old], cell])
        far, who, what = (np.concatenate(v) for v in ((self.d[touched][old], d[pair]), (self.j[touched][old], ids[pair]), (self.v[touched][old], y[pair, c])))
        order = np.lexsort((who, far, at))
        at, far, who, what = at[order], far[order], who[order], what[order]
        rank = np.arange(len(at)) - np.searchsorted(at, touched)[np.searchsorted(touched, at)]
        few = rank < self.k
        at, rank = at[few], rank[few]
        self.d[at, rank], self.j[at, rank], self.v[at, rank] = far[few], who[few], what[few]
        self.found[touched] = np.minimum(self.k, np.bincount(np.searchsorted(touched, at), minlength=len(touched)))

    def means(self) -> pd.DataFrame:
        some = self.found > 0
        total = np.where(np.arange(self.k)[None] < self.found[:, None], self.v, 0).sum(1)
        return pd.DataFrame({"i": self.own[self.row[some]], "c": self.column[some], "v": total[some] / self.found[some]})


def _search(best: _Best, y: np.ndarray, ids: np.ndarray, middle: np.ndarray, seen: int, step: int = 4096) -> None:
    """Give ``best`` the donors among the rows ``y`` that may be near enough, by one product of matrices in single precision:
    a pair's sum of squares less what its row's reach allows is above the error of that product for all others."""
    n = y.shape[1]
    has_y = ~np.isnan(y)
    x0, y0 = np.where(best.has, best.x - middle, 0), np.where(has_y, y - middle, 0)
    unit = max(np.abs(x0).max(initial=0), np.abs(y0).max(initial=0)) or 1.0
    x0, y0 = x0 / unit, y0 / unit
    right = np.concatenate([has_y, y0 * y0, y0], 1).astype(np.float32)
    left = np.concatenate([x0 * x0, best.has, -2 * x0], 1).astype(np.float32)
    size = np.sqrt((x0 * x0).sum(1)) + np.sqrt((y0 * y0).sum(1).max(initial=0))
    lo = 0
    while lo < len(y):
        s = slice(lo, lo + max(64, min(step, 3 * (seen + lo))))
        reach = best.reach() / unit / unit / n
        left[:, :n] = x0 * x0 - reach[:, None] * best.has
        error = (6 * n + 64) * 2.0**-24 * (size * size + np.maximum(reach, 0) * n) + 1e-36  # squares below that may vanish
        near = ~(left @ right[s].T > error.astype(np.float32)[:, None])
        some = best.open()
        rows = np.flatnonzero(some.any(1))
        if len(rows):
            near[rows] &= (reach[rows] >= 0)[:, None]
            near[rows] |= some[rows] @ right[s, :n].T > 0
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        for part in range(0, len(i), 65536):
            few = slice(part, part + 65536)
            best.take(i[few], y[s][j[few]], ids[s][j[few]])
        lo = s.stop


def _nearest(df: DataFrame, reference: DataFrame, columns: list[str], k: int, key: str, block: int = 4096) -> DataFrame:
    """Rows that lack values meet all of the reference's rows: a task holds a block of the former and reads the latter, which lie in
    the shared folder, a file after the other; for each row and column it keeps the k nearest rows that have the value. A row
    lacks what it looks for, so that it is not its own neighbour."""
    spark, df = df.sparkSession, cut(df)  # several plans read it
    lacking = df.where(F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), True))
    sides = lambda n: max(1, -(-n // block), min(8, n // 256))  # noqa: E731  small blocks, but large enough to read many rows for
    lefts, rights = sides(lacking.count()), max(1, reference.count() // (4 * block))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    reference.select(key, *columns).repartition(rights).write.parquet(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    means = spark.read.parquet(folder).agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    middle = np.array([means[c] if means[c] is not None and np.isfinite(means[c]) else 0.0 for c in columns])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows, seen, best = pd.concat(rows), 0, None
        system, base = open_path(folder)
        for file in sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".parquet")):
            with system.open_input_file(file) as source:
                part = parquet.read_table(source).to_pandas()
            y, ids = part[columns].to_numpy(float), part[key].to_numpy()
            if best is None:
                best = [_Best(rows[columns].to_numpy(float)[lo : lo + 512], rows[key].to_numpy()[lo : lo + 512], k, ids.dtype) for lo in range(0, len(rows), 512)]
            for some in best:
                _search(some, y, ids, middle, seen)
            seen += len(y)
        for some in best or ():
            yield some.means()

    kind = df.schema[key].dataType.simpleString()
    near = lacking.select(key, *columns).repartition(lefts).mapInPandas(search, f"i {kind}, c int, v double")
    filled = near.groupBy("i", "c").agg(F.avg("v").alias("v")).groupBy(F.col("i").alias("i_")).agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("fill_"))
    joined = df.join(filled, F.col(key) == F.col("i_"), "left")
    value = lambda c: F.coalesce(F.col(c), F.try_element_at("fill_", F.lit(columns.index(c))), F.lit(means[c]))
    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


@dataclass
class Scaler:
    """Shift and divisor of each column."""

    bounds: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return _each(df, list(self.bounds), lambda c: (F.col(c) - F.lit(self.bounds[c][0])) / F.lit(self.bounds[c][1]))


def fit_scaler(df: DataFrame, columns: list[str], method: str = "standard") -> Scaler:
    """Columns about 0 or within 0 and 1: ``standard`` (mean, population deviation), ``minmax`` or ``robust`` (median,
    interquartile range). A column without spread is only shifted."""
    if method == "robust":
        found = {c: (v[1], v[2] - v[0]) if v[0] is not None else (0.0, 1.0) for c, v in ranges.quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    else:
        pair = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}[method]
        row = df.agg(*[F.struct(*[e.cast("double").alias(n) for n, e in zip("ab", pair(c))]).alias(c) for c in columns]).first()
        found = {c: (row[c]["a"] or 0.0, row[c]["b"]) for c in columns}
    return Scaler({c: (a, b or 1.0) for c, (a, b) in found.items()})


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    return fit_scaler(df, columns, method).transform(df)


def save(fitted: Imputer | Scaler, spark: SparkSession, path: str) -> None:
    """Write an imputer or a scaler below ``path``."""
    if isinstance(fitted, Scaler):
        record = {"bounds": fitted.bounds}
    else:
        record = {f: v for f, v in fitted.__dict__.items() if f != "reference"}
        if fitted.reference is not None:
            fitted.reference.write.mode("overwrite").parquet(f"{path}/reference")
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")


def load(spark: SparkSession, path: str) -> Imputer | Scaler:
    record = json.loads(spark.read.text(f"{path}/record").first().value)
    if "bounds" in record:
        return Scaler({c: tuple(b) for c, b in record["bounds"].items()})
    reference = spark.read.parquet(f"{path}/reference") if record["strategy"] == "knn" else None
    return Imputer(**(record | {"reference": reference, "empty": tuple(record["empty"])}))


def whiten(df: DataFrame, columns: list[str], prefix: str = "pc") -> DataFrame:
    """All principal components of ``columns``, each divided by its standard deviation; directions without spread are 0."""
    centred = scale(df, columns, "standard")
    packed = VectorAssembler(inputCols=columns, outputCol="v_").transform(centred)
    model = PCA(k=len(columns), inputCol="v_", outputCol="p_").fit(packed)
    axes: DenseMatrix = model.pc
    out = model.transform(packed).withColumn("p_", vector_to_array("p_"))
    spread = out.agg(*[F.stddev_pop(F.col("p_")[k]).alias(str(k)) for k in range(axes.numCols)]).first()
    parts = [(F.col("p_")[k] / F.lit(spread[k]) if spread[k] and spread[k] > 1e-9 else F.lit(0.0)).alias(f"{prefix}{k}") for k in range(axes.numCols)]
    return out.select(*[c for c in df.columns if c not in columns], *parts)


def folds(df: DataFrame, k: int, key: str = "id", label: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` from 0 to k - 1, shuffled by ``seed``; with ``label``, the folds share each class evenly.

    Ranks inside a class are taken in chunks of the hash's order, so that no task sorts a whole class; chunk sizes are
    what evens out.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    chunk = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(64))
    by = [F.col(label)] if label else []
    return df.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy(*by, chunk).orderBy(order, key)) + chunk, F.lit(k)).cast("int"))
