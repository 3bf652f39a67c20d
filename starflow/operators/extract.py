"""Feature extraction: 84 features of a series' flux and of its derivative, weighted by the errors or not.

One row per series with a column per feature, named as the feature, with ``_deriv`` for the derivative's. Values are
clamped: undefined and non-finite ones are null, magnitudes over 1e10 become 1e10, positive ones below 1e-10 become
1e-10. Series of fewer than two points have nulls only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.functions import features, grouped
from starflow.operators import prepare

LIMIT, LEAST = "1e10", "1e-10"
POINTS = 500_000  # of a task, about: a point is widened to some seventy columns, which several sorts hold


def clamp_sql(c: str) -> str:
    """Null for what isn't a finite number, and the bounds of the feature table."""
    return (
        f"CASE WHEN {c} IS NULL OR isnan({c}) OR abs({c}) = double('infinity') THEN NULL WHEN {c} > {LIMIT}D THEN {LIMIT}D WHEN {c} < -{LIMIT}D THEN -{LIMIT}D "
        f"WHEN {c} > 0 AND {c} < {LEAST}D THEN {LEAST}D ELSE {c} END"
    )


def sql_features(points: DataFrame, wanted: Iterable[str], space: str, weighted: bool, convert: bool, zp: float, at_zero: bool = False) -> DataFrame | None:
    """``(lc_id, <wanted>)`` by window stages and one aggregation; None where SQL computes none of them."""
    possible = set(features.names(weighted))
    out = None
    for raw in (False, True):
        own = [w for w in wanted if w in possible and (w in features.RAW) == raw]
        if own:
            name, before = prepare.space_sql("{points}", space, raw, convert, zp, at_zero)
            part = points.sparkSession.sql(features.query(own, weighted, features.SPARK, name, before), points=points)
            out = part if out is None else out.join(part, "lc_id", "full")
    return out


def grouped_features(points: DataFrame, wanted: Iterable[str], space: str, weighted: bool, convert: bool, zp: float, at_zero: bool = False) -> DataFrame | None:
    """``(lc_id, <wanted>)`` of the features that NumPy computes, a series a group."""
    sql = set(features.names(weighted))
    own = [w for w in wanted if w in grouped.FEATURES and w not in sql]
    if not own:
        return None
    name, before = prepare.space_sql("{points}", space, False, convert, zp, at_zero)
    relation = points.sparkSession.sql(f"WITH {before} SELECT lc_id, seq, time, x, e FROM {name}", points=points)

    functions = [grouped.FEATURES[w] for w in own]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time", "seq"])
        x, e = rows["x"].to_numpy(float), rows["e"].to_numpy(float)
        with np.errstate(all="ignore"):
            return pd.DataFrame([(key[0], *(f(x, e, weighted) for f in functions))], columns=["lc_id", *own])

    kind = T.StructType([T.StructField("lc_id", points.schema["lc_id"].dataType), *[T.StructField(w, T.DoubleType()) for w in own]])
    return relation.groupBy("lc_id").applyInPandas(run, kind)


def extract(
    points: DataFrame, wanted: Iterable[str] | None = None, weighted: bool = True, convert: bool = True, zp: float = 24.0, spaces: Iterable[str] = ("flux", "deriv"), at_zero: bool = False
) -> DataFrame:
    """``(lc_id, features...)`` of ``points(lc_id, seq, time, mag, magerr)``.

    ``wanted`` names columns (``<feature>`` or ``<feature>_deriv``); only what they need is computed. ``convert`` takes
    magnitudes to fluxes at zero point ``zp``. ``seq`` breaks ties of time and should be unique in a series.
    ``at_zero``: points of zero flux keep their errors when the flux is normalised; otherwise they have none and weigh nothing.
    """
    parts = max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() / POINTS))
    points = prepare.finite(points).select("lc_id", "seq", F.col("time").cast("double").alias("time"), F.col("mag").cast("double").alias("mag"), F.col("magerr").cast("double").alias("magerr"))
    if convert:
        points, convert = prepare.to_flux(points, zp), False
    points = points.repartition(parts, "lc_id")  # small points, which adaptive execution would gather into few tasks
    spaces = tuple(spaces)
    columns = list(wanted) if wanted is not None else [n + ("_deriv" if s == "deriv" else "") for s in spaces for n in features.all_names()]
    out = points.groupBy("lc_id").agg(F.count(F.lit(1)).alias("n_"))
    for space in ("flux", "deriv"):
        own = [c.removesuffix("_deriv") for c in columns if c.endswith("_deriv") == (space == "deriv")]
        for part in (sql_features(points, own, space, weighted, convert, zp, at_zero), grouped_features(points, own, space, weighted, convert, zp, at_zero)):
            if part is not None:
                named = [f"{c} AS {c}_deriv" if space == "deriv" else c for c in part.columns if c != "lc_id"]
                out = out.join(part.selectExpr("lc_id", *named), "lc_id", "left")
    return out.selectExpr("lc_id", *[f"CASE WHEN n_ > 1 THEN {clamp_sql(c)} END AS {c}" for c in columns])
