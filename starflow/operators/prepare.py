"""From raw points to the relations that features read: finite filter, flux conversion, normalisation, derivative.

Every step is a window over one series in the total order of ``(time, seq)``; all share the partitioning by ``lc_id``.
The texts run on Spark and, for the oracle queries, on DuckDB alike. Null marks what is undefined; rows with NaN or
infinite values are removed before anything else.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _power_of_ten(y: float) -> float:
    try:
        return math.pow(10.0, y)
    except OverflowError:
        return math.inf


@F.pandas_udf(T.DoubleType())
def power_of_ten(y: pd.Series) -> pd.Series:
    """10 to a power by the C library, whose last bits are those of the SQL's side; the JVM's are others in a tenth of all
    values, and leading digits tell a flux of 0.5 from one just below it."""
    return pd.Series([_power_of_ten(v) for v in y], dtype=float)


@F.pandas_udf(T.DoubleType())
def decimal_log(x: pd.Series) -> pd.Series:
    """The decimal logarithm by the C library (see ``power_of_ten``); null where there is none."""
    return pd.Series([math.log10(v) if v > 0 else math.nan for v in x], dtype=float)


def finite(points: DataFrame, *columns: str) -> DataFrame:
    """The rows in which all columns (default: time, mag, magerr) are numbers, neither NaN nor infinite."""
    test = F.lit(True)
    for c in columns or ("time", "mag", "magerr"):
        value = F.col(c).cast("double")
        test = test & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return points.where(F.coalesce(test, F.lit(False)))


def flux_sql(source: str, convert: bool = True, zp: float = 24.0, at_zero: bool = False) -> str:
    """``flux``: (lc_id, seq, time, r, re, x, e), the flux, its error and both divided by the series' largest flux.

    The error is scaled as its flux is, so that a flux of zero has none; with ``at_zero`` it keeps its own share."""
    r = f"pow(10e0, -(mag - {zp}) / 2.5)" if convert else "mag"
    error = "magerr * r / 2.5 * ln(10e0)" if convert else "magerr"
    scaled = "re / nullif(peak, 0)" if at_zero else "re * ((r / nullif(peak, 0)) / nullif(r, 0))"
    return f"""
raw_flux AS (SELECT lc_id, seq, time, magerr, {r} AS r FROM {source}),
erred AS (SELECT lc_id, seq, time, r, {error} AS re, max(r) OVER (PARTITION BY lc_id) AS peak FROM raw_flux),
flux AS (SELECT lc_id, seq, time, r, re, r / nullif(peak, 0) AS x, {scaled} AS e FROM erred)"""


def to_flux(points: DataFrame, zp: float = 24.0) -> DataFrame:
    """``points`` with fluxes for magnitudes, and their errors, as ``flux_sql`` converts them, to the last bit of the SQL's side."""
    flux = points.select("lc_id", "seq", "time", power_of_ten(-(F.col("mag") - zp) / 2.5).alias("mag"), "magerr")
    return flux.withColumn("magerr", F.col("magerr") * F.col("mag") / 2.5 * F.expr("ln(10e0)"))


def _gradient(f: str) -> str:
    """Second-order difference of unevenly spaced values, first-order at the ends, in the window t."""
    before, after = f"({f} - (lag({f}) OVER t))", f"((lead({f}) OVER t) - {f})"
    hs, hd = "(time - (lag(time) OVER t))", "((lead(time) OVER t) - time)"
    inner = f"({hs} * {hs} * {after} + {hd} * {hd} * {before}) / nullif({hs} * {hd} * ({hs} + {hd}), 0)"
    return f"CASE WHEN (lag(time) OVER t) IS NULL THEN {after} / nullif({hd}, 0) WHEN (lead(time) OVER t) IS NULL THEN {before} / nullif({hs}, 0) ELSE {inner} END"


def derivative_sql() -> str:
    """After ``flux_sql``: ``deriv1``, the flux's derivative where it and its error are defined, and ``deriv2``, that
    divided by its maximum, where it and the error taken from its own neighbours are defined."""
    order = "WINDOW t AS (PARTITION BY lc_id ORDER BY time, seq)"
    ratio = "(coalesce(lead(r) OVER t, r) - coalesce(lag(r) OVER t, r)) / nullif(coalesce(lead(time) OVER t, time) - coalesce(lag(time) OVER t, time), 0)"
    return f"""
sloped AS (SELECT *, {ratio} AS fd FROM flux {order}),
bent AS (SELECT *, abs(({_gradient("fd")}) / nullif(fd, 0)) * re AS fde FROM sloped {order}),
deriv1 AS (SELECT lc_id, seq, time, fd, fde, e AS ne, fd / nullif(max(fd) OVER (PARTITION BY lc_id), 0) AS nfd
           FROM bent WHERE fd IS NOT NULL AND fde IS NOT NULL),
bent2 AS (SELECT *, abs(({_gradient("nfd")}) / nullif(nfd, 0)) * ne AS nfde FROM deriv1 {order}),
deriv2 AS (SELECT lc_id, seq, time, nfd, nfde FROM bent2 WHERE nfd IS NOT NULL AND nfde IS NOT NULL)"""


#: The relations (lc_id, seq, time, x, e) of both spaces: raw ones for the features of unnormalised values.
SPACES = {
    ("flux", False): ("norm", "norm AS (SELECT lc_id, seq, time, x, e FROM flux)"),
    ("flux", True): ("raw", "raw AS (SELECT lc_id, seq, time, r AS x, re AS e FROM flux)"),
    ("deriv", False): ("dnorm", "dnorm AS (SELECT lc_id, seq, time, nfd AS x, nfde AS e FROM deriv2)"),
    ("deriv", True): ("draw", "draw AS (SELECT lc_id, seq, time, fd AS x, fde AS e FROM deriv1)"),
}


def space_sql(source: str, space: str, raw: bool, convert: bool, zp: float, at_zero: bool = False) -> tuple[str, str]:
    """The name of a space's relation and the table expressions that define it."""
    name, last = SPACES[space, raw]
    parts = [flux_sql(source, convert, zp, at_zero), *([derivative_sql()] if space == "deriv" else []), last]
    return name, ",".join(parts)
