"""Period search: least-squares power of sinusoids on a frequency grid, and fits of periodic templates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def periodogram_sql(source: str, engine: str = "spark", oversampling: float = 5, nyquist: float = 3, most: int | None = None) -> str:
    """``power (lc_id, frequency, power)`` of ``(lc_id, seq, time, x, e)``.

    Frequencies are multiples of ``1 / (span * oversampling)``, half of ``oversampling * nyquist`` times the points of
    the series, or ``most`` at most if given. The power is the share of the weighted scatter that a sinusoid at that frequency explains.
    """
    spread = "explode(sequence(1, cast({} AS INT)))" if engine == "spark" else "unnest(generate_series(1, cast({} AS INT)))"
    whole = f"greatest(1, floor(0.5 * {oversampling} * {nyquist} * n))"
    grid = spread.format(whole if most is None else f"least({most}, {whole})")
    return f"""
heavy AS (SELECT *, CASE WHEN e > 0 THEN 1 / (e * e) ELSE 0e0 END AS w FROM {source}),
means AS (SELECT lc_id, count(*) AS n, min(time) AS t0, max(time) - min(time) AS span, sum(w * x) / nullif(sum(w), 0) AS mu FROM heavy GROUP BY lc_id),
grid AS (SELECT lc_id, t0, mu, span, {grid} AS k FROM means WHERE span > 0 AND mu IS NOT NULL),
waves AS (SELECT h.lc_id, k, k / (span * {oversampling}e0) AS frequency, w, x - mu AS y, cos(2 * pi() * (time - t0) * k / (span * {oversampling}e0)) AS c,
          sin(2 * pi() * (time - t0) * k / (span * {oversampling}e0)) AS s FROM heavy h JOIN grid g ON h.lc_id = g.lc_id),
sums AS (SELECT lc_id, k, max(frequency) AS frequency, sum(w * y * y) AS yy, sum(w * y * c) AS yc, sum(w * y * s) AS ys,
         sum(w * c * c) AS cc, sum(w * s * s) AS ss, sum(w * c * s) AS cs FROM waves GROUP BY lc_id, k),
power AS (SELECT lc_id, k, frequency, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / nullif(yy * (cc * ss - cs * cs), 0) AS power FROM sums)"""


CELLS = 1 << 18  # pairs of a point and a frequency that a task holds at a time


def _column(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values and which of them are given."""
    given = rows[name].is_valid().to_numpy()
    return np.where(given, rows[name].to_numpy(), 0.0), given


def _gains(rows: pa.Table, t0: float, times: np.ndarray, over: float = 1.0) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Of points ``(time, x, e)`` at the frequencies ``times / over``: what a sinusoid takes away of the weighted scatter,
    times the determinant of its equations; the determinant; the scatter. None without weights.

    These are the sums of ``periodogram_sql``, taken over blocks of frequencies; nulls add nothing to a sum."""
    (t, timed), (x, valued), (e, erred) = (_column(rows, c) for c in ("time", "x", "e"))
    with np.errstate(all="ignore"):
        w = np.where(erred & ~(e <= 0), 1 / (e * e), 0.0)
        if not valued.any() or w.sum() == 0:
            return None
        y = np.where(valued, x - (w * np.where(valued, x, 0.0)).sum() / w.sum(), 0.0)
        wy, turn, step = w * y, 2 * np.pi * (t - t0), max(1, CELLS // len(t))
        top, det = np.empty(len(times)), np.empty(len(times))
        for lo in range(0, len(times), step):
            angle = turn * times[lo : lo + step, None] / over
            c, s = np.where(timed, np.cos(angle), 0.0), np.where(timed, np.sin(angle), 0.0)
            wc = w * c
            yc, ys, cc, ss, cs = ((p).sum(1) for p in (wy * c, wy * s, wc * c, w * s * s, wc * s))
            top[lo : lo + step], det[lo : lo + step] = ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys, cc * ss - cs * cs
        return top, np.where(det == 0, np.nan, det), float((wy * y).sum())


def _best_first(power: np.ndarray, apart: int) -> np.ndarray:
    """Places of the local maxima, the highest first: no less than what is up to ``apart`` before, above what is after."""
    held = np.flatnonzero(~np.isnan(power))
    p = np.pad(power[held], apart, constant_values=-np.inf)
    n, top = len(held), np.ones(len(held), bool)
    for j in range(1, apart + 1):
        top &= (p[apart : apart + n] >= p[apart - j : apart - j + n]) & (p[apart : apart + n] > p[apart + j : apart + j + n])
    at = held[top]
    return at[np.lexsort((at, -power[at]))]


def periodogram(points: DataFrame, oversampling: float = 5, nyquist: float = 3, band: str | None = None, peaks: int = 0, apart: int = 5) -> DataFrame:
    """``(lc_id, k, frequency, power)`` of ``points(lc_id, time, x, e)``: the rows of ``periodogram_sql``, or of
    ``multiband_sql`` with a ``band`` column. ``peaks``: ``(lc_id, rank, period, power)``, the rows of ``best_periods``.

    A series is one task's, which meets its points with its frequencies in blocks: no pair is a row of a join, and memory
    grows with the points and frequencies of one series."""
    kind = points.schema["lc_id"].dataType.simpleString()
    fields = "rank int, period double, power double" if peaks else "k int, frequency double, power double"

    def table(rows: pa.Table, **columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table({"lc_id": rows["lc_id"].take(pa.array(np.zeros(n, np.int64))), **columns})

    def run(rows: pa.Table) -> pa.Table:
        t, timed = _column(rows, "time")
        most = max(1, int(np.floor(0.5 * oversampling * nyquist * len(t))))
        t, k = t[timed], np.arange(1.0, most + 1)
        span = t.max() - t.min() if len(t) else 0.0
        parts = [rows]
        if band is not None:
            own = rows[band].to_pandas().factorize()[0]
            parts = [rows.filter(pa.array(own == i)) for i in range(own.max() + 1)]
        found = [g for part in parts if (g := _gains(part, t.min(), k, span * oversampling))] if span > 0 else []
        k = k if found else k[:0]
        frequency = k / (span * oversampling) if found else k
        with np.errstate(all="ignore"):
            if not found:
                power = k
            elif band is None:
                top, det, scatter = found[0]
                power = top / (scatter * det if scatter else np.nan)
            else:
                scatter = sum(f[2] for f in found)
                power = sum(np.where(np.isnan(f[1]), 0.0, f[0] / f[1]) for f in found) / (scatter if scatter else np.nan)
        if not peaks:
            return table(rows, k=pa.array(k.astype(np.int32)), frequency=pa.array(frequency), power=pa.array(power, mask=np.isnan(power)))
        at = _best_first(power, apart)[:peaks]
        return table(rows, rank=pa.array(np.arange(1, len(at) + 1, dtype=np.int32)), period=pa.array(1 / frequency[at]), power=pa.array(power[at]))

    held = points.select("lc_id", *[F.col(c).cast("double").alias(c) for c in ("time", "x", "e")], *([F.col(band).cast("string").alias(band)] if band else [])).where("lc_id IS NOT NULL")
    return held.groupBy("lc_id").applyInArrow(run, f"lc_id {kind}, {fields}")


def best_periods(power: DataFrame, count: int = 1, apart: int = 5) -> DataFrame:
    """``(lc_id, rank, period, power)``: the ``count`` highest local maxima of each series, ``apart`` steps from each other."""
    near = Window.partitionBy("lc_id").orderBy("k").rowsBetween(-apart, apart)
    peaks = power.where("power IS NOT NULL").withColumn("top", F.max(F.struct("power", "k")).over(near)).where("top.k = k")
    ranked = peaks.withColumn("rank", F.row_number().over(Window.partitionBy("lc_id").orderBy(F.desc("power"), "k")))
    return ranked.where(F.col("rank") <= count).select("lc_id", "rank", (1 / F.col("frequency")).alias("period"), "power")


def refine_periods(points: DataFrame, coarse: DataFrame, count: int = 1, oversampling: float = 5, steps: int = 50) -> DataFrame:
    """``(lc_id, rank, period, power)``: the peaks of a coarse scan, searched again on ``steps`` frequencies to each side
    up to the next frequency of the coarse grid, and ranked anew. ``coarse`` is of ``best_periods``: more peaks than
    wanted, five at least, find a peak that the coarse grid undervalues."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        t, timed = _column(rows, "time")
        t = t[timed]
        step, best = 1 / np.ptp(t) / oversampling if len(t) and np.ptp(t) > 0 else 0.0, []
        for peak, period in zip(found["rank"].to_pylist(), found["period"].to_pylist()) if step else ():
            fine = 1 / period + np.arange(-steps, steps + 1) * step / steps
            fine = fine[fine > 0]
            if sums := _gains(rows, t.min(), fine):
                with np.errstate(all="ignore"):
                    power = sums[0] / (sums[2] * sums[1] if sums[2] else np.nan)
                best += sorted((-p, peak, 1 / f) for p, f in zip(power, fine) if p == p)[:1]
        best = sorted(best)[:count]
        columns = {"rank": pa.array(range(1, len(best) + 1), pa.int32()), "period": pa.array([b[2] for b in best], pa.float64()), "power": pa.array([-b[0] for b in best], pa.float64())}
        return pa.table({"lc_id": rows["lc_id"].take(pa.array(np.zeros(len(best), np.int64))), **columns})

    held = points.select("lc_id", *[F.col(c).cast("double").alias(c) for c in ("time", "x", "e")]).where("lc_id IS NOT NULL")
    peaks = coarse.select("lc_id", F.col("rank").cast("int").alias("rank"), "period")
    return held.groupBy("lc_id").cogroup(peaks.groupBy("lc_id")).applyInArrow(run, f"lc_id {dict(points.dtypes)['lc_id']}, rank int, period double, power double")


def multiband_sql(source: str, oversampling: float = 5, nyquist: float = 3) -> str:
    """``power (lc_id, k, frequency, power)`` of points of several bands ``(lc_id, band, seq, time, x, e)``.

    All bands of a series share its grid of frequencies; each has a mean and a sinusoid of its own. The power is the
    bands' mean, weighted by their scatter about their means: the share of all scatter that the model explains.
    """
    return f"""
heavy AS (SELECT *, CASE WHEN e > 0 THEN 1 / (e * e) ELSE 0e0 END AS w FROM {source}),
ends AS (SELECT lc_id, count(*) AS n, min(time) AS t0, max(time) - min(time) AS span FROM heavy GROUP BY lc_id),
means AS (SELECT lc_id, band, sum(w * x) / nullif(sum(w), 0) AS mu FROM heavy GROUP BY lc_id, band),
grid AS (SELECT lc_id, t0, span, explode(sequence(1, cast(greatest(1, floor(0.5 * {oversampling} * {nyquist} * n)) AS INT))) AS k FROM ends WHERE span > 0),
waves AS (SELECT h.lc_id, h.band, k, k / (span * {oversampling}e0) AS frequency, w, x - mu AS y, cos(2 * pi() * (time - t0) * k / (span * {oversampling}e0)) AS c,
          sin(2 * pi() * (time - t0) * k / (span * {oversampling}e0)) AS s
          FROM heavy h JOIN means m ON h.lc_id = m.lc_id AND h.band = m.band JOIN grid g ON h.lc_id = g.lc_id WHERE mu IS NOT NULL),
sums AS (SELECT lc_id, band, k, max(frequency) AS frequency, sum(w * y * y) AS yy, sum(w * y * c) AS yc, sum(w * y * s) AS ys,
         sum(w * c * c) AS cc, sum(w * s * s) AS ss, sum(w * c * s) AS cs FROM waves GROUP BY lc_id, band, k),
gains AS (SELECT *, coalesce((ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / nullif(cc * ss - cs * cs, 0), 0e0) AS gain FROM sums),
power AS (SELECT lc_id, k, max(frequency) AS frequency, sum(gain) / nullif(sum(yy), 0) AS power FROM gains GROUP BY lc_id, k)"""


def fit_bands(points: DataFrame, periods: DataFrame) -> DataFrame:
    """``(lc_id, band, period, t0, offset, cosine, sine)``: the least-squares sinusoid of each band at its series' period."""
    heavy = points.join(periods.where("rank = 1").select("lc_id", "period"), "lc_id").withColumn("w", F.when(F.col("e") > 0, 1 / (F.col("e") * F.col("e"))).otherwise(0.0))
    start = points.groupBy("lc_id").agg(F.min("time").alias("t0"))
    turn = 2 * F.pi() * (F.col("time") - F.col("t0")) / F.col("period")
    waves = heavy.join(start, "lc_id").withColumn("c", F.cos(turn)).withColumn("s", F.sin(turn))
    mean = F.sum(F.col("w") * F.col("x")).over(Window.partitionBy("lc_id", "band")) / F.nullif(F.sum("w").over(Window.partitionBy("lc_id", "band")), F.lit(0.0))
    waves = waves.withColumn("mu", mean).withColumn("y", F.col("x") - F.col("mu"))
    dot = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}{b}")
    sums = waves.groupBy("lc_id", "band").agg(F.max("period").alias("period"), F.max("t0").alias("t0"), F.max("mu").alias("offset"), dot("y", "c"), dot("y", "s"), dot("c", "c"), dot("s", "s"), dot("c", "s"))
    det = F.nullif(F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs"), F.lit(0.0))
    cosine, sine = (F.col("yc") * F.col("ss") - F.col("ys") * F.col("cs")) / det, (F.col("ys") * F.col("cc") - F.col("yc") * F.col("cs")) / det
    return sums.select("lc_id", "band", "period", "t0", "offset", F.coalesce(cosine, F.lit(0.0)).alias("cosine"), F.coalesce(sine, F.lit(0.0)).alias("sine"))


def predict_bands(fits: DataFrame, at: DataFrame) -> DataFrame:
    """``at(lc_id, band, time)`` with ``model``. A band that its series was not fitted with is an error."""
    joined = at.join(fits, ["lc_id", "band"], "left")
    turn = 2 * F.pi() * (F.col("time") - F.col("t0")) / F.col("period")
    model = F.col("offset") + F.col("cosine") * F.cos(turn) + F.col("sine") * F.sin(turn)
    unknown = F.raise_error(F.concat(F.lit("no fit of band "), F.col("band").cast("string"), F.lit(" of series "), F.col("lc_id").cast("string"))).cast("double")
    return joined.select(*at.columns, F.when(F.col("period").isNull(), unknown).otherwise(model).alias("model"))


def grid_size(shortest: float, longest: float, span: float, oversampling: float = 5) -> int:
    """Steps of a frequency grid between two periods, fine enough for the span."""
    if not 0 < shortest < longest:
        raise ValueError("a range of periods is needed")
    return int((1 / shortest - 1 / longest) * span * oversampling) + 1


def periodic_spline(values: np.ndarray) -> np.ndarray:
    """Second derivatives, by phase step, of the cubic spline through a template's values that closes on itself."""
    n = len(values)
    if n < 3:
        return np.zeros(n)
    system = 4 * np.eye(n) + np.roll(np.eye(n), 1, 0) + np.roll(np.eye(n), -1, 0)
    return np.linalg.solve(system, 6 * (np.roll(values, -1) - 2 * values + np.roll(values, 1)))


def spline_at(values: np.ndarray, bends: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """A template at any phases."""
    n = len(values)
    place = (phase % 1) * n
    k = np.minimum(place.astype(int), n - 1)
    b = place - k
    a, nxt = 1 - b, (k + 1) % n
    return a * values[k] + b * values[nxt] + ((a**3 - a) * bends[k] + (b**3 - b) * bends[nxt]) / 6


def fit_templates(points: DataFrame, periods: DataFrame, templates: dict[str, np.ndarray], phases: int = 50) -> DataFrame:
    """``(lc_id, template, offset, amplitude, phase, chi2)``: the best template of each series at its period.

    ``templates`` holds values at evenly spaced phases of [0, 1), a small table that goes to the tasks; between phases
    a cubic spline runs through them, around the end too. At each of ``phases`` shifts, offset and amplitude (not
    negative) follow by weighted least squares; the best shift is then narrowed between its neighbours by golden section.
    """
    splines = {name: (v := np.asarray(templates[name], float), periodic_spline(v)) for name in sorted(templates)}
    ratio = (5**0.5 - 1) / 2

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, x, w = rows["time"].to_numpy(), rows["x"].to_numpy(), 1 / np.maximum(rows["e"].to_numpy(), 1e-12) ** 2
        turn, best = t / rows["period"].iloc[0], (np.inf,)
        mx = np.average(x, weights=w)
        for name, (values, bends) in splines.items():

            def fit(shift: float) -> tuple:
                m = spline_at(values, bends, turn + shift)  # noqa: B023
                mm = np.average(m, weights=w)
                spread = (w * (m - mm) ** 2).sum()
                a = max(0.0, (w * (m - mm) * (x - mx)).sum() / spread) if spread > 0 else 0.0
                return ((w * (x - mx - a * (m - mm)) ** 2).sum(), name, mx - a * mm, a, shift % 1)  # noqa: B023

            found = min((fit(s) for s in np.arange(phases) / phases), key=lambda f: f[0])
            lo, hi = found[4] - 1 / phases, found[4] + 1 / phases
            while hi - lo > 1e-7:
                left, right = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
                lo, hi = (lo, right) if fit(left)[0] < fit(right)[0] else (left, hi)
            best = min(best, found, fit((lo + hi) / 2), key=lambda f: f[0])
        chi2, name, offset, a, shift = best
        return pd.DataFrame([(key[0], name, offset, a, shift, chi2)], columns=["lc_id", "template", "offset", "amplitude", "phase", "chi2"])

    return points.join(periods.where("rank = 1").select("lc_id", "period"), "lc_id").groupBy("lc_id").applyInPandas(run, "lc_id long, template string, offset double, amplitude double, phase double, chi2 double")
