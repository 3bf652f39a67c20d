"""Joint fits of periodic templates to several bands at trial periods.

Series are parted among the tasks and sorted, each with its trial periods, a short list; the templates, a small table, go to
all tasks. A task fits the whole series of some thousands of points at once. Bands share the phase (or have one each), and each has its own template, offset and amplitude. Offsets and
amplitudes follow from the phase by least squares, so that only the phase is searched: on an even grid, then by the sign
of chi-square's derivative, in which offsets and amplitudes need no terms of their own as they are at their best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AT_ZERO = {3: (4, 1), 5: (66, 26, 1)}  # fixed values: the splines' own values at whole distances, times 6 and 120


def _basis(x: np.ndarray, degree: int) -> np.ndarray:
    """The centred B-spline of a degree, by its recursion from the unit box."""
    if degree == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    half = (degree + 1) / 2
    return ((half + x) * _basis(x + 0.5, degree - 1) + (half - x) * _basis(x - 0.5, degree - 1)) / degree


class Spline:
    """The periodic spline through a template's values at evenly spaced phases of [0, 1)."""

    def __init__(self, values, degree: int = 5):
        values = np.asarray(values, float)
        self.n, self.degree = len(values), degree
        kernel = np.zeros(self.n)
        for distance in range(-(degree // 2), degree // 2 + 1):
            kernel[distance % self.n] += AT_ZERO[degree][abs(distance)] / {3: 6, 5: 120}[degree]
        weights = np.fft.irfft(np.fft.rfft(values) / np.fft.rfft(kernel), self.n)
        steps = range(-(degree // 2), degree // 2 + 2)
        u = np.arange(1, 2 * degree + 3, 2) / (2 * degree + 2)  # places inside a piece, as many as it has coefficients
        pieces = np.linalg.solve(np.vander(u, degree + 1), np.stack([_basis(u - s, degree) for s in steps], 1))
        self.pieces = np.stack([np.roll(weights, -s) for s in steps], 1) @ pieces.T  # (interval, power), the highest first
        self.columns = np.ascontiguousarray(self.pieces.T)

    def value(self, phase: np.ndarray) -> np.ndarray:
        """Values by phase, alone."""
        place = (phase % 1) * self.n
        near = np.minimum(place.astype(np.int64), self.n - 1)
        u, value = place - near, self.columns[0][near]
        for column in self.columns[1:]:
            value = value * u + column[near]
        return value

    def at(self, phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and derivatives by phase."""
        place = (np.asarray(phase, float) % 1) * self.n
        near = np.minimum(place.astype(np.int64), self.n - 1)
        u, c = place - near, self.pieces[near]
        value, slope = c[..., 0], np.zeros(place.shape)
        for power in range(1, self.degree + 1):
            slope = slope * u + value
            value = value * u + c[..., power]
        return value, slope * self.n


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first)


class Bands:
    """Bands of one or more series, points of a band side by side: what no trial changes, fits at a shift of each band."""

    def __init__(self, first: np.ndarray, t: np.ndarray, x: np.ndarray, e: np.ndarray):
        self.first, self.of, self.t = first, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(t)])), t
        self.w = 1 / np.maximum(e, 1e-12) ** 2
        self.total = _sums(self.w, first)
        self.mean = _sums(self.w * x, first) / self.total
        self.y = x - self.mean[self.of]
        self.wy = self.w * self.y
        self.null = _sums(self.wy * self.y, first)  # chi-square of a constant

    def part(self, bands: np.ndarray) -> Bands:
        """Some of the bands, by a mask."""
        if bands.all():
            return self
        kept = bands[self.of]
        sizes = np.diff(np.r_[self.first, len(self.t)])[bands]
        out = object.__new__(Bands)
        out.first, out.of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        out.t, out.w, out.y, out.wy = self.t[kept], self.w[kept], self.y[kept], self.wy[kept]
        out.total, out.mean, out.null = self.total[bands], self.mean[bands], self.null[bands]
        return out

    def fit(self, m: np.ndarray, d: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """``(chi2, slope of chi2 by the shift, offset, amplitude)`` of ``offset + amplitude * m``, the amplitude not negative,
        by the template's values ``m`` and slopes ``d`` at the points."""
        mm = _sums(m * self.w, self.first) / self.total
        m = m - mm[self.of]
        spread = _sums(m * m * self.w, self.first)
        a = np.maximum(0.0, _sums(m * self.wy, self.first) / np.where(spread > 0, spread, np.inf))
        rest = self.y - a[self.of] * m
        weighed = rest * self.w
        slope = None if d is None else -2 * a * _sums(weighed * d, self.first)
        return _sums(weighed * rest, self.first), slope, self.mean - a * mm, a


def _shape(splines: list[Spline], which: np.ndarray, phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes of each point's own template."""
    value, slope = np.empty(len(phase)), np.empty(len(phase))
    for k, spline in enumerate(splines):
        own = np.flatnonzero(which == k)
        value[own], slope[own] = spline.at(phase[own])
    return value, slope


def _best_shifts(bands: Bands, group: np.ndarray, splines: list[Spline], allowed: np.ndarray, period: np.ndarray, phases: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shift, template)`` of each band; bands of one ``group`` share the shift. All groups are searched at once."""
    turn, groups = bands.t / period[bands.of], int(group.max()) + 1
    best, at, chosen = np.full(groups, np.inf), np.zeros(groups), np.zeros(len(group), np.int64)
    for shift in np.arange(phases) / phases:
        each = np.stack([np.where(allowed[:, k], bands.fit(s.value(turn + shift))[0], np.inf) for k, s in enumerate(splines)])
        total = np.bincount(group, each.min(0), groups)
        better = total < best
        best, at, chosen = np.where(better, total, best), np.where(better, shift, at), np.where(better[group], each.argmin(0), chosen)
    which = chosen[bands.of]

    def both(shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chi2, slope, *_ = bands.fit(*_shape(splines, which, turn + shift[group][bands.of]))
        return np.bincount(group, chi2, groups), np.bincount(group, slope, groups)

    lo, hi = at - 1 / phases, at + 1 / phases
    while (hi - lo).max() > 1e-9:
        middle = (lo + hi) / 2
        left = both(middle)[1] > 0
        lo, hi = np.where(left, lo, middle), np.where(left, middle, hi)
    middle = (lo + hi) / 2
    return np.where(both(middle)[0] < best, middle % 1, at)[group], chosen


def _fits(rows: pd.DataFrame, splines: dict[str, Spline], of_band: dict[str, str], shared: bool, phases: int) -> pd.DataFrame:
    """The fits of whole series, sorted by series and band; rows without a band are trial periods, in ``time``."""
    lc, band, time = rows["lc_id"].to_numpy(), rows["band"].to_numpy(object), rows["time"].to_numpy(float)
    series, trial = np.cumsum(np.r_[False, lc[1:] != lc[:-1]]), rows["band"].isna().to_numpy()
    s, b = series[~trial], band[~trial]
    out = [pd.DataFrame(columns=["lc_id", *COLUMNS])]
    if not len(s) or not trial.any():
        return out[0]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (b[1:] != b[:-1])])
    bands = Bands(first, time[~trial], *[rows[c].to_numpy(float)[~trial] for c in ("x", "e")])
    names, home, name_of = list(splines), s[first], b[first]
    allowed = np.stack([name_of == of_band[n] if n in of_band else np.ones(len(first), bool) for n in names], 1)
    lost = np.zeros(series[-1] + 1, bool)
    lost[home[~allowed.any(1)]] = True
    tried = np.unique(np.stack([series[trial].astype(float), time[trial]]), axis=1)
    owner = tried[0].astype(np.int64)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    for k in range(place.max() + 1):  # each series' k-th period
        period = np.full(len(lost), np.nan)
        period[owner[place == k]] = tried[1][place == k]
        active = np.zeros(len(lost), bool)
        active[owner[place == k]] = True
        own = (active & ~lost)[home]
        if not own.any():
            continue
        some, at = bands.part(own), home[own]
        group = np.unique(at, return_inverse=True)[1] if shared else np.arange(len(at))
        shift, chosen = _best_shifts(some, group, list(splines.values()), allowed[own], period[at], phases)
        chi2, _, offset, amplitude = some.fit(_shape(list(splines.values()), chosen[some.of], some.t / period[at][some.of] + shift[some.of])[0])
        of = np.unique(at, return_inverse=True)[1]
        null = np.bincount(of, some.null)
        score = np.where(null > 0, 1 - np.bincount(of, chi2) / np.where(null > 0, null, 1), 0.0)[of]
        ids = lc[np.searchsorted(series, at)]
        out.append(pd.DataFrame(dict(zip(["lc_id", *COLUMNS], (ids, period[at], name_of[own], np.array(names, object)[chosen], offset, amplitude, shift, chi2, some.null, score)))))
    return pd.concat(out[1:] or out)


RESULT = "period double, band string, template string, offset double, amplitude double, phase double, chi2 double, null_chi2 double, score double"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
CHUNK = 16_384  # points whose fits are taken at once: arrays that stay in a core's cache


def fit_band_templates(points: DataFrame, periods: DataFrame, templates: dict[str, list[float]], of_band: dict[str, str] | None = None, shared: bool = True, phases: int = 50) -> DataFrame:
    """``(lc_id, period, band, template, offset, amplitude, phase, chi2, null_chi2, score)``: the best fit of each band of
    ``points(lc_id, band, time, x, e)`` at each of the trial ``periods(lc_id, period)``.

    ``score`` is of the series at the period: one less the bands' chi-square over that of constants, so that each band
    weighs by its own. ``templates`` holds values at evenly spaced phases, between which a periodic spline of the fifth
    degree runs; ``of_band`` names the band that a template is for (the others are for any). ``shared``: all bands have
    one phase, else each its own. Points with nulls, series without periods or whose band no template is for give no
    rows, periods that aren't above 0 none either; bands that never vary score 0.
    """
    splines, of_band = {n: Spline(templates[n]) for n in sorted(templates)}, of_band or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch]) if len(held) else batch
            if len(held) >= CHUNK:
                done = (held["lc_id"] != held["lc_id"].iloc[-1]).to_numpy()  # the last series may go on in the next batch
                if done.any():
                    yield _fits(held[done], splines, of_band, shared, phases)
                    held = held[~done]
        if len(held):
            yield _fits(held, splines, of_band, shared, phases)

    held = points.select("lc_id", F.col("band").cast("string").alias("band"), *[F.col(c).cast("double").alias(c) for c in ("time", "x", "e")]).dropna()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("band", "string"), ("x", "double"), ("e", "double"))]
    trials = periods.where("period > 0 AND lc_id IS NOT NULL").select("lc_id", F.col("period").cast("double").alias("time"), *none)
    placed = held.unionByName(trials).repartition("lc_id").sortWithinPartitions("lc_id", "band", "time")
    return placed.mapInPandas(run, f"lc_id {dict(points.dtypes)['lc_id']}, {RESULT}")


def best_template_periods(fits: DataFrame) -> DataFrame:
    """The rows of ``fit_band_templates`` of each series' period with the highest score, the shortest of equals."""
    top = F.max_by("period", F.struct("score", -F.col("period"))).over(Window.partitionBy("lc_id"))
    return fits.withColumn("top_", top).where("top_ = period").drop("top_")


def predict_band_templates(fits: DataFrame, at: DataFrame, templates: dict[str, list[float]]) -> DataFrame:
    """``at(lc_id, band, time)`` with ``model``, the fitted template of its series and band (one fit of each; null without)."""
    splines = {n: Spline(v) for n, v in templates.items()}

    @F.pandas_udf("double")
    def shape(name: pd.Series, phase: pd.Series) -> pd.Series:
        out = np.full(len(name), np.nan)
        for n, s in splines.items():
            own = (name == n).to_numpy(bool, na_value=False)
            out[own] = s.at(phase[own].to_numpy(float))[0]
        return pd.Series(out)

    joined = at.join(fits.select("lc_id", "band", "period", "template", "offset", "amplitude", "phase"), ["lc_id", "band"], "left")
    value = F.col("offset") + F.col("amplitude") * shape("template", F.col("time") / F.col("period") + F.col("phase"))
    return joined.select(*at.columns, F.when(F.col("template").isNotNull(), value).alias("model"))


def saw(n: int = 64, rise: float = 0.2) -> list[float]:
    """A template that rises fast and falls slowly, rounded off: the first harmonics of a saw tooth."""
    phase = np.arange(n) / n
    return reduce(np.add, [np.sin(2 * np.pi * k * (phase - rise)) / k**1.5 for k in range(1, 5)]).tolist()
