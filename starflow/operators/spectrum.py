"""Periodograms of long series in linear-logarithmic time.

The sums of sines and cosines that the power is made of are Fourier sums at unevenly spaced times: the points are spread
on an even grid by a narrow kernel, transformed by FFT, and divided by the kernel's own transform. That is exact to about
twelve digits and takes ``N log N`` steps, where a join of points and frequencies takes ``7.5 N * N``.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 14  # grid points that a time is spread on
SHARP = 2.30 * WIDTH
FEW = 48  # points up to which the sums are taken as they stand


def _kernel(z: np.ndarray) -> np.ndarray:
    """The spreading function over [-1, 1]."""
    return np.exp(SHARP * (np.sqrt(np.maximum(0.0, 1 - z * z)) - 1))


@cache
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    z, w = np.polynomial.legendre.leggauss(80)
    return z, w * _kernel(z)


def fourier_sums(turn: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """``sum(weights * exp(2i * pi * k * turn))`` for k of 0 to ``most``; a column of ``weights`` each."""
    if len(turn) <= FEW:
        return np.exp(2j * np.pi * np.outer(np.arange(most + 1), turn)) @ weights
    size = 1 << math.ceil(math.log2(4 * most + 2 * WIDTH + 2))  # twice the frequencies of both signs
    at = (turn % 1) * size
    first = np.ceil(at - WIDTH / 2).astype(np.int64)
    cells = first[:, None] + np.arange(WIDTH)
    spread = _kernel((cells - at[:, None]) * (2 / WIDTH))
    cells = (cells % size).ravel()
    z, w = _nodes()
    k = np.arange(most + 1)
    own = WIDTH / 2 * (np.cos(np.pi * WIDTH / size * np.outer(k, z)) @ w)  # the kernel's transform at each frequency
    out = np.empty((most + 1, weights.shape[1]), complex)
    for c in range(weights.shape[1]):
        grid = np.bincount(cells, (spread * weights[:, c : c + 1]).ravel(), size)
        out[:, c] = np.conj(np.fft.rfft(grid)[: most + 1]) / own
    return out


def steps_of(n: int, oversampling: float = 5, nyquist: float = 3) -> int:
    """How many frequencies the grid of a series of ``n`` points has."""
    return max(1, math.floor(0.5 * oversampling * nyquist * n))


def explained(t: np.ndarray, x: np.ndarray, e: np.ndarray, t0: float, length: float, most: int) -> tuple[np.ndarray, float]:
    """What weighted scatter about the mean a sinusoid takes away at each of the frequencies ``k / length``, k from 1 to
    ``most`` (NaN where it isn't defined), and the whole scatter."""
    w = np.where(e > 0, 1 / np.where(e > 0, e, 1) ** 2, 0.0)
    if not w.sum() > 0:
        return np.full(most, np.nan), math.nan
    y, turn = x - (w * x).sum() / w.sum(), (t - t0) / length
    first, second = fourier_sums(turn, (w * y)[:, None], most)[1:, 0], fourier_sums(2 * turn, w[:, None], most)[1:, 0]
    cc, ss, cs = (w.sum() + second.real) / 2, (w.sum() - second.real) / 2, second.imag / 2
    det = cc * ss - cs * cs
    det[np.abs(det) < 1e-12 * w.sum() ** 2] = np.nan  # the sums' own error
    return (ss * first.real**2 + cc * first.imag**2 - 2 * cs * first.real * first.imag) / det, float((w * y * y).sum())


def fast_periodogram(points: DataFrame, oversampling: float = 5, nyquist: float = 3, band: str | None = None) -> DataFrame:
    """``(lc_id, k, frequency, power)`` of ``points(lc_id, time, x, e)`` on the grid of ``periodogram_sql``: multiples of one
    over the span and the oversampling; with a ``band`` column as ``multiband_sql`` has it, bands weighted by their
    scatter. Power is null where it isn't defined, also where a sinusoid is all but constant over the points.

    A series is one task's (its points, 48 bytes each, and the grid must fit it), its frequencies come out in parts. Series
    without a span or without a positive error, and points with nulls, give nothing.
    """

    def run(rows: pa.Table) -> pa.Table:
        t, x, e = (rows[c].to_numpy() for c in names)
        t0, span = t.min(), t.max() - t.min()
        if not span > 0 or not (e > 0).any():
            return rows.slice(0, 0).select(["lc_id"]).append_column("k", pa.array([], pa.int64())).append_column("frequency", pa.array([], pa.float64())).append_column("power", pa.array([], pa.float64()))
        most, length = steps_of(len(t), oversampling, nyquist), span * oversampling
        if band is None:
            gains, scatter = explained(t, x, e, t0, length, most)
        else:
            own = rows["band"].to_pandas().factorize(use_na_sentinel=False)[0]
            found = [explained(t[own == i], x[own == i], e[own == i], t0, length, most) for i in range(own.max() + 1)]
            gains, scatter = sum(np.nan_to_num(g) for g, _ in found), sum(np.nan_to_num(s) for _, s in found)
        k = np.arange(1, most + 1)
        power = gains / scatter if scatter else np.full(most, np.nan)
        name = rows["lc_id"].take(np.zeros(most, np.int64))
        return pa.table({"lc_id": name, "k": k, "frequency": k / length, "power": pa.array(power, mask=np.isnan(power))})

    names = ("time", "x", "e")
    held = points.select("lc_id", *[F.col(c).cast("double").alias(c) for c in names], *([F.col(band).cast("string").alias("band")] if band else [])).dropna(subset=["lc_id", *names])
    kind = dict(held.dtypes)["lc_id"]
    return held.groupBy("lc_id").applyInArrow(run, f"lc_id {kind}, k long, frequency double, power double")
