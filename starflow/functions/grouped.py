"""Features of a series that need a loop, a special function or all pairs: NumPy over one series at a time.

Each takes the values and errors in time order and whether to weight, and returns a number or None.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def weights(e: np.ndarray) -> np.ndarray:
    """1 / e**2, and 0 for errors that are not positive numbers."""
    out = np.zeros(len(e))
    ok = np.isfinite(e) & (e > 0)
    out[ok] = 1 / e[ok] ** 2
    return out


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z) / math.sqrt(2))


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution, by its asymptotic series far below zero."""
    z = np.asarray(z, float)
    out, far = np.empty(len(z)), z < -20
    out[~far] = np.log(normal_cdf(z[~far]))
    t = z[far] ** -2.0
    out[far] = -0.5 * z[far] ** 2 - np.log(-z[far]) - 0.5 * math.log(2 * math.pi) + np.log1p(-t + 3 * t**2 - 15 * t**3)
    return out


def inverse_gaussian_cdf(x: np.ndarray, mu: float) -> np.ndarray:
    """Distribution of the inverse Gaussian of mean mu and unit scale."""
    out, ok = np.zeros(len(x)), x > 0
    root = np.sqrt(x[ok])
    out[ok] = normal_cdf((x[ok] / mu - 1) / root) + np.exp(2 / mu + log_normal_cdf(-(x[ok] / mu + 1) / root))
    return out


def anderson_darling(x, e, weighted):
    n, w = len(x), weights(e) if weighted else np.ones(len(x))
    if not w.sum():
        w = np.ones(n)
    mean = np.average(x, weights=w)
    var = np.average((x - mean) ** 2, weights=w) if weighted else np.var(x, ddof=1)
    if not var > 0:
        return None
    z = np.sort((x - mean) / math.sqrt(var))
    if weighted:
        p = np.clip(normal_cdf(z), np.finfo(float).eps, 1 - np.finfo(float).eps)
        logs = np.log(p) + np.log1p(-p[::-1])
    else:
        logs = log_normal_cdf(z) + log_normal_cdf(-z[::-1])
    a2 = -n - ((2 * np.arange(1, n + 1) - 1) * logs).sum() / n
    return 1 / (1 + math.exp(-10 * (a2 - 0.3)))


# Royston's polynomials (AS R94) for the two outermost coefficients, by descending power.
ROYSTON = ((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0), (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0))


def shapiro_wilk(x, e, weighted):
    n = len(x)
    spread = ((x - x.mean()) ** 2).sum()
    if n < 3 or not spread > 0:
        return None
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        square, u = (m**2).sum(), 1 / math.sqrt(n)
        outer = [np.polyval(c, u) + m[-1 - k] / math.sqrt(square) for k, c in enumerate(ROYSTON[: 1 + (n > 5)])]
        fixed = len(outer)
        phi = (square - 2 * (m[n - fixed :] ** 2).sum()) / (1 - 2 * sum(v * v for v in outer))
        a = m / math.sqrt(phi)
        for k, v in enumerate(outer):
            a[k], a[-1 - k] = -v, v
    return float((a @ np.sort(x)) ** 2 / spread)


def shannon_entropy(x, e, weighted, eps=1e-12):
    centre = np.median(x)
    w = weights(e)
    if weighted and w.sum():
        sigma = math.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))
    else:
        sigma = float(np.std(x)) if weighted else math.sqrt(np.mean((x - centre) ** 2))
    if not sigma > 0 or not centre > 0:
        return None
    bits = np.zeros(len(x))
    for side in (x + e, x - e):
        bits += np.log2(normal_cdf((side - centre) / sigma) + eps) + np.log2(inverse_gaussian_cdf(side / centre, sigma**2 / centre) + eps)
    scale = 1 / (e**2 + eps) if weighted else 1.0
    return float(-(scale * 2 * e * bits).sum())


def prominence_peaks(x, e, weighted, threshold=0.3, apart=25):
    """Share of points that are peaks above a share of the range, the higher of two nearer than ``apart``."""
    amp = x * weights(e) if weighted and weights(e).sum() else x
    slope = np.diff(x)
    if not slope.any():
        return 0.0
    flat = slope == 0
    edges = np.flatnonzero(np.diff(np.r_[0, flat.view(np.int8), 0]))
    filled = slope.copy()
    for a, b in zip(edges[::2], edges[1::2], strict=True):  # a flat stretch takes the slopes at its ends
        left, right = (slope[a - 1] if a else slope[b]), (slope[b] if b < len(slope) else slope[a - 1])
        middle = (a + b - 1) // 2 if a and b < len(slope) else a
        filled[a:middle], filled[middle:b] = left, right
    level = threshold * (amp.max() - amp.min()) + amp.min()
    peaks = np.flatnonzero((np.r_[filled, 0.0] < 0) & (np.r_[0.0, filled] > 0) & (amp > level))
    kept: list[int] = []
    for p in sorted(peaks, key=lambda k: (-amp[k], -k)):
        if all(abs(p - k) > apart for k in kept):
            kept.append(p)
    return len(kept) / len(x)


def cwt_like_peaks(x, e, weighted, prominence=0.5, width=5.0):
    """Share of points that are peaks of some prominence and of some width at half of it."""
    y = x / np.maximum(e, 1e-6) if weighted else x
    n, count, k = len(y), 0, 1
    while k < n - 1:
        end = k
        while end < n - 1 and y[end + 1] == y[k]:
            end += 1
        if y[k - 1] < y[k] and end < n - 1 and y[end + 1] < y[k]:
            peak = (k + end) // 2
            count += _prominent(y, peak, prominence, width)
        k = end + 1
    return count / n


def _prominent(y: np.ndarray, peak: int, prominence: float, width: float) -> bool:
    higher = np.flatnonzero(y > y[peak])
    left, right = higher[higher < peak], higher[higher > peak]
    lo, hi = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(y))
    left_base = peak - int(y[lo : peak + 1][::-1].argmin())
    right_base = peak + int(y[peak:hi].argmin())
    own = y[peak] - max(y[left_base], y[right_base])
    if own < prominence:
        return False
    half, a, b = y[peak] - own / 2, peak, peak
    while a > left_base and half < y[a]:
        a -= 1
    while b < right_base and half < y[b]:
        b += 1
    start = a + (half - y[a]) / (y[a + 1] - y[a]) if y[a] < half else a
    stop = b - (half - y[b]) / (y[b - 1] - y[b]) if y[b] < half else b
    return stop - start >= width


def has_near_pair(x, e, weighted):
    """Whether two values differ by twice their joint error at most (unweighted: are equal)."""
    if not weighted:
        return float(len(np.unique(x)) < len(x))
    order = np.argsort(x, kind="stable")
    x, e = x[order], e[order]
    reach = 2 * math.sqrt(2) * np.abs(e).max(initial=0.0)
    for k in range(1, len(x)):
        gap = x[k:] - x[:-k]
        if (gap <= 2 * np.sqrt(e[k:] ** 2 + e[:-k] ** 2)).any():
            return 1.0
        if gap.min() > reach:  # points further apart in the order only differ more
            break
    return 0.0


def recurring_share(x, e, weighted):
    """Share of the distinct values that more than one point equals, within its error.

    A point equals the values of an interval: its ends are found in the sorted values, and starts less stops before a
    value count the points that reach it."""
    values, times = np.unique(x, return_counts=True)
    if not weighted:
        return float((times > 1).mean())
    slack, n = 1e-5, len(values)
    equal = lambda k: np.abs(x - values[k]) <= e + slack * np.abs(values[k])
    steps = np.zeros(n + 1, np.int64)
    low, high = x - e, x + e
    first = np.searchsorted(values, np.where(low >= 0, low / (1 + slack), low / (1 - slack)))
    last = np.searchsorted(values, np.where(high >= 0, high / (1 - slack), high / (1 + slack)), "right") - 1
    for _ in range(2):  # ends that rounding has put next to the last equal value
        first -= (first > 0) & equal(np.maximum(first - 1, 0))
        last += (last < n - 1) & equal(np.minimum(last + 1, n - 1))
    for _ in range(2):
        first += (first <= last) & ~equal(np.clip(first, 0, n - 1))
        last -= (last >= first) & ~equal(np.clip(last, 0, n - 1))
    some = first <= last
    np.add.at(steps, first[some], 1)
    np.add.at(steps, last[some] + 1, -1)
    return float((steps.cumsum()[:-1] > 1).mean())


def sample_entropy(x, e, weighted, m=2, share=0.2, block=256):
    """Logarithm of how many more templates of ``m`` than of ``m + 1`` points match. Templates are sorted by their first
    value and only compared with those whose first value is near."""
    r, n = share * x.std(), len(x)

    def matches(length: int) -> int:
        rows = n - length + 1
        if rows < 1:
            return 0
        order = np.argsort(x[:rows], kind="stable")
        columns = [x[k : rows + k][order] for k in range(length)]
        lead, reach, total = columns[0], r * (1 + 1e-9) + 1e-300, -rows
        for lo in range(0, rows, block):
            hi = min(rows, lo + block)
            near = slice(np.searchsorted(lead, lead[lo] - reach), np.searchsorted(lead, lead[hi - 1] + reach, "right"))
            hit = np.abs(columns[0][lo:hi, None] - columns[0][None, near]) <= r
            for c in columns[1:]:
                hit &= np.abs(c[lo:hi, None] - c[None, near]) <= r
            total += int(np.count_nonzero(hit))
        return total

    b, a = matches(m), matches(m + 1)
    return -math.log(a / b) if a > 0 and b > 0 else None


FEATURES = {
    "AndersonDarling": anderson_darling,
    "check_for_duplicate": has_near_pair,
    "number_cwt_like_peaks": cwt_like_peaks,
    "prominence_peaks": prominence_peaks,
    "ratio_recurring_points": recurring_share,
    "sample_entropy": sample_entropy,
    "shannon_entropy": shannon_entropy,
    "shapiro_wilk": shapiro_wilk,
}
