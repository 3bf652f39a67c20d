"""Every feature of one series in NumPy, by its definition, as an independent check of the SQL."""

import math
from collections import Counter

import numpy as np


def safe(e):
    return np.array([1 / v**2 if v > 0 and np.isfinite(v) else 0.0 for v in e])


def wq(x, w, q):
    """Quantile by interpolation over cumulative weight."""
    order = np.lexsort((np.arange(len(x)), x))
    x, w = x[order], w[order]
    return np.float64(np.interp(q, np.cumsum(w) / w.sum(), x)) if len(x) and w.sum() else np.nan


def runs(mask):
    out, k = [], 0
    for m in mask:
        k = k + 1 if m else 0
        if m:
            out.append(k)
    return out


def first_digit(v):
    return int(abs(v) / 10.0 ** np.floor(np.log10(abs(v))))


def log_phi(z):
    """Logarithm of the normal distribution, in the far tail by its continued fraction."""
    if z >= -8:
        return math.log(phi(z))
    f = 0.0
    for k in range(60, 0, -1):
        f = k / (-z + f)
    return -z * z / 2 - math.log(math.sqrt(2 * math.pi) * (-z + f))


def phi(z):
    """The normal distribution by Simpson's rule over its density, from the far tail."""
    if z < -8:
        return math.exp(log_phi(z))
    if z > 12:
        return 1.0
    grid = np.linspace(-12, z, 8001)
    density = np.exp(-(grid**2) / 2) / math.sqrt(2 * math.pi)
    return float((density[0] + density[-1] + 4 * density[1:-1:2].sum() + 2 * density[2:-1:2].sum()) * (grid[1] - grid[0]) / 3)


def anderson(x, w, weighted):
    """Logistic of the Anderson-Darling statistic, point by point."""
    n = len(x)
    mu = sum(w * x) / sum(w)
    sd = math.sqrt(sum(w * (x - mu) ** 2) / sum(w)) if weighted else float(np.std(x, ddof=1))
    p = [phi((v - mu) / sd) for v in sorted(x)]
    tail = [phi(-(v - mu) / sd) for v in sorted(x)]
    if weighted:
        eps = float(np.finfo(float).eps)
        p, tail = [min(max(v, eps), 1 - eps) for v in p], [min(max(v, eps), 1 - eps) for v in tail]
    a2 = -n - sum((2 * i + 1) * (math.log(p[i]) + math.log(tail[n - 1 - i])) for i in range(n)) / n
    return 1 / (1 + math.exp(-10 * (a2 - 0.3)))


def shannon(x, e, w, weighted):
    """Bits of the normal and the inverse normal distribution at each value plus and minus its error."""
    centre = float(np.median(x))
    sd = math.sqrt(sum(w * (x - sum(w * x) / sum(w)) ** 2) / sum(w)) if weighted else math.sqrt(np.mean((x - centre) ** 2))
    if not centre > 0:
        return math.nan
    total, mu = 0.0, sd * sd / centre
    for v, s in zip(x, e):
        for side in (v + s, v - s):
            y = side / centre
            inverse = phi((y / mu - 1) / math.sqrt(y)) + math.exp(2 / mu + log_phi(-(y / mu + 1) / math.sqrt(y))) if y > 0 else 0.0
            total += (1 / (s * s + 1e-12) if weighted else 1.0) * 2 * s * (math.log2(phi((side - centre) / sd) + 1e-12) + math.log2(inverse + 1e-12))
    return -total


def features(t, x, e, weighted):
    with np.errstate(all="ignore"):
        return _features(t, x, e, weighted)


def _features(t, x, e, weighted):
    n, w0 = len(x), safe(e)
    w = w0 if weighted and w0.sum() else np.ones(n)
    mean = lambda v, ww: np.float64((ww * v).sum() / ww.sum()) if weighted else np.float64(np.mean(v))
    med, mu = np.float64(np.median(x)), np.float64((w * x).sum() / w.sum())
    var = np.float64((w * (x - mu) ** 2).sum() / w.sum())
    sd, s0, span = np.sqrt(var), float(np.std(x)), float(np.ptp(x))
    q = (lambda p: wq(x, w0, p)) if weighted else (lambda p: np.float64(np.quantile(x, p)))
    wmed, d, dt = q(0.5), np.diff(x), np.diff(t)
    e2 = e[1:] ** 2 + e[:-1] ** 2
    e3 = e[2:] ** 2 + e[1:-1] ** 2 + e[:-2] ** 2
    share = lambda m: float(w[m].sum() / w.sum())
    out = {"AndersonDarling": anderson(x, w, weighted), "shannon_entropy": shannon(x, e, w, weighted and bool(w0.sum()))}
    for name, k in (("20", 0.1), ("35", 0.175), ("50", 0.25), ("65", 0.325), ("80", 0.4)):
        out[f"FluxPercentileRatioMid{name}"] = (q(0.5 + k) - q(0.5 - k)) / (q(0.95) - q(0.05))
    lo, hi = x <= q(0.03), x >= q(0.97)
    out["Gskew"] = wq(x[lo], w0[lo], 0.5) + wq(x[hi], w0[hi], 0.5) - 2 * wmed if weighted else np.median(x[lo]) + np.median(x[hi]) - 2 * med
    tm = (w * t).sum() / w.sum()
    out["LinearTrend"] = (w * (t - tm) * (x - mu)).sum() / (w * (t - tm) ** 2).sum()
    ok = dt != 0
    slope = np.abs(d[ok] / dt[ok])
    out["MaxSlope"] = mean(slope, 1 / e2[ok]) if weighted else slope.max()
    tail, te = np.diff(x[-30:]), 1 / (e[-30:][1:] ** 2 + e[-30:][:-1] ** 2)
    out["PairSlopeTrend"] = te[tail > 0].sum() / te[tail != 0].sum() if weighted else np.mean(tail > 0)
    out["PercentAmplitude"] = np.abs(x - wmed).max() / wmed
    out["PercentDifferenceFluxPercentile"] = (q(0.95) - q(0.05)) / q(0.5)
    for k in (1, 3, 5):
        out[f"above{k}"], out[f"below{k}"] = share(k * (x - med) > s0), share(-k * (x - med) > s0)
        spread = e if weighted else np.std(x, ddof=1)
        out[f"con_above{k}"] = runs(x >= med + k * spread).count(3) / n
        out[f"con_below{k}"] = runs(x <= med - k * spread).count(3) / n
    out["abs_energy"] = (w0 * x**2).sum() if weighted else (x**2).sum()
    out["abs_sum_changes"] = (np.abs(d) / np.sqrt(e2)).sum() if weighted else np.abs(d).sum()
    if weighted:
        order = np.argsort(x, kind="stable")
        cum = np.cumsum(w0[order])
        step = lambda p: x[order][np.searchsorted(cum, p * cum[-1] * (1 - 1e-12))]
        out["amplitude"] = step(0.99) - step(0.01)
    else:
        out["amplitude"] = np.quantile(x, 0.99) - np.quantile(x, 0.01)
    out["median_buffer_range"] = np.mean(np.abs(x - (mu if weighted else med)) < 0.1 * out["amplitude"])
    wp = np.sqrt(w[1:] * w[:-1])
    out["auto_corr"] = (wp * (x[1:] - mu) * (x[:-1] - mu)).sum() / (w * (x - mu) ** 2).sum() if weighted else np.corrcoef(x[1:], x[:-1])[0, 1]
    digits = np.array([first_digit(v) if v else 0 for v in x])
    freq = np.array([w[digits == k].sum() for k in range(1, 10)]) / w[digits > 0].sum()
    out["benford_correlation"] = np.corrcoef(freq, np.log10(1 + 1 / np.arange(1, 10)))[0, 1]
    out["c3"] = mean(x[2:] * x[1:-1] * x[:-2], 1 / e3)
    tol = 3 * e if weighted else 0
    for name, edge in (("max", x.max()), ("min", x.min())):
        at = np.flatnonzero(np.abs(x - edge) <= tol)
        out[f"check_for_{name}_duplicate"], out[f"check_{name}_last_loc"] = float(len(at) > 1), 1 - at[-1] / n
    out["complexity"] = np.sqrt(mean(d**2, w0[:-1]))
    out["count_above"], out["count_below"] = share(x > wmed), share(x < wmed)
    sig = np.sqrt((w * (x - med) ** 2).sum() / w.sum()) if weighted else s0
    out["cusum"] = np.ptp(np.cumsum(x - med)) / (n * sig)
    out["first_loc_max"], out["first_loc_min"] = np.argmax(x * w) / n, np.argmin(x * w) / n
    up = x > med
    half = lambda m: ((w * (x - med) ** 2)[m]).sum() / w[m].sum()
    out["half_mag_amplitude_ratio"] = np.sqrt(half(up) / half(~up))
    mass = np.cumsum(np.abs(x) * w)
    out["index_mass_quantile"] = (np.searchsorted(mass, 0.5 * mass[-1] * (1 - 1e-12)) + 1) / n
    out["integrate"] = ((x[1:] + x[:-1]) / 2 * dt).sum()
    out["kurtosis"] = (w * (x - mu) ** 4).sum() / w.sum() / var**2 - 3
    out["skewness"] = (w * (x - mu) ** 3).sum() / w.sum() / var**1.5 * (1 if weighted else np.sqrt(n * (n - 1)) / (n - 2))
    out["large_standard_deviation"] = float(sd > 0.3 * span)
    out["longest_strike_above"] = max(runs(x > wmed + (e if weighted else 0)), default=0) / n
    out["longest_strike_below"] = max(runs(x < wmed - (e if weighted else 0)), default=0) / n
    out["meanMag"] = out["sum_values"] = mu
    out["mean_abs_change"] = mean(np.abs(d), 1 / (e[1:] + e[:-1]))
    out["mean_change"] = mean(d, 1 / e2)
    top = np.lexsort((np.arange(n), -np.abs(x)))[:10]
    out["mean_n_abs_max"] = mean(np.abs(x[top]), w0[top])
    good = (dt[1:] > 0) & (dt[:-1] > 0)
    bend = 2 / (t[2:] - t[:-2])[good] * (d[1:][good] / dt[1:][good] - d[:-1][good] / dt[:-1][good])
    out["mean_second_derivative"] = mean(bend, 1 / e3[good])
    if weighted:
        order = np.argsort(x, kind="stable")
        out["medianAbsDev"] = np.interp(0.5, np.cumsum(w0[order]) / w0.sum(), np.abs(x[order] - wmed))
    else:
        out["medianAbsDev"] = np.median(np.abs(x - med))
    out["median_distance"] = np.median(np.sqrt((d**2 + dt**2) / (e2 if weighted else 1)))
    cross = up[1:] != up[:-1]
    out["number_of_crossings"] = (cross & (np.abs(d) > e[:-1]) if weighted else cross).sum() / n
    patterns = Counter(tuple(np.argsort(x[i : i + 3], kind="stable")) for i in range(n - 2))
    out["permutation_entropy"] = -sum(c / (n - 2) * math.log(c / (n - 2)) for c in patterns.values())
    for p in (5, 25, 50, 75, 95):
        out[f"quantile_{p}"] = np.quantile(x, p / 100)
    out["root_mean_squared"], out["variance"] = sd, var
    out["std_over_mean"] = out["variation_coefficient"] = sd / mu
    delta = np.sqrt(n / (n - 1)) * (x - med) / e
    pair = delta[1:] * delta[:-1]
    out["stetsonJ"] = (np.sign(pair) * np.sqrt(np.abs(pair))).mean()
    out["stetsonK"] = np.abs(delta).mean() / np.sqrt((delta**2).mean())
    out["stetsonL"] = out["stetsonJ"] * out["stetsonK"] / 0.798
    out["symmetry_looking"] = float(abs(mu - wmed) < 0.5 * span)
    out["time_reversal_asymmetry"] = mean((x[2:] - x[:-2]) * (x[1:-1] - x[:-2]), 1 / e3)
    d3, we = x[3:] - x[:-3], 1 / (e[3:] ** 2 + e[:-3] ** 2)
    out["time_reversal_asymmetry_normalized"] = mean(d3**3, we) / mean(d3**2, we) ** 1.5
    out["variance_larger_than_standard_deviation"] = float(var > sd)
    out["vonNeumannRatio"] = (wp * d**2).sum() / wp.sum() / var
    peaks = 0
    for i in range(7, n - 7):
        others = [j for j in range(i - 7, i + 8) if j != i]
        peaks += all(x[i] - x[j] > (math.hypot(e[i], e[j]) if weighted else 0) for j in others)
    out["windowed_peak_fraction"] = peaks / n
    if weighted:
        out["check_for_duplicate"] = float(any(abs(x[i] - x[j]) <= 2 * math.hypot(e[i], e[j]) for i in range(n) for j in range(i)))
        values = sorted(set(x))
        out["ratio_recurring_points"] = sum(sum(abs(a - v) <= b + 1e-5 * abs(v) for a, b in zip(x, e)) > 1 for v in values) / len(values)
    else:
        times = Counter(x)
        out["check_for_duplicate"] = float(len(times) < n)
        out["ratio_recurring_points"] = sum(c > 1 for c in times.values()) / len(times)
    r = 0.2 * s0
    near = lambda m: sum(max(abs(x[i + k] - x[j + k]) for k in range(m)) <= r for i in range(n - m + 1) for j in range(n - m + 1) if i != j)
    a, b = near(3), near(2)
    out["sample_entropy"] = -math.log(a / b) if a and b else np.nan
    return {k: float(v) for k, v in out.items()}


def gradient(f, t):
    return np.gradient(f, t)


def derivative(t, r, re, e):
    """(time, raw, raw error), (time, normalised, error) of the derivative space."""
    with np.errstate(all="ignore"):
        fd = np.gradient(r) / np.gradient(t)
        fde = np.abs(np.gradient(fd, t) / fd) * re
        m = np.isfinite(fd) & np.isfinite(fde)
        t, fd, fde, e = t[m], fd[m], fde[m], e[m]
        nfd = fd / fd.max()
        nfde = np.abs(np.gradient(nfd, t) / nfd) * e
        k = np.isfinite(nfd) & np.isfinite(nfde)
    return (t, fd, fde), (t[k], nfd[k], nfde[k])
