"""The features of a light curve that SQL expresses, as one chain of window stages and one aggregation.

The chain reads a relation ``(lc_id, seq, time, x, e)``: a series' points in a total order of ``(time, seq)``, values
and errors. All windows and the aggregation are partitioned by ``lc_id``, so that Spark shuffles the points once and
sorts each series three times: by time, by value, by absolute value. A stage computes what later stages share (weights,
medians, neighbours, weighted cumulative shares, run positions); every feature is then one aggregate expression.

Quantiles are read at the points whose ranks or weighted shares enclose them, and what needs another order of the points is
a window column: an aggregate that gathers values would make Spark sort the widened points once more.

A run of consecutive points that meet a condition is followed by its position, the distance to the last point that did
not meet it: the number of runs of three or more is the number of points at position three, the longest run the
largest position. That replaces a grouping by runs.

Rows with null or non-finite values are to be removed before (``operators.prepare``). Undefined features are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: Features that Python computes per series (``functions.grouped``).
GROUPED = ("AndersonDarling", "check_for_duplicate", "number_cwt_like_peaks", "prominence_peaks", "ratio_recurring_points",
           "sample_entropy", "shannon_entropy", "shapiro_wilk")
#: Registered aggregate expressions by name, given whether to weight (``functions.registry``).
OWN: dict[str, Callable[[bool], str]] = {}
#: Features of the flux itself; all others are of the flux divided by its maximum.
RAW = ("amplitude", "median_buffer_range")
TOLERANCE = "1e-12"  # of cumulative shares, whose sums depend on the order of addition


def _fused(a: str, b: str, c: str) -> str:
    """``a * b + c`` rounded once, as the SQL's side interpolates quantiles: the errors of product and sum are added at the end."""
    high = lambda v: f"(134217729e0 * {v} - (134217729e0 * {v} - {v}))"  # noqa: E731  the upper half of the digits
    low = lambda v: f"({v} - {high(v)})"
    product, whole = f"({a} * {b})", f"({a} * {b} + {c})"
    lost = f"((({high(a)} * {high(b)} - {product}) + {high(a)} * {low(b)} + {low(a)} * {high(b)}) + {low(a)} * {low(b)})"
    then = f"({product} - ({whole} - ({whole} - {product})) + ({c} - ({whole} - {product})))"
    return f"({whole} + ({lost} + {then}))"


@dataclass(frozen=True)
class Dialect:
    """What differs between SQL engines: the exact, linearly interpolated quantile of a value. The quantiles of a
    series' values are taken together, so that the values are gathered once, or ``ranked``: by the places of the points."""

    single: Callable[[str, float], str]
    several: Callable[[str, str, int], str]
    ranked: bool = False

    def quantile(self, x: str, q: float, over: str = "") -> str:
        if x != "x":
            return self.single(x, q)
        if self.ranked:
            at = f"(n - 1) * {q}e0"
            between = f"(ceil({at}) - {at}) * x + ({at} - floor({at})) * next_x"
            if over:  # compared with values, which lie on its borders to the last bit
                between = f"CASE WHEN abs(x) < 1e290 AND abs(next_x) < 1e290 THEN {_fused('x', f'(1 - ({at} - floor({at})))', f'(next_x * ({at} - floor({at})))')} ELSE {between} END"
            return f"max(CASE WHEN rn = floor({at}) + 1 THEN CASE WHEN ceil({at}) = floor({at}) OR next_x = x THEN x ELSE {between} END END){over}"
        return self.several(x, ", ".join(map(str, PLAIN)), PLAIN.index(q))


PLAIN = (0.01, 0.05, 0.1, 0.175, 0.25, 0.325, 0.4, 0.5, 0.6, 0.675, 0.75, 0.825, 0.9, 0.95, 0.99)
SPARK = Dialect(lambda x, q: f"percentile({x}, {q})", lambda x, qs, k: f"percentile({x}, array({qs}))[{k}]", True)
DUCKDB = Dialect(lambda x, q: f"quantile_cont({x}, {q})", lambda x, qs, k: f"quantile_cont({x}, [{qs}])[{k + 1}]")

LEVELS = {"above1": 1, "above3": 3, "above5": 5, "below1": -1, "below3": -3, "below5": -5}
RUNS = {f"con_{side}{k}": (f"x >= med + {k} * spread" if side == "above" else f"x <= med - {k} * spread") for side in ("above", "below") for k in (1, 3, 5)}


def _shared(weighted: bool, d: Dialect, source: str) -> str:
    """The common table expressions that end in ``points``."""
    ahead = ", ".join(f"lead({c}, {k}) OVER t AS {c}{k}" for c in ("x", "time", "e") for k in (1, 2, 3))
    near = range(1, 8)
    if weighted:
        beats = lambda f, k: f"x - {f}(x, {k}) OVER t > sqrt(e * e + ({f}(e, {k}) OVER t) * ({f}(e, {k}) OVER t))"
        peak = " AND ".join(beats(f, k) for k in near for f in ("lag", "lead"))
    else:
        peak = "x > max(x) OVER (PARTITION BY lc_id ORDER BY time, seq ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AND x > max(x) OVER (PARTITION BY lc_id ORDER BY time, seq ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)"
    run = lambda name, test: f"i - coalesce(max(CASE WHEN NOT ({test}) THEN i END) OVER (PARTITION BY lc_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING), -1) AS {name}"
    up, down = ("x > wmed + e", "x < wmed - e") if weighted else ("x > med", "x < med")
    at = lambda q: f"coalesce({_crossing('x', q, ' OVER p') if d.ranked else _interpolated('x', 'cdf', 'rn', q, ' OVER p')}, med)"
    quantile = lambda x, q: f"{d.single(x, q)} OVER p"
    wmed, q3, q97 = (at(0.5), at(0.03), at(0.97)) if weighted else ("med", quantile("x", 0.03), quantile("x", 0.97))
    after, gathered, halves = "", "", ""
    if d.ranked:
        after = "lead(x, 1) OVER v AS next_x, "
        upto = "sum(w0) OVER (PARTITION BY lc_id ORDER BY x, time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING)"
        gathered = f"{upto} / nullif(total0, 0) AS next_cdf, {quantile('abs(x - med)', 0.5)} AS mad, {quantile(_distance(weighted), 0.5)} AS apart, "
        halves = f"{quantile('CASE WHEN x <= q3 THEN x END', 0.5)} AS med_lo, {quantile('CASE WHEN x >= q97 THEN x END', 0.5)} AS med_hi, 0.1 * ({_amplitude(weighted, d, ' OVER p')}) AS width, "
    return f"""
weighed AS (
  SELECT lc_id, seq, time, x, e, {"CASE WHEN e > 0 THEN 1 / (e * e) ELSE 0e0 END" if weighted else "1e0"} AS w0,
         {"CASE WHEN e <> 0 THEN 1 / (e * e) END" if weighted else "1e0"} AS raw_w FROM {source}),
ordered AS (
  SELECT *, CASE WHEN sum(w0) OVER p = 0 THEN 1e0 ELSE w0 END AS w, sum(w0) OVER p AS total0, count(*) OVER p AS n,
         avg(x) OVER p AS mean, {quantile("x", 0.5)} AS med, stddev_pop(x) OVER p AS s0, stddev_samp(x) OVER p AS s1,
         max(x) OVER p AS mx, min(x) OVER p AS mn, time - min(time) OVER p AS since, row_number() OVER t - 1 AS i, row_number() OVER v AS rn,
         lag(x, 1) OVER v AS below_x, lag(x, 2) OVER v AS below_x2, {after}row_number() OVER a AS ra,
         lag(x, 1) OVER t AS x_1, lag(time, 1) OVER t AS time_1, lag(e, 1) OVER t AS e_1, lag(w0, 1) OVER t AS w0_1, {ahead},
         lead(w0, 1) OVER t AS w01
  FROM weighed
  WINDOW p AS (PARTITION BY lc_id), t AS (PARTITION BY lc_id ORDER BY time, seq),
         v AS (PARTITION BY lc_id ORDER BY x, time, seq), a AS (PARTITION BY lc_id ORDER BY abs(x) DESC, time, seq)),
summed AS (
  SELECT *, sum(w) OVER p AS total, sum(w * x) OVER p / sum(w) OVER p AS mu,
         sum(w * (x - med) * (x - med)) OVER p / sum(w) OVER p AS var_med,
         sum(w0) OVER (PARTITION BY lc_id ORDER BY x, time, seq ROWS UNBOUNDED PRECEDING) / nullif(total0, 0) AS cdf, {gathered}
         sum(abs(x) * raw_w) OVER (PARTITION BY lc_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS mass,
         sum(abs(x) * raw_w) OVER p AS whole_mass, sum(x - med) OVER (PARTITION BY lc_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS drift,
         max(x * w) OVER p AS mxw, min(x * w) OVER p AS mnw, {"e" if weighted else "s1"} AS spread,
         CASE WHEN i >= 7 AND i < n - 7 AND {peak} THEN 1 ELSE 0 END AS peak,
         CASE WHEN x2 IS NULL THEN NULL ELSE 9 * {_rank("x", ("x1", "x2"), ())} + 3 * {_rank("x1", ("x2",), ("x",))} + {_rank("x2", (), ("x", "x1"))} END AS pattern,
         CASE WHEN x <> 0 THEN least(9, greatest(1, floor(abs(x) / pow(10e0, floor(log10(abs(x))))))) END AS digit
  FROM ordered WINDOW p AS (PARTITION BY lc_id), t AS (PARTITION BY lc_id ORDER BY time, seq)),
centred AS (
  SELECT *, sum(w * (x - mu) * (x - mu)) OVER p / total AS var, {wmed} AS wmed, {q3} AS q3, {q97} AS q97
  FROM summed WINDOW p AS (PARTITION BY lc_id)),
points AS (
  SELECT *, {", ".join(run(f"run_{name}", test) for name, test in RUNS.items())},
         {run("run_up", up)}, {run("run_down", down)},
         {halves}sum(CASE WHEN x <= q3 THEN w0 ELSE 0 END) OVER p AS total_lo, sum(CASE WHEN x >= q97 THEN w0 ELSE 0 END) OVER p AS total_hi
  FROM centred WINDOW p AS (PARTITION BY lc_id))"""


def _pruned(chain: str, used: str) -> str:
    """The stages without the columns that neither a later stage nor ``used`` names: less for the engine to plan."""
    stages = re.split(r"(?<=\)),\n(?=\w+ AS \()", chain.strip())
    for k in range(len(stages) - 1, -1, -1):
        head, columns, tail = _select(stages[k])
        later = set(re.findall(r"\w+", used))
        kept = [c for c in columns if c == "*" or re.search(r"(\w+)$", c)[1] in later]
        stages[k] = f"{head}{', '.join(kept)}{tail}"
        used += " " + " ".join(kept) + tail
    return "\n" + ",\n".join(stages)


def _select(stage: str) -> tuple[str, list[str], str]:
    """A stage as what stands before its columns, the columns, and what follows them."""
    start = stage.index("SELECT ") + 7
    depth, parts, last = 0, [], start
    for k in range(start, len(stage)):
        depth += (stage[k] == "(") - (stage[k] == ")")
        if depth == 0 and (stage[k] == "," or stage.startswith("FROM ", k) and stage[k - 1] in " \n"):
            parts.append(stage[last:k].strip())
            last = k + 1
            if stage[k] != ",":
                return stage[:start], parts, " " + stage[k:]
    raise ValueError(stage)


def _rank(x: str, later: tuple[str, ...], earlier: tuple[str, ...]) -> str:
    """How many of a point's neighbours sort before it, the earlier of equals first."""
    tests = [f"CASE WHEN {y} < {x} THEN 1 ELSE 0 END" for y in later] + [f"CASE WHEN {y} <= {x} THEN 1 ELSE 0 END" for y in earlier]
    return f"({' + '.join(tests)})"


def _interpolated(value: str, cdf: str, rank: str, q: float | str, over: str = "", where: str = "true") -> str:
    """A value interpolated over a cumulative share at q, the smallest below its first and the largest above its last."""
    lo, hi = f"{cdf} <= {q} + {TOLERANCE}", f"{cdf} > {q} + {TOLERANCE}"
    pick = lambda f, of, side: f"{f}({of}, CASE WHEN {side} AND {where} THEN {rank} END){over}"
    low, high = pick("max_by", value, lo), pick("min_by", value, hi)
    low_c, high_c = f"max(CASE WHEN {lo} AND {where} THEN {cdf} END){over}", f"min(CASE WHEN {hi} AND {where} THEN {cdf} END){over}"
    return f"CASE WHEN {low_c} IS NULL THEN {high} WHEN {high_c} IS NULL THEN {low} ELSE {low} + ({high} - {low}) * ({q} - {low_c}) / ({high_c} - {low_c}) END"


def _crossing(value: str, q: float, over: str = "", where: str = "true", cdf: str = "{}") -> str:
    """``_interpolated`` in one aggregate: at the last point whose share is not above q, towards the next one by value.

    ``where`` holds for neighbours by value, ``cdf`` makes a share of ``cdf`` or ``next_cdf``."""
    share, then, limit = cdf.format("cdf"), cdf.format("next_cdf"), f"{q} + {TOLERANCE}"
    ahead = lambda text: re.sub(r"\bx\b", "next_x", text)
    end = "rn = n" if where == "true" else f"(rn = n OR NOT ({ahead(where)}))"
    between = f"{value} + ({ahead(value)} - {value}) * ({q} - {share}) / nullif({then} - {share}, 0)"
    found = f"max(CASE WHEN {share} <= {limit} AND {where} AND ({end} OR {then} > {limit}) THEN CASE WHEN {end} THEN {value} ELSE {between} END END){over}"
    lowest = re.sub(r"\bx\b", "mn", value) if where == "true" else f"CASE WHEN {where} THEN {value} END"
    return f"coalesce({found}, min(CASE WHEN {share} IS NOT NULL THEN {lowest} END){over})"


def _amplitude(weighted: bool, d: Dialect, over: str = "") -> str:
    """Range of the values without the outermost hundredths, by shares of the weights."""
    plain = f"({d.quantile('x', 0.99, over)} - {d.quantile('x', 0.01, over)})"
    if not weighted:
        return plain
    at = lambda p: f"min(CASE WHEN cdf >= {p} - {TOLERANCE} THEN x END){over}"
    return f"CASE WHEN max(total0){over} = 0 THEN {plain} ELSE {at(0.99)} - {at(0.01)} END"


def _distance(weighted: bool) -> str:
    """How far a point is from the next in time and value."""
    square = "(x1 - x) * (x1 - x) + (time1 - time) * (time1 - time)"
    return f"sqrt(({square}) / nullif(e * e + e1 * e1, 0))" if weighted else f"sqrt({square})"


def expressions(weighted: bool, d: Dialect) -> dict[str, str]:
    """Every feature as an aggregate expression over ``points``, by name."""
    some = lambda x: f"max({x})"  # noqa: E731  a value that all points of a series share
    n, total, med, mu, var = some("n"), some("total"), some("med"), some("mu"), some("var")
    part = lambda test: f"(sum(CASE WHEN {test} THEN w ELSE 0 END) / sum(w))"
    count = lambda test: f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)"
    flag = lambda test: f"CASE WHEN {test} THEN 1e0 ELSE 0e0 END"

    def q(p: float) -> str:
        if weighted:
            return _crossing("x", p) if d.ranked else _interpolated("x", "cdf", "rn", p)
        return d.quantile("x", p)

    def mean(value: str, err2: str) -> str:
        """Mean over the points that have the value, weighted by the inverse of ``err2``."""
        if not weighted:
            return f"avg({value})"
        given = f"CASE WHEN {value} IS NOT NULL THEN {err2} END"
        return f"CASE WHEN min({given}) = 0 THEN NULL ELSE sum(({value}) / nullif({given}, 0)) / nullif(sum(1 / nullif({given}, 0)), 0) END"

    e01, e012, e03 = "e * e + e1 * e1", "e * e + e1 * e1 + e2 * e2", "e * e + e3 * e3"
    step, slope = "(x1 - x)", "abs(x1 - x) / nullif(time1 - time, 0)"
    bend = "CASE WHEN time1 > time AND time > time_1 THEN 2 / (time1 - time_1) * ((x1 - x) / (time1 - time) - (x - x_1) / (time - time_1)) END"
    same, last30 = f"sum(CASE WHEN ra <= 10 THEN {{}} END)", "i >= n - 30 AND x1 IS NOT NULL"
    share = {k: f"sum(CASE WHEN digit = {k} THEN w ELSE 0 END) / nullif(sum(CASE WHEN digit IS NOT NULL THEN w END), 0)" for k in range(1, 10)}
    law = {k: f"(log10(1 + 1 / {k}e0) - 1 / 9e0)" for k in range(1, 10)}
    pairs = f"({n} - 1)"
    a, b = "(CASE WHEN x1 IS NOT NULL THEN x - mean END)", "(x1 - mean)"
    spread_ab = f"(sum({a} * {a}) - sum({a}) * sum({a}) / {pairs}) * (sum({b} * {b}) - sum({b}) * sum({b}) / {pairs})"
    pearson = f"CASE WHEN {n} < 3 THEN NULL ELSE (sum({a} * {b}) - sum({a}) * sum({b}) / {pairs}) / nullif(sqrt(greatest({spread_ab}, 0)), 0) END"
    root = "sqrt(w * CASE WHEN total0 = 0 THEN 1 ELSE w01 END)"
    delta = lambda x, e: f"(sqrt(n / (n - 1e0)) * ({x} - med) / nullif({e}, 0))"
    product = f"({delta('x', 'e')} * {delta('x1', 'e1')})"
    ok = f"CASE WHEN {n} > 1 AND min(abs(e)) > 0 THEN {{}} END"
    stetson_j = ok.format(f"sum(CASE WHEN n > 1 AND x1 IS NOT NULL THEN sign({product}) * sqrt(abs({product})) END) / {pairs}")
    stetson_k = ok.format(f"(sum(CASE WHEN n > 1 THEN abs({delta('x', 'e')}) END) / {n}) / nullif(sqrt(sum(CASE WHEN n > 1 THEN {delta('x', 'e')} * {delta('x', 'e')} END) / {n}), 0)")
    near = lambda extreme: f"abs(x - {extreme}) <= {'3 * e' if weighted else '0'}"
    loc = lambda plain, weighed: f"min(CASE WHEN {f'x * w = {weighed}' if weighted else f'x = {plain}'} THEN i END) / {n}"
    m3, m4 = f"(sum(w * (x - mu) * (x - mu) * (x - mu)) / {total})", f"(sum(w * pow(x - mu, 4)) / {total})"
    flat = f"{some('mx')} = {some('mn')}"
    d3 = "(x3 - x)"
    d3m = lambda p: f"(sum(CASE WHEN x3 IS NOT NULL AND {e03} > 0 THEN pow({d3}, {p}) / ({e03}) END) / nullif(sum(CASE WHEN x3 IS NOT NULL AND {e03} > 0 THEN 1 / ({e03}) END), 0))" if weighted else f"avg(pow({d3}, {p}))"  # noqa: E731,E501
    amplitude = _amplitude(weighted, d)
    sub = (
        f"{_interpolated('x', '(cdf * total0 / nullif(total_lo, 0))', 'rn', 0.5, where='x <= q3')} + "
        f"{_interpolated('x', '((cdf * total0 - total0 + total_hi) / nullif(total_hi, 0))', 'rn', 0.5, where='x >= q97')} - 2 * {some('wmed')}"
        if weighted
        else f"{d.quantile('CASE WHEN x <= q3 THEN x END', 0.5)} + {d.quantile('CASE WHEN x >= q97 THEN x END', 0.5)} - 2 * {med}"
    )
    deviation = _interpolated("abs(x - wmed)", "cdf", "rn", 0.5)
    absolute = d.quantile("abs(x - med)", 0.5)
    distance = d.quantile(f"sqrt(({step} * {step} + (time1 - time) * (time1 - time)) / nullif({e01}, 0))" if weighted else f"sqrt({step} * {step} + (time1 - time) * (time1 - time))", 0.5)
    if d.ranked:
        absolute, distance, deviation = some("mad"), some("apart"), _crossing("abs(x - wmed)", 0.5)
        low = _crossing("x", 0.5, "", "x <= q3", "({} * total0 / nullif(total_lo, 0))")
        high = _crossing("x", 0.5, "", "x >= q97", "(({} * total0 - total0 + total_hi) / nullif(total_hi, 0))")
        sub = f"{low} + {high} - 2 * {some('wmed')}" if weighted else f"{some('med_lo')} + {some('med_hi')} - 2 * {med}"
    out = {
        "Gskew": sub,
        "LinearTrend": "sum(w * (x - mu) * since) / nullif(sum(w * since * since) - sum(w * since) * sum(w * since) / sum(w), 0)",
        "MaxSlope": mean(slope, e01) if weighted else f"max({slope})",
        "PairSlopeTrend": f"CASE WHEN min(CASE WHEN {last30} THEN {e01} END) = 0 THEN NULL ELSE sum(CASE WHEN {last30} AND x1 > x THEN 1 / nullif({e01}, 0) ELSE 0 END) / nullif(sum(CASE WHEN {last30} AND x1 <> x THEN 1 / nullif({e01}, 0) END), 0) END" if weighted else f"avg(CASE WHEN {last30} THEN {flag('x1 > x')} END)",  # noqa: E501
        "PercentAmplitude": f"max(abs(x - wmed)) / nullif({some('wmed')}, 0)",
        "PercentDifferenceFluxPercentile": f"({q(0.95)} - {q(0.05)}) / nullif({q(0.5)}, 0)",
        "abs_energy": "sum(w0 * x * x)",
        "abs_sum_changes": f"coalesce(sum(CASE WHEN {e01} > 0 THEN abs{step} / sqrt({e01}) END), 0e0)" if weighted else f"coalesce(sum(abs{step}), 0e0)",
        "amplitude": amplitude,
        "auto_corr": f"CASE WHEN {n} < 2 THEN NULL WHEN {some('total0')} = 0 OR sum(sqrt(w0 * w01)) = 0 THEN {pearson} ELSE sum(sqrt(w0 * w01) * (x - mu) * (x1 - mu)) / nullif(sum(w * (x - mu) * (x - mu)), 0) END" if weighted else pearson,  # noqa: E501
        "benford_correlation": f"({' + '.join(f'{law[k]} * ({share[k]})' for k in law)}) / nullif(sqrt(({' + '.join(f'{law[k]} * {law[k]}' for k in law)}) * ({' + '.join(f'(({share[k]}) - 1 / 9e0) * (({share[k]}) - 1 / 9e0)' for k in law)})), 0)",  # noqa: E501
        "c3": mean("x * x1 * x2", e012),
        "check_for_max_duplicate": flag(f"{count(near('mx'))} > 1"),
        "check_for_min_duplicate": flag(f"{count(near('mn'))} > 1"),
        "check_max_last_loc": f"1 - max(CASE WHEN {near('mx')} THEN i END) / cast({n} AS DOUBLE)",
        "check_min_last_loc": f"1 - max(CASE WHEN {near('mn')} THEN i END) / cast({n} AS DOUBLE)",
        "complexity": f"sqrt(sum(w0 * {step} * {step}) / nullif(sum(CASE WHEN x1 IS NOT NULL THEN w0 END), 0))" if weighted else f"sqrt(avg({step} * {step}))",
        "count_above": part("x > wmed"),
        "count_below": part("x < wmed"),
        "cusum": f"CASE WHEN {some('var_med' if weighted else 's0')} = 0 THEN 0e0 ELSE (max(drift) - min(drift)) / ({n} * {f'sqrt({some("var_med")})' if weighted else some('s0')}) END",  # noqa: E501
        "first_loc_max": loc("mx", "mxw"),
        "first_loc_min": loc("mn", "mnw"),
        "half_mag_amplitude_ratio": "sqrt(nullif(sum(CASE WHEN x > med THEN w0 * (x - med) * (x - med) END) / nullif(sum(CASE WHEN x > med THEN w0 END), 0), 0) / nullif(sum(CASE WHEN x <= med THEN w0 * (x - med) * (x - med) END) / nullif(sum(CASE WHEN x <= med THEN w0 END), 0), 0))",  # noqa: E501
        "index_mass_quantile": f"min(CASE WHEN mass >= (0.5 - {TOLERANCE}) * whole_mass THEN i + 1 END) / {n}",
        "integrate": "coalesce(sum((x + x1) / 2 * (time1 - time)), 0e0)",
        "kurtosis": f"CASE WHEN {n} < 4 OR {some('total0')} = 0 THEN NULL WHEN {flat} THEN {'0e0' if weighted else 'NULL'} ELSE {m4} / nullif({var} * {var}, 0) - 3 END",
        "large_standard_deviation": flag(f"{some('mx')} > {some('mn')} AND sqrt({var}) > 0.3 * ({some('mx')} - {some('mn')})"),
        "longest_strike_above": f"max(run_up) / {n}",
        "longest_strike_below": f"max(run_down) / {n}",
        "meanMag": mu,
        "mean_abs_change": mean(f"abs{step}", "e + e1"),
        "mean_change": mean(step, e01),
        "mean_n_abs_max": f"CASE WHEN {n} < 10 THEN NULL WHEN {same.format('w0')} = 0 THEN {same.format('abs(x)')} / 10 ELSE {same.format('w0 * abs(x)')} / {same.format('w0')} END",
        "mean_second_derivative": mean(bend, "e_1 * e_1 + e * e + e1 * e1"),
        "medianAbsDev": f"CASE WHEN {some('total0')} = 0 THEN {absolute} ELSE {deviation} END" if weighted else absolute,
        "median_buffer_range": "",
        "median_distance": distance,
        "number_of_crossings": f"{count('x1 IS NOT NULL AND (x > med) <> (x1 > med)' + (' AND abs(x1 - x) > e' if weighted else ''))} / {n}",
        "permutation_entropy": f"CASE WHEN {n} >= 3 THEN {' + '.join(_entropy(count(f'pattern = {k}'), f'({n} - 2)') for k in (5, 7, 11, 15, 19, 21))} END",
        "skewness": f"CASE WHEN {n} < 3 OR {some('total0')} = 0 THEN NULL WHEN {flat} THEN {'0e0' if weighted else 'NULL'} ELSE {m3} / nullif(pow({var}, 1.5), 0){'' if weighted else f' * sqrt({n} * ({n} - 1e0)) / ({n} - 2)'} END",  # noqa: E501
        "stetsonJ": stetson_j,
        "stetsonK": stetson_k,
        "stetsonL": f"({stetson_j}) * ({stetson_k}) / 0.798",
        "symmetry_looking": flag(f"abs({mu} - {some('wmed')}) < 0.5 * (CASE WHEN {flat} THEN 1 ELSE {some('mx')} - {some('mn')} END)"),
        "time_reversal_asymmetry": mean("(x2 - x) * (x1 - x)", e012),
        "time_reversal_asymmetry_normalized": f"CASE WHEN {n} < 4 THEN NULL WHEN {d3m(2)} > 0 THEN {d3m(3)} / pow({d3m(2)}, 1.5) ELSE 0e0 END",
        "variance": var,
        "vonNeumannRatio": f"(sum({root} * {step} * {step}) / nullif(sum(CASE WHEN x1 IS NOT NULL THEN {root} END), 0)) / nullif({var}, 0)",
        "windowed_peak_fraction": f"sum(peak) / {n}",
    }
    centre, width = mu if weighted else med, f"0.1 * ({amplitude})"
    out["median_buffer_range"] = f"{centre}|{width}"
    if d.ranked:
        centre = "mu" if weighted else "med"
        out["median_buffer_range"] = f"avg(CASE WHEN x > {centre} - width AND x < {centre} + width THEN 1e0 ELSE 0e0 END)"
    for k, name in ((0.10, "FluxPercentileRatioMid20"), (0.175, "FluxPercentileRatioMid35"), (0.25, "FluxPercentileRatioMid50"), (0.325, "FluxPercentileRatioMid65"), (0.40, "FluxPercentileRatioMid80")):  # noqa: E501
        out[name] = f"({q(round(0.5 + k, 3))} - {q(round(0.5 - k, 3))}) / nullif({q(0.95)} - {q(0.05)}, 0)"
    for p in (25, 5, 50, 75, 95):
        out[f"quantile_{p}"] = d.quantile("x", p / 100)
    for name, k in LEVELS.items():
        out[name] = f"CASE WHEN {some('s0')} = 0 THEN 0e0 ELSE {part(f'{k} * (x - med) > s0')} END"
    for name in RUNS:
        out[name] = f"CASE WHEN {n} < 3 THEN 0e0 ELSE {count(f'run_{name} = 3')} / {n} END"
    out |= {
        "root_mean_squared": f"sqrt({var})",
        "std_over_mean": f"sqrt({var}) / nullif({mu}, 0)",
        "sum_values": mu,
        "variance_larger_than_standard_deviation": flag(f"{var} > sqrt({var})"),
        "variation_coefficient": f"sqrt({var}) / nullif({mu}, 0)",
    }
    if not weighted:
        repeats = count("below_x = x AND (below_x2 IS NULL OR below_x2 <> x)")
        out["check_for_duplicate"] = flag(f"{count('below_x = x')} > 0")
        out["ratio_recurring_points"] = f"{repeats} / {count('below_x IS NULL OR below_x <> x')}"
    return out | {name: expression(weighted) for name, expression in OWN.items()}


def _entropy(times: str, of: str) -> str:
    return f"CASE WHEN {times} = 0 THEN 0e0 ELSE -({times} / cast({of} AS DOUBLE)) * ln({times} / cast({of} AS DOUBLE)) END"


def names(weighted: bool = True) -> tuple[str, ...]:
    """The features that SQL computes, in the order of their names."""
    return tuple(sorted(expressions(weighted, SPARK)))


def all_names() -> tuple[str, ...]:
    """All 84 features, and those registered, in the order of their names, upper case first."""
    from starflow.functions import grouped

    return tuple(sorted({*names(True), *grouped.FEATURES}))


def query(wanted: list[str], weighted: bool, d: Dialect, source: str, before: str = "") -> str:
    """SQL for ``(lc_id, <wanted>)`` over the relation ``source``; ``before`` holds further table expressions."""
    found = expressions(weighted, d)
    plain = [w for w in wanted if w != "median_buffer_range" or d.ranked]
    shared = _pruned(_shared(weighted, d, source), " ".join(found[w] for w in wanted) + " lc_id seq time x e")
    chain = f"WITH {before + ',' if before else ''}{shared}"
    columns = ", ".join(f"cast({found[w]} AS DOUBLE) AS {w}" for w in plain)
    if plain == list(wanted):
        return f"{chain}\nSELECT lc_id, {columns} FROM points GROUP BY lc_id"
    centre, width = found["median_buffer_range"].split("|")
    return f"""{chain},
grouped AS (SELECT lc_id, {columns}{',' if columns else ''} {centre} AS centre_, {width} AS width_ FROM points GROUP BY lc_id)
SELECT lc_id, {''.join(f'max({w}) AS {w}, ' for w in plain)}
       avg(CASE WHEN x > centre_ - width_ AND x < centre_ + width_ THEN 1e0 ELSE 0e0 END) AS median_buffer_range
FROM points JOIN grouped USING (lc_id) GROUP BY lc_id"""


BUILT_IN = frozenset({*names(True), *GROUPED})
