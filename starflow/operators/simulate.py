"""Simulated light curves on given cadences, with noise and quality tests, as SQL over the points.

Random numbers are digests of seed, name, series and attempt: a draw depends on nothing else, so that results are the
same in any partitioning and in any engine. The texts run on Spark and on DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starflow.session import cut


@dataclass(frozen=True)
class Draws:
    """Uniform and normal draws as SQL, over the columns that identify what is drawn for."""

    engine: str = "spark"
    seed: int = 1

    def uniform(self, name: str, *keys: str) -> str:
        """In (0, 1)."""
        label = f"concat_ws('|', '{self.seed}', '{name}', {', '.join(f'cast({k} AS {self.string})' for k in keys)})"
        digits = f"substr(md5({label}), 1, 13)"
        number = f"cast(conv({digits}, 16, 10) AS DOUBLE)" if self.engine == "spark" else f"cast(('0x' || {digits})::UBIGINT AS DOUBLE)"
        return f"(({number} + 0.5e0) / 4503599627370496e0)"

    @property
    def string(self) -> str:
        return "STRING" if self.engine == "spark" else "VARCHAR"

    def between(self, name: str, lo: str | float, hi: str | float, *keys: str) -> str:
        return f"({lo} + ({hi} - ({lo})) * {self.uniform(name, *keys)})"

    def normal(self, name: str, mean: str | float, sd: str | float, *keys: str) -> str:
        """By Box and Muller."""
        return f"({mean} + {sd} * sqrt(-2 * ln({self.uniform(name + '/r', *keys)})) * cos(2 * pi() * {self.uniform(name + '/a', *keys)}))"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})" if self.engine == "spark" else f"quantile_cont({x}, {q})"

    def sequence(self, lo: str, hi: str) -> str:
        """A row for each whole number from lo to hi."""
        return f"explode(sequence(cast({lo} AS BIGINT), cast({hi} AS BIGINT)))" if self.engine == "spark" else f"unnest(generate_series(cast({lo} AS BIGINT), cast({hi} AS BIGINT)))"


KEY = ("lc_id", "attempt")


def microlensing_sql(source: str, d: Draws) -> str:
    """``(lc_id, attempt, seq, time, mag, baseline, u0, t0, te, blend)`` from ``(lc_id, attempt, seq, time, baseline)``.

    Impact parameter and blend ratio are uniform, the crossing time normal (30 +- 10 days), the peak somewhere in the
    observed span. The source's share of the flux is magnified by ``(u**2 + 2) / (u * sqrt(u**2 + 4))``.
    """
    return f"""
spans AS (SELECT lc_id, attempt, {d.quantile("time", 0.01)} AS t_lo, {d.quantile("time", 0.99)} AS t_hi FROM {source} GROUP BY lc_id, attempt),
lens0 AS (SELECT *, {d.uniform("u0", *KEY)} AS u0, {d.normal("te", 30, 10, *KEY)} AS te, {d.uniform("blend", *KEY)} AS blend FROM spans),
lens AS (SELECT *, {d.between("t0", "t_lo - te / 2", "t_hi + te / 2", *KEY)} AS t0 FROM lens0),
near AS (SELECT p.lc_id, p.attempt, seq, time, baseline, u0, t0, te, blend, sqrt(u0 * u0 + ((time - t0) / te) * ((time - t0) / te)) AS u
         FROM {source} p JOIN lens l ON p.lc_id = l.lc_id AND p.attempt = l.attempt),
lensed AS (SELECT lc_id, attempt, seq, time, baseline, u0, t0, te, blend,
         baseline - 2.5 * log10((((u * u + 2) / (u * sqrt(u * u + 4))) + blend) / (1 + blend)) AS mag FROM near)"""


def cataclysmic_sql(source: str, d: Draws) -> str:
    """``outbursts`` and ``erupting (lc_id, attempt, seq, time, baseline, mag)``.

    Outbursts recur with a period of about 100 +- 200 days (absolute), the first within one of the start. Each rises
    linearly, stays, and declines linearly; where two overlap the later one counts.
    """
    return f"""
ranges AS (SELECT lc_id, attempt, min(time) AS t_lo, max(time) AS t_hi FROM {source} GROUP BY lc_id, attempt),
pace AS (SELECT *, greatest(abs({d.normal("period", 100, 200, *KEY)}), 1) AS period, {d.between("amplitude", 0.5, 5, *KEY)} AS amplitude FROM ranges),
firsts AS (SELECT *, {d.between("first", "t_lo", "least(t_lo + period, t_hi)", *KEY)} AS first FROM pace),
numbered AS (SELECT *, {d.sequence("0", "floor((t_hi - first) / period)")} AS k FROM firsts),
timed AS (SELECT *, first + k * period AS start, {d.between("duration", 3, "greatest(period / 10, 3)", *KEY, "k")} AS duration FROM numbered),
outbursts AS (SELECT lc_id, attempt, k, start, amplitude, {d.between("rise", 0.5, 1, *KEY, "k")} AS rise,
       least(greatest({d.normal("high", "0.4 * duration", "0.2 * duration", *KEY, "k")}, 0), duration - 1) AS high, duration FROM timed),
bright AS (SELECT p.lc_id, p.attempt, p.seq, max_by(
         CASE WHEN p.time < start + rise THEN amplitude * (p.time - start) / rise WHEN p.time < start + rise + high THEN amplitude
              ELSE amplitude * (start + rise + duration - p.time) / nullif(duration - high, 0) END, k) AS gain
       FROM {source} p JOIN outbursts o ON p.lc_id = o.lc_id AND p.attempt = o.attempt AND p.time BETWEEN start AND start + rise + duration
       GROUP BY p.lc_id, p.attempt, p.seq),
erupting AS (SELECT p.lc_id, p.attempt, p.seq, p.time, p.baseline, p.baseline - coalesce(gain, 0) AS mag
       FROM {source} p LEFT JOIN bright b ON p.lc_id = b.lc_id AND p.attempt = b.attempt AND p.seq = b.seq)"""


def periodic_sql(source: str, d: Draws) -> str:
    """``pulsing``: a long-period variable as three sinusoids of falling amplitude (an extension)."""
    wave = " + ".join(
        f"{d.between(f'amp{k}', 0.1, 2 / k, *KEY)} * sin(2 * pi() * (time / {d.between(f'per{k}', 80 / k, 900 / k, *KEY)} + {d.uniform(f'phase{k}', *KEY)}))" for k in (1, 2, 3)
    )
    return f"pulsing AS (SELECT lc_id, attempt, seq, time, baseline, baseline + {wave} AS mag FROM {source})"


def noisy_sql(source: str, d: Draws, rms: str = "0.01 + 0.02 * exp(0.7 * (mag - 20))", zp: float = 24.0, exposure: float = 60.0) -> str:
    """``noisy``: magnitudes after normal noise on the flux, with errors; ``rms`` gives the scatter at a magnitude."""
    counts = f"pow(10e0, -(mag - {zp}) / 2.5) * {exposure}"
    return f"""
counted AS (SELECT *, {counts} AS counts, CASE WHEN {rms} > 0 THEN {rms} ELSE 1e-5 END AS rms FROM {source}),
struck AS (SELECT *, counts + counts * rms * ln(10e0) / 2.5 * {d.normal("noise", 0, 1, *KEY, "seq")} AS seen FROM counted),
noisy AS (SELECT *, {zp} - 2.5 * log10(CASE WHEN seen > 0 THEN seen / {exposure} END) AS noisy_mag, rms AS magerr FROM struck)"""


def add_noise(points: DataFrame, noise: Callable, zp: float = 24.0, exposure: float = 60.0, seed: int = 1, vectorised: bool = False) -> DataFrame:
    """``points(lc_id, seq, mag, ...)`` with ``noisy_mag`` and ``magerr`` by a noise model of the user's.

    ``noise`` gives the scatter at a magnitude: a function of a column, or (``vectorised``) of a pandas Series, which goes to
    the tasks. Scatter that isn't above 0 counts as 1e-5, null scatter or magnitude gives null. Series with an ``attempt``
    have draws of their own for each.
    """
    scatter = F.pandas_udf(noise, "double")("mag") if vectorised else noise(F.col("mag")).cast("double")
    held = points.withColumn("scatter_", scatter)
    held = held if "attempt" in points.columns else held.withColumn("attempt", F.lit(0))
    text = noisy_sql("{points}", Draws("spark", seed), "scatter_", zp, exposure)
    out = points.sparkSession.sql(f"WITH {text} SELECT * FROM noisy", points=held)
    known = F.col("scatter_").isNotNull() & F.col("mag").isNotNull()
    return out.select(*points.columns, F.when(known, F.col("noisy_mag")).alias("noisy_mag"), F.when(known, F.col("magerr")).alias("magerr"))



def microlensing_quality_sql(source: str, n: int = 7) -> str:
    """``passing (lc_id, attempt)`` of ``noisy`` lensed series: enough points near the peak, some of them three errors
    above the baseline, a third of them at least, brighter in the mean, and magnified beyond the blend."""
    three = "(baseline - noisy_mag) / nullif(magerr, 0)"
    return f"""
passing AS (SELECT lc_id, attempt FROM {source} WHERE time BETWEEN t0 - te AND t0 + te GROUP BY lc_id, attempt, u0, blend
  HAVING count(*) >= {n} AND max({three}) >= 3 AND avg(noisy_mag) < min(baseline) - 0.05
     AND sum(CASE WHEN {three} > 3 THEN 1 ELSE 0 END) >= 0.33 * count(*) AND 1 / u0 > blend)"""


def cataclysmic_quality_sql(points: str, outbursts: str, n1: int = 7, n2: int = 1) -> str:
    """``erupted (lc_id, attempt)``: series with an outburst that has n1 points, n2 of them in its rise or its decline."""
    return f"""
seen_in AS (SELECT p.lc_id, p.attempt, k, count(*) AS points,
    sum(CASE WHEN time < start + rise THEN 1 ELSE 0 END) AS rising, sum(CASE WHEN time >= start + rise + high THEN 1 ELSE 0 END) AS falling
  FROM {points} p JOIN {outbursts} o ON p.lc_id = o.lc_id AND p.attempt = o.attempt AND time BETWEEN start AND start + rise + duration
  GROUP BY p.lc_id, p.attempt, k),
erupted AS (SELECT DISTINCT lc_id, attempt FROM seen_in WHERE points >= {n1} AND (rising >= 1 OR falling >= {n2}))"""


CLASSES = ("VARIABLE", "CONSTANT", "CV", "LPV", "ML")


def training_points(cadence: DataFrame, baseline: float | str = 19.0, seed: int = 1, attempts: int = 100, zp: float = 24.0) -> DataFrame:
    """``(lc_id, seq, time, mag, magerr, class)``: each cadence ``(lc_id, seq, time)`` simulated once per class; ids are
    made distinct by class. CV and ML series are drawn up to ``attempts`` times, and the first that passes its quality test
    counts. Rounds of attempts, each twice as long as the last, are over the cadences that are still open; a ValueError names
    those on which none passes."""
    spark, d = cadence.sparkSession, Draws("spark", seed)
    base = cadence.select("lc_id", "seq", F.col("time").cast("double").alias("time"))

    def run(text: str, **frames: DataFrame) -> DataFrame:
        return spark.sql(text, **frames)

    plain = base.withColumn("attempt", F.lit(0)).withColumn("baseline", F.lit(baseline).cast("double"))
    parts = []
    for label, chain, out in (
        ("VARIABLE", "rr AS (SELECT *, baseline + " + f"{d.between('rr_amp', 0.2, 0.8, *KEY)} * sin(2 * pi() * time / abs({d.normal('rr_per', 0.6, 0.15, *KEY)})) AS mag FROM {{src}})", "rr"),
        ("CONSTANT", "flat AS (SELECT *, baseline AS mag FROM {src})", "flat"),
        ("LPV", periodic_sql("{src}", d), "pulsing"),
    ):
        parts.append((label, run(f"WITH {chain}, {noisy_sql(out, d, zp=zp)} SELECT lc_id, seq, time, noisy_mag AS mag, magerr FROM noisy", src=plain)))
    for label, chain, out, test, keep in (
        ("CV", cataclysmic_sql("{src}", d), "erupting", cataclysmic_quality_sql("noisy", "outbursts"), "erupted"),
        ("ML", microlensing_sql("{src}", d), "lensed", microlensing_quality_sql("noisy"), "passing"),
    ):
        text = f"""WITH {chain}, {noisy_sql(out, d, zp=zp)}, {test},
best AS (SELECT lc_id, min(attempt) AS attempt FROM {keep} GROUP BY lc_id)
SELECT n.lc_id, seq, time, noisy_mag AS mag, magerr FROM noisy n JOIN best b ON n.lc_id = b.lc_id AND n.attempt = b.attempt"""
        left, start, size = base, 0, 4
        while start < attempts:
            numbers = F.explode(F.sequence(F.lit(start), F.lit(min(start + size, attempts) - 1)))
            done = cut(run(text, src=left.withColumn("attempt", numbers).withColumn("baseline", F.lit(baseline).cast("double"))))
            parts.append((label, done))
            left = cut(left.join(done.select("lc_id").distinct(), "lc_id", "left_anti"))
            if left.isEmpty():
                break
            start, size = start + size, 2 * size
        if not left.isEmpty():
            failed = left.select("lc_id").distinct()
            raise ValueError(f"no {label} series passes in {attempts} attempts on {failed.count()} cadences, such as {[r.lc_id for r in failed.orderBy('lc_id').limit(5).collect()]}")
    out = None
    for label, part in parts:
        one = part.withColumn("class", F.lit(label)).withColumn("lc_id", F.col("lc_id") * len(CLASSES) + CLASSES.index(label))
        out = one if out is None else out.unionByName(one)
    return out


def create_noise(median: np.ndarray, rms: np.ndarray, degree: int = 3) -> str:
    """A scatter model as SQL in ``mag``: a least-squares polynomial over distinct magnitudes, flat beyond them."""
    x, at = np.unique(np.asarray(median, float), return_index=True)
    y = np.asarray(rms, float)[at]
    centre, scale = x.mean(), x.std() or 1.0
    coefficients = np.polyfit((x - centre) / scale, y, min(degree, len(x) - 1))
    z = f"((least(greatest(mag, {x[0]}), {x[-1]}) - {centre}) / {scale})"
    text = "0e0"
    for c in coefficients:
        text = f"(({text}) * {z} + {float(c)!r})"
    return text


def add_poisson_noise(points: DataFrame, zp: float = 24.0, exposure: float = 60.0, seed: int = 1) -> DataFrame:
    """``points`` with magnitudes of Poisson counts and their errors; a count of zero gives nulls. A point's draw depends
    on its series and ``seq`` alone."""

    @F.pandas_udf("double")
    def drawn(mean: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.default_rng(k & (2**63 - 1)).poisson(m)) if m >= 0 else None for m, k in zip(mean, key)])

    counts = F.pow(F.lit(10.0), -(F.col("mag") - zp) / 2.5) * exposure
    out = points.withColumn("n_", drawn(counts, F.xxhash64(F.lit(seed), "lc_id", "seq")))
    ok = F.col("n_") > 0
    mag = F.when(ok, zp - 2.5 * F.log10(F.col("n_") / exposure))
    return out.withColumn("mag", mag).withColumn("magerr", F.when(ok, 2.5 / np.log(10) / F.sqrt("n_"))).drop("n_")
