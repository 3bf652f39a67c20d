"""Features that depend on the order of points, kept per series while its session is still open.

A stream's points wait in the state of their series until the watermark has passed them, so that no point on time can come
before them any more; then they are folded, in order, into a few running numbers. Each advance gives a row of the open
session's features so far, and a session that has been silent for ``gap`` a last row that is closed. The state of a series is
its waiting points (those of the allowed lateness) and one record, however long its session is.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FEATURES = "n long, mean double, variance double, longest_rise long, longest_fall long, eta double"
RECORD = "start long, last long, n long, mean double, squares double, value double, rise long, fall long, longest_rise long, longest_fall long, steps double, timer long"
POINT = "at long, mag double, magerr double"
NAMES = [c.split()[0] for c in RECORD.split(", ")]
EMPTY = {"start": 0, "last": 0, "n": 0, "mean": 0.0, "squares": 0.0, "value": 0.0, "rise": 0, "fall": 0, "longest_rise": 0, "longest_fall": 0, "steps": 0.0, "timer": -1}


def folded(record: dict, at: int, value: float) -> dict:
    """A session's record with its next point."""
    if not record["n"]:
        return EMPTY | {"start": at, "last": at, "n": 1, "mean": value, "value": value, "timer": record["timer"]}
    n, step, away = record["n"] + 1, value - record["value"], value - record["mean"]
    mean = record["mean"] + away / n
    rise, fall = record["rise"] + 1 if step > 0 else 0, record["fall"] + 1 if step < 0 else 0
    return record | {
        "last": at, "n": n, "mean": mean, "squares": record["squares"] + away * (value - mean), "value": value, "steps": record["steps"] + step * step,
        "rise": rise, "fall": fall, "longest_rise": max(record["longest_rise"], rise), "longest_fall": max(record["longest_fall"], fall),
    }


def features_of(record: dict) -> tuple:
    n, variance = record["n"], record["squares"] / record["n"]
    return n, record["mean"], variance, record["longest_rise"], record["longest_fall"], record["steps"] / (n - 1) / variance if n > 1 and variance > 0 else None


class _Live(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.record, self.waiting = handle, handle.getValueState("record", RECORD), handle.getListState("waiting", POINT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(a), float(m), float(e)) for part in rows for a, m, e in zip(part["at_us"], part["mag"], part["magerr"])]
        yield self._advance(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues)

    def _advance(self, key, fresh: list[tuple], timers) -> pd.DataFrame:
        mark = timers.getCurrentWatermarkInMs() * 1000
        record = dict(zip(NAMES, self.record.get())) if self.record.exists() else EMPTY
        held = sorted([*(tuple(p) for p in self.waiting.get()), *(p for p in fresh if p[0] >= mark)])  # others come too late
        ready = [p for p in held if p[0] < mark]
        out, before = [], record["n"]

        def put(closed: bool) -> None:
            out.append((key[0], record["start"], record["last"], closed, *features_of(record)))

        for at, value, _ in ready:
            if record["n"] and at - record["last"] >= self.gap:
                put(True)
                record, before = EMPTY | {"timer": record["timer"]}, 0
            record = folded(record, at, value)
        rest = held[len(ready) :]
        if record["n"] and record["last"] + self.gap <= mark:
            put(True)
            record = EMPTY | {"timer": record["timer"]}
        elif record["n"] > before:
            put(False)
        self._remember(record, rest)
        frame = pd.DataFrame(out, columns=["lc_id", "start_us", "last_us", "closed", *[c.split()[0] for c in FEATURES.split(", ")]])
        return frame.astype({"eta": float})

    def _remember(self, record: dict, rest: list[tuple]) -> None:
        """Keep what is left, and wake up when the watermark reaches the next point or the session's end."""
        if record["timer"] >= 0:
            self.handle.deleteTimer(record["timer"])
        due = min([p[0] for p in rest] + ([record["last"] + self.gap] if record["n"] else []), default=None)
        if due is None:
            self.record.clear()
            self.waiting.clear()
            return
        timer = due // 1000 + 1
        self.handle.registerTimer(timer)
        self.record.update(tuple((record | {"timer": timer})[n] for n in NAMES))
        self.waiting.put(rest) if rest else self.waiting.clear()


def live_features(stream: DataFrame, ts: str = "ts", gap: datetime.timedelta = datetime.timedelta(hours=6), late: str = "1 hour") -> DataFrame:
    """``(lc_id, start_us, last_us, closed, n, mean, variance, longest_rise, longest_fall, eta)`` of a stream ``(lc_id, <ts>,
    mag, magerr)``, in update mode: rows of open sessions as they grow, and one of each session that has ended.

    A session ends before a point that comes ``gap`` or more after the last. Points later than ``late`` are left out, as are
    rows with nulls; points of one time go by value. ``longest_rise`` and ``longest_fall`` count steps, ``eta`` is the mean
    squared step over the variance (null for one point or equal values). Needs the RocksDB state store.
    """
    rows = stream.where(F.col("lc_id").isNotNull() & F.col(ts).isNotNull() & F.col("mag").isNotNull()).withColumn("magerr", F.coalesce("magerr", F.lit(0.0)))
    kind = dict(stream.dtypes)["lc_id"]
    timed = rows.select("lc_id", F.col(ts).cast("timestamp").alias("ts"), "mag", "magerr").withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    processor = _Live(int(gap.total_seconds() * 1e6))
    return timed.groupBy("lc_id").transformWithStateInPandas(processor, f"lc_id {kind}, start_us long, last_us long, closed boolean, {FEATURES}", "Update", "EventTime")


def session_features_sql(source: str, gap: int, engine: str = "spark") -> str:
    """The closed rows of ``live_features`` over a table ``(lc_id, at_us, mag, magerr)``, with a gap in microseconds."""
    variance = "nullif(var_pop(mag), 0)"
    return f"""
steps AS (SELECT *, at_us - lag(at_us) OVER (PARTITION BY lc_id ORDER BY at_us, mag, magerr) AS wait FROM {source}),
parts AS (SELECT *, sum(CASE WHEN wait IS NULL OR wait < {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY lc_id ORDER BY at_us, mag, magerr ROWS UNBOUNDED PRECEDING) AS s FROM steps),
moves AS (SELECT *, mag - lag(mag) OVER o AS step, row_number() OVER o AS r FROM parts WINDOW o AS (PARTITION BY lc_id, s ORDER BY at_us, mag, magerr)),
runs AS (SELECT *, r - coalesce(max(CASE WHEN step > 0 THEN NULL ELSE r END) OVER o, 0) AS rise, r - coalesce(max(CASE WHEN step < 0 THEN NULL ELSE r END) OVER o, 0) AS fall
  FROM moves WINDOW o AS (PARTITION BY lc_id, s ORDER BY r ROWS UNBOUNDED PRECEDING))
SELECT lc_id, min(at_us) AS start_us, max(at_us) AS last_us, count(*) AS n, avg(mag) AS mean, var_pop(mag) AS variance,
  max(rise) AS longest_rise, max(fall) AS longest_fall, sum(step * step) / (count(*) - 1) / {variance} AS eta FROM runs GROUP BY lc_id, s HAVING count(*) > 1
UNION ALL
SELECT lc_id, min(at_us), max(at_us), count(*), avg(mag), 0e0, 0, 0, NULL FROM runs GROUP BY lc_id, s HAVING count(*) = 1"""
