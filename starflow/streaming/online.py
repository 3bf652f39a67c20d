"""Features of light curves that arrive as a stream.

Moments, extremes and counts decompose over points, so a stream of points keeps one small aggregate per series and
window, closed by a watermark on event time. Features that depend on the order of points are taken per closed session,
by the batch operators in ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from starflow.operators.extract import extract


def windowed_moments(points: DataFrame, ts: str = "ts", length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``(lc_id, window, n, mean, variance, weighted_mean, smallest, largest)`` per series and tumbling window.

    ``points`` is a stream or a table ``(lc_id, <ts>, mag, magerr)``; points later than ``late`` are left out of a stream.
    """
    w = F.when(F.col("magerr") > 0, 1 / (F.col("magerr") * F.col("magerr"))).otherwise(0.0)
    timed = points.withWatermark(ts, late) if points.isStreaming else points
    return timed.groupBy("lc_id", F.window(ts, length).alias("window")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("mag").alias("mean"),
        F.var_pop("mag").alias("variance"),
        F.try_divide(F.sum(w * F.col("mag")), F.sum(w)).alias("weighted_mean"),
        F.min("mag").alias("smallest"),
        F.max("mag").alias("largest"),
    )


def sessions(points: DataFrame, ts: str = "ts", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """``(lc_id, session, points)``: the points of each session of a series, sessions ending after ``gap`` without one."""
    timed = points.withWatermark(ts, late) if points.isStreaming else points
    point = F.struct(F.col(ts).alias("at"), "mag", "magerr")
    return timed.groupBy("lc_id", F.session_window(ts, gap).alias("session")).agg(F.sort_array(F.collect_list(point)).alias("points"))


def session_points(found: DataFrame) -> DataFrame:
    """Sessions as series: ``lc_id`` becomes a hash of the series and the session's start, kept beside it."""
    opened = found.select(F.xxhash64("lc_id", "session.start").alias("s_"), "lc_id", F.col("session.start").alias("start"), F.posexplode("points").alias("seq", "p"))
    seconds = F.col("p.at").cast("timestamp").cast("double") / 86400
    return opened.select(F.col("s_").alias("lc_id"), F.col("lc_id").alias("series"), "start", F.col("seq").cast("long"), seconds.alias("time"), "p.mag", "p.magerr")


def extract_sessions(stream: DataFrame, sink: Callable[[DataFrame, int], None], wanted: list[str], weighted: bool = True, **kw: str) -> DataStreamWriter:
    """A writer that extracts ``wanted`` features of each closed session and hands them to ``sink(features, batch)``."""

    def each(batch: DataFrame, number: int) -> None:
        points = session_points(batch)
        names = points.groupBy("lc_id").agg(F.first("series").alias("series"), F.first("start").alias("start"))
        sink(extract(points, wanted, weighted, False).join(names, "lc_id").drop("lc_id"), number)

    return sessions(stream, **kw).writeStream.outputMode("append").foreachBatch(each)
