"""Per-series state of a stream against a table of the same points."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from starflow.streaming import live

HOUR = 3_600_000_000
START = 1_700_000_000_000_000


def files(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "lc_id long, us long, mag double, magerr double").select("lc_id", F.timestamp_micros("us").alias("ts"), "mag", "magerr")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def streamed(spark, folder, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    try:
        stream = spark.readStream.schema("lc_id long, ts timestamp, mag double, magerr double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        query = live.live_features(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{folder}-{name}").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return seen


def table(spark, rows):
    df = spark.createDataFrame(rows, "lc_id long, at_us long, mag double, magerr double")
    return spark.sql(f"WITH {live.session_features_sql('{p}', 6 * HOUR)}", p=df).collect()


def test_equals_the_table(spark, tmp_path):
    """Points out of order within the lateness, several sessions, ties; a last far point closes all."""
    draw, rows = random.Random(3), []
    for lc in range(6):
        at = START + lc * 1000
        for _ in range(60):
            at += int(draw.choice([0, 0.2, 0.5, 1, 7]) * HOUR) if draw.random() < 0.3 else int(0.1 * HOUR)
            rows.append((lc, at, float(draw.randint(0, 9)), 0.1))
    rows.sort(key=lambda r: r[1] + draw.uniform(0, 0.4 * HOUR))
    last = max(r[1] for r in rows)
    far = [(99, last + d * HOUR, 1.0, 0.1) for d in (20, 40)]
    batches = [rows[i : i + 45] for i in range(0, len(rows), 45)] + [[f] for f in far]
    files(spark, f"{tmp_path}/in", batches)
    seen = streamed(spark, f"{tmp_path}/in", "cp")
    want = {(r.lc_id, r.start_us): r for r in table(spark, rows)}
    closed = {(r.lc_id, r.start_us): r for r in seen if r.closed and r.lc_id != 99}
    assert closed.keys() == want.keys() and len(want) > 12
    for key, w in want.items():
        g = closed[key]
        assert (g.last_us, g.n, g.longest_rise, g.longest_fall) == (w.last_us, w.n, w.longest_rise, w.longest_fall)
        assert (g["mean"], g.variance) == pytest.approx((w["mean"], w.variance)) and (g.eta is None) == (w.eta is None)
        assert g.eta is None or g.eta == pytest.approx(w.eta)
    grown = [r for r in seen if not r.closed and r.lc_id == 0]
    assert grown and all(0 < r.n for r in grown)


def test_late_rows_and_nulls(spark, tmp_path):
    hour = lambda h, v, lc=1: (lc, int(START + h * HOUR), v, 0.1)
    files(spark, f"{tmp_path}/in", [[hour(0, 1.0), hour(1, 2.0)], [hour(10, 5.0)], [hour(0.5, 99.0), (1, None, 1.0, 0.1), (None, START, 1.0, 0.1), (1, START + 11 * HOUR, None, 0.1)], [hour(30, 1.0)], [hour(60, 1.0)]])
    closed = sorted((r.start_us, r.n, r["mean"]) for r in streamed(spark, f"{tmp_path}/in", "cp") if r.closed)
    assert closed[:2] == [(START, 2, 1.5), (START + 10 * HOUR, 1, 5.0)]


def test_folding():
    record = live.EMPTY
    for i, v in enumerate([3.0, 4.0, 5.0, 5.0, 1.0, 0.0, 7.0]):
        record = live.folded(record, i, v)
    n, mean, variance, rise, fall, eta = live.features_of(record)
    assert (n, rise, fall) == (7, 2, 2) and mean == pytest.approx(25 / 7) and variance == pytest.approx(125 / 7 - (25 / 7) ** 2) and eta == pytest.approx((1 + 1 + 16 + 1 + 49) / 6 / variance)
    assert live.features_of(live.folded(live.EMPTY, 0, 2.0)) == (1, 2.0, 0.0, 0, 0, None)
    assert datetime.timedelta(hours=6).total_seconds() * 1e6 == 6 * HOUR
