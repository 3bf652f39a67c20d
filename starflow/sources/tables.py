"""Light curves from event and order tables: the relation (lc_id, seq, time, mag, magerr)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starflow.operators.prepare import decimal_log
from starflow.session import table

DAY = 86400e6  # microseconds

#: Each view as SQL over the given tables, with the engine's expression for microseconds since 1970 and its logarithm.
VIEWS = {
    "flux": ("events", "SELECT user_id AS lc_id, event_id AS seq, {us} / 86400e6 AS time, value AS mag, 0.5e0 + 0.02e0 * value AS magerr FROM {events}", "ts"),
    "mag": ("events", "SELECT user_id AS lc_id, event_id AS seq, {us} / 86400e6 AS time, 20 - 2.5e0 * {log10}(1 + value) AS mag, 0.02e0 AS magerr FROM {events} WHERE value > -1", "ts"),
    "orders": (
        "lineitem",
        "SELECT l_suppkey AS lc_id, l_orderkey * 8 + l_linenumber AS seq, {us} / 86400e6 AS time, cast(l_extendedprice AS DOUBLE) AS mag, "
        "1 + 0.01e0 * cast(l_extendedprice AS DOUBLE) AS magerr FROM {lineitem}",
        "l_shipdate",
    ),
}


def light_curves(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the views of the given tables."""
    name, text, ts = VIEWS[view]
    spark.udf.register("starflow_log10", decimal_log)
    return spark.sql(text.replace("{us}", f"unix_micros(cast({ts} AS TIMESTAMP))").replace("{log10}", "starflow_log10"), **{name: table(spark, sf_dir, name)})


def light_curves_sql(view: str) -> str:
    """The same view for DuckDB, over the registered tables."""
    name, text, ts = VIEWS[view]
    return text.replace("{us}", f"epoch_us(cast({ts} AS TIMESTAMP))").replace("{" + name + "}", name).replace("{log10}", "log10")
