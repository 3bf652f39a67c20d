"""Order statistics of whole tables by range-partitioned sorts: no task holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starflow.session import cut


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str], tops: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``<c>_before`` for each of ``sums``: its sum over the rows before, in this order, among rows of equal
    ``by``; and for each of ``tops`` the largest value before (null at the first row).

    Rows are sorted by ranges; a window inside each range adds to the sums of the ranges before, a row a range.
    """
    placed = cut(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("part_", F.spark_partition_id()))
    earlier = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part_", *by).agg(*[F.sum(c).alias(f"{c}_own_") for c in sums], *[F.max(c).alias(f"{c}_own_") for c in tops])
    parts = parts.select(
        F.col("part_").alias("range_"), *[F.col(b).alias(f"{b}_range_") for b in by],
        *[F.coalesce(F.sum(f"{c}_own_").over(ranges), F.lit(0)).alias(f"{c}_start_") for c in sums],
        *[F.max(f"{c}_own_").over(ranges).alias(f"{c}_start_") for c in tops],
    )
    same = F.col("part_") == F.col("range_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_range_"))
    return placed.join(parts, same).select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"{c}_start_")).alias(f"{c}_before") for c in sums],
        *[F.greatest(F.max(c).over(earlier), F.col(f"{c}_start_")).alias(f"{c}_before") for c in tops],
    )


def cells_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(c, v)``: the values of all columns, by the column's number, without nulls."""
    return df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("c", "v")).where("v IS NOT NULL")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """The exact quantiles of each column, interpolated linearly between neighbours; None for a column without values."""
    steps = cells_of(df, columns).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running(steps, ["c"], [F.col("v")], ["n"])
    sizes = placed.groupBy("c").agg(F.sum("n").alias("size"))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("size") - 1)).alias("at")) for k, q in enumerate(shares)])).alias("q")
    wanted = sizes.select("c", places).select("c", "q.k", "q.at", F.explode(F.array_distinct(F.array(F.floor("q.at"), F.ceil("q.at")))).alias("row"))
    held = placed.join(F.broadcast(wanted), "c").where((F.col("n_before") <= F.col("row")) & (F.col("row") < F.col("n_before") + F.col("n")))
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    ends: dict[tuple[int, int], list[tuple[float, float, float]]] = {}
    for r in held.select("c", "k", "at", "row", "v").collect():  # two values a column and share
        ends.setdefault((r.c, r.k), []).append((r.row, r.v, r.at))
    for (c, k), found in ends.items():
        (lo, a, at), (_, b, _) = min(found), max(found)
        out[columns[c]][k] = a + (b - a) * (at - lo)
    return out


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The most frequent value of each column, the smallest of equals."""
    counts = cells_of(df, columns).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.max_by(F.col("v"), F.struct(F.col("n"), -F.col("v"))).alias("v")).collect()  # a row a column
    return dict.fromkeys(columns) | {columns[r.c]: r.v for r in best}
