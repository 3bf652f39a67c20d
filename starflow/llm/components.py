"""Connected components of a link table, by alternating star contractions.

Each round replaces every node's neighbours by links to the smallest node near it (large star, then small star);
rounds end when the links no longer change. Links stay in Spark tables throughout: per round two joins and three
aggregations, each of at most twice the links there were. A hub is spread by map-side aggregation and, in the join,
by Spark's splitting of skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starflow.llm.common import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)`` that is not the smallest of its component.

    ``component`` is the smallest node that can be reached. Loops and repeated links are allowed, null ends are
    dropped; no links give no rows. Nodes that are absent are their own component.
    """
    current = cut(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    mark = None
    while True:
        current = cut(_small_star(_large_star(current)))
        n, digest = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if (n, digest) == mark or n == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = (n, digest)
