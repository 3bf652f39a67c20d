"""Levels of immutable sorted runs, as in a log-structured merge tree.

A run is a table of the shared folder, bucketed and sorted by its key columns. Runs have the same buckets, so that Spark
merge-joins them with each other, bucket by bucket, without a shuffle. A level that holds ``fanout`` runs is merged into
one run of the next: ``b`` batches leave at most ``fanout * log(b)`` runs, and each row is rewritten ``log(b)`` times.
The files of merged runs are removed at once, those of the others by ``remove``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from starflow.llm.common import delete_path, scratch

ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # lets Spark rely on the order inside a bucket's one file


@dataclass
class Levels:
    """Runs by level, each a table name. ``merge`` unites the rows of equal key in a union of runs."""

    spark: SparkSession
    keys: tuple[str, ...]
    fanout: int = 4
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    names: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, name: str) -> str:
        return f"{scratch(self.spark)}/{name}"

    def write(self, rows: DataFrame) -> str:
        """A new run of these rows, which stand in no level yet."""
        name = f"run_{uuid.uuid4().hex}"
        spread = rows.repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys)
        out = spread.write.format("parquet").option("compression", "zstd").option("path", self._path(name))
        out.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(name)
        return name

    def read(self, name: str) -> DataFrame:
        """A run; rows with a null key, of which there are none, are filtered so that Spark reads rows, not columns: a
        union of columnar scans keeps the buckets' partitioning in its plan, but not when it runs."""
        self.spark.conf.set(ORDERED, "true")
        return self.spark.table(name).where(" AND ".join(f"{k} IS NOT NULL" for k in self.keys))

    def runs(self) -> list[DataFrame]:
        return [self.read(name) for level in self.names.values() for name in level]

    def add(self, name: str) -> None:
        """Put a written run into level 0 and merge the levels that are full."""
        level = 0
        self.names.setdefault(0, []).append(name)
        while len(self.names[level]) >= self.fanout:
            full = self.names.pop(level)
            merged = self.write(self.merge(reduce(DataFrame.union, map(self.read, full))))
            self.drop(*full)
            level += 1
            self.names.setdefault(level, []).append(merged)

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, self._path(name))

    def remove(self) -> None:
        """Drop all runs; nothing that still reads them may be left to run."""
        self.drop(*[name for level in self.names.values() for name in level])
        self.names.clear()
