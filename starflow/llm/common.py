"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.session import checkpoint_dir, cut, table

__all__ = ["ASCII_LOWER", "SPACE", "WORD", "checkpoint_dir", "cut", "delete_path", "grown", "scratch", "split_join", "stored", "table", "without"]

#: ASCII white space, as every contract here defines it; ``bytes.split()`` splits at the same six characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z for ``bytes.translate``; other characters stay.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    files, where = _files(spark, path)
    files.delete(where, True)


_scratch: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared folder, made once and removed when the application ends."""
    base = checkpoint_dir(spark).rstrip("/")
    owner = (spark.sparkContext.applicationId, base)
    if owner not in _scratch:
        path = f"{base}/{uuid.uuid4().hex}"
        files, where = _files(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _scratch[owner] = path
    return _scratch[owner]


def stored(df: DataFrame, *sort: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: a cut of the lineage that keeps columns apart.

    With ``sort``, each file is sorted by these columns.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MOST_HOT = 20_000  # keys that are broadcast, at most: those with over 1 / MOST_HOT of all rows each


def split_join(rows: DataFrame, side: DataFrame, on: Sequence[str], total: int, most: int | None = None) -> DataFrame:
    """``rows`` joined with ``side``, a stored table of one row a key, ``n`` the number of the key's ``rows`` (or more),
    which are ``total`` at most. Keys that hold over ``1 / most`` of all rows, so fewer than ``most`` keys, are
    broadcast and leave the others' shuffle: no key's rows meet in one task unless they are few."""
    share = max(1, total // (most or MOST_HOT))
    hot = F.broadcast(side.where(F.col("n") > share).drop("n"))
    cold = side.where(F.col("n") <= share).drop("n")
    on = list(on)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns an operator is about to add, compared as Spark compares names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def grown(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of ``df`` with further fields."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])
