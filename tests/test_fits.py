"""FITS tables: round trips, row ranges, files made by hand byte for byte, errors."""

import struct

import pytest
from pyspark.sql import functions as F

from starflow.sources import fits


def cards(*lines):
    head = b"".join(x.ljust(80).encode() for x in (*lines, "END"))
    return head + b" " * (-len(head) % 2880)


def by_hand(path):
    """A file with an image before the table, written by hand."""
    primary = cards("SIMPLE  =                    T / standard", "BITPIX  =                  -32", "NAXIS   =                    1", "NAXIS1  =                    3") + b"\0" * 2880
    table = cards(
        "XTENSION= 'BINTABLE'           / a table", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  =                   33", "NAXIS2  =                    2", "PCOUNT  = 0", "GCOUNT  = 1",
        "TFIELDS = 7", "TTYPE1  = 'name    '", "TFORM1  = '6A      '", "TTYPE2  = 'it''s   '", "TFORM2  = 'D       '", "TTYPE3  = 'n       '", "TFORM3  = 'J       '", "TNULL3  =                  -99",
        "TTYPE4  = 'ok      '", "TFORM4  = 'L       '", "TTYPE5  = 'pair    '", "TFORM5  = '2E      '", "TTYPE6  = 'u       '", "TFORM6  = 'I       '", "TZERO6  =              32768.0", "TTYPE7  = 'scaled  '", "TFORM7  = 'I       '", "TSCAL7  =                  0.5",
        "COMMENT   more to come",
    )
    rows = b"abc   " + struct.pack(">di", 1.5, 7) + b"T" + struct.pack(">ffhh", 1, 2, -32768, 3) + b"\0" * 2
    rows += b"x\0\0\0\0\0" + struct.pack(">di", float("nan"), -99) + b"\0" + struct.pack(">ffhh", 3, float("nan"), 32767, -4) + b"\0" * 2
    path.write_bytes(primary + table + (rows[:31] + rows[33:64]).ljust(2880, b"\0"))


@pytest.fixture(autouse=True)
def known(spark):
    fits.register(spark)


def test_a_file_made_by_hand(spark, tmp_path):
    by_hand(tmp_path / "a.fits")
    body = (tmp_path / "a.fits").read_bytes().replace(b"NAXIS1  =                   33", b"NAXIS1  =                   31")
    (tmp_path / "a.fits").write_bytes(body)
    df = spark.read.format("fits").load(str(tmp_path / "a.fits"))
    assert df.dtypes == [("name", "string"), ("it's", "double"), ("n", "int"), ("ok", "boolean"), ("pair", "array<float>"), ("u", "bigint"), ("scaled", "double")]
    assert [tuple(r) for r in df.collect()] == [("abc", 1.5, 7, True, [1.0, 2.0], 0, 1.5), ("x", None, None, None, [3.0, None], 65535, -2.0)]
    assert df.select("u").where("n = 7").first().u == 0


def test_round_trip_in_row_ranges(spark, tmp_path):
    df = spark.range(5000).select(
        F.col("id"), (F.col("id") % 7).cast("int").alias("i"), (F.col("id") % 5).cast("short").alias("s"), F.expr("IF(id % 3 = 0, NULL, id * 0.5D)").alias("d"), F.expr("cast(id / 3 AS float)").alias("f"),
        F.expr("id % 2 = 0").alias("b"), F.expr("concat('curve ', id)").alias("t"), F.expr("array(id * 1D, 2D)").alias("a"), F.expr("IF(id % 4 = 0, NULL, id)").alias("holes"), F.expr("IF(id % 6 = 0, NULL, id % 2 = 0)").alias("maybe"),
    ).repartition(3)
    df.write.format("fits").mode("overwrite").option("bytesPerFile", 40_000).save(str(tmp_path / "t"))
    back = spark.read.format("fits").option("bytesPerPartition", 20_000).load(str(tmp_path / "t"))
    assert back.dtypes == df.dtypes and back.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    files = list((tmp_path / "t").iterdir())
    assert len(files) > 5 and all(f.suffix == ".fits" and f.stat().st_size % 2880 == 0 for f in files)
    df.limit(10).write.format("fits").mode("append").save(str(tmp_path / "t"))
    assert spark.read.format("fits").load(str(tmp_path / "t")).count() == 5010
    df.limit(4).write.format("fits").mode("overwrite").save(str(tmp_path / "t"))
    assert spark.read.format("fits").load(str(tmp_path / "t")).count() == 4


def test_empty_tables_and_errors(spark, tmp_path):
    df = spark.createDataFrame([], "id long, t string, a array<double>")
    df.write.format("fits").mode("overwrite").save(str(tmp_path / "e"))
    back = spark.read.format("fits").load(str(tmp_path / "e"))
    assert back.count() == 0 and [n for n, _ in back.dtypes] == ["id", "t", "a"]
    (tmp_path / "bad.fits").write_bytes(cards("SIMPLE  = T", "NAXIS   = 0"))
    with pytest.raises(Exception, match="no binary table"):
        spark.read.format("fits").load(str(tmp_path / "bad.fits"))
    with pytest.raises(Exception, match="has no column"):
        spark.sql("SELECT map('a', 1) AS m").write.format("fits").mode("overwrite").save(str(tmp_path / "m"))
    with pytest.raises(Exception, match="one length"):
        spark.sql("SELECT array(1, 2) AS a UNION ALL SELECT array(1)").coalesce(1).write.format("fits").mode("overwrite").save(str(tmp_path / "l"))
    assert not list((tmp_path / "l").glob("*")) if (tmp_path / "l").exists() else True


def test_feature_table(spark, tmp_path):
    """A table of features and labels, as training sets are kept."""
    names = [f"f{i}" for i in range(168)]
    df = spark.range(50).select("id", F.lit("VARIABLE").alias("class"), *[(F.col("id") * (i + 1) / 7).alias(n) for i, n in enumerate(names)])
    df.write.format("fits").mode("overwrite").save(str(tmp_path / "features"))
    back = spark.read.format("fits").load(str(tmp_path / "features"))
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
