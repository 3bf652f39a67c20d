"""Light curves and feature tables from and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starflow.session import cut

LABELS = ("filename", "label", "id")


def dense_ids(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``id``, their place from 1 in the order of columns that tell them apart.

    A range-partitioned sort and the sizes of its partitions; no task holds all rows.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id()))
    part = F.shiftright("place_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # a row a partition
    numbered = placed.withColumn("part_", part).join(starts, "part_")
    return numbered.withColumn("id", F.col("before_") + F.col("place_").bitwiseAND((1 << 33) - 1) + 1).drop("part_", "place_", "before_")


def read_directory(spark: SparkSession, path: str, skiprows: int = 0, label: str | None = None) -> DataFrame:
    """``(lc_id, seq, time, mag, magerr, class, filename)`` from text files ``path/<class>/<file>``.

    Columns are separated by white space, the first three count; ``#`` begins a comment. A file with a line that isn't
    numbers, has fewer than three of them or another number of columns than its first is left out as a whole; its
    ``lc_id`` (the file's place in the order of class and name, from 1) stays unused. With ``label``, files are
    ``path/<file>`` of that class.
    """
    pattern = f"{path.rstrip('/')}/*" if label is not None else f"{path.rstrip('/')}/*/*"
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    in_file = Window.partitionBy("file").orderBy("block", "m")
    lines = lines.withColumn("seq", F.row_number().over(in_file)).where(F.col("seq") > skiprows)
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    lines = lines.withColumn("body", F.regexp_replace(body, r"\s+", " ")).where("body <> ''")
    cells = F.split("body", " ")
    numbers = F.transform(cells, lambda x: x.try_cast("double"))
    parsed = lines.select("file", "seq", numbers.alias("v"))
    sound = parsed.groupBy("file").agg(F.bool_and(F.size("v") >= 3).alias("wide"), F.bool_and(~F.exists("v", lambda x: x.isNull())).alias("clean"), F.countDistinct(F.size("v")).alias("widths"))
    parts = F.split("file", "/")
    listed = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("file")).select("file", (F.lit(label) if label is not None else F.element_at(parts, -2)).alias("class"), F.element_at(parts, -1).alias("filename"))
    files = dense_ids(listed, "class", "filename").withColumnRenamed("id", "lc_id")
    good = files.join(sound.where("wide AND clean AND widths = 1"), "file", "left_semi")
    get = lambda k: F.col("v")[k]
    return parsed.join(good, "file").select("lc_id", F.col("seq").cast("long"), get(0).alias("time"), get(1).alias("mag"), get(2).alias("magerr"), "class", "filename")


def from_arrays(spark: SparkSession, curves: list, label: str = "ML", first_id: int = 1) -> DataFrame:
    """The same relation from in-memory curves of shape (n, 3)."""
    rows = [(first_id + k, i, float(t), float(m), float(e), label, None) for k, curve in enumerate(curves) for i, (t, m, e) in enumerate(curve)]
    return spark.createDataFrame(rows, "lc_id long, seq long, time double, mag double, magerr double, class string, filename string")


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """A feature table with a header: labels as text, all else as doubles. The schema is taken from the header alone."""
    header = spark.read.option("header", True).csv(path)
    kinds = ", ".join(f"`{c}` {'string' if c in LABELS else 'double'}" for c in header.columns)
    return spark.read.option("header", True).schema(kinds).csv(path)


def read_features_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A feature table of space-separated columns with ``#`` comments; ``columns`` are all its names."""
    kinds = ", ".join(f"`{c}` {'string' if c in LABELS else 'double'}" for c in columns)
    return spark.read.option("sep", " ").option("comment", "#").schema(kinds).csv(path)


def read_xml_table(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Rows of an XML table, such as a list of stars with their periods and amplitudes."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_votable(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a VOTable's ``TABLEDATA``, whose cells have no names but places: ``columns`` names the first of them. Cells
    that aren't numbers are null."""
    cells = spark.read.format("xml").option("rowTag", "TR").schema("TD array<string>").load(path)
    return cells.select(*[F.get("TD", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(columns)])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``(lc_id, seq, time, mag, magerr, class)`` of the points that ``write_points`` wrote. ``seq`` numbers a series'
    points in the order of time, which is what the file keeps."""
    points = spark.read.parquet(path).select(F.col("id").alias("lc_id"), "time", F.col("mag").cast("double"), F.col("magerr").cast("double"), "class")
    return points.withColumn("seq", (F.row_number().over(Window.partitionBy("lc_id").orderBy("time", "mag", "magerr")) - 1).cast("long"))


def write_selection(selection: DataFrame, path: str) -> None:
    """The results of feature selection as CSV: feature, mean and deviation of its importance, decision, best first."""
    ordered = selection.where("decision <> 'shadow'").orderBy(F.desc("mean"), "feature")  # a row a feature
    ordered.select("feature", "mean", "deviation", "decision").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_points(points: DataFrame, path: str) -> None:
    """Points as Parquet: class, id, time, and magnitude and error as 32-bit floats."""
    points.select("class", F.col("lc_id").alias("id"), "time", F.col("mag").cast("float"), F.col("magerr").cast("float")).write.mode("overwrite").parquet(path)


def write_features_csv(features: DataFrame, path: str, loaded: bool = False) -> None:
    """A feature table as CSV: features then label, or (``loaded``) filename, label and id first."""
    values = [c for c in features.columns if c not in (*LABELS, "lc_id")]
    features.select(*(LABELS if loaded else ()), *values, *(() if loaded else ("label",))).write.mode("overwrite").option("header", True).csv(path)


def write_features_text(features: DataFrame, path: str, loaded: bool = False) -> None:
    """A feature table as space-separated text with a comment line of its names at the top of each file."""
    values = [c for c in features.columns if c not in (*LABELS, "lc_id")]
    columns = [*(("filename", "label", "id") if loaded else ("label",)), *values]
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of a partition, and so of a file
    text = F.when(first, F.concat(F.lit(f"# {' '.join(columns)}\n"), line)).otherwise(line)
    features.select(text.alias("value")).write.mode("overwrite").text(path)


def points_of(points: DataFrame, lc_id: int | None = None, label: str | None = None, seed: int = 0) -> DataFrame:
    """The points of one curve, given by id, or drawn by ``seed`` from those of a class."""
    if lc_id is not None:
        return points.where(F.col("lc_id") == lc_id)
    chosen = points.where(F.col("class") == label) if label is not None else points
    one = chosen.groupBy("lc_id").agg(F.first("class").alias("c_")).orderBy(F.xxhash64(F.lit(seed), "lc_id")).limit(1)
    return points.join(one, "lc_id", "left_semi")
