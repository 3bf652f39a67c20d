"""Line dedup over levelled sorted runs of line hashes, with DataFrame and SQL functions only.

A run is an immutable table of distinct lines ``(h1, h2, n_docs, max_doc)``, bucketed and sorted by the hash pair. A batch
of documents is summed to one row a line, in how many documents it stands and in which largest one, and merge-anti-joined
with the runs: lines that no run holds become the batch's own run, so that a line is in one run for good and merging the
runs of a full level (``runs.Levels``) only unites them. The lines that a run holds are sightings, marked in what the batch
writes: they are kept, with what the run has of the line, in a table that is small beside the runs, as is a new line that
stands in enough documents of its own batch. The lines that are dropped are read from the sightings alone; no run is looked at again.

Only hash pairs (128 bits) of lines long enough are shuffled; documents are counted before the shuffle, so a line that
every document holds costs one row a task. Where lines are matched with the documents they leave, the few lines that
hold a large share of all rows are broadcast (``common.split_join``) and all others meet by their hash. The text itself
moves only in the last join, from documents to the places of the lines they lose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starflow.llm.common import SPACE, cut, split_join, stored, without
from starflow.llm.runs import Levels

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
H = ("h1", "h2")


def lines_of(text: str = "text") -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def text_id(text: str) -> Column:
    """Tells the rows of one key apart."""
    return F.xxhash64(F.lit(3), F.coalesce(F.col(text), F.lit("")))


class LineIndex:
    """Runs of line hashes. ``copies``: a line found in at least so many documents is dropped from all but the largest."""

    def __init__(self, spark, shortest: int = 20, copies: int = 3, fanout: int = 4):
        self.shortest, self.copies = shortest, copies
        self.levels = Levels(spark, H, fanout, self.new)
        self.sightings: list[DataFrame] = []

    @staticmethod
    def new(rows: DataFrame) -> DataFrame:
        """Of a run as it was written, the lines that no run held before."""
        return rows.where("held IS NULL")

    def keys(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """``(doc_id, text_id, h1, h2, pos, first)``: one row per long line of each row of ``docs``; ``first`` marks the
        first of equal lines in it."""
        hashed = F.transform(
            lines_of(text),
            lambda line, pos: F.transform(
                F.filter(F.array(line_key(line)), lambda k: F.char_length(k) >= self.shortest),
                lambda k: F.struct(F.xxhash64(F.lit(1), k).alias("h1"), F.xxhash64(F.lit(2), k).alias("h2"), pos.alias("pos")),
            ),
        )
        rows = docs.where(F.col(key).isNotNull() & (F.char_length(text) >= self.shortest))
        rows = rows.select(F.col(key).cast("long").alias("doc_id"), text_id(text).alias("text_id"), F.flatten(hashed).alias("lines"))
        repeats = F.size(F.array_distinct(F.transform("lines", lambda x: x["h1"]))) < F.size("lines")
        rows = rows.withColumn("repeats", repeats).withColumn("lines", F.when(F.col("repeats"), F.sort_array("lines")).otherwise(F.col("lines")))
        same = lambda x, y: (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])
        before = F.when(F.col("repeats"), F.concat(F.array(F.lit(None)), F.slice("lines", 1, F.size("lines") - 1)))
        marked = F.when(~F.col("repeats"), F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), F.lit(True).alias("first"))))
        marked = marked.otherwise(
            F.zip_with("lines", before, lambda x, y: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), F.coalesce(~same(x, y), F.lit(True)).alias("first")))
        )
        return rows.select("doc_id", "text_id", F.explode(marked).alias("line")).select("doc_id", "text_id", "line.*")

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join a batch, given as ``keys()``, with the runs: new lines are its own run, known ones sightings."""
        batch = keys.groupBy(*H).agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        held = []
        for k, run in enumerate(self.levels.runs()):
            batch = batch.join(self.new(run).select(*H, F.struct("n_docs", "max_doc").alias(f"in_{k}")), [*H], "left")
            held.append(F.col(f"in_{k}"))
        held = F.coalesce(*held) if held else F.lit(None).cast("struct<n_docs:long,max_doc:long>")  # one run holds a line, if any
        name = self.levels.write(batch.select(*H, "n_docs", "max_doc", held.alias("held")))
        own = F.struct("n_docs", "max_doc")
        seen = self.levels.read(name).where(F.col("held").isNotNull() | (F.col("n_docs") >= self.copies))
        self.sightings.append(stored(seen.select(*H, F.coalesce("held", own).alias("first"), F.when(F.col("held").isNotNull(), own).alias("again"))))
        self.levels.add(name)

    def repeated(self) -> DataFrame:
        """``(h1, h2, n_docs, max_doc)`` of the lines that lose copies: what the line's run has and all later sightings."""
        rows = reduce(DataFrame.unionByName, self.sightings)
        sums = rows.groupBy(*H).agg((F.max("first.n_docs") + F.coalesce(F.sum("again.n_docs"), F.lit(0))).alias("n_docs"), F.greatest(F.max("first.max_doc"), F.max("again.max_doc")).alias("max_doc"))
        return sums.where(F.col("n_docs") >= self.copies)


def lost_places(keys: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(doc_id, text_id, places)``: the places of the lines that each row of the keys' documents loses."""
    lines = stored(repeated.select(*H, F.col("n_docs").alias("n"), "max_doc"))
    hits = split_join(keys.select("doc_id", "text_id", *H, "pos"), lines, H, keys.count())
    return hits.where("max_doc > doc_id").groupBy("doc_id", "text_id").agg(F.collect_list("pos").alias("places"))


def without_lines(docs: DataFrame, lost: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, less the lines at the ``lost`` places."""
    lost = lost.select(F.col("doc_id").alias("lost_doc_"), F.col("text_id").alias("lost_text_"), F.col("places").alias("lost_"))
    joined = docs.join(lost, (F.col(key).cast("long") == F.col("lost_doc_")) & (text_id(text) == F.col("lost_text_")), "left")
    lines = lines_of(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lost_")
    kept = F.when(F.col("lost_").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    return (
        joined.withColumn("kept_text", kept)
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(F.array_distinct("lost_")), F.lit(0)).cast("long"))
        .drop("lost_doc_", "lost_text_", "lost_")
        .select(*docs.columns, "n_lines", "n_dropped", "kept_text")
    )


def dedup_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 20, copies: int = 3, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line whose key (ASCII-stripped, A-Z lower-cased) has at least ``shortest`` code points and stands in at least
    ``copies`` rows is dropped everywhere but in the row of the largest ``key``; other lines stay, joined by a line feed.
    The table is taken in ``batches`` by a hash of the key, each adding its run.

    Null and empty texts are one empty line. Each row counts as a document: rows that repeat a key count apart, and
    the largest key keeps its lines in all its rows. Rows whose key is null keep all lines and count nowhere. Columns
    that bear the names of the results are replaced. An empty table stays empty.
    """
    docs = without(docs, ("n_lines", "n_dropped", "kept_text", "lost_doc_", "lost_text_", "lost_"))
    index = LineIndex(docs.sparkSession, shortest, copies, fanout)
    keys = stored(index.keys(docs, text, key))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for b in range(batches):
        index.add(keys.where(batch == b))
    lost = cut(lost_places(keys, index.repeated()))
    index.levels.remove()
    return without_lines(docs, lost, text, key)
