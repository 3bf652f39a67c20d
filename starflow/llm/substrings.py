"""Substring dedup over a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Of the hashes of all shorter grams inside a document, the index keeps those
that winnowing picks: in every stretch of ``width - gram + 1`` grams the smallest one. Two equal windows hold the same
grams and so pick the same one, at the same place: a window that stands in two documents always leaves an equal
fingerprint in both, while the index has about ``2 / (width - gram + 2)`` entries a word.

Runs of the index are immutable tables ``(h, doc)``, bucketed and sorted by fingerprint (``runs.Levels``). Each new
batch is merge-joined with the runs there are, without a shuffle of theirs; the fingerprints that it shares with them,
or within itself, point to candidate entries of both sides. Then the batch becomes a run, and full levels are merged.
Candidate windows are verified by a digest of their whole word sequence, which together with the fingerprint has 128
bits; of equal sequences the smallest document is found.

Texts that equal one with a smaller key are found by their digest first: they lose all words, if they have a window at
all, and don't enter the index. Whole texts are shuffled once, into a table bucketed by document; all later joins by
document read it bucket by bucket. Fingerprints, windows and texts that hold a large share of all rows are broadcast
where they are joined (``common.split_join``), after counts and minima that are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm import common
from starflow.llm.common import cut, grown, split_join, stored, without
from starflow.llm.runs import Levels

TEXTS_AT_ONCE = 512
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive words from the hashes of the words."""
    out = np.full(max(0, len(hashes) - n + 1), seed, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * MULTIPLY
        out ^= out >> np.uint64(31)
    return out


def smallest(grams: np.ndarray, stretch: int) -> np.ndarray:
    """The smallest gram of each stretch of so many."""
    n = len(grams) - stretch + 1
    if n <= 0:
        return grams[:0]
    out, span = grams, 1
    while 2 * span <= stretch:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[stretch - span : stretch - span + n])


class FingerprintIndex:
    """Runs ``(h, doc)`` of fingerprints in levels of ``fanout``."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.levels = Levels(spark, ("h",), fanout)

    def add(self, entries: DataFrame) -> DataFrame:
        """Merge-join a batch ``(h, doc)`` with the runs, then add it; returns, stored, the entries ``(h, doc)`` of the
        batch and of the runs whose fingerprint the batch shares with another document. An entry that an earlier batch
        shared can come again."""
        name = self.levels.write(entries)
        batch, runs = self.levels.read(name), self.levels.runs()
        known = batch.groupBy("h").agg((F.min("doc") < F.max("doc")).alias("more"))
        for run in runs:
            there = run.groupBy("h").agg(F.lit(True).alias("there"))
            known = known.join(there, "h", "left").select("h", (F.col("more") | F.coalesce("there", F.lit(False))).alias("more"))
        shared = batch.join(known.where("more").select("h"), "h").select("h", "doc")
        for run in runs:
            shared = shared.union(run.join(batch.select("h"), "h", "left_semi").select("h", "doc"))
        shared = stored(shared)
        self.levels.add(name)
        return shared


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def picks(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``(doc, h)`` of the fingerprints of ``docs(doc, text)``, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, TEXTS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, TEXTS_AT_ONCE)):
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = gram_hashes(word_hashes(words_of(text)), gram)
                own = np.unique(smallest(grams, width - gram + 1))
                ids.append(np.full(len(own), doc, np.int64))
                found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), _signed(np.concatenate(found))], names=["doc", "h"])

    return docs.mapInArrow(run, "doc long, h long")


def candidates(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``(h, doc, pos, digests)`` from ``docs(doc, text, hs)``: for each picked gram that is among the row's ``hs``, the
    first of the consecutive windows that pick it and the 64-bit digests of all of them, packed. With the gram's own
    hash that is 128 bits a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, TEXTS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, TEXTS_AT_ONCE)):
            ids, hashed, at, packed = [], [], [], []
            for doc, text, hs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes = word_hashes(words_of(text))
                if len(hashes) < width:
                    continue
                least = smallest(gram_hashes(hashes, gram), width - gram + 1)
                begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                end = np.r_[begin[1:], len(least)]
                wanted = np.isin(least[begin], np.array(hs, np.int64).view(np.uint64))
                digests = gram_hashes(hashes, width, 0x5851F42D).astype("<u8").tobytes()
                for lo, hi in zip(begin[wanted].tolist(), end[wanted].tolist(), strict=True):
                    at.append(lo)
                    packed.append(digests[8 * lo : 8 * hi])
                ids.append(np.full(int(wanted.sum()), doc, np.int64))
                hashed.append(least[begin[wanted]])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(hashed)), pa.array(np.concatenate(ids)), pa.array(at, pa.int32()), pa.array(packed, pa.binary())],
                    names=["h", "doc", "pos", "digests"],
                )

    return docs.mapInArrow(run, "h long, doc long, pos int, digests binary")


def _unpacked(rows: DataFrame, *more: str) -> DataFrame:
    """``rows(h, digests, more...)`` with ``k`` and ``d``, a row a window: its place in the packed digests and its own."""
    n = (F.octet_length("digests") / 8).cast("int")
    opened = rows.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return opened.select("h", *more, "k", F.substring("digests", F.col("k") * 8 + 1, F.lit(8)).alias("d"))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``(doc, starts)``: places, in lists, of the windows of stored ``candidates`` rows whose sequence stands in a
    smaller document; a document can come in several rows.

    Windows of a fingerprint are compared where the fingerprint's rows meet. The rows of fingerprints that hold a large
    share of all rows, few by that, are united by their packed digests before they are shuffled: each different pack is
    compared once, and its smallest documents, a list, go back to the rows that hold it.
    """
    share = max(1, rows.count() // common.MOST_HOT)
    hot = F.broadcast(cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("h")))
    least = F.min("doc").over(Window.partitionBy("h", "d"))
    cold = _unpacked(rows.join(hot, "h", "left_anti").repartition("h"), "doc", "pos").withColumn("first", least)
    cold = cold.where("doc > first").select("doc", F.array(F.col("pos") + F.col("k")).alias("starts"))

    many = rows.join(hot, "h", "left_semi")
    packs = stored(many.groupBy("h", "digests").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n")))
    opened = _unpacked(packs.withColumn("pack", F.xxhash64("h", "digests")), "pack", "doc")
    firsts = stored(opened.groupBy("h", "d").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")))
    placed = split_join(opened.select("h", "d", "pack", "k"), firsts, ("h", "d"), firsts.agg(F.sum("n")).first()[0] or 0)
    lists = placed.groupBy("h", "pack").agg(F.sort_array(F.collect_list(F.struct("k", "first"))).alias("firsts"))
    lists = stored(lists.join(packs.select("h", F.xxhash64("h", "digests").alias("pack"), "n"), ["h", "pack"]))
    back = split_join(many.select("h", F.xxhash64("h", "digests").alias("pack"), "doc", "pos"), lists, ("h", "pack"), many.count())
    gone = F.filter("firsts", lambda f: f["first"] < F.col("doc"))
    back = back.select("doc", F.transform(gone, lambda f: F.col("pos") + f["k"]).alias("starts")).where(F.size("starts") > 0)
    return cold.union(back)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    marks = np.zeros(n + 1, np.int64)
    marks[starts] += 1
    marks[np.minimum(starts + width, n)] -= 1
    return np.cumsum(marks[:n]) > 0


def _removed(docs: DataFrame, text: str, width: int) -> DataFrame:
    """Takes ``copy_`` (the text stands in a row with a smaller key) and ``starts_`` (places of removed windows) from
    ``docs`` and adds the three results."""
    kept = [c for c in docs.columns if c not in ("copy_", "starts_")]
    places = [docs.columns.index(c) for c in (*kept, text, "copy_", "starts_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, TEXTS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, TEXTS_AT_ONCE)):
            columns = [batch.column(i) for i in places]
            sizes, gone, left = [], [], []
            for body, copy, starts in zip(*(c.to_pylist() for c in columns[-3:]), strict=True):
                words = words_of(body)
                out = np.zeros(len(words), bool)
                if copy and len(words) >= width:
                    out[:] = True
                elif starts:
                    out = covered(len(words), np.unique(np.array(starts, np.int64)), width)
                sizes.append(len(words))
                gone.append(int(out.sum()))
                stay = words if not gone[-1] else [words[i] for i in np.flatnonzero(~out)]
                left.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [*columns[:-3], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())],
                names=[*kept, "n_words", "n_removed", "kept_text"],
            )

    more = (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()))
    return docs.mapInArrow(run, grown(docs.select(*kept), *more))


def copies_of(ids: DataFrame) -> DataFrame:
    """``(doc)`` of the texts ``ids(doc, id1, id2)`` that equal one of a smaller document."""
    firsts = ids.groupBy("id1", "id2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.where("first < last").select("id1", "id2", "first", "n"))
    return split_join(ids, firsts, ("id1", "id2"), ids.count()).where("doc > first").select("doc").distinct()


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 13, gram: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text``.

    A word goes if it lies in a window of ``width`` words whose word sequence also starts in a row with a smaller key;
    windows are judged on the input. Kept words are joined by one space. The table enters the index in ``batches``, by
    a hash of the key.

    Null and blank texts have no words. Rows that repeat a key are taken as one document: they lose the windows that
    stand in a row with a smaller key, not those they share; should their texts differ, a place at which one of them
    has such a window counts for all, so such rows ought to be given keys of their own. Rows with a null key keep all
    words and count nowhere. Columns that bear the names of the results are replaced. An empty table stays empty.
    """
    docs = without(docs, ("n_words", "n_removed", "kept_text", "key_", "copy_", "starts_"))
    spark, names = docs.sparkSession, docs.columns
    plain = docs.withColumn(text, F.col(text).cast("string"))
    held = Levels(spark, ("doc",))
    keyed = plain.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("doc", F.col(f"c{names.index(key)}").cast("long"))
    texts = held.read(held.write(keyed.where("doc IS NOT NULL")))
    rows = texts.select("doc", F.col(f"c{names.index(text)}").alias("text")).where(F.length("text") >= 2 * width - 1)
    copies = copies_of(stored(rows.select("doc", F.xxhash64(F.lit(1), "text").alias("id1"), F.xxhash64(F.lit(2), "text").alias("id2"))))
    copies = stored(copies.withColumn("copy_", F.lit(True)))

    index = FingerprintIndex(spark, fanout)
    fresh = rows.join(copies, "doc", "left_anti")
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches))
    shared = reduce(DataFrame.union, [index.add(picks(fresh.where(batch == b), width, gram)) for b in range(batches)])
    index.levels.remove()
    hs = shared.groupBy("doc").agg(F.collect_set("h").alias("hs"))
    windows = stored(candidates(rows.join(hs, "doc").select("doc", "text", "hs"), width, gram))
    starts = repeated_windows(windows).groupBy("doc").agg(F.flatten(F.collect_list("starts")).alias("starts_"))

    lost = starts.join(copies, "doc", "full").select("doc", "copy_", "starts_")
    again = texts.join(lost, "doc", "left").drop("doc").toDF(*names, "copy_", "starts_")
    keyless = plain.where(F.col(key).cast("long").isNull()).withColumn("copy_", F.lit(None).cast("boolean")).withColumn("starts_", F.lit(None).cast("array<int>"))
    return _removed(again.union(keyless), text, width)
