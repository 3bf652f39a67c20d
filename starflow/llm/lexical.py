"""Ranked lexical search, a term at a time, with a limited number of accumulators.

The documents are read once: tasks count lengths and the occurrences of the items' terms and store them as inverted
lists of blocks of documents. The counts of all blocks give the terms' weights. Then each block is searched for every
item: its terms are taken rarest first, and every document of a list gets an accumulator, until what the terms that are
left can add at most is below the k-th best partial score (or the k-th best score of the blocks that the task has
searched before). From there on no accumulator is made, and the lists are only looked up for the documents that have
one, so that their scores stay exact. A block's ten best documents of an item meet those of the other blocks in two
levels.

No text and no list is shuffled, and a document is in one block whatever its length. The items' terms are sent to all
tasks in groups of at most ``MOST_PAIRS`` item-term pairs, a search a group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starflow.llm.common import stored

MOST_PAIRS = 1_000_000  # item-term pairs that are sent to the tasks at once
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 20  # a block ends at so many documents, or list entries if these are earlier

#: Letters and digits of ASCII and every character beyond ASCII make terms; A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCKS = "docs binary, masses binary, terms binary, starts binary, rows binary, counts binary, n_docs long, n_terms long, seen array<struct<term:int,df:long>>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def term_weight(n_docs: int, df: int) -> int:
    """How much a term counts that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """Inverted lists of a block: for each of ``terms`` the rows ``rows[starts[i]:starts[i + 1]]``, rising, and how often
    each row holds the term; ``docs`` and ``masses`` (numbers of terms) of the rows."""

    def __init__(self, docs: np.ndarray, masses: np.ndarray, terms: np.ndarray, starts: np.ndarray, rows: np.ndarray, counts: np.ndarray):
        self.docs, self.masses, self.terms, self.starts, self.rows, self.counts = docs, masses, terms, starts, rows, counts

    @classmethod
    def of(cls, docs: list[int], masses: list[int], terms: list[int], rows: list[int], counts: list[int]) -> Lists:
        found, at, many = np.array(terms, np.int32), np.array(rows, np.int32), np.array(counts, np.int64)
        order = np.argsort(found, kind="stable")
        names, starts = np.unique(found[order], return_index=True)
        return cls(np.array(docs, np.int64), np.array(masses, np.int64), names, np.append(starts, len(order)).astype(np.int64), at[order], many[order])

    def impacts(self, weights: np.ndarray, n_docs: int, n_terms: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
        """For each term its rows, what it adds to each, and the most that it adds."""
        big = 90 * int(self.masses.max(initial=0)) * n_docs >= 1 << 63  # whole numbers of any size
        lengths = self.masses.astype(object) if big else self.masses
        m = (10 + (90 * lengths * n_docs) // max(1, n_terms)).astype(np.int64)
        out = {}
        for i, t in enumerate(self.terms.tolist()):
            part = slice(self.starts[i], self.starts[i + 1])
            rows, tf = self.rows[part], self.counts[part]
            adds = int(weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows]))
            out[t] = rows, adds, int(adds.max())
        return out


def accumulate(lists: list[tuple[np.ndarray, np.ndarray, int]], size: int, k: int, border: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(rows, scores, made)`` of the rows of a block that may be among the k best of an item, scores exact, and how many
    accumulators were made. ``lists``: rows, additions and their largest, of the item's terms, rarest first; ``border``:
    a score that k other documents are known to reach."""
    left = np.cumsum([top for _, _, top in lists][::-1])[::-1].tolist() + [0]  # what the terms from here on add at most
    scores, has = np.zeros(size, np.int64), np.zeros(size, bool)
    at = 0
    while at < len(lists):
        partial = scores[has]
        kth = int(np.partition(partial, len(partial) - k)[len(partial) - k]) if len(partial) >= k else 0
        if left[at] < max(kth, border):
            break
        rows, adds, _ = lists[at]
        scores[rows] += adds
        has[rows] = True
        at += 1
    held = np.flatnonzero(has)
    for rows, adds, _ in lists[at:]:
        place = np.searchsorted(rows, held)
        place[place == len(rows)] = 0
        hit = rows[place] == held
        scores[held[hit]] += adds[place[hit]]
    return held, scores[held], len(held)


def search(blocks: Iterator[Lists], items: list[tuple[int, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(item, documents, scores)`` of the k best over all blocks, equal scores by document."""
    best = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item, _ in items}
    for block in blocks:
        impacts = block.impacts(weights, n_docs, n_terms)
        for item, terms in items:
            lists = [impacts[t] for t in terms if t in impacts and impacts[t][2] > 0]
            if not lists:
                continue
            docs, scores = best[item]
            rows, found, _ = accumulate(lists, len(block.docs), k, int(scores[-1]) if len(scores) == k else 0)
            docs, scores = np.append(docs, block.docs[rows]), np.append(scores, found)
            if len(scores) > k:  # ties at the border stay until they are sorted by document
                kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                docs, scores = docs[kept], scores[kept]
            order = np.lexsort((docs, -scores))[:k]
            best[item] = docs[order], scores[order]
    for item, (docs, scores) in best.items():
        yield item, docs, scores


def build_lists(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Inverted lists of ``docs(doc_id, text)`` for the terms of ``vocabulary``, a block of documents a row. Documents
    without an id only count."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = sent.value, pa.schema([
            *[(n, pa.binary()) for n in ("docs", "masses", "terms", "starts", "rows", "counts")], ("n_docs", pa.int64()), ("n_terms", pa.int64()),
            ("seen", pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())]))),
        ])
        ids, masses, terms, rows, counts, n_docs, n_terms, seen = [], [], [], [], [], 0, 0, Counter()

        def block() -> pa.RecordBatch:
            made = Lists.of(ids, masses, terms, rows, counts)
            packed = {n: getattr(made, n).tobytes() for n in ("docs", "masses", "terms", "starts", "rows", "counts")}
            row = packed | {"n_docs": n_docs, "n_terms": n_terms, "seen": [{"term": t, "df": n} for t, n in seen.items()]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                found = terms_of(text or b"")
                if not found:
                    continue
                n_docs, n_terms, own = n_docs + 1, n_terms + len(found), Counter(found)
                hits = [(known[t], own[t]) for t in own.keys() & known.keys()]
                seen.update(t for t, _ in hits)
                if hits and doc is not None:
                    terms.extend(t for t, _ in hits)
                    counts.extend(c for _, c in hits)
                    rows.extend([len(ids)] * len(hits))
                    ids.append(doc)
                    masses.append(len(found))
                if len(ids) >= BLOCK_DOCS or len(rows) >= BLOCK_POSTINGS:
                    yield block()
                    ids, masses, terms, rows, counts, n_docs, n_terms, seen = [], [], [], [], [], 0, 0, Counter()
        if n_docs:
            yield block()

    return docs.mapInArrow(run, BLOCKS)


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def _search_group(docs: DataFrame, asked: dict[int, set[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
    blocks = stored(build_lists(docs, vocabulary))
    totals = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = int(totals.n), int(totals.l)
    df = np.zeros(len(vocabulary), np.int64)
    for r in blocks.select(F.explode("seen").alias("s")).groupBy("s.term").agg(F.sum("s.df").alias("df")).toLocalIterator():  # a row a term of the items
        df[r.term] = r.df
    weights = np.array([term_weight(n_docs, int(n)) for n in df], np.int64)
    items = [(item, sorted((vocabulary[t] for t in terms if df[vocabulary[t]]), key=lambda t: (df[t], t))) for item, terms in asked.items()]
    sent = spark.sparkContext.broadcast((items, weights))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
        kinds = (np.int64, np.int64, np.int32, np.int64, np.int32, np.int64)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield Lists(*[np.frombuffer(x.as_py(), t) for x, t in zip(row, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        for item, ids, scores in search(unpacked(batches), items, weights, n_docs, n_terms, k):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], names=["item_id", "doc_id", "score"])

    lists = blocks.select("docs", "masses", "terms", "starts", "rows", "counts")
    found = lists.mapInArrow(run, "item_id long, doc_id long, score long").withColumn("part_", F.spark_partition_id())
    groups = max(1, math.isqrt(lists.rdd.getNumPartitions()))
    return _ranked(_ranked(found.withColumn("group_", F.pmod("part_", F.lit(groups))), k, "item_id", "group_").drop("rank"), k, "item_id")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest scores above 0 for each item.

    A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased. Weights
    and scores are whole numbers: see ``term_weight`` and ``Lists.impacts``. Every row of ``docs`` is a document; null
    and empty texts have no terms and count nowhere; rows without a key count in the statistics but are never returned;
    repeated rows take a rank each. Equal scores go by rising key. Items without an id take no part, rows of one item
    are one item with all their terms, and an item whose terms no document holds has no rows. Further columns are
    ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    posed = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    out, asked, pairs = None, {}, 0

    def flushed() -> DataFrame:
        part = _search_group(rows, asked, k)
        return part if out is None else out.unionByName(part)

    for r in posed.orderBy("item_id").toLocalIterator():  # rows of one item follow each other
        terms = set(terms_of(r.text.encode()))
        if asked and r.item_id not in asked and pairs + len(terms) > MOST_PAIRS:
            out, asked, pairs = flushed(), {}, 0
        asked.setdefault(r.item_id, set()).update(terms)
        pairs += len(terms)
    out = flushed()
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


RANK_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, size GROUP BY term),
parts AS (
  SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
  FROM asked JOIN postings USING (term) JOIN weights USING (term), size),
scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM parts WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""
