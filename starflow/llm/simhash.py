"""SimHash fingerprints and their near-duplicate groups by a self-join of a binary trie.

Fingerprints are leaves of a binary trie over their bits. The join starts from the pair (root, root) and goes down both
nodes of a pair together: a pair of children adds the bits in which they differ to the pair's error, and pairs whose
error passes the budget are pruned with all that lies below them.

The upper trie is walked by Spark, four bits a round, over node counts only: a node with at most ``leaf`` distinct
fingerprints is not opened further, whatever its depth, so that a crowded region is cut finer and no task gets more
than ``leaf`` fingerprints and those of the nodes near it. Each surviving pair of such nodes is walked to the end in a
task, over sorted arrays in which a node is a range. A task returns a forest of its links (at most one row per
fingerprint), not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm.common import ASCII_LOWER, cut, grown, stored, without
from starflow.llm.components import components

STEP = 4  # bits a round of the upper trie
FRONTIER = 1 << 19  # node pairs a task holds at once
SMALL = 256  # node pairs with at most so many fingerprint pairs are compared directly


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8", n)
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """Every row of ``docs`` with the fingerprint of its whole text as a signed long."""
    docs = without(docs, (name,))
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x, words, seed) for x in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, grown(docs, (name, T.LongType())))


def _top(fp, bits: int):
    """The first ``bits`` bits of a fingerprint, as a number."""
    return F.shiftrightunsigned(fp, 64 - bits) if bits else F.lit(0).cast("long")


def _leaves(fps: DataFrame, leaf: int) -> DataFrame:
    """``fps`` with the node at which the upper trie ends for each: ``depth`` and ``node`` (its first bits)."""
    done, open_, depth = None, fps, 0
    while True:
        if depth:
            sized = open_.groupBy(_top(F.col("fp"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
            sized = cut(sized.select("node", (F.col("n") > leaf).alias("more") if depth < 64 else F.lit(False).alias("more")))
            marked = open_.withColumn("node", _top(F.col("fp"), depth)).join(sized, "node")
            ended = marked.where("not more").select("fp", "rep", F.lit(depth).alias("depth"), "node")
            done = ended if done is None else done.union(ended)
            if sized.where("more").isEmpty():
                return done
            open_ = marked.where("more").select("fp", "rep")
        depth += STEP


def _node_pairs(nodes: DataFrame, budget: int, deepest: int) -> DataFrame:
    """Pairs of end nodes ``(a_depth, a, b_depth, b)`` whose common bits differ in at most ``budget``; each pair once."""
    pairs = nodes.sparkSession.sql("SELECT 0 AS a_depth, 0L AS a, 0 AS b_depth, 0L AS b, 0L AS error")
    for depth in range(STEP, deepest + STEP, STEP):
        below = nodes.where(F.col("depth") >= depth)
        grown_ = below.select(
            _shift(F.col("node"), F.col("depth") - depth).alias("child"),
        ).distinct()
        grown_ = grown_.select(_shift(F.col("child"), F.lit(STEP)).alias("parent"), "child", F.lit(depth - STEP).alias("at"))
        for side in ("a", "b"):
            kids = grown_.select(F.col("at").alias(f"{side}_depth"), F.col("parent").alias(side), F.col("child").alias(f"{side}_child"))
            pairs = pairs.join(kids, [f"{side}_depth", side], "left")
        both = F.col("a_child").isNotNull() & F.col("b_child").isNotNull()
        nibble = F.when(both, F.bit_count(F.col("a_child").bitwiseXOR(F.col("b_child")).bitwiseAND(F.lit((1 << STEP) - 1)))).otherwise(0)
        same = (F.col("a_depth") == F.col("b_depth")) & (F.col("a") == F.col("b"))
        pairs = pairs.where(~same | F.col("a_child").isNull() | (F.col("a_child") <= F.col("b_child")))
        pairs = pairs.withColumn("error", F.col("error") + nibble).where(F.col("error") <= budget)
        pairs = pairs.select(
            F.when(F.col("a_child").isNull(), F.col("a_depth")).otherwise(depth).alias("a_depth"),
            F.coalesce("a_child", "a").alias("a"),
            F.when(F.col("b_child").isNull(), F.col("b_depth")).otherwise(depth).alias("b_depth"),
            F.coalesce("b_child", "b").alias("b"),
            "error",
        )
        pairs = cut(pairs)
    return pairs


def _shift(value, by):
    return F.call_function("shiftrightunsigned", value, by)


def trie_links(a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of two sorted arrays of fingerprints with at most ``budget`` differing bits, in chunks."""
    stack = [(np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([0]), 63)]
    while stack:
        alo, ahi, blo, bhi, error, bit = stack.pop()
        live = (ahi > alo) & (bhi > blo) & (error <= budget)
        alo, ahi, blo, bhi, error = alo[live], ahi[live], blo[live], bhi[live], error[live]
        small = (ahi - alo) * (bhi - blo) <= SMALL if bit >= 0 else np.ones(len(alo), bool)
        if small.any():
            yield from _compare(a, b, alo[small], ahi[small], blo[small], bhi[small], budget)
        alo, ahi, blo, bhi, error = alo[~small], ahi[~small], blo[~small], bhi[~small], error[~small]
        if not len(alo):
            continue
        if len(alo) > FRONTIER // 4:
            half = len(alo) // 2
            stack += [(alo[s], ahi[s], blo[s], bhi[s], error[s], bit) for s in (slice(0, half), slice(half, None))]
            continue
        amid, bmid = _middle(a, alo, ahi, bit), _middle(b, blo, bhi, bit)
        cat = np.concatenate
        stack.append((
            cat([alo, amid, alo, amid]), cat([amid, ahi, amid, ahi]),
            cat([blo, bmid, bmid, blo]), cat([bmid, bhi, bhi, bmid]),
            cat([error, error, error + 1, error + 1]), bit - 1,
        ))


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, in each range of equal higher bits, the values with ``bit`` set begin."""
    one = np.uint64(1 << bit)
    border = (values[lo] | one) & ~(one - np.uint64(1))
    return np.clip(np.searchsorted(values, border), lo, hi)


def _compare(a, b, alo, ahi, blo, bhi, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (ahi - alo) * (bhi - blo)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):  # about a million comparisons at once
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 20), "right")))
        s = slice(first, last)
        which = np.repeat(np.arange(first, last), sizes[s])
        rank = np.arange(len(which)) - np.repeat(ends[s] - sizes[s] - (ends[first - 1] if first else 0), sizes[s])
        width = (bhi - blo)[which]
        i, j = alo[which] + rank // width, blo[which] + rank % width
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        yield i[near], j[near]
        first = last


def forest(n: int, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n numbered nodes and chunks of links, the smallest number each node is connected to."""
    label = np.arange(n)
    for i, j in chunks:
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (label[label] != label).any():
                label = label[label]
    return label


def near_links(fps: DataFrame, budget: int = 2, leaf: int = 2048) -> DataFrame:
    """Links ``(a, b)`` between the ``rep`` of distinct fingerprints ``(fp, rep)`` that connect all fingerprints within
    ``budget`` differing bits, directly or over others: a forest of each task's links."""
    placed = cut(_leaves(fps, leaf))
    nodes = cut(placed.select("depth", "node").distinct())
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    pairs = _node_pairs(nodes, budget, deepest)
    own = placed.select(F.col("depth").alias("a_depth"), F.col("node").alias("a"), "fp", "rep", F.lit(True).alias("own"))
    near = (
        pairs.where("a_depth <> b_depth OR a <> b")
        .join(placed, (F.col("b_depth") == F.col("depth")) & (F.col("b") == F.col("node")))
        .select("a_depth", "a", "fp", "rep", F.lit(False).alias("own"))
    )

    def walk(key, rows: pd.DataFrame) -> pd.DataFrame:
        fp, rep = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
        order = np.lexsort((fp,))
        fp, rep, mine = fp[order], rep[order], rows["own"].to_numpy()[order]
        at = np.flatnonzero(mine)
        chunks = ((at[i], j) for i, j in trie_links(fp[at], fp, budget))
        label = forest(len(fp), chunks)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": rep[label[moved]], "b": rep[moved]})

    return own.union(near).groupBy("a_depth", "a").applyInPandas(walk, "a long, b long")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, seed: int = 42, budget: int = 2, leaf: int = 2048
) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    A bit of the fingerprint is set if over half of the text's shingles of ``words`` words (A-Z lower-cased, repeats
    included) have it set in their XXH64. Fingerprints that differ in ``budget`` bits or fewer are linked;
    ``component_id`` is the smallest ``key`` among all that links reach, the row's own included.

    Null, empty and blank texts have fingerprint zero and are linked like others; shorter texts are one shingle. Equal
    texts meet as one fingerprint, so copies cost one row each. Rows that repeat a key with another text have a
    fingerprint and a component each. A null key gets a null ``component_id`` unless its
    fingerprint is linked with one that has a key. Columns that bear the names of the results are replaced. An empty
    table stays empty.
    """
    fp = stored(fingerprints(without(docs, ("fingerprint", "component_id", "of_fp_")), text, "fp_", words, seed))
    distinct = cut(fp.groupBy(F.col("fp_").alias("fp")).agg(F.min(F.col(key).cast("long")).alias("rep")))
    links = near_links(distinct.where(F.col("rep").isNotNull()).select("fp", F.col("fp").alias("rep")), budget, leaf)
    parts = components(links)
    placed = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "component").select(F.col("fp").alias("of_fp_"), "component_id")
    return (
        fp.join(named, F.col("fp_") == F.col("of_fp_"), "left")
        .withColumn("fingerprint", F.lpad(F.lower(F.hex("fp_")), 16, "0"))
        .drop("fp_", "of_fp_")
    )
