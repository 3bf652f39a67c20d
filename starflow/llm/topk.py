"""Exact top-k search by inner product with sequential reads of sorted lists and bounds, without random access.

Candidates are held in blocks. A block has one list per dimension, sorted by component, made once and stored. Lists are
read step by step from both ends, so that what is unread of a dimension lies between the two components read last.
After each step a vector's score lies between what is known of it plus the smallest, and plus the largest, that each
of its unread components can add. A query's border is its k-th largest lower bound, or the k-th best score of the
blocks before, if larger; vectors whose upper bound is below it are out. Reading stops when the queries that share it
have few vectors left that could qualify, or at the end of the lists; then the scores of what is left are resolved.

Blocks meet queries in cells (block of queries, stripe of candidate blocks) of bounded size: the stated query set
against all rows. A cell returns at most k rows a query, and Spark keeps the best k of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starflow.llm.common import stored

STEPS = (1 / 8, 3 / 16, 1 / 4, 9 / 32, 5 / 16, 11 / 32, 3 / 8, 13 / 32, 7 / 16, 15 / 32, 1 / 2)  # of a list, from each end
FEW = 4  # times k: how many vectors a query may have left, in the mean, when reading stops
AT_ONCE = 256  # queries that share a read of a block's lists
STRIPE = 8  # blocks a cell holds, at most, where there are enough cells for all cores
EXACT = 2.0**53  # up to here doubles hold the integers


def _usable(vector: str):
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _scaled(vectors: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """``(id, x)``: integer vectors, of usable rows only."""
    rows = vectors.where(_usable(vector) & F.col(key).isNotNull())
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))


class Lists:
    """The sorted lists of one block of integer vectors: ``order[d]`` and ``values[d]``, by rising component."""

    def __init__(self, ids: np.ndarray, order: np.ndarray, values: np.ndarray):
        self.ids, self.order, self.values = ids, order, values

    @classmethod
    def of(cls, ids: np.ndarray, xs: np.ndarray) -> Lists:
        order = np.argsort(xs, axis=0, kind="stable").T
        values = np.take_along_axis(xs.T, order, 1)
        low, high = values.min(initial=0), values.max(initial=0)  # not by absolute values: the least long has none
        size = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        return cls(ids, order.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32), values.astype(size))


class Reader:
    """A pass over the lists of a block: what is read of each vector."""

    def __init__(self, lists: Lists):
        self.lists, self.at, self.n = lists, 0, len(lists.ids)
        dims = len(lists.order)
        self.known, self.unread = np.zeros((self.n, dims)), np.ones((self.n, dims))
        self.column = np.arange(dims)[:, None]

    def read(self, to: int) -> None:
        """Go on to ``to`` entries from each end of every list."""
        low = min(to, self.n - self.at)
        for part in (slice(self.at, low), slice(max(low, self.n - to), self.n - self.at)):
            rows = self.lists.order[:, part]
            self.known[rows, self.column] = self.lists.values[:, part]
            self.unread[rows, self.column] = 0
        self.at = min(to, self.n)

    @property
    def ended(self) -> bool:
        return 2 * self.at >= self.n

    def bounds(self, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that an unread component of each dimension adds to each query's score."""
        if self.ended:
            return np.zeros(qs.shape), np.zeros(qs.shape)
        ends = qs * self.lists.values[:, self.at], qs * self.lists.values[:, self.n - 1 - self.at]
        return np.minimum(*ends), np.maximum(*ends)


def _kth(values: np.ndarray, group: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The k-th largest value of each group, minus infinity where there are fewer."""
    order = np.lexsort((-values, group))
    first = np.searchsorted(group[order], np.arange(groups))
    at = first + k - 1
    ok = at < np.append(first[1:], len(group))
    out = np.full(groups, -np.inf)
    out[ok] = values[order][at[ok]]
    return out


def _paired(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 14):
        s = slice(lo, lo + (1 << 14))
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return out


def best(lists: Lists, own: np.ndarray, qs: np.ndarray, k: int, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``(row, query, score)`` of all candidates of a block that may be among the k best of a query, none of the query's
    ``own`` id, scores exact; and the share of the lists that was read before the bounds left few.

    ``border``: a score that k other candidates of each query are known to reach."""
    reader, n, m = Reader(lists), len(lists.ids), len(qs)
    mine = lists.ids[:, None] == own[None, :]
    qs, border = qs.astype(float), border.copy()
    rows = cols = None  # pairs that are left, once they are a small share
    for step in STEPS:
        reader.read(-(-n // 2) if step == STEPS[-1] else max(1, int(n * step)))
        least, most = reader.bounds(qs)
        if rows is None:
            known = reader.known @ qs.T
            lower, upper = known + reader.unread @ least.T, known + reader.unread @ most.T
            lower[mine] = upper[mine] = -np.inf
            if n > k:
                border = np.maximum(border, np.partition(lower, n - k, axis=0)[n - k])
            left = (upper >= border) & ~mine
            if np.count_nonzero(left) <= left.size // 8 or reader.ended:
                rows, cols = np.nonzero(left)
        else:
            known = _paired(reader.known, rows, qs, cols)
            border = np.maximum(border, _kth(known + _paired(reader.unread, rows, least, cols), cols, m, k))
            left = known + _paired(reader.unread, rows, most, cols) >= border[cols]
            rows, cols = rows[left], cols[left]
        if reader.ended or (rows is not None and len(rows) <= FEW * k * m):
            break
    share = min(1.0, 2 * reader.at / n)
    reader.read(-(-n // 2))
    return rows, cols, _paired(reader.known, rows, qs, cols), share


def _large(lists: Lists, qs: np.ndarray) -> bool:
    """Whether scores may pass what doubles hold exactly."""
    return float(np.abs(lists.values.astype(float)).max(initial=0)) * float(np.abs(qs.astype(float)).sum(1).max(initial=0)) >= EXACT


def _exact(lists: Lists, own: np.ndarray, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scores of a block in whole numbers of any size, cut off at what a long holds: for components whose bounds
    doubles can't tell apart."""
    xs = np.empty(lists.values.shape[::-1], object)
    np.put_along_axis(xs, lists.order.T.astype(np.int64), lists.values.T.astype(object), 0)
    rows, cols = np.nonzero(lists.ids[:, None] != own[None, :])
    scores = (xs @ qs.T.astype(object))[rows, cols]
    limit = (1 << 63) - 1
    return rows, cols, np.array([max(-limit, min(limit, int(s))) for s in scores], np.int64)


def search(blocks: list[Lists], own: np.ndarray, qs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, id, score)`` of the k best of each query over all blocks, ties to the smaller id."""
    border, found = np.full(len(qs), -np.inf), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for lists in blocks:
        if _large(lists, qs):
            rows, cols, scores = _exact(lists, own, qs)
        else:
            rows, cols, scores, _ = best(lists, own, qs, k, border)
        q, ids, s = (np.concatenate(p) for p in zip(found, (cols, lists.ids[rows], scores.astype(np.int64)), strict=True))
        order = np.lexsort((ids, -s, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order = order[place < k]
        found = q[order], ids[order], s[order]
        border = np.maximum(border, _kth(found[2].astype(float), found[0], len(qs), k))
    return found


def build_lists(vectors: DataFrame, size: int) -> DataFrame:
    """``(block, dim, ids, orders, vals, bytes)``: sorted lists of up to ``size`` vectors of one length a row, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list[int], list[list[int]]]] = {}
        number, part = 0, TaskContext.get().partitionId()

        def row(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, xs = waiting.pop(dim)
            lists, number = Lists.of(np.array(ids, np.int64), np.array(xs, np.int64).reshape(len(ids), dim)), number + 1
            packed = [pa.array([x.tobytes()]) for x in (lists.ids, lists.order, lists.values)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number]), pa.array([dim]), *packed, pa.array([lists.values.itemsize])], names=["block", "dim", "ids", "orders", "vals", "bytes"]
            )

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, xs = waiting.setdefault(len(x), ([], []))
                ids.append(i)
                xs.append(x)
                if len(ids) == size:
                    yield row(len(x))
        for dim in list(waiting):
            yield row(dim)

    return vectors.where(F.size("x") > 0).mapInArrow(run, "block long, dim long, ids binary, orders binary, vals binary, bytes long")


def _unpacked(row) -> Lists:
    ids = np.frombuffer(row.ids, np.int64)
    order = np.frombuffer(row.orders, np.uint16 if len(ids) <= 1 << 16 else np.uint32).reshape(row.dim, -1)
    return Lists(ids, order, np.frombuffer(row.vals, f"<i{row.bytes}").reshape(row.dim, -1))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: int = 256, block: int = 4096, query_block: int = 4096
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` rows of ``vectors`` with the highest integer inner
    product (all, if fewer), but those of its own key; ties go to the smaller key.

    Components are taken as ``floor(scale * x)``. Vectors that are null, empty or hold a null or non-finite component,
    and rows without a key, take no part; vectors of another length than the query's are no candidates. Repeated query
    keys are answered once, with the best of what their distinct vectors find; repeated candidate rows count each, and
    equal rows of one key take a rank each. Scores beyond a long are cut off at its ends. Further columns are ignored.
    No queries, or no other rows, give no rows.
    """
    rows = _scaled(vectors, vector, key, scale)
    asked = stored(_scaled(queries, vector, key, scale).distinct())
    spark = vectors.sparkSession
    n, m = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // query_block))
    stripes = min(blocks, max(-(-blocks // STRIPE), -(-spark.sparkContext.defaultParallelism // groups)))
    lists = stored(build_lists(rows.repartition(blocks, F.xxhash64("id", "x")), block))
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    held = lists.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes))).withColumn("q", numbers(groups))
    posed = asked.select("id", "x", F.size("x").cast("long").alias("dim"), F.pmod(F.xxhash64("id", "x"), F.lit(groups)).alias("q")).withColumn("stripe", numbers(stripes))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((3, 0), np.int64)]
        if len(left) and len(right):
            blocks = [_unpacked(r) for r in left.sort_values("block").itertuples()]
            for lo in range(0, len(right), AT_ONCE):
                own, qs = right["id"].to_numpy(np.int64)[lo : lo + AT_ONCE], np.array(right["x"].iloc[lo : lo + AT_ONCE].tolist(), np.int64)
                q, ids, scores = search(blocks, own, qs, k)
                out.append(np.stack([own[q], ids, scores]))
        return pd.DataFrame(np.concatenate(out, 1).T, columns=["query_id", "vec_id", "score"])

    keys, cells = ("q", "stripe", "dim"), groups * stripes
    spread = lambda df: df.repartition(cells, *keys).groupBy(*keys)
    found = spread(held).cogroup(spread(posed)).applyInPandas(cell, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
