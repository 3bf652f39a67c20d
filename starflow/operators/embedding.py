"""Two-dimensional maps of feature tables in which near rows stay near (t-SNE).

Neighbours are found in cells: several times, rows are parted by quantiles of two random directions into cells of about
``CELL`` rows, in which all distances are taken; a row keeps the nearest of all its cells. Each row's distances become
probabilities of a given perplexity, which are made symmetric by one shuffle; both travel packed, by blocks of rows. The map is
then improved in rounds: tasks hold a block each and see all positions as they were at the round's start; a block's rows
are pulled by their neighbours and pushed away from all rows, whose field is a sum over a grid (charges are interpolated to
its nodes, and FFT multiplies them by the kernel), so that a step takes time linear in the rows. Tasks leave positions
and momenta as files in the shared folder, where the next round's tasks read them; the driver gets a count a task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starflow.operators import ranges
from starflow.session import checkpoint_dir, cut
from starflow.sources.fits import open_path

CELL = 1024  # rows whose distances are all taken
BLOCK = 2048  # rows a task improves at once
MOST = 2_000_000  # rows of a map: positions, 16 bytes a row, are read by all tasks
NODES = 3  # of the grid, in each direction of an interval
WIDEST = 0.6  # an interval: the kernel is one unit wide
MARGIN = 2.0  # of the grid around the rows, and so how far a row may leave their box in a round


def _direction(seed: int, number: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, number]).normal(size=width)


EDGE = np.dtype([("j", "<i4"), ("d", "<f8")])  # a neighbour and its squared distance, as tasks send them


def _near(rows: DataFrame, width: int, k: int, passes: int, seed: int) -> DataFrame:
    """``(i, near)``: the ``k`` rows nearest to each row in its cell of each pass, packed as ``EDGE``."""
    n = rows.count()
    parts = max(1, math.ceil(math.sqrt(n / CELL)))
    found = None
    for number in range(passes if parts > 1 else 1):
        along = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, _direction(seed, 2 * number + side, width).tolist())), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) for side in (0, 1)]
        jitter = lambda side: 1 + 1e-9 * F.pmod(F.xxhash64(F.lit(side), "i"), F.lit(1_000_003)) / 1_000_003
        placed = rows.select("i", "x", *[((a + 1e-12) * jitter(s)).alias(f"u{s}") for s, a in enumerate(along)])
        if parts > 1:
            inner = [q / parts for q in range(1, parts)]
            first = placed.agg(F.percentile_approx("u0", inner, 100_000)).first()[0]
            below = lambda bounds, u: F.size(F.filter(bounds, lambda b: b < F.col(u)))
            slabs = placed.withColumn("slab", below(F.array(*map(F.lit, first)), "u0"))
            second = slabs.groupBy("slab").agg(F.percentile_approx("u1", inner, 10_000).alias("b"))  # a row a slab
            placed = slabs.join(F.broadcast(second), "slab").select("i", "x", "slab", below(F.col("b"), "u1").alias("cell"))
        else:
            placed = placed.select("i", "x", F.lit(0).alias("slab"), F.lit(0).alias("cell"))

        def near(cell: pd.DataFrame) -> pd.DataFrame:
            ids, x = cell["i"].to_numpy(), np.stack(cell["x"].to_numpy())
            norm, out, most = (x * x).sum(1), [], min(k, len(x) - 1)
            for lo in range(0, len(x), 256):
                d = np.maximum(0.0, norm[lo : lo + 256, None] + norm[None] - 2 * x[lo : lo + 256] @ x.T)
                d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
                best = np.argpartition(d, most - 1, 1)[:, :most] if most else np.empty((len(d), 0), int)
                held = np.empty(best.shape, EDGE)
                held["j"] = ids[best]
                apart = x[best]
                apart -= x[lo : lo + len(d), None]
                held["d"] = np.einsum("abc,abc->ab", apart, apart)  # exact, the same in every pass
                out += [row.tobytes() for row in held]
            return pd.DataFrame({"i": ids, "near": out})

        part = placed.groupBy("slab", "cell").applyInPandas(near, "i long, near binary")
        found = part if found is None else found.unionByName(part)
    return found


def _merged(part: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a block, and the places and squared distances of the ``k`` nearest of each by rising distance; where a row
    has fewer, distances are infinite."""
    held = np.frombuffer(b"".join(part["near"]), EDGE)
    at = np.repeat(part["i"].to_numpy(np.int64), [len(v) // EDGE.itemsize for v in part["near"]])
    order = np.lexsort((held["j"], held["d"], at))
    at, held = at[order], held[order]
    new = np.r_[True, (at[1:] != at[:-1]) | (held["j"][1:] != held["j"][:-1])][: len(at)]  # in each pass the same distance
    at, held = at[new], held[new]
    ids = np.unique(part["i"].to_numpy(np.int64))
    row = np.searchsorted(ids, at)
    rank = np.arange(len(at)) - np.searchsorted(row, np.arange(len(ids)))[row]
    few = rank < k
    j, d = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.inf)
    j[row[few], rank[few]], d[row[few], rank[few]] = held["j"][few], held["d"][few]
    return ids, j, d


def nearest_rows(rows: DataFrame, width: int, k: int, passes: int = 6, seed: int = 1909) -> DataFrame:
    """``(i, near array<struct<d, j>>)``: up to ``k`` rows near each of ``rows(i, x)``, by rising distance: exact for up to
    ``CELL`` rows, else the best of ``passes`` partings into cells. Equal rows are spread over cells by hashes."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        ids, j, d = _merged(part, k)
        return pd.DataFrame({"i": ids, "near": [[{"d": float(v), "j": int(c)} for c, v in zip(*pair) if v < np.inf] for pair in zip(j, d)]})

    return _near(rows, width, k, passes, seed).groupBy(F.floor(F.col("i") / BLOCK)).applyInPandas(merge, "i long, near array<struct<d:double,j:long>>")


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Shares of a row's neighbours by squared distances, a normal's whose entropy has the perplexity's logarithm."""
    if not len(d):
        return d
    goal, low, high, beta = math.log(min(perplexity, len(d))), 0.0, math.inf, 1.0 / max(d.mean(), 1e-300)
    d = d - d.min()
    for _ in range(80):
        p = np.exp(-d * beta)
        total = p.sum()
        entropy = math.log(total) + beta * float(d @ p) / total
        if abs(entropy - goal) < 1e-7 or beta > 1e200:  # equal distances have one entropy only
            break
        low, high = (beta, high) if entropy > goal else (low, beta)
        beta = (low + high) / 2 if high < math.inf else beta * 2
    return p / total


def affinities_of(d: np.ndarray, perplexity: float) -> np.ndarray:
    """``affinities`` of many rows at once; infinite distances are of no neighbour and have no share."""
    given = d < np.inf
    count = given.sum(1)
    goal, low, high = np.log(np.minimum(perplexity, np.maximum(count, 1))), np.zeros(len(d)), np.full(len(d), np.inf)
    d = np.where(given, d, 0.0)
    beta = 1 / np.maximum(d.sum(1) / np.maximum(count, 1), 1e-300)
    d = d - np.where(given, d, np.inf).min(1, initial=np.inf, keepdims=True).clip(max=1e300) * given
    out, left = np.zeros(d.shape), np.flatnonzero(count)
    for _ in range(80):
        if not len(left):
            break
        p = np.exp(-d[left] * beta[left, None]) * given[left]
        total = p.sum(1)
        entropy = np.log(total) + beta[left] * (d[left] * p).sum(1) / total
        out[left] = p / total[:, None]
        far = ~((np.abs(entropy - goal[left]) < 1e-7) | (beta[left] > 1e200))  # equal distances have one entropy only
        over, left = (entropy > goal[left])[far], left[far]
        low[left], high[left] = np.where(over, beta[left], low[left]), np.where(over, high[left], beta[left])
        beta[left] = np.where(high[left] < np.inf, (low[left] + np.minimum(high[left], 1e300)) / 2, beta[left] * 2)
    return out


@dataclass
class Field:
    """The push of all rows on any place: sums over rows of ``1 / (1 + d^2)^2``, times distance, by a grid of charges."""

    low: np.ndarray
    step: float
    intervals: int
    potential: np.ndarray  # (charge, node, node): one and both coordinates
    total: float

    @classmethod
    def of(cls, y: np.ndarray) -> Field:
        """The field of rows at ``y``. Intervals are narrower than the kernel's core."""
        low, span = y.min(0), float((y.max(0) - y.min(0)).max())
        low, span = low - MARGIN, span + 2 * MARGIN
        intervals = max(50, math.ceil(span / WIDEST))
        step, size = span / intervals, intervals * NODES
        node, weight = _interpolation(y, low, step, intervals)
        grid = np.zeros((3, size * size))
        for a in range(NODES):
            for b in range(NODES):
                flat, share = node[0][:, a] * size + node[1][:, b], weight[0][:, a] * weight[1][:, b]
                for layer, held in zip(grid, (share, share * y[:, 0], share * y[:, 1])):
                    layer += np.bincount(flat, held, size * size)
        grid = grid.reshape(3, size, size)
        apart = np.arange(size) * step / NODES
        square = apart[:, None] ** 2 + apart[None, :] ** 2
        narrow, wide = _convolved(grid, 1 / (1 + square) ** 2), _convolved(grid[:1], 1 / (1 + square))[0]
        total = float((wide * grid[0]).sum()) - len(y)  # the sum over rows of what the grid gives at their places
        return cls(low, step, intervals, narrow, max(1e-12, total))

    def at(self, y: np.ndarray) -> np.ndarray:
        """The potentials at any places near the rows."""
        node, weight = _interpolation(y, self.low, self.step, self.intervals)
        held = self.potential[:, node[0][:, :, None], node[1][:, None, :]]
        return np.einsum("cnab,na,nb->nc", held, weight[0], weight[1])

    def push(self, y: np.ndarray) -> np.ndarray:
        """By how much each row at ``y`` is pushed, before division by the total."""
        v = self.at(y)
        return y * v[:, :1] - v[:, 1:3]


def _interpolation(y: np.ndarray, low: np.ndarray, step: float, intervals: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes and Lagrange weights of places in both directions; nodes lie evenly, ``NODES`` an interval."""
    nodes, weights = [], []
    for side in (0, 1):
        at = (y[:, side] - low[side]) / step
        box = np.clip(np.floor(at).astype(np.int64), 0, intervals - 1)
        u = (at - box) * NODES - 0.5  # nodes of the interval are at 0, 1, 2
        w = np.stack([(u - 1) * (u - 2) / 2, -u * (u - 2), u * (u - 1) / 2], 1)
        nodes.append(box[:, None] * NODES + np.arange(NODES))
        weights.append(w)
    return nodes, weights


def _convolved(grid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Each layer's sum over all nodes of a kernel of the distance."""
    n = kernel.shape[0]
    m = _even(2 * n)
    whole = np.zeros((m, m))
    whole[:n, :n] = kernel
    whole[m - n + 1 :, :] = whole[n - 1 : 0 : -1, :]
    whole[:, m - n + 1 :] = whole[:, n - 1 : 0 : -1]
    return np.fft.irfft2(np.fft.rfft2(grid, (m, m)) * np.fft.rfft2(whole), (m, m))[:, :n, :n]


def _even(n: int) -> int:
    """The next size of an FFT without large prime factors."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1 and n % 2 == 0:
            return n
        n += 1


def improved(y: np.ndarray, speed: np.ndarray, gain: np.ndarray, own: slice, degree: np.ndarray, to: np.ndarray, p: np.ndarray, field: Field, steps: int, pull: float, inertia: float, rate: float) -> None:
    """A few steps of the rows ``own``, in place: edges with weight ``p``, ``degree`` for each row, to the rows ``to`` pull, the
    field pushes. ``speed`` and ``gain`` are those of the rows ``own``."""
    first = np.concatenate([[0], np.cumsum(degree)[:-1]])
    for _ in range(steps):
        apart = [np.repeat(y[own, c], degree) - y[:, c].take(to) for c in (0, 1)]
        force = p / (1 + apart[0] * apart[0] + apart[1] * apart[1])
        pulled = np.stack([np.add.reduceat(force * a, first) for a in apart], 1)
        slope = 4 * (pull * pulled - field.push(y[own]) / field.total)
        same = np.sign(slope) == np.sign(speed)
        gain[:] = np.maximum(0.01, np.where(same, gain * 0.8, gain + 0.2))
        speed[:] = inertia * speed - rate * gain * slope
        there = y[own] + speed
        y[own] = np.clip(there, field.low, field.low + field.step * field.intervals)  # where the grid is
        speed *= there == y[own]


LINK = np.dtype([("i", "<i4"), ("j", "<i4"), ("p", "<f8")])


def _blocks(rows: DataFrame, width: int, perplexity: float, passes: int, seed: int, n: int) -> DataFrame:
    """``(block, degree, to, p)``: the symmetric affinities of each block's rows, packed by rows; each row has an edge to itself
    without weight, so that none is without an edge."""
    size, k = BLOCK, min(n - 1, round(3 * perplexity))

    def links(part: pd.DataFrame) -> pd.DataFrame:
        ids, j, d = _merged(part, k)
        p = affinities_of(d, perplexity)
        own, given = np.repeat(ids, k), (d < np.inf).ravel()
        own, j, p = own[given], j.ravel()[given], p.ravel()[given]
        held = np.empty(2 * len(own) + len(ids), LINK)
        held["i"], held["j"], held["p"] = np.concatenate([own, j, ids]), np.concatenate([j, own, ids]), np.concatenate([p, p, np.zeros(len(ids))])
        block = held["i"] // size
        order = np.argsort(block, kind="stable")
        held, block = held[order], block[order]
        to, start = np.unique(block, return_index=True)
        return pd.DataFrame({"block": to.astype(np.int64), "links": [v.tobytes() for v in np.split(held, start[1:])]})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        held = np.frombuffer(b"".join(part["links"]), LINK)
        key = held["i"].astype(np.int64) * n + held["j"]
        order = np.lexsort((held["p"], key))  # sums don't depend on the order of arrival
        key, p = key[order], held["p"][order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        p, i, to = np.add.reduceat(p, start) / (2 * n), key[start] // n, key[start] % n
        degree = np.unique(i, return_counts=True)[1]
        return pd.DataFrame({"block": part["block"].iloc[:1], "degree": [degree.astype(np.int32).tobytes()], "to": [to.astype(np.int32).tobytes()], "p": [p.astype(np.float32).tobytes()]})

    sent = _near(rows, width, k, passes, seed).groupBy(F.floor(F.col("i") / size)).applyInPandas(links, "block long, links binary")
    return cut(sent.groupBy("block").applyInPandas(pack, "block long, degree binary, to binary, p binary"))


@dataclass(frozen=True)
class Rounds:
    """Where the rounds of a map leave its rows: a folder a round, in it two files a task. Round 0 is drawn from the seed."""

    folder: str
    n: int
    block: int
    seed: int

    def own(self, block: int) -> slice:
        return slice(block * self.block, min(self.n, (block + 1) * self.block))

    def _files(self, number: int) -> tuple[fs.FileSystem, str]:
        return open_path(f"{self.folder}/{number}")

    def places(self, number: int) -> np.ndarray:
        """The places of all rows after so many rounds, around their mean."""
        if number == 0:
            return np.random.default_rng(self.seed).normal(scale=1e-4, size=(self.n, 2))
        system, base = self._files(number)
        y, found = np.empty((self.n, 2)), 0
        for file in system.get_file_info(fs.FileSelector(base)):
            if file.base_name.startswith("place-"):
                for block, at in self._read(system, file.path, float):
                    y[self.own(block)] = at
                    found += len(at)
        if found != self.n:
            raise ValueError(f"{found} of {self.n} rows of round {number} in {self.folder}")
        y -= y.mean(0)
        return y

    def motions(self, number: int, part: int) -> dict[int, np.ndarray]:
        """Momenta and gains of a task's blocks, (rows, 4)."""
        if number == 0:
            return {}
        system, base = self._files(number)
        return dict(self._read(system, f"{base}/motion-{part}", np.float32))

    def _read(self, system: fs.FileSystem, path: str, kind: type) -> Iterator[tuple[int, np.ndarray]]:
        with system.open_input_file(path) as file:
            raw = file.read()
        blocks = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
        sizes = [self.own(int(b)).stop - self.own(int(b)).start for b in blocks]
        held = np.frombuffer(raw, kind, offset=8 * (1 + len(blocks))).reshape(sum(sizes), -1)
        yield from zip(blocks.tolist(), np.split(held, np.cumsum(sizes)[:-1]))

    def write(self, number: int, part: int, rows: dict[int, tuple[np.ndarray, np.ndarray]]) -> int:
        """A task's places and motions by block. A task that is run again writes the same once more, whole files only."""
        system, base = self._files(number)
        system.create_dir(base, recursive=True)
        head = np.array([len(rows), *rows], np.int64).tobytes()
        for name, k, kind in (("motion", 1, np.float32), ("place", 0, float)):
            half = f"{base}/_{uuid.uuid4().hex}"
            with system.open_output_stream(half) as out:
                out.write(head + b"".join(r[k].astype(kind).tobytes() for r in rows.values()))
            system.move(half, f"{base}/{name}-{part}")
        return sum(len(r[0]) for r in rows.values())


_held: dict = {}  # of the round that this worker is in


def _once(kind: str, rounds: Rounds, number: int):
    """A round's places (``end``), or its places in the tasks' precision and their field (``start``), read once a worker."""
    if _held.get("of") != (kind, rounds, number):
        y = rounds.places(number)
        if kind == "start":
            y = y.astype(np.float32).astype(float)
            y = (y, Field.of(y))
        _held.update(of=(kind, rounds, number), is_=y)
    return _held["is_"]


def _improve(batches: Iterator[pa.RecordBatch], rounds: Rounds, number: int, **how) -> Iterator[pa.RecordBatch]:
    """A round of a task's blocks, after ``number`` rounds; gives how many rows it wrote."""
    part, held, done = TaskContext.get().partitionId(), None, {}
    for batch in batches:
        for row in batch.to_pylist():
            y, field = _once("start", rounds, number)
            held = rounds.motions(number, part) if held is None else held
            own = rounds.own(row["block"])
            before, motion = y[own].copy(), held[row["block"]].astype(float) if number else np.repeat([[0.0, 0.0, 1.0, 1.0]], own.stop - own.start, 0)
            degree, to, p = (np.frombuffer(row[c], t) for c, t in (("degree", np.int32), ("to", np.int32), ("p", np.float32)))
            improved(y, motion[:, :2], motion[:, 2:], own, degree, to, p, field, **how)
            done[row["block"]] = (y[own].copy(), motion)
            y[own] = before  # other blocks see it where it was
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([rounds.write(number + 1, part, done)])], names=["rows"])


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def tsne(df: DataFrame, columns: list[str], key: str = "id", perplexity: float = 35.0, rounds: int = 300, steps: int = 1, passes: int = 6, seed: int = 1909) -> DataFrame:
    """``(key, x, y)``: a map of the rows of ``df`` by t-SNE.

    ``rounds`` of ``steps`` steps each; neighbours pull twelvefold in the first half. Within a round the field stays and a
    block's rows see the others where they were at its start: more than two steps a round keep fewer neighbours. Nulls count as 0; rows of one key are rows of their own; one row lies at
    the origin, no rows give none. More than ``MOST`` rows are an error: map a sample (``trees.representative``).
    """
    spark, width = df.sparkSession, len(columns)
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])
    numbered = ranges.running(df.select(F.col(f"`{key}`").alias("key_"), x.alias("x"), F.lit(1).alias("one_"), F.monotonically_increasing_id().alias("m_")), [], [F.col("key_"), F.col("m_")], ["one_"])
    rows = cut(numbered.select("key_", F.col("one__before").cast("long").alias("i"), "x"))
    n = rows.count()
    if n > MOST:
        raise ValueError(f"{n} rows are more than the {MOST} of a map; map a representative sample of them")
    state, last = Rounds(f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}", n, BLOCK, seed), 0
    if n > 1:
        blocks = _blocks(rows.select("i", "x"), width, perplexity, passes, seed, n)
        files, where = _files(spark, state.folder)
        files.mkdirs(where)
        files.deleteOnExit(where)  # the map reads the last round when it is asked for
        for last in range(1, rounds + 1):
            pull, inertia = (12.0, 0.5) if last <= rounds // 2 else (1.0, 0.8)
            step = partial(_improve, rounds=state, number=last - 1, steps=steps, pull=pull, inertia=inertia, rate=max(50.0, n / 48))
            written = sum(r.rows for r in blocks.mapInArrow(step, "rows long").collect())  # a number a task
            if written != n:
                raise ValueError(f"round {last} of the map wrote {written} of {n} rows")
            files.delete(_files(spark, f"{state.folder}/{last - 1}")[1], True)
    end = last
    place = lambda c: F.pandas_udf(lambda i: pd.Series(_once("end", state, end)[i.to_numpy(), c] if n > 1 else np.zeros(len(i))), "double")
    return rows.select(F.col("key_").alias(key), place(0)("i").alias("x"), place(1)("i").alias("y"))
