"""Embedding near-dedup by sorted projection passes.

Each pass hashes all vectors by signs of its own random projections, orders them lexicographically by the concatenated
signs and compares windows of neighbours in that order. A window ends where a run of equal signs ends, near ``window``
rows; a run that is longer than two windows is cut into parts, and all its parts are compared with each other, so that
crowded regions lose nothing. Two vectors at the threshold's angle agree in all ``bits`` signs of a pass with the
probability ``(1 - angle / pi) ** bits``, whatever the other vectors are; ``bits`` grows with the logarithm of the rows,
and there are as many passes as leave a link unmet by all of them with a probability of ``miss`` at most: about
``(rows / window) ** 0.22 * log(1 / miss)`` at cosine 0.9. Up to ``window`` rows, one window holds them all.

Products are taken in single precision, and again in double precision where they are near the threshold: no pair below
it is linked. A window returns a forest that spans its verified links; the forests of all passes are united into groups.

Inside each group, links are then counted exactly. Angles to a group's pivot (its smallest vector) decide most of them
without a comparison: with angles x and y to the pivot, two vectors are linked for certain if x + y is within the
threshold's angle and not linked if x and y differ by more. Members in order of their angle are cut into blocks, and
only pairs of blocks whose angles leave it open are compared, a pair of blocks a task row. Equal vectors are one vector
with a count throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm.common import cut, stored, without
from starflow.llm.components import components

SLACK = 1e-9  # how much rounding may move an angle; pairs this near the border are compared


def usable(vector: str):
    """Whether a vector has a length and only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _unit(raw: bytes, rows: int, kind: str) -> np.ndarray:
    """Packed vectors as unit vectors of doubles, whatever the size of their components."""
    x = np.frombuffer(raw, kind).astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, kind: str) -> np.ndarray:
    """Rows of a binary column as unit vectors."""
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return _unit(b"".join(values), len(values), kind)


def _packed(df: DataFrame, kind: str) -> DataFrame:
    """``(id, v)`` with the vector as binary numbers of a NumPy type in place of the array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "v"])

    return df.mapInArrow(run, "id long, v binary")


def passes_of(rows: int, window: int, threshold: float, miss: float) -> tuple[int, int]:
    """``(passes, bits)`` for a table of so many rows."""
    bits = max(0, int(np.ceil(np.log2(max(1, rows) / window))))
    met = (1 - np.arccos(threshold) / np.pi) ** bits
    return (1 if met == 1 else max(1, int(np.ceil(np.log(miss) / np.log1p(-met))))), bits


def _keys(vectors: DataFrame, passes: int, bits: int, seed: int, kind: str) -> DataFrame:
    """``(id, v, keys)``: the concatenated signs of each pass, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for dim, at in _by_dimension(batch.column(1), kind):
                rows = batch.take(pa.array(at))
                planes = np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))
                signs = (_matrix(rows.column(1), kind) @ planes > 0).reshape(len(at), passes, bits)
                keys = (signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "v", "keys"])

    return vectors.mapInArrow(run, "id long, v binary, keys array<long>")


def _by_dimension(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(v) for v in column.to_pylist()])
    for size in np.unique(sizes):
        yield int(size) // np.dtype(kind).itemsize, np.flatnonzero(sizes == size)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(root, member)`` for every end of the links that is not the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        for side in (root[x], root[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span what ``near`` (left x right) links: themselves if they are few, else a star a component."""
    if np.count_nonzero(near) <= len(left) + len(right):
        i, j = np.nonzero(near)
        yield left[i], right[j]
        return
    todo = near.any(1)
    while todo.any():
        rows, columns, front = np.zeros(len(left), bool), np.zeros(len(right), bool), np.array([todo.argmax()])
        while len(front):
            rows[front] = True
            found = near[front].any(0) & ~columns
            columns |= found
            front = np.flatnonzero(near[:, found].any(1) & ~rows)
        ids = np.concatenate([left[rows], right[columns]])
        yield np.full(len(ids), ids.min()), ids
        todo &= ~rows


def _blocks(x: np.ndarray, block: int) -> list[tuple[slice, np.ndarray, float]]:
    """Slices of unit vectors with a centre and the largest angle to it."""
    out = []
    for at in range(0, len(x), block):
        part = x[at : at + block]
        mean = part.mean(0)
        centre = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else part[0]
        out.append((slice(at, at + block), centre, float(np.arccos(np.clip(part @ centre, -1, 1)).max())))
    return out


def _near(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit vectors of ``x`` and ``y`` have a cosine of ``threshold`` or more."""
    slack = 1e-6 + 1.2e-7 * x.shape[1]  # above the rounding of single precision
    cos = x32 @ y32.T
    near = cos >= threshold + slack
    i, j = np.nonzero(~near & (cos >= threshold - slack))
    for k in range(0, len(i), 65536):
        p, q = i[k : k + 65536], j[k : k + 65536]
        near[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
    return near


def _windows(keys: DataFrame, window: int) -> DataFrame:
    """``(pass, key, tile, parts)``: the window in which the run of each key lies, in the order of the keys. A run of
    over two windows is a window of its own, in parts."""
    sizes = keys.select(F.posexplode("keys").alias("pass", "key")).groupBy("pass", "key").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("pass").orderBy("key")) - F.col("n")  # a row a run: rows / window of them
    crowded = F.col("n") > 2 * window
    tile = F.when(crowded, -1 - F.col("key")).otherwise(F.floor(before / window))
    return cut(sizes.select("pass", "key", tile.cast("long").alias("tile"), F.when(crowded, F.ceil(F.col("n") / window)).otherwise(1).cast("int").alias("parts")))


def spanning_links(vectors: DataFrame, threshold: float, seed: int, window: int = 2048, miss: float = 0.001, block: int = 1024, kind: str = "<f8") -> DataFrame:
    """``(a, b)``: links among ``vectors(id, v)``, all of cosine ``threshold`` or more, that span the components of those
    found."""
    passes, bits = passes_of(vectors.count(), window, threshold, miss)
    limit = float(np.arccos(threshold))
    keyed = stored(_keys(vectors, passes, bits, seed, kind))
    rows = keyed.select("id", "v", F.posexplode("keys").alias("pass", "key")).join(_windows(keyed, window), ["pass", "key"])
    home, other = F.pmod(F.xxhash64("id", "pass"), F.col("parts")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.select("id", "v", "pass", "tile", home.cast("int").alias("home"), other.alias("other"))
    dealt = dealt.withColumn("lo", F.least("home", "other")).withColumn("hi", F.greatest("home", "other"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        one = rows["lo"].iloc[0] == rows["hi"].iloc[0]
        for _, same in rows.groupby(rows["v"].map(len), sort=True):
            left, right = same[same["home"] == same["lo"]], same[same["home"] == same["hi"]]
            if not len(left) or not len(right):
                continue
            x = _matrix(left["v"], kind)
            y = x if one else _matrix(right["v"], kind)
            x32, ids = x.astype(np.float32), left["id"].to_numpy()
            y32, ids_2 = (x32, ids) if one else (y.astype(np.float32), right["id"].to_numpy())
            own, others = _blocks(x, block), _blocks(y, block)
            for p, centre, radius in own:
                for q, centre_2, radius_2 in others:
                    if one and q.start < p.start:
                        continue
                    apart = float(np.arccos(np.clip(centre @ centre_2, -1, 1)))
                    if apart - radius - radius_2 > limit + 1e-6:  # no pair of the blocks is near enough
                        continue
                    if apart + radius + radius_2 < limit - 1e-6:  # all pairs are
                        ends_2 = np.concatenate([ids[p], ids_2[q]])
                        a.append(np.full(len(ends_2), ends_2.min()))
                        b.append(ends_2)
                        continue
                    near = _near(x[p], y[q], x32[p], y32[q], threshold)
                    if one and p == q:
                        np.fill_diagonal(near, False)
                    for ends, ends_2 in _spanning(near, ids[p], ids_2[q]):
                        a.append(ends)
                        b.append(ends_2)
        root, member = _forest(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": root, "b": member})

    return dealt.groupBy("pass", "tile", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def exact_links(members: DataFrame, threshold: float, block: int = 256, kind: str = "<f8") -> DataFrame:
    """``(id, links)`` from ``members(id, n, v, group)``: how many vectors of its group each is linked with, itself and
    its copies included, ``n`` counting the copies of each."""
    limit = float(np.arccos(threshold))
    pivots = members.where(F.col("id") == F.col("group")).select("group", F.col("v").alias("pivot"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
                cos = [float(_unit(a, 1, kind)[0] @ _unit(b, 1, kind)[0]) if len(a) == len(b) else -1.0 for a, b in pairs]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["id", "n", "v", "group", "angle"])

    turned = members.select("id", "n", "v", "group").join(pivots, "group").select("id", "n", "v", "group", "pivot")
    turned = turned.mapInArrow(angles, "id long, n long, v binary, group long, angle double")
    # ranks by angle inside a group: first over coarse steps of the angle, then inside a step, so that no task sorts a group
    step = F.floor(F.col("angle") * 4096).cast("long")
    sizes = turned.withColumn("step", step).groupBy("group", "step").agg(F.count(F.lit(1)).alias("m"))
    ahead = sizes.select("group", "step", (F.sum("m").over(Window.partitionBy("group").orderBy("step")) - F.col("m")).alias("ahead"))
    inside = Window.partitionBy("group", "step", "salt").orderBy("angle", "id")
    salted = turned.withColumn("step", step).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)))
    salts = salted.groupBy("group", "step", "salt").agg(F.count(F.lit(1)).alias("m"))
    shift = salts.select("group", "step", "salt", (F.sum("m").over(Window.partitionBy("group", "step").orderBy("salt")) - F.col("m")).alias("shift"))
    numbered = (
        salted.withColumn("r", F.row_number().over(inside) - 1)
        .join(shift, ["group", "step", "salt"])
        .join(ahead, ["group", "step"])
        .withColumn("block", F.floor((F.col("r") + F.col("shift") + F.col("ahead")) / block))
        .select("id", "n", "v", "group", "angle", "block")
    )

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("angle")
        one = lambda c, t: rows[c].to_numpy(t).tobytes()
        return pd.DataFrame([{
            "group": key[0], "block": key[1], "lo": rows["angle"].min(), "hi": rows["angle"].max(), "total": int(rows["n"].sum()),
            "ids": one("id", np.int64), "ns": one("n", np.int64), "vs": b"".join(rows["v"]), "dim": len(rows["v"].iloc[0]),
        }])

    shape = "group long, block long, lo double, hi double, total long, ids binary, ns binary, vs binary, dim long"
    spread = numbered.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "block")
    packed = stored(spread.groupBy("group", "block").applyInPandas(pack, shape))
    thin = packed.select(F.col("group"), *[F.col(c).alias(f"{c}_2") for c in ("block", "lo", "hi", "total")])
    apart = F.greatest(F.col("lo_2") - F.col("hi"), F.col("lo") - F.col("hi_2"))
    pairs = packed.select("group", "block", "lo", "hi").join(thin, "group").where(apart <= limit + SLACK)
    sure = F.col("hi") + F.col("hi_2") <= limit - SLACK
    whole = pairs.where(sure).groupBy("group", "block").agg(F.sum("total_2").alias("sure"))
    open_ = pairs.where(~sure).select("group", "block", "block_2")
    right = packed.select("group", F.col("block").alias("block_2"), F.col("ns").alias("ns_2"), F.col("vs").alias("vs_2"))
    work = open_.join(packed.select("group", "block", "ids", "vs", "dim"), ["group", "block"]).join(right, ["group", "block_2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vs, dim, ns_2, vs_2 in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                links = (_unit(vs, len(vs) // dim, kind) @ _unit(vs_2, len(vs_2) // dim, kind).T >= threshold) @ np.frombuffer(ns_2, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(links.astype(np.int64))], names=["id", "links"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sure in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), sure, np.int64))], names=["id", "links"])

    compared = work.select("ids", "vs", "dim", "ns_2", "vs_2").mapInArrow(count, "id long, links long")
    certain = packed.join(whole, ["group", "block"]).select("ids", "sure").mapInArrow(spread, "id long, links long")
    return compared.union(certain).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    threshold: float = 0.9,
    seed: int = 7,
    window: int = 2048,
    miss: float = 0.001,
) -> DataFrame:
    """Every row of ``vectors`` with ``n_links`` (other rows of cosine ``threshold`` or more, as far as one group holds
    them), ``component_id`` (the smallest key reachable by links found) and ``kept`` (whether it is that key).

    ``window`` and ``miss`` set the passes, see above; no link is lost up to ``window`` distinct vectors, and none of a
    lower cosine is ever counted. Vectors that are null, empty, zero or hold a null or non-finite component have no
    links. Equal vectors link. Rows that repeat a key count as rows of their own for all ``n_links``, also with other
    vectors. Rows with a null key take no part and have no component. Vectors of different lengths don't link. Columns
    that bear the names of the results are replaced. An empty table stays empty.
    """
    vectors = without(vectors, ("n_links", "component_id", "kept", "key_", "h1_", "h2_", "links_", "least_"))
    doubles = F.transform(vector, lambda x: x.cast("double") + 0.0)
    hashes = lambda x: (F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"))
    clean = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), doubles.alias("x"))
    plain = stored(clean.select("key", "x", *hashes("x")))
    firsts = plain.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.min_by("x", "key").alias("x"))
    firsts = stored(firsts.withColumn("id", F.monotonically_increasing_id()))
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"  # what holds the given components exactly
    members = stored(_packed(firsts.select("id", "x"), kind).join(firsts.select("id", "n"), "id"))
    groups = components(spanning_links(members.select("id", "v"), threshold, seed, window, miss, kind=kind))
    heads = groups.select(F.col("component").alias("node"), "component").distinct()
    groups = stored(groups.union(heads))
    grouped = members.join(groups, F.col("id") == F.col("node")).select("id", "n", "v", F.col("component").alias("group"))
    links = exact_links(stored(grouped), threshold, kind=kind)
    named = firsts.drop("x").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("least_"))
    found = named.drop("least").join(smallest, "component").join(links, "id", "left")
    found = found.select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), (F.coalesce("links", "n") - 1).alias("links_"), "least_")
    found = plain.select(F.col("key").alias("key_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_")).distinct().join(found, ["h1_", "h2_"])
    h1, h2 = hashes(doubles)
    same = (F.col(key).cast("long") == F.col("key_")) & (h1 == F.col("h1_")) & (h2 == F.col("h2_"))
    return (
        vectors.join(found, same, "left")
        .withColumn("n_links", F.coalesce("links_", F.lit(0)).cast("long"))
        .withColumn("component_id", F.coalesce("least_", F.col(key).cast("long")))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
        .drop("key_", "h1_", "h2_", "links_", "least_")
    )
