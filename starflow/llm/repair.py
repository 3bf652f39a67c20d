"""Repair of the turn structure of conversations at least cost, by a rank-convergence parallel Viterbi.

A conversation's rows are cut into chunks of at most ``CHUNK``, each a string of one symbol a row (role and fault).
The costs of repairing what follows a row, one for each of the four states of ``(s?(ua)+)?``, are found from the end
backwards, in all chunks at once: a chunk that isn't the last starts from a speculative cost vector. Fix-up passes then
rerun every chunk whose start vector differs from its successor's result by more than a constant, until none does; the
steps have min-plus rank one after a few rows almost always, so that one pass suffices. With the stitched costs the
edits are traced forwards, at each row the least letter that a cheapest repair can go on with; chunks speculate on the
state they are entered in, and those that are wrong are traced again.

Symbols, vectors and traces are a few bytes a row. Texts are shuffled once, by conversation and chunk, to meet the edits
in order. Conversations of at most ``CHUNK`` rows are one chunk and need no passes; only larger ones are ranked by a
range-partitioned sort. No task holds a conversation: it holds a chunk's symbols, and texts stream by. (The hash of a
whole conversation, which the registered query asks for, is sequential by nature: a larger conversation's segments
stream through one task.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starflow.llm.common import SPACE, split_join, stored
from starflow.operators import ranges

CHUNK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last is added to truncated rows that stay
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the last row's role
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a rerole or an insertion
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})  # and after a kept row, by its initial
FAR = 1 << 40
SEGMENT = 1 << 20  # bytes of repaired text that are handed on at once
LONG = (1 << 63) - 1

Vector = tuple[int, ...]


def _closed(costs: list[int]) -> list[int]:
    """Costs with insertions before what follows."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return costs


END: Vector = tuple(_closed([0, FAR, FAR, 0]))


def symbol(initial: str, fault: int) -> str:
    """One letter for a row: its role's class and its fault, 0 none, 1 truncated, 2 blank or duplicate."""
    return chr(65 + 3 * "sua".find(initial) + fault) if initial and initial in "sua" else chr(65 + 9 + fault)


@lru_cache(1 << 16)
def step(sym: str, after: Vector) -> tuple[Vector, int, tuple[tuple[str, int], ...]]:
    """Of a row before costs ``after``: the costs from each state less their least, that least, and for each state the
    least letter of a cheapest edit and the state after it. Vectors differ by constants, so few of them occur."""
    kind, fault = divmod(ord(sym) - 65, 3)
    extra = TRUNCATED if fault == 1 else 0
    edits: list[list[tuple[str, int, int]]] = []  # (letter, cost, state after) of each state
    for q in range(4):
        own = [("D", DELETE + after[q], q)]
        if fault < 2:
            if kind < 3 and "sua"[kind] in FOLLOWS[q]:
                to = FOLLOWS[q]["sua"[kind]]
                own.append(("K", KEEP + extra + after[to], to))
            own.append(("R", REROLE + extra + after[NEXT[q]], NEXT[q]))
        edits.append(own)
    costs = _closed([min(c for _, c, _ in own) for own in edits])
    choice = tuple(min((letter, to) for letter, c, to in [*own, ("I", INSERT + costs[NEXT[q]], NEXT[q])] if c == costs[q]) for q, own in enumerate(edits))
    least = min(costs)
    return tuple(c - least for c in costs), least, choice


def backward(symbols: str, after: Vector) -> Vector:
    """Costs before a chunk, less their least, given the costs after it."""
    for sym in reversed(symbols):
        after = step(sym, after)[0]
    return after


def trace(symbols: str, after: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """``(audit, cost, state)``: the least letters of a cheapest repair of a chunk that is entered in ``state``, with its
    insertions, their cost, and the state behind them."""
    plans = []
    for sym in reversed(symbols):
        after, _, choice = step(sym, after)
        plans.append(choice)
    audit, cost = [], 0
    for sym, choice in zip(symbols, reversed(plans)):
        letter = "I"
        while letter == "I":
            letter, state = choice[state]
            audit.append(letter)
            cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[letter]
            if letter in "KR" and (ord(sym) - 65) % 3 == 1:
                cost += TRUNCATED
    while last and state in (SYSTEM, USER):
        state, cost = NEXT[state], cost + INSERT
        audit.append("I")
    return "".join(audit), cost, state


def _named(rows: DataFrame) -> DataFrame:
    """``(c, turn, role, text)``: conversations by name, '' for null; roles and texts that are null are one space."""
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])


ORDER = ("rank", "turn", "role", "digest")  # of the rows of a chunk; ranks are null where one chunk is all


def _chunked(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of small conversations, chunk 0 each; those of large ones, ranked and cut into chunks; and the names of
    these, with their rows and chunks."""
    named = _named(rows)
    large = stored(named.groupBy("c").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > CHUNK).withColumn("n_chunks", F.ceil(F.col("n_rows") / CHUNK).cast("long")))
    marked = named.withColumn("digest", F.md5("text"))
    small = marked.join(large.select("c"), "c", "left_anti").select("*", F.lit(None).cast("long").alias("rank"), F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("n_chunks"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("spread")]  # equal rows share no range
    spread = marked.join(large, "c").withColumn("one", F.lit(1)).withColumn("spread", F.monotonically_increasing_id())
    placed = ranges.running(spread, ["c"], order, ["one"]).withColumn("rank", F.col("one_before"))
    big = placed.select("c", "turn", "role", "text", "digest", "rank", F.floor(F.col("rank") / CHUNK).cast("long").alias("chunk"), "n_chunks")
    return small, big, large


def _symbols(small: DataFrame, big: DataFrame, large: DataFrame) -> DataFrame:
    """``(c, chunk, n_chunks, symbols, blank, duplicate, truncated, illegal, first, last, gaps)``: a row a chunk."""
    bare = F.rtrim("text", F.lit(SPACE))
    light = lambda df: df.select(
        "c", "chunk", "n_chunks", "rank", "turn", "role", "digest", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut")
    )
    ranked = stored(light(big))
    firsts = stored(ranked.where("NOT blank").groupBy("c", "role", "digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")))
    whole = split_join(ranked.where("NOT blank"), firsts, ("c", "role", "digest"), large.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0])
    seen = whole.withColumn("seen", F.col("rank") > F.col("first")).drop("first").unionByName(ranked.where("blank").withColumn("seen", F.lit(False)))
    fields = (*ORDER, "initial", "blank", "cut", "seen")
    cells = light(small).withColumn("seen", F.lit(False)).unionByName(seen)
    grouped = cells.groupBy("c", "chunk", "n_chunks").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("r"))
    parts = grouped.select("c", "chunk", "n_chunks", *[F.col(f"r.{x}").alias(x) for x in ("turn", "role", "digest", "initial", "blank", "cut", "seen")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                met, text, counts, illegal, before = set(), [], [0, 0, 0], 0, None
                for role, digest, initial, blank, cut, seen in zip(row["role"], row["digest"], row["initial"], row["blank"], row["cut"], row["seen"]):
                    fault = 0 if blank else 1 if seen or (role, digest) in met else 2 if cut else 3
                    met.add((role, digest))
                    if fault < 3:
                        counts[fault] += 1
                    text.append(symbol(initial, (2, 2, 1, 0)[fault]))
                    illegal += before is not None and before + initial not in ("su", "ua", "au")
                    before = initial
                turns = {t for t in row["turn"] if t is not None}
                gaps = min(LONG, max(turns) - min(turns) + 1 - len(turns)) if turns else 0
                out.append({
                    "c": row["c"], "chunk": row["chunk"], "n_chunks": row["n_chunks"], "symbols": "".join(text), "blank": counts[0], "duplicate": counts[1], "truncated": counts[2],
                    "illegal": illegal, "first": row["initial"][0], "last": before, "gaps": gaps,
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    longs = ("chunk", "n_chunks", "blank", "duplicate", "truncated", "illegal", "gaps")
    names = ("c", "chunk", "n_chunks", "symbols", "blank", "duplicate", "truncated", "illegal", "first", "last", "gaps")
    schema = pa.schema([(n, pa.int64() if n in longs else pa.string()) for n in names])
    return parts.mapInArrow(run, ", ".join(f"{n} {'long' if n in longs else 'string'}" for n in names))


def _mapped(chunks: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of each row, a dict, by tasks."""
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([function(r) for r in batch.to_pylist()], schema=arrow)

    return chunks.mapInArrow(run, schema)


def stitched(chunks: DataFrame) -> tuple[DataFrame, int, int]:
    """``(c, chunk, symbols, n_chunks, after, state)`` of the chunks of large conversations, with the true costs after
    each and the true state before it; and the fix-up passes of costs and of states."""
    keep = ("c", "chunk", "n_chunks", "symbols")
    final = lambda r: r["chunk"] == r["n_chunks"] - 1

    def cost(r: dict) -> dict:
        after = tuple(r["after"])
        return {n: r[n] for n in keep} | {"after": list(after), "before": list(backward(r["symbols"], after))}

    def walk(r: dict) -> dict:
        return {n: r[n] for n in (*keep, "after", "state")} | {"left": trace(r["symbols"], tuple(r["after"]), r["state"], final(r))[2]}

    def passes(table: DataFrame, function, schema: str, given: str, found: str, way: int) -> tuple[DataFrame, int]:
        """``function`` of the chunks until what each was ``given`` is what its neighbour has ``found``."""
        held, n = stored(_mapped(table, function, schema)), 0
        while True:
            true = held.select("c", (F.col("chunk") + way).alias("chunk"), F.col(found).alias("true_"))
            met = held.join(true, ["c", "chunk"], "left")
            wrong = F.col("true_").isNotNull() & (F.col("true_") != F.col(given))
            if not met.where(wrong).limit(1).count():
                return held, n
            again = _mapped(met.where(wrong).withColumn(given, F.col("true_")).drop("true_", found), function, schema)
            held, n = stored(again.unionByName(met.where(~wrong).drop("true_"))), n + 1

    rows = "c string, chunk long, n_chunks long, symbols string, after array<long>"
    start = chunks.select(*keep).withColumn("after", F.array(*[F.lit(x).cast("long") for x in END]))  # true of the last chunk, a guess elsewhere
    costs, first = passes(start, cost, f"{rows}, before array<long>", "after", "before", -1)
    entered = costs.drop("before").withColumn("state", F.when(F.col("chunk") == 0, START).otherwise(ASSISTANT).cast("long"))
    walked, second = passes(entered, walk, f"{rows}, state long, left long", "state", "left", 1)
    return walked.drop("left"), first, second


class Repaired:
    """``rows``: the repaired conversations, see ``repair``; ``conversations``: what was found and done in each."""

    def __init__(self, rows: DataFrame, conversations: DataFrame):
        self.rows, self.conversations = rows, conversations


def repair(rows: DataFrame) -> Repaired:
    """Cheapest repairs of conversations ``(conv_id, turn, role, text)``, whose rows are taken by turn, nulls first.

    Rows of one turn go by role and by the MD5 of their text, which also tells texts apart. Roles and texts that are null
    count as one space. A row is blank without a character other than ASCII white space; else duplicate, if a row
    before has its role and text; else truncated, unless its last such character is one of ``.!?``. Edits cost: keep 0,
    change the role to user or assistant 1, delete 2 (blank and duplicate rows must be), insert an empty user or
    assistant row 5; truncated rows that stay add 5. What remains has role initials ``(s?(ua)+)?``. Of all cheapest
    repairs the one with the least audit in ASCII order is taken.

    ``rows``: ``(conv_id, chunk, place, edit, role, text)`` of the rows that remain, ``place`` rising in a chunk; rows of
    a chunk follow each other in order. ``conversations``: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit)``. Null ids are one conversation. Further columns are ignored; no rows give none.
    """
    small, big, large = _chunked(rows)
    chunks = stored(_symbols(small, big, large))
    alone = chunks.where("n_chunks = 1").withColumn("after", F.array(*[F.lit(x).cast("long") for x in END])).withColumn("state", F.lit(START).cast("long"))
    part = ("c", "chunk", "n_chunks", "symbols", "after", "state")
    several = chunks.where("n_chunks > 1")
    ready = alone.select(*part)
    if not several.isEmpty():
        ready = ready.unionByName(stitched(several)[0].select(*part))

    def edits(r: dict) -> dict:
        audit, cost, _ = trace(r["symbols"], tuple(r["after"]), r["state"], r["chunk"] == r["n_chunks"] - 1)
        return {"c": r["c"], "chunk": r["chunk"], "n_chunks": r["n_chunks"], "state": r["state"], "audit": audit, "cost": cost}

    traced = stored(_mapped(ready, edits, "c string, chunk long, n_chunks long, state long, audit string, cost long"))
    return Repaired(_applied(small.unionByName(big), traced), _reported(chunks, traced, big))


def _id(name: str = "c"):
    return F.nullif(F.col(name), F.lit("")).cast("long").alias("conv_id")


def _reported(chunks: DataFrame, traced: DataFrame, big: DataFrame) -> DataFrame:
    counts = ("blank", "duplicate", "truncated", "illegal")
    joined = chunks.join(traced.select("c", "chunk", "audit", "cost"), ["c", "chunk"])
    one = joined.where("n_chunks = 1").select("c", "gaps", *counts, "cost", "audit")
    follows = chunks.where("chunk > 0").select("c", (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("then_"))
    seam = F.when(F.col("then_").isNotNull() & ~F.concat("last", "then_").isin("su", "ua", "au"), 1).otherwise(0)
    pieces = joined.where("n_chunks > 1").join(follows, ["c", "chunk"], "left").withColumn("illegal", F.col("illegal") + seam)
    text = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"])
    sums = pieces.groupBy("c").agg(*[F.sum(x).alias(x) for x in (*counts, "cost")], F.array_join(text, "").alias("audit"))
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    turns = big.where("turn IS NOT NULL").select("c", "turn").distinct().groupBy("c").agg(F.least(F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count(F.lit(1)), F.lit(LONG)).cast("long").alias("gaps"))
    many = sums.join(turns, "c", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return one.unionByName(many.select(*one.columns)).select(_id(), *one.columns[1:])


def _applied(rows: DataFrame, traced: DataFrame) -> DataFrame:
    """The edits of each chunk on its rows: the chunk's audit comes first, its rows follow in order, and stream by."""
    nothing = lambda t: F.lit(None).cast(t)
    plans = traced.select("c", "chunk", "n_chunks", F.lit(0).alias("kind"), nothing("long").alias("rank"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("digest"), F.col("audit").alias("text"), "state")
    lines = rows.select("c", "chunk", "n_chunks", F.lit(1).alias("kind"), "rank", "turn", "role", "digest", "text", nothing("long").alias("state"))
    ordered = plans.unionByName(lines).repartition("c", "chunk").sortWithinPartitions("c", "chunk", "kind", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, waiting = "", 0, START, 0, []
        name, out, size = ("", 0, 1), [], 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, size
            out.append((*name, place, edit, role, text))
            place, size = place + 1, size + len(text)

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = NEXT[state], at + 1
                put("I", ROLES[state], "")

        for batch in batches:
            for c, chunk, n, kind, role, text, start in zip(*[batch.column(batch.schema.names.index(x)).to_pylist() for x in ("c", "chunk", "n_chunks", "kind", "role", "text", "state")]):
                if kind == 0:
                    inserted()
                    name, audit, at, state, place = (c, chunk, n), text, 0, start, 0
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = FOLLOWS[state][role[0]]
                    put("K", role, text)
                elif edit == "R":
                    state = NEXT[state]
                    put("R", ROLES[state], text)
                if size > SEGMENT:
                    yield _batch(out)
                    out, size = [], 0
        inserted()
        yield _batch(out)

    return ordered.mapInArrow(run, "c string, chunk long, n_chunks long, place long, edit string, role string, text string").select(_id(), "chunk", "n_chunks", "place", "edit", "role", "text")


ROLES = ("", "", "user", "assistant")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("c", pa.string()), *[(n, pa.int64()) for n in ("chunk", "n_chunks", "place")], *[(n, pa.string()) for n in ("edit", "role", "text")]])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, sha256)`` of ``role:text`` of all rows of each conversation that has rows left, joined by newlines.

    Where the rows of ``Repaired.rows`` are, conversations of one chunk are hashed, and the segments of others made, which
    then stream in order through a task each."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, body, part, out = None, bytearray(), 0, []

        def shut(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal body, part, hasher, out
            if now is not None:
                if now[2] == 1:
                    hasher.update(body)
                    if whole:
                        out.append((now[0], 0, 0, None, hasher.hexdigest()))
                elif body:
                    out.append((now[0], now[1], part, bytes(body), None))
                    part += 1
                body = bytearray()
            if len(out) >= 1024 or sum(len(x[3] or b"") for x in out[-8:]) > 4 * SEGMENT:
                yield packed(out)
                out = []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "chunk", "part", "body", "sha256"])

        hasher = hashlib.sha256()
        for batch in batches:
            for conv, chunk, n, role, text in zip(*[batch.column(batch.schema.names.index(x)).to_pylist() for x in ("conv_id", "chunk", "n_chunks", "role", "text")]):
                if now != (conv, chunk, n):
                    yield from shut(True)
                    now, part, hasher = (conv, chunk, n), 0, hashlib.sha256()
                    first = n == 1
                body += (b"" if first else b"\n") + f"{role}:{text}".encode()
                first = False
                if len(body) > SEGMENT:
                    yield from shut(False)
        yield from shut(True)
        yield packed(out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, begun, any_ = None, hashlib.sha256(), False, False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hasher.hexdigest()])], names=["conv_id", "sha256"])
        for batch in batches:
            for conv, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if any_ and conv != now:
                    yield done()
                if not any_ or conv != now:
                    now, hasher, any_, begun = conv, hashlib.sha256(), True, False
                hasher.update(body if begun else body[1:])  # without the first newline
                begun = True
        if any_:
            yield done()

    made = stored(repaired.mapInArrow(segments, "conv_id long, chunk long, part long, body binary, sha256 string"))
    parts = made.where("sha256 IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part").select("conv_id", "body")
    return made.where("sha256 IS NOT NULL").select("conv_id", "sha256").unionByName(parts.mapInArrow(joined, "conv_id long, sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    takes its ``.!?`` away, 3 repeats it, 4 makes its role user. Nulls are one space (turns stay null)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    marked = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20)).alias("m_"))
    text = F.when(F.col("m_") == 1, "").when(F.col("m_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("m_") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("m_") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.where("m_ <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("n_")).drop("n_")


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``Repaired.conversations`` with ``repaired_sha256``, for all of ``ids(conv_id)``: zeros, an empty audit and the hash
    of nothing for those without rows."""
    done = repair(rows)
    found = done.conversations.withColumnRenamed("conv_id", "id_")
    hashed = digests(done.rows).select(F.col("conv_id").alias("hash_id_"), "sha256")
    joined = ids.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id_")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("hash_id_")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
