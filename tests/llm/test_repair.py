"""Repair of conversations against a search over all edits, from beginning to end, without chunks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from starflow.llm import repair

EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if m == 0:
            continue
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(conv, turn, "user" if m == 4 else role, text)] * (2 if m == 3 else 1)
    return out


def cheapest(rows, faults):
    """``(cost, audit, lines)`` by Dijkstra's search on (cost, audit)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        new, name = ("a", "assistant") if state == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 5, audit + "I", i, new, (*lines, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if faults[i] in ("", "truncated"):
                extra = 5 if faults[i] else 0
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[state][role[:1]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, new, (*lines, f"{name}:{text}")))
    raise AssertionError


def slow(rows, ids):
    out = {}
    for conv in ids:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest([(r, x) for _, r, x in own], faults)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, ids=None):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    named = spark.createDataFrame([(i,) for i in ({r[0] for r in rows} if ids is None else ids)], "conv_id long")
    return {r[0]: tuple(r[1:]) for r in repair.repair_report(table, named).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def invented(seed, sizes):
    draw, rows = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for i in range(n):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.4 else ("user", "assistant")[i % 2]
            role = draw.choice(["system", "tool", "", None, "u2"]) if draw.random() < 0.1 else role
            text = draw.choice([None, "", " \n\t", "no end", "no end  \n", "same.", "é!"]) if draw.random() < 0.25 else f"text {draw.random()}."
            rows.append((conv, None if draw.random() < 0.05 else i + (3 if draw.random() < 0.1 else 0), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_search_of_all_edits(spark, seed, monkeypatch):
    """Chunks of seven rows: many conversations are stitched."""
    monkeypatch.setattr(repair, "CHUNK", 7)
    rows = invented(seed, [0, 1, 2, 3, 5, 7, 8, 14, 15, 40, 100, 6, 6, 4])
    assert found(spark, rows) == slow(rows, {r[0] for r in rows})


def test_small_conversations(spark):
    rows = invented(9, [random.Random(4).randint(1, 9) for _ in range(150)])
    assert found(spark, rows) == slow(rows, {r[0] for r in rows})


def test_registered_query(spark):
    from starflow.llm import queries

    folder = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_conversation_repair(spark, folder)
    want = slow(damage(given), {r[0] for r in given})
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out.collect()} == want
    assert {c: t for c, t in out.dtypes if t != "bigint"} == {"audit": "string", "repaired_sha256": "string"}


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, None, None), (2, 5, "user", "x" * 300_000 + "."), (2, 6, "assistant", "b?\n"),
        (3, 1, "user", "q."), (3, 1, "user", "q."), (3, 1, "user", "q."), (3, 1, "assistant", "q."), (4, -5, "assistant", "lone."), (4, None, "system", "first."),
        (5, 1, "system", "only."), (6, 1, "user", "no end"), (6, 2, "assistant", "end!"),
    ]
    got = found(spark, rows, [None, 1, 2, 3, 4, 5, 6, 77])
    assert got.pop(77) == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert got == slow(rows, [None, 1, 2, 3, 4, 5, 6])
    assert got[None][5:7] == (0, "KK") and got[3][5:7] == (6, "RRDD")


def test_empty_and_wide_tables(spark):
    assert found(spark, [], [3]) == {3: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    wide = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, 'a.' AS text, 9 AS chunk, 8 AS c, 7 AS rank, 6 AS digest")
    assert [r.cost for r in repair.repair(wide).conversations.collect()] == [2]


def test_damage(spark):
    rows = [(c, t, r, "One. Two! Three?") for c in range(20) for t, r in [(None, "user"), (0, "user"), (1, None), (2, "assistant")]] + [(None, 1, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, repair.damaged(table).collect()))) == sorted(map(str, damage(rows)))


def test_chunks_converge_after_one_pass(spark, monkeypatch):
    """Speculation is wrong in most chunks, one pass mends it; a run in which no row decides takes more."""
    monkeypatch.setattr(repair, "CHUNK", 50)
    rows = invented(5, [2000])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small, big, large = repair._chunked(table)
    done, costs, states = repair.stitched(repair._symbols(small, big, large))
    assert done.count() == 40 and costs <= 2 and states <= 3
    steps = [(r.symbols, tuple(r.after), r.state) for r in done.orderBy("chunk").collect()]
    after = repair.END
    for symbols, held, _ in reversed(steps):
        assert held == after  # what a pass over the whole conversation has there
        after = repair.backward(symbols, after)
    state = repair.START
    for k, (symbols, held, entered) in enumerate(steps):
        assert entered == state
        state = repair.trace(symbols, held, state, k == len(steps) - 1)[2]


def test_repaired_rows(spark):
    rows = [(1, 1, "user", "a."), (1, 2, "tool", "b."), (1, 3, "user", ""), (1, 4, "user", "c.")]
    out = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).rows
    assert [(r.edit, r.role, r.text) for r in out.orderBy("chunk", "place").collect()] == [("K", "user", "a."), ("R", "assistant", "c.")]  # KDDR comes before KRDD
