"""Mixture-controlled packing of documents into fixed-length token sequences.

Tokens of each source form a queue. Windows are filled by deficit round-robin: in each window every source that still
has tokens earns ``window * weight / (sum of the weights of such sources)`` tokens, gives the whole tokens of what it
has earned so far, and carries the fraction on as its deficit. When a source runs dry, a new phase starts in the next
window, with the shares of those that are left. The filled windows follow each other without gaps and are cut into
sequences of ``length`` tokens, so that only the very last sequence can be short.

What a source has given after ``w`` windows of a phase is ``start + w * num // den``, a closed form in integers: the
deficit at any window, and so at any partition's first token, is known without running the windows before it. Every
partition therefore packs its own documents on its own and the result is the one of a single round-robin over all
windows. It needs only the number of tokens of each source in the partitions before it, a table of partitions x
sources.

Texts are encoded once, into a table of token ids; the second pass reads that table, adds the queue positions, and
cuts the ids. No ids are shuffled.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm.common import ASCII_LOWER, grown, stored, without

WORDS_KEPT = 300_000  # words whose ids a worker keeps before it starts anew
PLAIN = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([,.]?)")  # composed letters with one lower case, and a stop of its own
MARK = "\x7f"
END = MARK.encode()
TEXTS_AT_ONCE = 256
WEIGHTS = 1 << 16  # resolution of the sources' shares


class WordTokenizer:
    """Ids of whole texts by a public tokenizer that drops white space and joins nothing across it.

    Such a tokenizer gives a text the ids of its space-separated words one after the other, and a word in lower case
    those of the word, so that each distinct word is encoded once. Words of plain Latin letters, with a comma or full
    stop after them (a token of its own), are encoded together by the tokenizer's own merges, with a byte that no such
    word holds as the mark of a word's end; all others go through the tokenizer itself.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self._merges(path)

    def _merges(self, path: str) -> None:
        """The tokenizer's merges over plain bytes; a word's last byte joins the mark of its end first of all."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(letters)]
        spelled = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(others)}  # how such files write bytes
        plain = lambda t: bytes(map(spelled.__getitem__, t.removesuffix(suffix))) + END * t.endswith(suffix)
        ranks = {bytes([b]): b for b in range(256)}
        ids = [-1] * 256
        for t in [spell + suffix for spell in spelled] + [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]:
            if plain(t) not in ranks:
                ranks[plain(t)] = len(ids)
                ids.append(model["vocab"][t])
        for spell, b in spelled.items():
            ids[b] = model["vocab"].get(spell, -1)
        self.ids = np.array(ids, np.int64)
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for t, r in ranks.items() if t.endswith(END)]] = True
        self.stops = {x: np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ("", ",", ".")}
        self.letters = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[bytes]) -> None:
        fast, cores, stops, slow, texts = [], [], [], [], []
        for word, text in zip(words, b"\n".join(words).decode("utf-8", "surrogatepass").split("\n"), strict=True):
            if match := PLAIN.fullmatch(text):
                fast.append(word)
                cores.append(match[1])
                stops.append(match[2])
            else:
                slow.append(word)
                texts.append(text)
        if fast:
            ranks = self.letters.encode_to_numpy((MARK + " ").join(cores).lower() + MARK)
            ids, ends = self.ids[ranks].astype("<u4").tobytes(), ((np.flatnonzero(self.ends[ranks]) + 1) * 4).tolist()
            found = [ids[lo:hi] + self.stops[stop] for lo, hi, stop in zip([0, *ends], ends, stops, strict=False)]
            self.known.update(zip(fast, found, strict=True))
        if slow:
            for word, e in zip(slow, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.known[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; none for null."""
        out = []
        for lo in range(0, len(texts), TEXTS_AT_ONCE):
            split = [(t or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() for t in texts[lo : lo + TEXTS_AT_ONCE]]
            used = set().union(*split)
            if len(self.known) > WORDS_KEPT:
                self.known = {}
            if new := list(used.difference(self.known)):
                self._learn(new)
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
        return out


_workers: dict[str | None, WordTokenizer] = {}


def worker_tokenizer(path: str | None) -> WordTokenizer:
    """One tokenizer a worker process and path."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def encode(docs: DataFrame, text: str, source: str, path: str | None, end: int | None) -> DataFrame:
    """``docs`` without the text, with ``ids_`` (binary), ``n_`` and the row's place in its partition's queue of its
    source: ``part_``, ``source_`` and ``from_`` (tokens of that queue before it). Stored, as the second pass needs the
    partitions to stay as they are."""
    at, src = docs.columns.index(text), docs.columns.index(source)
    kept = [i for i, c in enumerate(docs.columns) if i != at]
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = worker_tokenizer(path), TaskContext.get().partitionId()
        before: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                rows = batch.slice(lo, TEXTS_AT_ONCE)
                ids = [x + tail for x in tokenizer.encode(rows.column(at).to_pylist())]
                names = [s or "" for s in rows.column(src).to_pylist()]
                starts = []
                for name, x in zip(names, ids, strict=True):
                    starts.append(before.get(name, 0))
                    before[name] = starts[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(i) for i in kept], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([part] * len(ids), pa.int64()), pa.array(names, pa.string()), pa.array(starts, pa.int64())],
                    names=[*[rows.schema.names[i] for i in kept], "ids_", "n_", "part_", "source_", "from_"],
                )

    base = docs.drop(text)
    more = (("ids_", T.BinaryType()), ("n_", T.LongType()), ("part_", T.LongType()), ("source_", T.StringType()), ("from_", T.LongType()))
    return stored(docs.mapInArrow(run, grown(base, *more)))


@dataclass
class Phase:
    """Windows from ``window`` on, to the next phase: source i has given ``given[i]`` tokens before them and earns
    ``num[i] / den`` of them in each."""

    window: int
    given: list[int]
    num: list[int]
    den: int


class Schedule:
    """The round-robin over ``totals`` tokens of each source with integer ``weights``."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.phases = totals, []
        at, given = 0, [0] * len(totals)
        while live := [i for i, n in enumerate(totals) if n > given[i]]:
            den = sum(weights[i] for i in live)
            num = [window * weights[i] if i in set(live) else 0 for i in range(len(totals))]
            self.phases.append(Phase(at, given, num, den))
            lasts = min(-(-(totals[i] - given[i]) * den // num[i]) for i in live)  # until the first runs dry
            at += lasts
            given = [self.given(i, at) for i in range(len(totals))]
        self.phases.append(Phase(at, given, [0] * len(totals), 1))
        self.starts = [p.window for p in self.phases]
        self.dry = [[p.given[i] for p in self.phases] for i in range(len(totals))]

    def given(self, i: int, w: int) -> int:
        """Tokens that source i has given before window w."""
        p = self.phases[bisect_right([q.window for q in self.phases], w) - 1] if len(self.phases) > 1 else self.phases[0]
        return min(self.totals[i], p.given[i] + (w - p.window) * p.num[i] // p.den)

    def window_of(self, i: int, token: int) -> int:
        """The window that takes the token at this place of source i's queue."""
        p = self.phases[bisect_right(self.dry[i], token) - 1]
        return p.window + ((token - p.given[i] + 1) * p.den - 1) // p.num[i]

    def place(self, i: int, w: int) -> int:
        """The place, among all packed tokens, of source i's first token in window w."""
        return sum(self.given(k, w + (k < i)) for k in range(len(self.totals)))


def weights_of(totals: dict[str, int], targets: dict[str, float] | None) -> dict[str, int]:
    """Integer weights of the sources with tokens; a source without a target gets its share of the tokens."""
    whole = sum(totals.values()) or 1
    wanted = {s: (targets or {}).get(s, n / whole) for s, n in totals.items()}
    scale = WEIGHTS / (sum(wanted.values()) or 1)
    return {s: max(1, round(v * scale)) for s, v in wanted.items()}


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    targets: dict[str, float] | None = None,
    length: int = 2048,
    window: int = 16 * 2048,
    end: int | None = 1,
    tokenizer: str | None = None,
) -> DataFrame:
    """The pieces of all documents: the rows' other columns with ``start``, ``length``, ``ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``.

    Each id, the ``end`` id of each document included, lies in exactly one piece; offsets in a sequence have no gaps,
    and all sequences but the last are full. ``targets`` are the wanted token shares of the sources (default: their
    shares of the corpus). Sources are grouped on the driver by name: their number is taken to be small.

    Null and empty texts hold the end id alone; null sources share the queue of the empty name; rows that repeat a key
    are packed apart, each with its own ``start`` from 0; columns that bear the names of the results are replaced. An
    empty table gives no pieces.
    """
    made = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    base = without(docs, {c for c in made if c not in (key, text, source)} | {"ids_", "n_", "part_", "source_", "from_", "base_"})
    coded = encode(base, text, source, tokenizer, end)
    queues = coded.groupBy("part_", "source_").agg(F.sum("n_").alias("queue_"))
    order = Window.partitionBy("source_").orderBy("part_")  # a row a partition and source
    queues = queues.select("part_", "source_", "queue_", (F.sum("queue_").over(order) - F.col("queue_")).alias("base_"))
    queues = stored(queues)
    totals = {r["source_"]: r["n"] for r in queues.groupBy("source_").agg(F.sum("queue_").alias("n")).collect()}
    names = sorted(s for s, n in totals.items() if n)
    weights = weights_of({s: totals[s] for s in names}, targets)
    plan = docs.sparkSession.sparkContext.broadcast((names, [totals[s] for s in names], [weights[s] for s in names]))
    placed = coded.join(queues.select("part_", "source_", "base_"), ["part_", "source_"])
    carried = [c for c in base.columns if c != text]
    placed = placed.select(*carried, "ids_", "n_", "source_", (F.col("base_") + F.col("from_")).alias("from_"))
    width = len(carried)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, totals, weights = plan.value
        number = {s: i for i, s in enumerate(names)}
        schedule = Schedule(totals, weights, window)
        spots: dict[tuple[int, int], int] = {}
        for batch in (b.slice(lo, TEXTS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, TEXTS_AT_ONCE)):
            rows, pieces = [], []
            columns = [batch.column(width + k).to_pylist() for k in range(4)]
            for r, (ids, n, name, first) in enumerate(zip(*columns, strict=True)):
                i, at = number.get(name, 0), first
                while at < first + n:
                    w = schedule.window_of(i, at)
                    if (i, w) not in spots:
                        spots = spots if len(spots) < 100_000 else {}
                        spots[i, w] = schedule.place(i, w) - schedule.given(i, w)
                    stop = min(first + n, schedule.given(i, w + 1))
                    while at < stop:
                        sequence, offset = divmod(spots[i, w] + at, length)
                        size = min(stop - at, length - offset)
                        rows.append(r)
                        lo = at - first
                        pieces.append((lo, size, ids[4 * lo : 4 * (lo + size)], n, sequence, offset))
                        at += size
            if pieces:
                taken = batch.take(pa.array(rows))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[taken.column(k) for k in range(width)], *[pa.array(x, t) for x, t in zip(zip(*pieces, strict=True), kinds, strict=True)]],
                    names=[*carried, *made],
                )

    long = T.LongType()
    fields = (("start", long), ("length", long), ("ids", T.BinaryType()), ("doc_tokens", long), ("sequence_id", long), ("offset", long))
    return placed.mapInArrow(cut, grown(placed.select(*carried), *fields))
