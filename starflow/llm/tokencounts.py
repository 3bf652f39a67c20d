"""Token counts of fields or sections of documents, from one encoding of the whole document.

A document is encoded once, as a whole; the bytes of its tokens, laid end to end, give each token's span of characters.
The spans are interval-joined with the spans of the document's sections: both are sorted, so two binary searches find
the sections a token touches. A token that lies in one section counts there; one that crosses a border goes by the
rule:

``largest``  to the section with which it shares most characters, the earlier of equals (the default);
``start``    to the section that holds its first character;
``split``    to all of them, in proportion to the characters shared.

A token that splits a character counts that character as its own. Tokens that touch no section are counted under the
section number -1. Documents are never shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm.common import without

TEXTS_AT_ONCE = 512


class SpanTokenizer:
    """Whole-text ids with the character span of each token, by a public byte-level tokenizer."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the last-but-one-past character of each token."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        stops = np.cumsum(self.sizes[ids])
        starts = stops - self.sizes[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) != len(text):
            char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
            starts, stops = char[starts], char[stops - 1] + 1
        return ids, starts, stops


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, each with the line feed that ends it."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return np.concatenate([[0], ends]), np.concatenate([ends, [len(text)]])


def attribute(starts: np.ndarray, stops: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section ``[first, last)``, these being sorted and apart, and of none."""
    totals, outside = np.zeros(len(first)), 0.0
    lo = np.searchsorted(last, starts, "right")  # the first section that ends after the token starts
    hi = np.searchsorted(first, stops, "left")  # the first section that begins where the token has ended
    inside = hi - lo
    outside += float((inside <= 0).sum())
    whole = inside == 1
    if rule == "split":
        whole &= (starts >= first[np.minimum(lo, len(first) - 1)]) & (stops <= last[np.minimum(lo, len(first) - 1)]) if len(first) else whole
    totals += np.bincount(lo[whole], minlength=len(first))[: len(first)]
    for t in np.flatnonzero((inside >= 1) & ~whole):
        at = np.arange(lo[t], hi[t])
        shared = np.minimum(stops[t], last[at]) - np.maximum(starts[t], first[at])
        if rule == "split":
            size = max(1, stops[t] - starts[t])
            totals[at] += shared / size
            outside += 1 - shared.sum() / size
        elif rule == "start":
            totals[at[0]] += 1
        else:
            totals[at[shared.argmax()]] += 1
    return totals, outside


def section_tokens(
    docs: DataFrame, text: str = "text", key: str = "doc_id", sections: str | None = None, rule: str = "largest", tokenizer: str | None = None
) -> DataFrame:
    """``(doc_id, section, start, stop, n_tokens, doc_tokens)``: one row per section of each row of ``docs``.

    ``sections`` names a column ``array<struct<start int, stop int>>`` of character spans; without it, sections are the
    lines, each with its line feed. Spans are numbered from 0 in their order by start; they must not overlap, null or
    empty ones count nothing. A row with tokens outside all sections gets a section -1 with null bounds. Null texts are
    empty: one line without tokens. Repeated rows stay repeated; an empty table gives no rows.
    """
    if rule not in ("largest", "start", "split"):
        raise ValueError(f"no such rule: {rule}")
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(sections).alias("sections")] if sections else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpanTokenizer(tokenizer)
        for batch in (b.slice(lo, TEXTS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, TEXTS_AT_ONCE)):
            at, numbers, lows, highs, counts, sums = [], [], [], [], [], []
            given = batch.column(2).to_pylist() if sections else [None] * batch.num_rows
            for row, (body, spans) in enumerate(zip(batch.column(1).to_pylist(), given, strict=True)):
                body = body or ""
                ids, starts, stops = encoder.spans(body)
                if sections:
                    pairs = sorted((s["start"], s["stop"]) for s in spans or [] if s and None not in s.values() and s["start"] < s["stop"])
                    first, last = np.array(pairs, np.int64).reshape(-1, 2).T
                else:
                    first, last = line_spans(body)
                totals, outside = attribute(starts, stops, first, last, rule)
                n = len(first) + (outside > 0)
                at.append(np.full(n, row))
                numbers.append(np.r_[np.arange(len(first)), [-1] * (outside > 0)])
                lows.append(np.r_[first, [-1] * (outside > 0)])
                highs.append(np.r_[last, [-1] * (outside > 0)])
                counts.append(np.r_[totals, [outside] * (outside > 0)])
                sums.append(np.full(n, len(ids)))
            number = np.concatenate(numbers).astype(np.int64)
            bound = lambda x: pa.array(np.concatenate(x).astype(np.int64), mask=number < 0)  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.concatenate(at))), pa.array(number), bound(lows), bound(highs),
                 pa.array(np.concatenate(counts).astype(np.float64)), pa.array(np.concatenate(sums).astype(np.int64))],
                names=["doc_id", "section", "start", "stop", "n_tokens", "doc_tokens"],
            )

    fields = [T.StructField(n, T.DoubleType() if n == "n_tokens" else T.LongType()) for n in ("section", "start", "stop", "n_tokens", "doc_tokens")]
    return without(chosen, ()).mapInArrow(run, T.StructType([T.StructField("doc_id", chosen.schema["doc_id"].dataType), *fields]))
