"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The probability of a run of letters is
the sum, over all ways to cut it into pieces, of the product of the piece probabilities; a forward pass computes it:
``alpha[i] = sum over pieces ending at i of alpha[i - len] * p(piece)``. A text scores the sum of the logarithms over
its runs, and the posterior under equal priors is its score. Runs of any length are summed in one pass: the alphas are
divided by the last of them as often as the longest piece is long, and the logarithms of the divisors are added.

Texts are never shuffled: training sends sums by (language, piece) only, and the model (pieces x languages, bounded by
the vocabulary) goes to the tasks once. The forward pass runs over whole arrays of distinct words; a worker keeps the
scores of the words it has met, up to a bound in words.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starflow.llm.common import grown, without

LETTERS = regex.compile(r"\p{L}+")
START = "▁"  # how the vocabulary marks the start of a word
WORDS_KEPT = 300_000  # words whose scores a worker keeps
TEXTS_AT_ONCE = 512
CELLS = 1 << 18  # characters that are looked up at once
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def vocabulary(path: str | None = None) -> list[str]:
    """All pieces of letters of a public sentencepiece model, lower-cased, and the first letter of each."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    pieces = {p for p in pieces if LETTERS.fullmatch(p.removeprefix(START))}
    return sorted(pieces | {p.removeprefix(START)[:1] for p in pieces})


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of a number, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """Finds every vocabulary piece inside arrays of runs, by a polynomial hash of each stretch of characters."""

    def __init__(self, pieces: list[str]):
        keys = np.zeros(len(pieces), np.uint64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        for n, ids in by_length.items():
            codes = np.array([[*map(ord, pieces[i])] for i in ids], np.uint64)
            keys[ids] = (codes * _powers(BASE, n)).sum(1, dtype=np.uint64)
        self.index, self.lengths = pd.Index(keys), sorted(by_length)
        self.longest = max(by_length, default=1)

    def find(self, codes: np.ndarray) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
        """``(first end, found)`` by chunks of columns, ``found[n][row, k]`` the number of the piece of n characters that
        ends at ``first end + k``, -1 where there is none. ``codes``: rows of one width."""
        rows, width = codes.shape
        sums = np.zeros((rows, width + 1), np.uint64)
        np.cumsum(codes * _powers(BASE, width), 1, out=sums[:, 1:])
        back = _powers(INVERSE, width + 1)
        step = max(self.longest, CELLS // max(rows, 1))
        for first in range(1, width + 1, step):
            last, found = min(width, first + step - 1), {}
            for n in self.lengths:
                lo = max(first, n)
                if lo <= last:
                    keys = (sums[:, lo : last + 1] - sums[:, lo - n : last + 1 - n]) * back[lo - n : last + 1 - n]
                    found[n] = np.full((rows, last + 1 - first), -1, np.int64)
                    found[n][:, lo - first :] = self.index.get_indexer(keys.ravel()).reshape(keys.shape)
            yield first, found


def _runs(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owners, code points) by width: every run of letters of each word, its start marked, so many at once."""
    by_width: dict[int, tuple[list[int], list[str]]] = {}
    for owner, word in enumerate(words):
        for run in LETTERS.findall(word):
            owners, parts = by_width.setdefault(len(run) + 1, ([], []))
            owners.append(owner)
            parts.append(START + run)
    for width, (owners, parts) in by_width.items():
        size = max(1, CELLS // width)
        for lo in range(0, len(parts), size):
            joined = "".join(parts[lo : lo + size]).encode("utf-32-le", "surrogatepass")
            yield np.array(owners[lo : lo + size]), np.frombuffer(joined, np.uint32).reshape(-1, width)


@dataclass
class LanguageModel:
    """Log-free piece probabilities, ``probs[piece, language]``; ``unknown`` is that of a character outside the pieces."""

    pieces: list[str]
    languages: list[str]
    probs: np.ndarray
    unknown: float = 1e-7

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; holds the words it has scored before."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, Pieces(model.pieces)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, summed over all segmentations."""
        k, longest = len(self.model.languages), self.pieces.longest
        out = np.zeros((len(words), k))
        for owners, codes in _runs(words):
            past = deque([np.ones((len(owners), k))], longest)  # of the last positions, the nearest first
            logs = np.zeros((len(owners), k))
            for first, found in self.pieces.find(codes):
                some = {n: (ids >= 0).any(0).tolist() for n, ids in found.items()}
                for at in range(len(next(iter(some.values())))):
                    total = past[0] * self.model.unknown
                    for n, ids in found.items():
                        if some[n][at]:
                            hit = ids[:, at] >= 0
                            total[hit] += past[n - 1][hit] * self.model.probs[ids[hit, at]]
                    past.appendleft(total)
                    if (first + at) % longest == 0:  # alphas stay near 1, whatever the length of a run
                        logs += np.log(total)
                        past = deque([a / total for a in past], longest)
            np.add.at(out, owners, logs + np.log(past[0]))
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, posteriors and whether a text has letters."""
        k = len(self.model.languages)
        total, lettered = np.zeros((len(texts), k)), np.zeros(len(texts), bool)
        for lo in range(0, len(texts) if k else 0, TEXTS_AT_ONCE):
            split = [t.lower().split() if t and LETTERS.search(t) else None for t in texts[lo : lo + TEXTS_AT_ONCE]]
            new = list({w for words in split if words for w in words if w not in self.rows})
            if len(self.rows) + len(new) > WORDS_KEPT:
                self._clear()
                new = list({w for words in split if words for w in words})
            if new:
                at = len(self.rows)
                if at + len(new) > len(self.scores):
                    room = np.zeros((max(2 * len(self.scores), at + len(new), 4096), k))
                    room[: len(self.scores)] = self.scores
                    self.scores = room
                self.scores[at : at + len(new)] = self.words(new)
                self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            for i, words in enumerate(split, lo):
                if words:
                    lettered[i] = True
                    rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
                    total[i] = self.scores[rows].sum(0)
        if not k:
            return ["und"] * len(texts), np.zeros(len(texts)), lettered
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        names = [self.model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, share, 0.0), lettered


def sample(labelled: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each label at most, by a hash of ``key``: a label with more rows keeps that share of them."""
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n_"))
    shares = {r[0]: min(1.0, most / r["n_"]) for r in sizes.collect()}  # one row a language
    if not shares:
        return labelled.limit(0)
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 32)) / float(1 << 32)
    limit = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    return labelled.where(unit < F.element_at(limit, F.col(label)))


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    vocabulary_path: str | None = None,
    sample_per_language: int = 4000,
    smoothing: float = 0.5,
) -> LanguageModel:
    """Learn the piece probabilities of each language from labelled texts.

    At most about ``sample_per_language`` texts of each language are read (a documented bound; they are chosen by a
    hash of ``key``). A piece's probability is its smoothed share of all occurrences of pieces in the language's words.
    Rows without text or label are left out; no rows give a model without languages, which calls every text ``und``.
    """
    pieces = vocabulary(vocabulary_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, sums, waiting = Pieces(pieces), {}, {}

        def add(language: str, words: Counter) -> None:
            seen, times = sums.setdefault(language, np.zeros(len(pieces))), np.fromiter(words.values(), np.int64)
            for owners, codes in _runs(list(words)):
                for _, found in finder.find(codes):
                    for ids in found.values():
                        rows, ends = np.nonzero(ids >= 0)
                        seen += np.bincount(ids[rows, ends], times[owners[rows]], len(pieces))
            words.clear()

        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = waiting.setdefault(language, Counter())
                words.update(body.lower().split())
                if len(words) > WORDS_KEPT // 4:
                    add(language, words)
        for language, words in waiting.items():
            add(language, words)
        for language, seen in sums.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[at], pa.float64())],
                names=["language", "piece", "times"],
            )

    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(key).alias("key_"), F.col(label).cast("string").alias("label_"), F.col(text).alias("text_"))
    chosen = sample(rows, "label_", "key_", sample_per_language).select("label_", "text_")
    counted = chosen.mapInArrow(count, "language string, piece int, times double").groupBy("language", "piece").agg(F.sum("times").alias("times")).toPandas()
    languages = sorted(counted["language"].unique())
    probs = np.full((len(pieces), len(languages)), smoothing)
    for k, language in enumerate(languages):
        own = counted[counted["language"] == language]
        probs[own["piece"].to_numpy(), k] += own["times"].to_numpy()
    return LanguageModel(pieces, languages, probs / np.maximum(probs.sum(0), 1), 1e-7)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of ``docs`` with its predicted language and the posterior of it, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0; equal scores go to the language first in order.
    Columns that already bear the two names are replaced; repeated rows stay, an empty table stays empty.
    """
    body = f"{text}_in_" if text.lower() in (language.lower(), score.lower()) else text
    source = docs if body == text else docs.withColumnRenamed(text, body)
    source = without(source, (language, score))
    at = source.columns.index(body)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            names, scores, _ = scorer.texts(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, language, score],
            )

    return source.mapInArrow(score_batches, grown(source, (language, T.StringType()), (score, T.DoubleType())))


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row belongs to the fold that is never learnt from; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
