import zlib
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starflow.llm import packing


@pytest.mark.parametrize("totals,weights,window", [([500, 90, 3000], [5, 1, 2], 64), ([1], [1], 7), ([10, 0, 10], [1, 3, 65000], 33), ([5, 5], [1, 65535], 16)])
def test_schedule_is_a_partition_of_all_tokens(totals, weights, window):
    s = packing.Schedule(totals, weights, window)
    places = []
    for i, n in enumerate(totals):
        for t in range(n):
            w = s.window_of(i, t)
            assert s.given(i, w) <= t < s.given(i, w + 1)
            places.append(s.place(i, w) + t - s.given(i, w))
    assert sorted(places) == list(range(sum(totals)))


@pytest.mark.parametrize("totals,weights,window", [([500, 90, 3000], [5, 1, 2], 64), ([40, 41, 42, 7], [1, 1, 1, 9], 30), ([100, 3], [1, 65535], 50)])
def test_schedule_is_a_round_robin_window_by_window(totals, weights, window):
    """Run the rounds one after another with exact deficits."""
    s = packing.Schedule(totals, weights, window)
    given, deficit, w = [0] * len(totals), [Fraction(0)] * len(totals), 0
    live = [i for i, n in enumerate(totals) if n]
    while live:
        assert [s.given(i, w) for i in range(len(totals))] == given
        share = sum(weights[i] for i in live)
        for i in live:
            deficit[i] += Fraction(window * weights[i], share)
            gives = min(int(deficit[i]), totals[i] - given[i])
            deficit[i] -= gives
            given[i] += gives
        w += 1
        left = [i for i in live if given[i] < totals[i]]
        if left != live:  # a source ran dry: the others begin anew with their new shares
            live, deficit = left, [Fraction(0)] * len(totals)
    assert [s.given(i, w) for i in range(len(totals))] == totals


def test_word_by_word_ids_are_the_whole_texts(spark):
    texts = [None, "", "Don't STOP, it's 12.5%... ÉÀ Σς İ x y é a .b, c.,d <|endoftext|>z<|startoftext|> I'LL 你好,世界", "'s, t's. a'. ,a.", "x" * 5000, "A, b. " * 4000]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.WordTokenizer().encode(texts)] == want


def check(rows, texts, length):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = t.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        pieces.sort(key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids, "<u4").tobytes()
        at = 0
        for p in pieces:
            assert p.start == at and p.doc_tokens == len(ids) and p.length * 4 == len(p.ids)
            at += p.length
    for k, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == length or k == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_pack_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").repartition(5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = packing.pack(docs, window=4096)
    rows = out.collect()
    check(rows, texts, 2048)
    crc = {(r.doc_id, r.start): r.c for r in out.select("doc_id", "start", F.crc32("ids").alias("c")).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(bytes(r.ids)) for r in rows)


def test_targets_and_edge_rows(spark):
    rows = [(i, f"word{i} " * (50 + i % 7), "a" if i % 3 else "b", "x") for i in range(300)] + [(900, None, "a", "x"), (901, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Length string").repartition(3)
    out = packing.pack(docs, targets={"a": 0.5, "b": 0.5}, length=256, window=512)
    got = out.collect()
    check(got, {r[0]: r[1] for r in rows}, 256)
    share = defaultdict(lambda: defaultdict(int))
    for r in got:
        share[r.sequence_id // 2][r.source] += r.length
    assert all(abs(share[w]["a"] - share[w]["b"]) <= 8 for w in range(10))
    assert packing.pack(docs.limit(0)).count() == 0
    assert Path(packing.__file__).exists()
