import numpy as np
import pytest

from starflow.llm import tokencounts as tc

TEXT = "Été à\n\nla plage…\nof the  end 你好\n\n\n x"


def slow(tok, text, spans, rule):
    """Character by character."""
    out, outside = [0.0] * len(spans), 0.0
    ids = tok.encoding.encode_ordinary(text)
    byte_char = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for t in ids:
        n = len(tok.encoding.decode_single_token_bytes(t))
        chars = sorted(set(byte_char[at : at + n]))
        at += n
        share = [sum(lo <= c < hi for c in chars) for lo, hi in spans]
        if not any(share):
            outside += 1
        elif rule == "split":
            out = [o + s / len(chars) for o, s in zip(out, share)]
            outside += 1 - sum(share) / len(chars)
        elif rule == "start":
            out[next(i for i, s in enumerate(share) if s)] += 1
        else:
            out[share.index(max(share))] += 1
    return out, outside


@pytest.mark.parametrize("rule", ["largest", "start", "split"])
@pytest.mark.parametrize("spans", [None, [(0, 3), (3, 4), (8, 20)], [], [(0, 100)]])
def test_matches_slow_attribution(rule, spans):
    tok = tc.SpanTokenizer()
    first, last = tc.line_spans(TEXT) if spans is None else np.array(spans, np.int64).reshape(-1, 2).T
    _, starts, stops = tok.spans(TEXT)
    got, outside = tc.attribute(starts, stops, first, last, rule)
    want, want_outside = slow(tok, TEXT, list(zip(first.tolist(), last.tolist())), rule)
    assert np.allclose(got, want) and np.isclose(outside, want_outside)


def test_rows(spark):
    rows = [(1, TEXT, [(3, 8), None, (0, 3)]), (1, TEXT, [(3, 8), None, (0, 3)]), (2, None, None), (3, "", []), (4, "one two " * 4000, [(5, 9)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start int, stop int>>")
    out = tc.section_tokens(df).collect()
    tok = tc.SpanTokenizer()
    assert sum(r.n_tokens for r in out) == sum(len(tok.encoding.encode_ordinary(t or "")) for _, t, _ in rows)
    assert [(r.section, r.start, r.stop, r.n_tokens, r.doc_tokens) for r in out if r.doc_id == 2] == [(0, 0, 0, 0.0, 0)]
    given = tc.section_tokens(df, sections="spans").collect()
    assert sum(r.n_tokens for r in given) == sum(r.n_tokens for r in out)
    assert {r.section for r in given if r.doc_id == 4} == {0, -1} and [r.start for r in given if r.doc_id == 4 and r.section < 0] == [None]
    assert tc.section_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tc.section_tokens(df, rule="other")
