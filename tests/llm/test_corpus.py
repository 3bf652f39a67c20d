"""Language identification, line dedup, mixing and the pipeline."""

import math
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starflow.llm import common, langid, linededup, mixing, packing, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def all_cuts(run):
    """All ways to cut a run, one list of parts after the other."""
    if not run:
        yield []
    for n in range(1, len(run) + 1):
        for rest in all_cuts(run[n:]):
            yield [run[:n], *rest]


def slow_log_probability(word, model, k):
    """The sum over all segmentations of each run, written out; a character outside the pieces is a part of its own."""
    total = 0.0
    for run in re.findall(r"[^\W\d_]+", word):
        ways = 0.0
        for cut in all_cuts(langid.START + run):
            p = 1.0
            for part in cut:
                own = model.probs[model.pieces.index(part), k] if part in model.pieces else 0.0
                p *= own + (model.unknown if len(part) == 1 else 0.0)
            ways += p
        total += np.log(ways)
    return total


def toy_model():
    pieces = ["a", "ab", "b", "ba", "aba", langid.START + "a", langid.START, "é", "éa", "abababababab"]
    return langid.LanguageModel(pieces, ["x", "y"], np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T)


def test_forward_sums_all_segmentations():
    model = toy_model()
    words = ["abab", "a", "éab", "b-a", "q", "abababababab", "aqbabababa", "12", "ba."]
    got = model.scorer().words(words)
    assert np.allclose(got, [[slow_log_probability(w, model, k) for k in (0, 1)] for w in words], rtol=1e-12)


@pytest.mark.parametrize("cells", [langid.CELLS, 64])
def test_forward_over_very_long_runs(cells, monkeypatch):
    """One pass over a run of any length, against exact fractions."""
    monkeypatch.setattr(langid, "CELLS", cells)
    model = toy_model()
    run = langid.START + "abaqé" * 60 + "ab" * 700
    for k in (0, 1):
        alpha = [Fraction(1)]
        probs = {p: Fraction(float(model.probs[i, k])) for i, p in enumerate(model.pieces)}
        for end in range(1, 401):
            ways = alpha[end - 1] * Fraction(model.unknown)
            alpha.append(ways + sum(alpha[end - n] * probs.get(run[end - n : end], 0) for n in range(1, min(end, 12) + 1)))
        exact = math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)
        assert model.scorer().words([run[1:400]])[0, k] == pytest.approx(exact, rel=1e-12)
    assert np.isfinite(model.scorer().words([run[1:], "ab" * 50_000])).all()


def test_fit_counts_all_pieces(spark, monkeypatch):
    pieces = sorted({"a", "ab", "b", "aba", langid.START, langid.START + "a", "é"})
    monkeypatch.setattr(langid, "vocabulary", lambda path=None: pieces)
    rows = [(1, "abab, a-ba Éa aba", "x"), (2, "bb ab", "y"), (3, "aba " * 50, "y"), (4, None, "x"), (5, "abc", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), smoothing=0.5)
    assert model.languages == ["x", "y"]
    for k, lang in enumerate("xy"):
        runs = [langid.START + run for _, t, other in rows if t and other == lang for run in re.findall(r"[^\W\d_]+", t.lower())]
        times = np.array([sum(run[i:].startswith(p) for run in runs for i in range(len(run))) + 0.5 for p in pieces])
        assert np.allclose(model.probs[:, k], times / times.sum())


def test_vocabulary_is_whole():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {p for i in range(model.get_piece_size()) if langid.LETTERS.fullmatch((p := model.id_to_piece(i).lower()).removeprefix(langid.START))}
    assert letters <= set(langid.vocabulary()) and max(map(len, letters)) > 8


def test_language_of_held_out_documents(spark, docs):
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs.select("doc_id", "text", "lang"), model).where(langid.held_out()).collect()
    judged = [r for r in out if r.lang_pred != "und"]
    assert np.mean([r.lang_pred == r.lang for r in judged]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_rows(spark):
    rows = [(1, "the and of thing", "en", "x"), (2, "les des une que", "fr", "x"), (3, None, "en", None), (4, "12 !? 3", None, "x"), (5, "", "fr", "x"), (1, "the and of thing", "en", "x"), (None, "thing " * 3000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")
    out = langid.predict(df, langid.fit(df)).collect()
    assert [(r.doc_id, r.lang_pred) for r in out] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (1, "en"), (None, "en")]
    assert out[0].score > 0.5 and out[2].score == 0
    none = langid.predict(df, langid.fit(df.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert langid.predict(df.limit(0), langid.fit(df)).count() == 0
    assert langid.sample(df.where("lang IS NOT NULL"), "lang", "text", 1).count() <= 5


def slow_lines(rows, shortest=20, copies=3):
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = {}
    for n, (d, t, *_) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if d is not None and len(k) >= shortest:
                holders.setdefault(k, []).append(d)
    last = {k: max(v) for k, v in holders.items() if len(v) >= copies}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or last.get(key(x), d) <= d]
        out.append((d if d is not None else -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_line_dedup(spark, batches, fanout):
    long = "A line that is long enough"
    rows = [(i, f"own line number {i} of this text\n  {long.upper() if i % 2 else long}\t\nshort\n", "x") for i in range(9)]
    rows += [(20, None, "x"), (21, "", "x"), (22, long + "\n" + long, None), (22, long, "x"), (None, long, "x"), (23, "É" * 20, "x"), (24, "É" * 20 + "\r", "x"), (25, "é" * 20, "x"), (26, "É" * 19, "x"), (27, "É" * 20 + "\n" + long * 500, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Lines string")
    got = linededup.dedup_lines(df, batches=batches, fanout=fanout).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept_text) for r in got) == slow_lines(rows)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_a_large_text_and_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_HOT", 10**9)
    many = "\n".join(f"this is the common line number {k % 3000}" for k in range(6000))
    rows = [(i, many + f"\nand the own last line of {i}") for i in range(4)] + [(i, "one line that all of these hold") for i in range(10, 40)]
    rows += [(10, "one line that all of these hold\nanother text of the same key"), (50, many[:-1])]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == slow_lines(rows)


def test_runs_are_merge_anti_joined_and_compacted(spark):
    index = linededup.LineIndex(spark, fanout=2)
    row = lambda i, *lines: (i, "\n".join(x * 20 for x in lines))
    for batch in ([row(1, "a", "b"), row(2, "a")], [row(3, "b", "c")], [row(4, "b", "d"), row(5, "c")]):
        index.add(index.keys(spark.createDataFrame(batch, "doc_id long, text string")))
    assert sorted(map(len, index.levels.names.values())) == [1, 1]  # two runs of level 0 have become one of level 1
    key = {spark.sql(f"SELECT xxhash64(1, repeat('{c}', 20)) AS h").first().h: c for c in "abcd"}
    top, low = ({key[r.h1]: (r.n_docs, r.max_doc) for r in index.new(index.levels.read(index.levels.names[level][0])).collect()} for level in (1, 0))
    assert top == {"a": (2, 2), "b": (1, 1), "c": (1, 3)} and low == {"d": (1, 4)}  # each line in one run, as first met
    seen = sorted((key[r.h1], r.first.n_docs, r.again.n_docs) for s in index.sightings for r in s.collect())
    assert seen == [("b", 1, 1), ("b", 1, 1), ("c", 1, 1)]
    assert {key[r.h1]: (r.n_docs, r.max_doc) for r in index.repeated().collect()} == {"b": (3, 4)}
    batch = index.keys(spark.createDataFrame([row(9, "a")], "doc_id long, text string")).groupBy("h1", "h2").count()
    plan = batch.join(index.levels.read(index.levels.names[1][0]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # of the batch alone
    index.levels.remove()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_lines_repeat_by_the_join_with_the_runs_alone(spark, monkeypatch):
    """A line of one document a batch is found by the merge-anti-join; without it every sighting would be a new line."""
    batches = [[(b, "this line is in one text of each batch")] for b in range(4)]

    def found():
        index = linededup.LineIndex(spark)
        for rows in batches:
            index.add(index.keys(spark.createDataFrame(rows, "doc_id long, text string")))
        held = sum(index.new(index.levels.read(n)).count() for level in index.levels.names.values() for n in level)
        out = [(r.n_docs, r.max_doc) for r in index.repeated().collect()]
        index.levels.remove()
        return out, held

    assert found() == ([(4, 3)], 1)
    monkeypatch.setattr(linededup.Levels, "runs", lambda self: [])
    assert found() == ([], 4)


def test_mixing_moves_no_text(spark, docs):
    """The executed plan joins documents with the cells without an exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mix(docs, {"source": 0.5}, 0.5)
        assert mixed.count() == docs.count()
        plan = mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_mixing_meets_margins(spark, docs):
    mixed = mixing.mix(docs, {"source": 0.5, "lang": {"en": 0.4, "fr": 0.3}, "topic": 1.0}, 0.3).cache()
    total, kept = mixed.agg(F.sum("n_tokens"), F.sum(F.col("probability") * F.col("n_tokens"))).first()
    assert kept == pytest.approx(0.3 * total, rel=1e-6) and mixed.count() == docs.count()
    cells = mixed.groupBy("source", "lang", "mix_topic").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0").withColumnRenamed("mix_topic", "topic")
    raked = mixing.rake(cells, {"source": 0.5, "lang": {"en": 0.4, "fr": 0.3}, "topic": 1.0})
    share = {r.lang: r.s for r in raked.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("factor") / total).alias("s")).collect()}
    plain = {r.lang: r.s / total for r in raked.groupBy("lang").agg(F.sum("tokens").alias("s")).collect()}
    norm = 0.7 + plain["de"] + plain["es"]
    assert share["en"] == pytest.approx(0.4 / norm, rel=1e-3) and share["de"] == pytest.approx(plain["de"] / norm, rel=1e-3)
    u = [r.u for r in docs.select(mixing.uniform(F.col("doc_id")).alias("u")).collect()]
    assert abs(np.mean(u) - 0.5) < 0.03 and 0 <= min(u) and max(u) < 1


def test_mixing_rounds_end_when_margins_hold(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{a}", b, c, int(rng.integers(1, 10**6))) for a in range(6) for b in "xy" for c in ("t", "u", "v") if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"s0": 0.6, "s1": 0.1}, "lang": {"x": 0.9, "y": 0.1}, "topic": 0.2}
    out = mixing.rake(cells, targets).toPandas()
    out["raked"] = out["tokens"] * out["factor"]
    shares = out.groupby("lang")["raked"].sum() / out["raked"].sum()
    assert shares["x"] == pytest.approx(0.9, rel=1e-11)
    with pytest.warns(UserWarning, match="margins are off"):
        mixing.rake(cells, targets, rounds=1)


def test_topics_and_token_estimates(spark, docs):
    rows = [("x = {a: 1}; import os",), ("Copyright by all, under this License, without Warranty",), ("a | b | c",), ("mail me@x.org",), ("see https://x.org or www.y.org",), ("plain words here",), (None,), ("word " * 3000 + "= {}",), (" ",)]
    df = spark.createDataFrame(rows, "text string").select(mixing.topic_of().alias("t"), mixing.token_count().alias("n"))
    assert [r.t for r in df.collect()] == ["code", "law", "table", "contact", "web", "prose", "prose", "prose", "prose"]
    assert [r.n for r in df.collect()][5:7] == [3, 0]
    own = spark.createDataFrame([("the cat",), ("a dog",)], "text string").select(mixing.topic_of(topics={"cats": ["cat", "kitten"], "dogs": ["dog"]}).alias("t"))
    assert [r.t for r in own.collect()] == ["cats", "dogs"]
    given = docs.select("text", mixing.token_count().alias("n")).limit(200).collect()
    real = [len(x) // 4 for x in packing.WordTokenizer().encode([r.text for r in given])]
    assert np.corrcoef(np.log1p(real), np.log1p([r.n for r in given]))[0, 1] > 0.98
    known = mixing.mix(docs.select("*", F.lit(7).alias("own")), tokens=F.col("own"), topic=F.col("source"))
    assert known.agg(F.sum("n_tokens")).first()[0] == 7 * docs.count()


def test_mixing_edge_rows(spark):
    rows = [(1, "a b", None, None, "x"), (1, "a b", None, None, "x"), (2, None, "s", "en", "x"), (3, "", "s", "en", None), (None, "c " * 5000, "s", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, KEPT string")
    out = mixing.mix(df, keep=1.0).collect()
    assert len(out) == 5 and all(r.probability == 1 and r.kept for r in out) and sorted(r.n_tokens for r in out) == [0, 0, 2, 2, 5000]
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.probability for r in mixing.mix(df, keep=0.5).collect() if r.n_tokens} == {0.5}


def test_pipeline_stages_against_slow_versions(spark, docs, tmp_path):
    columns = list(corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]

    def step(name, df):
        out = stages[name](spark, df, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    extra = spark.createDataFrame([(10_001, "12 34", "en", "src1", 5), (10_002, None, "en", "src1", 0)], docs.select(*columns).schema)
    first = step("language_id", docs.select(*columns).union(extra))
    model = langid.fit(docs.where(~langid.held_out()))
    texts, judged = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}, {}
    words = sorted(set().union(*texts.values()))
    logs = dict(zip(words, model.scorer().words(words)))
    for r in docs.collect():
        total = sum(logs[w] for w in texts[r.doc_id]) if langid.LETTERS.search(r.text or "") else None
        if total is not None and 1 / np.exp(total - total.max()).sum() >= 0.5:
            judged[r.doc_id] = model.languages[int(total.argmax())]
    assert first.columns == columns and {r.doc_id: r.lang for r in first.collect()} == judged

    second = step("line_dedup", first)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    want = {d: t for d, _, gone, t in slow_lines(rows) if not gone or t.split()}
    assert {r.doc_id: r.text for r in second.collect()} == want and all(r.n_chars == len(r.text) for r in second.collect())

    third = step("simhash_dedup", second)
    fps = {d: simhash.fingerprint(t) for d, t in want.items()}
    ids, values = np.array(list(fps)), np.array(list(fps.values()), np.uint64)
    label = ids.copy()
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 2) for v in values]
    for _ in range(50):
        label = np.array([label[n].min() for n in near])
    assert {r.doc_id for r in third.collect()} == {int(i) for i, g in zip(ids, label) if i == g}

    fourth = step("mixing", third)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/simhash_dedup/*.parquet'")
    kept = con.execute(mixing.mix_sql(corpus_pipeline.MIX, corpus_pipeline.MIX_KEEP)).fetchall()
    assert {r.doc_id for r in fourth.collect()} == {r[0] for r in kept if r[6]}

    last = step("packing", fourth)
    ids = packing.WordTokenizer()
    texts = {r.doc_id: r.text for r in fourth.collect()}
    pieces = {}
    for r in last.orderBy("doc_id", "start").collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + bytes(r.ids)
    assert pieces == {d: ids.encode([t])[0] + (1).to_bytes(4, "little") for d, t in texts.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == set(texts)
