"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling. DataFrame functions only.

Token counts are summed into cells (source x language x topic), a table bounded by the number of categories. Raking
multiplies the cells, one margin after another, by wanted over present tokens of the margin, until all margins hold.
All documents of a cell have the same factor, so raking cells is raking documents. The factors become sampling
probabilities ``min(1, c * factor)``, with ``c`` such that the expected tokens are the wanted share of all tokens; a
document stays if a uniform number made from its key lies below its probability.

Texts are read once, and documents aren't shuffled: they are written with their tokens and topic, summed (before the
shuffle) from these columns, and joined with the cells, which are broadcast after a look at their number.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starflow.llm.common import cut, stored, without

DIMENSIONS = ("source", "lang", "topic")
TOLERANCE = 1e-12  # relative, of every margin
ROUNDS = 200  # at most; margins that contradict each other never hold
A_JOB = 4  # rounds between two looks at the margins
MOST_CELLS = 200_000  # that are broadcast, of some 100 bytes each

#: Pieces that subword tokenizers tend to make: up to six letters, up to three digits, one of any other character.
PIECE = r"\p{L}{1,6}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{N}]"
#: Marks of a topic; the topic with most marks a token has the text, if it has one in ``SPARSE`` tokens at least.
TOPICS = {
    "code": ("{", "}", "import "),
    "contact": ("@", "Mr. ", "Mrs. "),
    "law": ("opyright", "icense", "arrant"),
    "table": (" | ", "\t"),
    "web": ("http", "www."),
}
OTHER, SPARSE = "prose", 200


def marks_of(marks: Sequence[str], text: str = "text") -> Column:
    """How often any of these strings stands in a text, each counted apart: by how much it shrinks without them."""
    body = F.coalesce(F.col(text), F.lit(""))
    lost = [(F.octet_length(body) - F.octet_length(F.replace(body, F.lit(m), F.lit("")))) / len(m.encode()) for m in marks]
    return F.round(sum(lost[1:], lost[0])).cast("long")


def topic_of(text: str = "text", topics: Mapping[str, Sequence[str]] | None = None, tokens: Column | None = None) -> Column:
    """The topic whose marks, strings by name, are most frequent in a text; of equals the first by name; ``OTHER`` where
    all are rare."""
    tokens = token_count(text) if tokens is None else tokens
    counts = [F.struct(marks_of(marks, text).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, marks) in enumerate(sorted((topics or TOPICS).items()))]
    best = F.array_max(F.array(*counts))
    return F.when((best["n"] > 0) & (best["n"] * SPARSE >= tokens), best["name"]).otherwise(OTHER)


def token_count(text: str = "text") -> Column:
    """An estimate of a text's tokens without a tokenizer: the number of its pieces; 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE)).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) made from the key's digest: the first 13 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``factor``: by how much each cell's tokens are to be weighted.

    ``targets`` gives for each dimension either the wanted share of each value (values it doesn't name keep the
    share they have; shares are normed) or a number t: shares in proportion to the present share to the power t.
    Rounds end when each margin is right to ``tolerance``, or after ``rounds`` with a warning.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in DIMENSIONS:
        share, target = F.sum("tokens") / F.lit(total or 1.0), targets.get(d, 1.0)
        if isinstance(target, Mapping):
            named = F.create_map(*[F.lit(x) for pair in target.items() for x in pair]) if target else None
            share = F.coalesce(F.element_at(named, F.col(d)), share) if named is not None else share
        else:
            share = F.pow(share, F.lit(float(target)))
        margin = cut(cells.groupBy(d).agg(share.cast("double").alias("share")))
        norm = float(margin.agg(F.sum("share")).first()[0] or 1)
        cells = cells.join(margin.select(d, (F.col("share") / norm * total).alias(f"wanted_{d}")), d)
    present = lambda d: F.sum("raked").over(Window.partitionBy(d))
    cells, error = cut(cells.withColumn("raked", F.col("tokens").cast("double"))), 0.0
    for done in range(0, rounds, A_JOB):
        for d in DIMENSIONS * A_JOB:
            cells = cells.withColumn("raked", F.col("raked") * (F.col(f"wanted_{d}") / present(d)))
        cells = cut(cells)
        off = [F.max(f"off_{d}") for d in DIMENSIONS]
        error = cells.select(*[F.abs(present(d) / F.col(f"wanted_{d}") - 1).alias(f"off_{d}") for d in DIMENSIONS]).agg(F.greatest(*off)).first()[0] or 0.0
        if error <= tolerance:
            break
    else:
        warnings.warn(f"margins are off by up to {error:.1e} after {rounds} rounds", stacklevel=2)
    return cells.select(*DIMENSIONS, "tokens", (F.col("raked") / F.col("tokens")).alias("factor"))


def calibrate(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with ``probability = min(1, c * factor)`` such that ``keep`` of all tokens are expected to stay.

    c is the wanted tokens, less those of the cells that stay whole, over the weighted tokens of the others; each look
    at c can only add cells that stay whole, and ends when none is added.
    """
    cells, c, whole = cut(cells), 0.0, -1
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    while True:
        full = F.lit(c) * F.col("factor") >= 1
        sums = cells.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("tokens") * F.col("factor")))).first()
        if sums[0] == whole:
            break
        whole = sums[0]
        c = (keep * total - (sums[1] or 0)) / sums[2] if sums[2] else float("inf")
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(c) * F.col("factor")))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | float] | None = None,
    keep: float = 0.5,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
    topic: Column | None = None,
    tokens: Column | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Every row of ``docs`` with ``mix_topic``, ``n_tokens``, ``probability`` and ``kept``.

    ``tokens`` and ``topic`` are columns of ``docs`` where these are known (such as the counts of a tokenizer's pass);
    otherwise tokens are estimated and topics found from the text.
    Null sources and languages are categories of their own, named ''. Texts without tokens (null, empty, blank) change
    no margin; they get their cell's probability, or 1 where the cell has no tokens. A null key counts as ''. Rows that
    repeat a key are kept or dropped together. Columns that bear the names of the results are replaced. An empty table
    stays empty.
    """
    docs = without(docs, ("mix_topic", "n_tokens", "probability", "kept"))
    docs = docs.withColumn("n_tokens", (token_count(text) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long"))
    docs = docs.withColumn("mix_topic", F.coalesce(topic, F.lit("")) if topic is not None else topic_of(text, tokens=F.col("n_tokens")))
    docs = stored(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_topic", "n_tokens")], "mix_topic", "n_tokens"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = (
        docs.groupBy(blank(source).alias("source"), blank(lang).alias("lang"), F.col("mix_topic").alias("topic"))
        .agg(F.sum("n_tokens").alias("tokens"))
        .where("tokens > 0")
    )
    cells = cut(calibrate(rake(cut(cells), targets or {}, rounds), keep))
    cells = cells.select(*[F.col(d).alias(f"cell_{d}_") for d in DIMENSIONS], "probability")
    if cells.count() <= MOST_CELLS:  # else the texts move, to the cells that hold them
        cells = F.broadcast(cells)
    same = (blank(source) == F.col("cell_source_")) & (blank(lang) == F.col("cell_lang_")) & (F.col("mix_topic") == F.col("cell_topic_"))
    return (
        docs.join(cells, same, "left")
        .drop(*[f"cell_{d}_" for d in DIMENSIONS])
        .withColumn("probability", F.coalesce("probability", F.lit(1.0)))
        .withColumn("kept", uniform(F.coalesce(F.col(key).cast("string"), F.lit(""))) < F.col("probability"))
    )


def mix_sql(powers: Mapping[str, float], keep: float, rounds: int = 40) -> str:
    """DuckDB SQL for ``mix`` over ``documents`` with target powers: so many rounds unrolled, enough for the margins to
    hold; more of them change nothing."""
    shares = ", ".join(
        f"pow(sum(tokens) OVER (PARTITION BY {d}) / sum(tokens) OVER (), {float(powers.get(d, 1.0))}) AS p_{d}, "
        f"row_number() OVER (PARTITION BY {d} ORDER BY source, lang, topic) = 1 AS f_{d}"
        for d in DIMENSIONS
    )
    wanted = ", ".join(f"p_{d} / sum(p_{d}) FILTER (WHERE f_{d}) OVER () AS wanted_{d}" for d in DIMENSIONS)
    steps, last = [], "r0"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"r{k}_{d}"
            steps.append(
                f"{name} AS (SELECT * EXCLUDE raked, raked * (wanted_{d} * total / sum(raked) OVER (PARTITION BY {d})) AS raked FROM {last})"
            )
            last = name
    lost = lambda m: f"(strlen(body) - strlen(replace(body, '{m}', ''))) / {len(m.encode())}"
    marks = ", ".join(f"round({' + '.join(map(lost, own))})::BIGINT AS n_{name}" for name, own in sorted(TOPICS.items()))
    most = f"greatest({', '.join(f'n_{name}' for name in sorted(TOPICS))})"
    cases = " ".join(f"WHEN n_{name} = {most} THEN '{name}'" for name in sorted(TOPICS))
    return rf"""
WITH bodies AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS body FROM documents),
marked AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(body, '{PIECE}')) AS n_tokens, {marks} FROM bodies),
docs AS (
  SELECT doc_id, source, lang, CASE WHEN {most} = 0 OR {most} * {SPARSE} < n_tokens THEN '{OTHER}' {cases} END AS topic, n_tokens FROM marked),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
shares AS (SELECT source, lang, topic, tokens, {shares} FROM cells),
r0 AS (SELECT source, lang, topic, tokens, {wanted}, sum(tokens) OVER () AS total, tokens AS raked FROM shares),
{", ".join(f"{chr(10)}{s}" for s in steps)},
factors AS (SELECT source, lang, topic, tokens, raked / tokens AS factor FROM {last}),
scaled AS (
  SELECT *, ({keep} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY factor DESC, source, lang, topic
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(tokens * factor) OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM factors),
settled AS (
  SELECT *, least(1.0, coalesce(max(c) FILTER (WHERE c * factor <= 1) OVER (), 'infinity'::DOUBLE) * factor) AS p FROM scaled)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 1.0), 6) AS probability,
       ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 < coalesce(p, 1.0) AS kept
FROM docs LEFT JOIN settled USING (source, lang, topic)"""
