"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) over all that the stage before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starflow.llm import langid, linededup, mixing, packing, simhash
from starflow.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Target shares of the mix: the present shares of sources and topics to these powers; languages keep their shares.
MIX, MIX_KEEP = {"source": 0.9, "topic": 1.0, "lang": 1.0}, 0.9


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learnt, labelled with it; those without a letter or a clear language go."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return _documents(found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).withColumn("lang", F.col("lang_pred")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in a larger one too, among three at least; those left without a word go."""
    out = linededup.dedup_lines(docs)
    left = out.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return _documents(left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates by SimHash."""
    return _documents(simhash.near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens follow the target shares of sources, languages and topics."""
    return _documents(mixing.mix(docs, MIX, MIX_KEEP).where("kept"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, every window in the sources' proportions; a row a piece, with its token ids."""
    return packing.pack(docs.select("doc_id", "text", "source"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification, the SimHash of whole texts and byte-pair encoding have no SQL form; the pipeline is tested
#: against a brute-force version of each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder, where they stay until the
    application ends, and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
