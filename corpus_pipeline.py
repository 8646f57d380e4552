"""From raw documents to packed sequences: language, repeated lines, near duplicates, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm import decontamination, language, linededup, neardup, packing
from gramlake.llm.common import cut, cuts_within, read, remove

#: Least share of a document's letters that its language has.
LANGUAGE_SHARE = 0.5
#: Least percentage of the union of two documents' word shingles that both have, if they are near duplicates.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with one language of at least LANGUAGE_SHARE; those without a letter or a main language go."""
    model = language.train(docs)
    found = language.identify(docs, model, carry=tuple(docs.columns))
    if not model.languages:
        return docs
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated chunks and passages of lines; n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = linededup.dedup_lines(docs, carry=others, passages=True).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one of the least id (null ids last, then by place).

    Rows are told apart by their place, not by their id: repeated rows and rows without an id are documents of their own.
    Rows without a word link with nothing and stay. ``docs`` must come from files or a checkpoint, so that places hold.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    found = neardup.near_duplicates(rows, key="_row", percent=NEAR_PERCENT)
    ids = rows.select("_row", "doc_id")
    least = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m"))
    return rows.join(least.select(F.col("m._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontamination.find_contamination(docs, read(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where("n_hit = 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Trained, sketched and tokenized stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written once in the shared checkpoint folder for the next.

    Whatever a stage wrote on its way, and what it read, is removed when its result is written; the last result's input stays.
    """
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with cuts_within(spark) as made:
            docs = cut(stage(spark, docs, sf_dir))
            kept = [made.pop()]
        remove(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
