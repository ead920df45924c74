"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import language_id, near_dedup, packing, quality, suffix_dedup
from siftwork.llm.common import held_out, stored, table
from siftwork.llm.queries import WORD_BPE

#: A language is accepted from this posterior on.
LEAST_CERTAIN = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language of at least LEAST_CERTAIN go."""
    model = language_id.fit(docs.where(~held_out()))
    scored = language_id.identify(docs, model)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAIN)).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur more than once are cut out; documents of which nothing is left go."""
    cut = suffix_dedup.without_repeats(docs)
    left = cut.where(F.coalesce(F.length("text"), F.lit(0)) > 0)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document, with its token ids."""
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_windows),
]

#: SQL expresses none of the stages; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. The last one's rows come back; those before are in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
