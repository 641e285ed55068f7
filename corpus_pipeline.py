"""From raw documents to a training mix: language ID, line dedup, near-dedup, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import column_or_null, materialize
from pagewright.llm.decontam import decontaminate
from pagewright.llm.langid import UNKNOWN, fit, identify
from pagewright.llm.line_dedup import dedup_lines
from pagewright.llm.mixing import mix
from pagewright.llm.neardup import one_of_each


def as_documents(df: DataFrame) -> DataFrame:
    """doc_id, text and the struct carried as the columns of documents; n_chars follows the text."""
    return df.select("doc_id", "text", "carried.lang", "carried.source", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; one that is missing is null, others are left out."""
    return docs.select(*[column_or_null(docs, name, kind).alias(name) for name, kind in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))])


CARRY = ("lang", "source")

#: A document is rejected whose words are less familiar, in proportion to unseen training texts. On held-out documents the least is 0.95 of
#: what is usual, and random letters reach 0.77 at most.
MIN_FAMILIAR = 0.85


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those in no learned language, as their words' n-grams tell; lang is left as it came."""
    docs = columns(docs)
    model = fit(docs)
    out = identify(docs, model, carry=CARRY)
    return as_documents(out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("familiar") >= MIN_FAMILIAR * (model.usual if model else 0.0))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold, but in one of them. A document that loses all its lines goes."""
    out = dedup_lines(columns(docs), carry=CARRY).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return as_documents(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, with the least doc_id of the class; documents of different texts that share
    doc_id, or have none, are different documents."""
    out = one_of_each(columns(docs))
    return as_documents(out.select("doc_id", "text", F.struct(*CARRY).alias("carried")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    out = decontaminate(columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=CARRY)
    return as_documents(out.filter("n_hit = 0"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters the mix; documents that it takes no time stay with reps 0."""
    return mix(columns(docs)).drop("carried")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: SQL can't express language ID, near-dedup and the seeded choice of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
