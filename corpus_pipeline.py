"""Corpus preparation: stages applied one after another, each written and read again.

Every stage but the last returns the columns of `documents`; each works on all that the one before
kept.  A lost executor costs the tasks it ran: what a stage needs of earlier ones is on disk.

Defined results of all stages: null and empty texts fail the quality rules, so later stages see none from
here, and by themselves keep them (no evidence, no near copy, no leak) or encode them as no pieces; texts
of any length are taken whole; rows that repeat stay or go together; rows with a null doc_id are judged
by their text and are nobody's near copy; empty tables give empty tables; other columns stay, whatever
their names, but for the last stage, which returns doc_id, lang, source and the encoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm import chosen_path, fertility, latent, pieces, toxicity
from wordtide.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return fertility.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the model learns from the labels of documents that are left."""
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return chosen_path.keep_first(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent.keep_unleaked(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the piece ids of the text."""
    return docs.select("doc_id", "lang", "source", pieces.encoded(F.col("text")).alias("e")).select("doc_id", "lang", "source", "e.*")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]
#: SQL cannot express these stages (sub-word vocabularies, trained models): tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage wrote goes once the next one has been written."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
