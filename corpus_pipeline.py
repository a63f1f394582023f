"""The corpus pipeline: five stages from documents to packed sequences, each by an operator of `facetrank.llm`.

All stages but the last return the columns of documents; each works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.llm import classifier, line_dedup, mixing, near_dup
from facetrank.llm.queries import packed, remainder, table
from facetrank.shared import write_once

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier rejects (a score below 0.5) go."""
    labels = table(spark, sf_dir, "labels").filter(remainder() != 1)
    model = classifier.fit(docs, labels)
    return classifier.scored(docs.select(*COLUMNS), model).filter("score >= 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks go from the later documents; documents of which no word is left go."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_dropped") > 0) & ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.filter(~emptied).withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id."""
    gone = near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(write_once(gone.distinct(), "near-duplicates"), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come at their target weights, in shuffled order; a document's copies are equal rows."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, align, hash and tokenize: SQL can't express them. Tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
