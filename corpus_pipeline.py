"""A corpus pipeline: each stage calls one operator and works on all that the stage before it kept.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the shared folder and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import language_id, line_dedup, mixing, near_dedup, packing
from tallywright.llm.common import shared_folder, table, written


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose text has no language."""
    return language_id.known_language(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every line from all but the first document that holds it; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs)
    out = out.filter((F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    kept = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return out.select(*[kept[n].alias(n) if n in kept else F.col("row")[n].alias(n) for n in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.one_of_each(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does."""
    return mixing.mixed_documents(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mix_sources", to_target_weights),
    ("pack_sequences", into_sequences),
]

#: Language profiles and byte-pair ids can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
