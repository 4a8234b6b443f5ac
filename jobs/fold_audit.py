"""Batch job: folds for cross-validation over texts that leak nothing between training and evaluation.

Documents of one group (an author, here the source) share a fold; groups are dealt round-robin in an order of hashes.
Copies of a text may still stand in several groups, so the job also states, for every document, the folds whose model may
be trained on it: all but its own and those that hold a copy of its text. Texts are copies if they are equal after runs of
white space become one space and A-Z are lower-cased. A document without a group is grouped with its copies.

Written to target/folds, partitioned by fold: doc_id, grp, lang, text_key (null for texts without a word), copies, leaks
(the other folds with a copy), train_for (folds), and the labels (the largest of a document's labels; null if none).

Texts are hashed where they are read; no text is shuffled. Copies are counted before they meet, so that a text that a third of
all documents share is one row of the counts, and only texts in two folds or more are joined to the documents again.

    python -m jobs.fold_audit --documents <path> --labels <path> --target <folder>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, write_parts
from tallywright.functions.scalar import hash_draw
from tallywright.operators.labels import numbered
from tallywright.sources.scratch import shared_folder


def keyed(docs: DataFrame, group: str) -> DataFrame:
    """doc_id, grp, lang and text_key."""
    plain = F.trim(F.translate(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    key = F.when(plain != "", F.md5(plain.cast("binary")))
    alone = F.concat(F.lit("copies of "), F.coalesce(key, F.lit("nothing")))
    return docs.select("doc_id", F.coalesce(F.col(group), alone).alias("grp"), "lang", key.alias("text_key"))


def once(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that what reads them several times reads and hashes the texts once."""
    path = f"{shared_folder(rows.sparkSession)}/keyed"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    """grp and fold of each group."""
    groups = rows.select("grp").distinct().withColumn("draw", hash_draw(seed, F.col("grp")))
    return numbered(groups, "place", ["draw", "grp"]).select("grp", (F.col("place") % folds).cast("int").alias("fold"))


def bit(fold: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), fold)


def leak_free(rows: DataFrame, folds: int) -> DataFrame:
    """rows with copies, leaks and train_for. rows: fold, text_key and any others."""
    held = rows.filter("text_key is not null").groupBy("text_key").agg(F.count("*").alias("copies"), F.bit_or(bit(F.col("fold"))).alias("mask"))
    rows = rows.join(held.filter("copies > 1"), "text_key", "left")
    own = bit(F.col("fold"))
    mask = F.coalesce(F.col("mask"), own)
    every = F.array(*[F.lit(k) for k in range(folds)])
    holds = lambda k: mask.bitwiseAND(bit(k)) != 0
    leaks = F.filter(every, lambda k: holds(k) & (k != F.col("fold")))
    train = F.filter(every, lambda k: ~holds(k) & (k != F.col("fold")))
    return rows.withColumns({"leaks": leaks, "train_for": train, "copies": F.coalesce("copies", F.when(F.col("text_key").isNotNull(), F.lit(1)).otherwise(0)).cast("long")}).drop("mask")


def run(spark: SparkSession, documents: str, labels: str, target: str, config: dict) -> DataFrame:
    """Writes target/folds and returns it as read back."""
    folds, names = int(config["folds"]), list(config["labels"])
    if not 2 <= folds <= 62:
        raise ValueError("folds: 2 to 62")
    rows = once(keyed(spark.read.parquet(documents), config["group"]))
    marks = spark.read.parquet(labels).filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    out = leak_free(rows.join(dealt(rows, folds, int(config["seed"])), "grp"), folds).join(marks, "doc_id", "left")
    path = f"{target}/folds"
    write_parts(out.select("doc_id", "grp", "lang", "text_key", "copies", "leaks", "train_for", *names, "fold"), path, "fold")

    done = spark.read.parquet(path)
    positives = [F.sum((F.col(n) >= 1).cast("int")).alias(n) for n in names]
    told = done.groupBy("fold").agg(F.count("*").alias("documents"), F.countDistinct("grp").alias("groups"), F.sum((F.size("leaks") > 0).cast("int")).alias("leaking"), *positives)
    LOG.info("read %s and %s", documents, labels)
    for r in told.orderBy("fold").collect():  # a row for each fold
        LOG.info("wrote fold %s of %s: %s", r["fold"], path, ", ".join(f"{k} {v}" for k, v in r.asDict().items() if k != "fold"))
    return done


if __name__ == "__main__":
    command_line("fold_audit", __doc__, ["documents", "labels", "target"], run)
