"""Null distributions of the held-out selector's headroom; all replicates are one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.scalar import hash_draw
from tallywright.operators.dealt import dealt_positives
from tallywright.operators.metrics import auc_of_counts, counted, ordered_mean
from tallywright.operators.select import oracle_counts
from tallywright.sources.scratch import shared_folder


def _headrooms(own: DataFrame, folds: DataFrame) -> DataFrame:
    """rep, headroom: the selector's macro AUC minus the best single model's, in each replicate.

    own: counts by rep, fold, class_id, model and ord, in one row or more for each score; folds: a table with the folds. Macros are
    added up in the order of classes, so that equal counts give equal bits in any partitioning. The selection, the oracle and
    the single models each filter the counts in their own way, so that Spark would draw and pair all replicates three times:
    they are written to the shared folder once.
    """
    path = f"{shared_folder(own.sparkSession)}/counts"
    own.write.parquet(path)
    own = own.sparkSession.read.schema(own.schema).parquet(path)
    chosen = oracle_counts(own, ("rep",), folds)
    total = lambda f, *by: f.groupBy("rep", *by, "class_id", "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    oracle = auc_of_counts(total(chosen), ["rep", "class_id"], grain=4).select("rep", "class_id", F.col("auc").alias("o"))
    singles = auc_of_counts(total(own.filter("model <> 'mean'"), "model"), ["rep", "model", "class_id"], grain=4)
    both = singles.join(oracle, ["rep", "class_id"]).filter("auc is not null and o is not null")
    macro = both.groupBy("rep", "model").agg(ordered_mean("auc", "class_id").alias("m"), ordered_mean("o", "class_id").alias("o"))
    return macro.groupBy("rep").agg((F.max("o") - F.max("m")).alias("headroom"))


def permuted_counts(df: DataFrame, reps: int, seed: int, models: list[str] | None = None) -> DataFrame:
    """Counts by rep, fold, class_id, model and ord with label rows permuted within authors, for all models or for some.

    A permutation moves labels within a fold, so how often a score stands does not change: rows are counted once, and a
    replicate adds only its positives, which are few. df has every class for each row; an author is in one fold.
    """
    by = ["fold", "class_id", "model", "ord"]
    df = df.filter(F.col("author").isNotNull())
    own = F.lit(True) if models is None else F.col("model").isin(models)
    each = F.broadcast(df.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    counts = counted(df, by).withColumn("_all", F.col("_p") + F.col("_n"))
    base = counts.withColumn("_p", F.when(own, 0).otherwise(F.col("_p"))).select(*by, "_s", "_p", "_all").crossJoin(each)
    new = dealt_positives(df, by, own, reps, seed).withColumn("_all", F.lit(0).cast("bigint"))
    both = base.unionByName(new).groupBy("rep", *by, "_s").agg(F.sum("_p").alias("_p"), F.sum("_all").alias("_all"))
    return both.select("rep", *by, "_s", "_p", (F.col("_all") - F.col("_p")).alias("_n"))


def label_permutation(df: DataFrame, reps: int, seed: int) -> DataFrame:
    """Whole label rows are permuted within authors; the selector is run anew in each replicate."""
    return _headrooms(permuted_counts(df, reps, seed), df)


def prediction_permutation(df: DataFrame, model: str, reps: int, seed: int) -> DataFrame:
    """One model's score rows are permuted within authors: its labels are, the other way round, which pairs them alike."""
    return _headrooms(permuted_counts(df, reps, seed, [model]), df)


def noise_null(df: DataFrame, anchor: str, reps: int, seed: int, keep_best: bool = False) -> DataFrame:
    """A candidate of noise, the sigmoid of a normal draw made of two hashes, against the anchor alone.

    keep_best: all models stay candidates, so the null can't fall below the best of them by leaving it out. The models are
    counted once, as no replicate changes them; draws hardly ever tie, so they are not summed by score first.
    """
    by = ["fold", "class_id", "model", "ord"]
    anchored = df.filter(F.col("model") == anchor)
    each = F.broadcast(df.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    held = counted(df if keep_best else anchored, by).crossJoin(each)
    draw = lambda n: (hash_draw(seed, n, F.col("rep"), F.col("row_id"), F.col("class_id")) + 1) / 4294967297
    z = F.sqrt(-2 * F.log(draw(1))) * F.cos(6.283185307179586 * draw(2))
    y = F.col("y").cast("bigint")
    noise = anchored.crossJoin(each).select("rep", "fold", "class_id", F.lit("noise").alias("model"), F.lit(98).alias("ord"), (1 / (1 + F.exp(-z))).alias("_s"), y.alias("_p"), (1 - y).alias("_n"))
    return _headrooms(held.select(noise.columns).unionByName(noise), df)


def debiased(boot: DataFrame, null: DataFrame, center: str = "bootstrap_mean", point: float | None = None) -> DataFrame:
    """The headroom less the null's mean, with the null mean's standard error: mean, null_mean, null_se, debiased.

    center: the bootstrap's mean, or "point", the point estimate.
    """
    b = boot.agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("se"))
    n = null.agg(F.avg("headroom").alias("null_mean"), (F.stddev_samp("headroom") / F.sqrt(F.count("headroom"))).alias("null_se"))
    top = F.lit(point) if center == "point" else F.col("mean")
    return b.crossJoin(n).withColumn("debiased", top - F.col("null_mean"))
