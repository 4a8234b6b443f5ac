"""Per-class model selection: held out, in sample, shrunken, nested and frozen.

All outer folds, classes and candidates are columns of one plan; no loop runs on the driver. Candidates are rows of
(row_id, class_id, model, ord, score, y, fold); ord breaks ties, the first wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.metrics import auc_of_counts, counted, without_each


def other_folds(df: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Every row once for each outer fold that is not its own. The folds are few, and are broadcast as such."""
    folds = df.select("fold").distinct() if folds is None else folds
    return df.join(F.broadcast(folds.select(F.col("fold").alias("outer_fold"))), F.col("outer_fold") != F.col("fold"))


def best(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of the highest AUC for each key; without any AUC the first candidate."""
    order = Window.partitionBy(*keys).orderBy(F.col("auc").desc_nulls_last(), "ord")
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def meeting(df: DataFrame, pick: DataFrame, on: list[str], few: bool) -> DataFrame:
    """df's rows of the picked candidates, never with df as the side that is broadcast.

    few: pick has a row for each fold and class, and is broadcast, so rows are not gathered by the few picked keys. Picks by
    further keys, as replicates, are merged.
    """
    return df.join(F.broadcast(pick), on) if few else df.join(pick.hint("merge"), on)


def selection(df: DataFrame, keys: tuple[str, ...] = (), min_pos: int = 1, policy: str = "kill", whole: str | None = None) -> DataFrame:
    """The AUC of each candidate over the folds other than the outer fold: keys, outer_fold, class_id, model, ord, auc, pos.

    policy: "kill" gives a candidate no AUC if any of its scores there is missing; "pairwise" leaves rows out on which
    any candidate's score is missing. whole, a column of metrics.candidates, tells which those are; else the rows are grouped,
    once for all outer folds, as a row and class is in one fold.
    """
    if policy == "pairwise" and whole is None:
        on = [*keys, "fold", "row_id", "class_id"]
        full = df.groupBy(*on).agg((F.count("*") == F.count("score")).alias("_ok")).filter("_ok").drop("_ok")
        df = df.join(full.hint("merge"), on, "left_semi")
    elif policy == "pairwise":
        df = df.filter(F.col(whole))
    return selection_of_counts(counted(df, [*keys, "fold", "class_id", "model", "ord"]), keys, min_pos, df)


def scorable(found: DataFrame, by: list[str], min_pos: int) -> DataFrame:
    """The AUCs, but none of a candidate with missing scores or too few positives."""
    fit = (F.col("missing") == 0) & (F.col("pos") >= min_pos)
    return found.select(*by, F.when(fit, F.col("auc")).alias("auc"), "pos")


def selection_of_counts(own: DataFrame, keys: tuple[str, ...] = (), min_pos: int = 1, folds: DataFrame | None = None) -> DataFrame:
    """selection() by policy "kill" from counts by keys, fold, class_id, model and ord; scores are compared as 32-bit floats.

    The outer fold is taken out in closed form, so that counts are dealt and sorted once and not repeated for each of the
    other folds. All sums are whole numbers and halves: the AUC is that of the other folds' counts to the last bit while
    pairs stay below 2**52. folds: a table with the folds, if there is one that is quicker to read than the counts.
    """
    by = ["class_id", "model", "ord"]
    folds = (own if folds is None else folds).select("fold").filter("fold is not null").distinct()
    own = own.filter("fold is not null").withColumn("_s", F.col("_s").cast("float"))
    found = without_each(own, [*keys, *by], "fold", folds).withColumnRenamed("fold", "outer_fold")
    return scorable(found, [*keys, "outer_fold", *by], min_pos)


def heldout_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The held-out selector on counts: those of all candidates by keys, fold, class_id, model and ord, and the oracle's.

    Rows are summed once; the selection, the oracle, whose counts are those of the chosen candidates, and all AUCs are made
    of these counts.
    """
    own = counted(df, [*keys, "fold", "class_id", "model", "ord"])
    return own, oracle_counts(own, keys, df)


def oracle_counts(own: DataFrame, keys: tuple[str, ...] = (), folds: DataFrame | None = None) -> DataFrame:
    """The counts of the candidates that the held-out selector chooses, as model oracle."""
    choice = best(selection_of_counts(own, keys, folds=folds), [*keys, "outer_fold", "class_id"])
    pick = choice.select(*keys, F.col("outer_fold").alias("fold"), "class_id", "model")
    oracle = meeting(own, pick, [*keys, "fold", "class_id", "model"], not keys).withColumns({"model": F.lit("oracle"), "ord": F.lit(-1)})
    return oracle.select(own.columns)


def heldout_headroom(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """headroom() of the held-out selector."""
    own, oracle = heldout_counts(df, keys)
    return headroom_of_counts(own.unionByName(oracle), keys)


def apply_choice(df: DataFrame, choice: DataFrame, keys: tuple[str, ...] = (), name: str = "oracle") -> DataFrame:
    """The chosen candidate's scores on the outer fold's own rows, as a model called name."""
    pick = choice.select(*keys, F.col("outer_fold").alias("fold"), "class_id", "model")
    return meeting(df, pick, [*keys, "fold", "class_id", "model"], not keys).withColumns({"model": F.lit(name), "ord": F.lit(-1)}).select(*df.columns)


def heldout(df: DataFrame, keys: tuple[str, ...] = (), **policy) -> tuple[DataFrame, DataFrame]:
    """The held-out selector: scores of the model `oracle`, and the choices by outer fold and class."""
    choice = best(selection(df, keys, **policy), [*keys, "outer_fold", "class_id"])
    return apply_choice(df, choice, keys), choice


def in_sample(df: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The apparent oracle, chosen on all rows; classes that no candidate can be scored on have no scores."""
    by = [*keys, "class_id", "model", "ord"]
    found = auc_of_counts(counted(df, by, single=True), by).filter("missing = 0 and auc is not null")
    choice = best(found, [*keys, "class_id"])
    picked = meeting(df, choice.select(*keys, "class_id", "model"), [*keys, "class_id", "model"], not keys)
    return picked.withColumns({"model": F.lit("oracle_in"), "ord": F.lit(-1)}).select(*df.columns), choice


def shrunken(df: DataFrame, default: str, grid: DataFrame) -> DataFrame:
    """The held-out choice that leaves the default model only for a margin: outer_fold, class_id, margin, min_pos, model.

    grid: margin, min_pos. Both candidates must be scorable and the class must have min_pos positives.
    """
    scored = selection(df)
    top = best(scored, ["outer_fold", "class_id"]).select("outer_fold", "class_id", F.col("model").alias("top"), F.col("auc").alias("top_auc"), "pos")
    base = scored.filter(F.col("model") == default).select("outer_fold", "class_id", F.col("auc").alias("base_auc"))
    both = top.join(base, ["outer_fold", "class_id"]).crossJoin(F.broadcast(grid))
    move = (F.col("top_auc") - F.col("base_auc") > F.col("margin")) & (F.col("pos") >= F.col("min_pos"))
    return both.select("outer_fold", "class_id", "margin", "min_pos", F.when(F.coalesce(move, F.lit(False)), F.col("top")).otherwise(F.lit(default)).alias("model"))


def nested_base(shards: DataFrame) -> DataFrame:
    """Selection scores by outer fold: rows of fold g from the model trained without f and g.

    shards: ex_a, ex_b, fold, row_id, class_id, model, score. Returns them with outer_fold, the excluded fold that is not the rows'.
    """
    pair = shards.filter((F.col("fold") == F.col("ex_a")) | (F.col("fold") == F.col("ex_b")))
    return pair.withColumn("outer_fold", F.when(F.col("fold") == F.col("ex_a"), F.col("ex_b")).otherwise(F.col("ex_a"))).drop("ex_a", "ex_b")


def nested_choice(selecting: DataFrame) -> DataFrame:
    """The choice by outer fold and class from scores that are keyed by outer fold already."""
    by = ["outer_fold", "class_id", "model", "ord"]
    found = auc_of_counts(counted(selecting, by, single=True), by)
    return best(found.withColumn("auc", F.when(F.col("missing") == 0, F.col("auc"))), ["outer_fold", "class_id"])


def headroom(df: DataFrame, oracle: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Macro AUC of every model and the oracle on the classes common to all, and the oracle's lead over the best."""
    return headroom_of_counts(counted(df.unionByName(oracle), [*keys, "model", "class_id"]), keys)


def headroom_of_counts(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    by = [*keys, "model", "class_id"]
    counts = counts.groupBy(*by, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    per = auc_of_counts(counts, by)
    common = F.bool_and(F.col("auc").isNotNull() & (F.col("missing") == 0)).over(Window.partitionBy(*keys, "class_id"))
    per = per.withColumn("_ok", common).filter("_ok")
    macro = per.groupBy(*keys, "model").agg(F.avg("auc").alias("macro"), F.count("auc").alias("classes"))
    single = ~F.col("model").isin("oracle", "oracle_in", "mean", "fusion")
    lead = macro.groupBy(*keys).agg(
        F.max(F.when(single, F.col("macro"))).alias("best_single"), F.max(F.when(F.col("model").startswith("oracle"), F.col("macro"))).alias("oracle"), F.max("classes").alias("classes"))
    return lead.withColumn("headroom", F.col("oracle") - F.col("best_single"))


def author_splits(df: DataFrame, reps: int, folds: int, seed: int) -> DataFrame:
    """rep, author, fold: authors dealt round-robin over folds in an order of hashes."""
    from tallywright.functions.scalar import hash_draw

    reps_ = df.sparkSession.range(reps).withColumnRenamed("id", "rep")
    every = df.select("author").distinct().crossJoin(F.broadcast(reps_))
    order = Window.partitionBy("rep").orderBy(hash_draw(seed, F.col("rep"), F.col("author")), "author")
    return every.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))
