"""Whole audits: pseudo-labels made and judged, the ranking of configurations against a leaderboard, and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.tails import correlation_tail, kendall_tail
from tallywright.operators.metrics import auc, average_rank, kendall, macro_auc, rank_auc, summary
from tallywright.operators.resample import paired_deltas, replicate_auc_plain
from tallywright.operators.select import best, headroom, heldout
from tallywright.operators.shift import pseudo_labels, sampled, window_grid


def pseudo_label_generation(pool: DataFrame, labelled: DataFrame, scores: DataFrame, files: int, starts: list[int], k: int, seed: int) -> DataFrame:
    """The pseudo-labels of sampled files: filename, start_sec, class_id, rank.

    pool: filename; labelled files leave it, `files` of the rest are drawn without replacement (all, if fewer). scores:
    filename, start_sec, class_id, score. Each window of a drawn file gets its k best classes; missing and infinite scores
    are never labels, and a window without any finite score has no rows.
    """
    rest = pool.select("filename").distinct().join(labelled.select("filename").distinct(), "filename", "left_anti")
    windows = window_grid(sampled(rest, "filename", files, seed), starts).drop("end_sec")
    found = windows.join(scores, ["filename", "start_sec"])
    fine = F.when(F.abs("score") < float("inf"), F.col("score"))
    found = found.withColumns({"score": fine, "row_id": F.struct("filename", "start_sec")})
    return pseudo_labels(found, k).select("filename", "start_sec", "class_id", "rank")


def pseudo_label_audit(target: DataFrame, focal: DataFrame, trained: DataFrame, weights: DataFrame, base: str, pseudo: str) -> DataFrame:
    """Whether pseudo-labels help in the target domain: base, pseudo, delta, lo, hi, n_boot, focal_delta, own_base, own_pseudo, verdict.

    target, focal: row_id, class_id, y, model, score, the target with filename too. trained: model, class_id, the classes
    that a model saw positives of. weights: rep, filename, w. Classes are those of the base's training that the target has
    positives of; the own scores take each model's. The interval is a bootstrap over files, of replicates in which both
    models have a score. Missing focal scores count as 0.
    """
    models = [base, pseudo]
    target, focal = target.filter(F.col("model").isin(models)), focal.filter(F.col("model").isin(models))
    there = target.filter("y = 1").select("class_id").distinct()
    common = there.join(trained.filter(F.col("model") == base).select("class_id"), "class_id", "left_semi")
    wide = lambda f, mask, names: macro_auc(f, mask, empty=None).groupBy().pivot("model", models).agg(F.first("macro")).toDF(*names)
    point = wide(target, common, ["base", "pseudo"]).withColumn("delta", F.col("pseudo") - F.col("base"))
    focal_ = wide(focal.withColumn("score", F.coalesce("score", F.lit(0.0))), common, ["f_base", "f_pseudo"])
    own = wide(target, there.join(trained.select("model", "class_id").distinct(), "class_id").select("model", "class_id"), ["own_base", "own_pseudo"])
    rows = target.join(common, "class_id", "left_semi")
    boot = summary(paired_deltas(replicate_auc_plain(rows, weights, "filename", ["model", "class_id"]), base, [pseudo], common=False), "delta")
    out = point.crossJoin(focal_).crossJoin(own).crossJoin(boot.select("lo", "hi", F.col("n").alias("n_boot")))  # one row each
    verdict = F.when((F.col("lo") > 0) & (F.col("delta") > 0), "adds").when((F.col("hi") < 0) & (F.col("delta") < 0), "hurts").otherwise("none")
    return out.select("base", "pseudo", "delta", "lo", "hi", "n_boot", (F.col("f_pseudo") - F.col("f_base")).alias("focal_delta"), "own_base", "own_pseudo", verdict.alias("verdict"))


def concordance(configs: DataFrame) -> DataFrame:
    """Spearman and Kendall of cv with lb, with p-values, over the reproducible configurations and over all: part, spearman, spearman_p, tau, tau_p, n.

    configs: config, cv, lb, reproducible; a row for each configuration, so the table is small.
    """

    def one(df: DataFrame, part: str) -> DataFrame:
        ranked = average_rank(average_rank(df, [], "cv", "rc"), [], "lb", "rl")
        both = ranked.agg(F.corr("rc", "rl").alias("spearman"), F.count("*").alias("n")).crossJoin(kendall(df, "cv", "lb").select("tau"))
        return both.select(F.lit(part).alias("part"), "spearman", "tau", "n")

    out = one(configs.filter("reproducible"), "reproducible").unionByName(one(configs, "all"))
    return out.withColumns({"spearman_p": correlation_tail("spearman", "n"), "tau_p": kendall_tail("tau", "n")})


def invariants(df: DataFrame, model: str, other: str, null: DataFrame) -> DataFrame:
    """Checks that the selector must pass on any data: name, value, ok.

    off_mask: the oracle's macro AUC doesn't change if its scores outside the common classes are taken away. forced_single,
    duplicate: the lead over one model, of itself or of two copies, is 0. argmax: choices are those of an independent
    ranking by ranks. alignment: a model's AUC against the labels of other rows falls to one half. null_centre: the null's
    mean headroom is not above 0.05. df: candidates; null: rep, headroom.
    """
    oracle, choice = heldout(df)
    every = df.unionByName(oracle)
    per = every.groupBy("class_id", "model").agg(((F.sum("y") > 0) & (F.sum(1 - F.col("y")) > 0) & (F.count("*") == F.count("score"))).alias("ok"))
    mask = per.groupBy("class_id").agg(F.bool_and("ok").alias("ok")).filter("ok").select("class_id")
    inside = oracle.join(F.broadcast(mask.withColumn("_in", F.lit(True))), "class_id", "left").withColumn("score", F.when(F.col("_in"), F.col("score"))).select(oracle.columns)
    whole = macro_auc(oracle, mask).select(F.col("macro").alias("x")).crossJoin(macro_auc(inside, mask).select(F.col("macro").alias("z")))
    off = whole.select(F.lit("off_mask").alias("name"), F.abs(F.col("x") - F.col("z")).alias("value"))

    single = df.filter(F.col("model") == model)
    lead = lambda f, name: headroom(f, heldout(f)[0]).select(F.lit(name).alias("name"), F.abs("headroom").alias("value"))
    twice = single.unionByName(single.withColumns({"model": F.lit("copy"), "ord": F.col("ord") + 1}))

    folds = df.select("fold").distinct()
    outer = df.join(F.broadcast(folds.select(F.col("fold").alias("outer_fold"))), F.col("outer_fold") != F.col("fold"))
    keys = ["outer_fold", "class_id", "model", "ord"]
    full = outer.groupBy(*keys).agg((F.count("*") == F.count("score")).alias("full"))
    again = rank_auc(outer.withColumn("score", F.col("score").cast("float")), keys).join(full, keys).withColumn("auc", F.when(F.col("full"), F.col("auc")))
    again = best(again, ["outer_fold", "class_id"]).filter("auc is not null").select("outer_fold", "class_id", F.col("model").alias("manual"), F.col("auc").alias("manual_auc"))
    picked = again.join(choice, ["outer_fold", "class_id"])  # a tie to the last bit of two sums is no mismatch
    wrong = picked.agg(F.coalesce(F.sum(((F.col("model") != F.col("manual")) & (F.abs(F.col("auc") - F.col("manual_auc")) > 1e-12)).cast("double")), F.lit(0.0)).alias("value"))

    rows = df.filter(F.col("model") == other).select("row_id", "class_id", "y", "score")
    place = rows.select("row_id").distinct()
    from tallywright.functions.scalar import hash_draw
    from tallywright.operators.labels import numbered

    own = numbered(place, "k", ["row_id"])
    dealt = numbered(place.withColumn("o", hash_draw(0, F.col("row_id"))), "k", ["o", "row_id"]).select("k", F.col("row_id").alias("giver"))
    moved = own.join(dealt.hint("merge"), "k").drop("k").join(rows.drop("y").hint("merge"), "row_id")
    moved = moved.join(rows.select(F.col("row_id").alias("giver"), "class_id", "y").hint("merge"), ["giver", "class_id"])
    shuffled = auc(moved, ["class_id"]).agg(F.percentile("auc", F.lit(0.5)).alias("value"))

    named = lambda f, name: f.select(F.lit(name).alias("name"), "value")
    centre = null.agg(F.avg("headroom").alias("value"))
    out = off.unionByName(lead(single, "forced_single")).unionByName(lead(twice, "duplicate")).unionByName(named(wrong, "argmax"))
    out = out.unionByName(named(shuffled, "alignment")).unionByName(named(centre, "null_centre"))
    ok = F.when(F.col("name") == "alignment", F.abs(F.col("value") - 0.5) < 0.1).when(F.col("name") == "null_centre", F.col("value") < 0.05).otherwise(F.col("value") < 1e-12)
    return out.withColumn("ok", ok)
