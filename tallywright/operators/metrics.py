"""Masks, ROC-AUC and summaries.

AUC is counted, not ranked: rows of equal score are summed first, so what is shuffled is at most a row for each score and
task, and ties need no care. The running sums are two-level, over ranges of scores and within them, so that one model and
class with many distinct scores doesn't gather in one task. Ranges are parts of a power of two on either side of 0, so they
are as even for scores that lie near 0, and for logits, as for scores spread over [0, 1], and need no pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores to a power of two.
GRAIN = 16
#: The same where a range's rows are held by one task, as for ranks.
FINE = 256


def score_range(score: Column, grain: int = GRAIN) -> Column:
    """The number of the range that a score lies in; it never falls as scores rise."""
    s = score.cast("double")
    size = F.least(F.lit(1e300), F.greatest(F.lit(1e-300), F.abs(s)))
    step = F.floor(F.log2(size) * grain) + 1000 * grain  # above 0 for all sizes
    return F.when(s > 0, step).when(s < 0, -step).otherwise(F.lit(0).cast("bigint"))


def counted(df: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: Column | None = None, single: bool = False) -> DataFrame:
    """The weight of positives and negatives at each score, missing ones too: keys, _s, _p, _n."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    s = F.col(score).cast("float") if single else F.col(score)
    rows = df.select(*keys, s.alias("_s"), (w * F.col(y)).alias("_p"), (w * (1 - F.col(y))).alias("_n"))
    return rows.groupBy(*keys, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))


def wins_of_counts(counts: DataFrame, keys: list[str], grain: int = GRAIN) -> DataFrame:
    """keys, wins (pairs of a positive above a negative, ties as halves), pos, neg and missing of counts by key and score."""
    there = F.col("_s").isNotNull()
    zero = F.lit(0)
    known = lambda c: F.when(there, F.col(c)).otherwise(zero)
    counts = counts.withColumns({"_p": known("_p"), "_n": known("_n"), "_m": F.when(there, zero).otherwise(F.col("_p") + F.col("_n"))})
    counts = counts.withColumn("_b", score_range(F.col("_s"), grain))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), zero)
    wins = counts.withColumn("_w", F.col("_p") * (below + 0.5 * F.col("_n")))
    parts = wins.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in ("_w", "_p", "_n", "_m")])
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), zero)
    parts = parts.withColumn("_w", F.col("_w") + F.col("_p") * earlier)
    return parts.groupBy(*keys).agg(F.sum("_w").alias("wins"), F.sum("_p").alias("pos"), F.sum("_n").alias("neg"), F.sum("_m").alias("missing"))


def auc_of_counts(counts: DataFrame, keys: list[str], grain: int = GRAIN) -> DataFrame:
    """keys, auc, pos, neg and missing (the weight of rows without a score) of counts with one row for each key and score."""
    ratio = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("wins") / (F.col("pos").cast("double") * F.col("neg")))
    return wins_of_counts(counts, keys, grain).select(*keys, ratio.alias("auc"), "pos", "neg", "missing")


def auc(df: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: Column | None = None, single: bool = False, grain: int = GRAIN) -> DataFrame:
    """ROC-AUC with ties as halves for each key: keys, auc (NULL if a class is absent), pos, neg.

    Rows without a score don't count. weight: row multiplicities, as a bootstrap draw gives them. single: scores are
    compared as 32-bit floats.
    """
    return auc_of_counts(counted(df.filter(F.col(score).isNotNull()), keys, score, y, weight, single), keys, grain).drop("missing")


def without_each(counts: DataFrame, by: list[str], part: str, parts: DataFrame, grain: int = FINE) -> DataFrame:
    """The AUC of the counts without each part: by, part, auc, pos and missing; no row where the part is all there is.

    counts: by, part, _s, _p, _n; parts: the parts, few, as folds. Concordant pairs of all counts lose those with a positive
    or a negative of the part, and regain those with both. Counts are dealt by ranges of scores and sorted there; a second
    level adds the ranges up, so no task holds a whole key's scores and no count is repeated for the other parts.
    """
    zero, earlier, there = F.lit(0), (Window.unboundedPreceding, -1), F.col("_s").isNotNull()
    known = lambda c: F.when(there, F.col(c)).otherwise(zero)
    c = counts.withColumns({"_p": known("_p"), "_n": known("_n"), "_m": F.when(there, zero).otherwise(F.col("_p") + F.col("_n"))})
    c = c.withColumn("_b", score_range(F.col("_s"), grain)).repartition(*by, "_b")  # all windows over scores keep to this
    for name, keys in (("all", [*by, "_b"]), ("own", [*by, "_b", part])):
        upto, tie = Window.partitionBy(*keys).orderBy("_s"), Window.partitionBy(*keys, "_s")  # ties included
        c = c.withColumns({f"{x}_{name}": F.sum(x).over(upto) - F.sum(x).over(tie) / 2 for x in ("_p", "_n")})
    own = c.groupBy(*by, "_b", part).agg(
        *[F.sum(x).alias(x) for x in ("_p", "_n", "_m")], F.sum(F.col("_p") * F.col("_n_all")).alias("_over"),
        F.sum(F.col("_n") * F.col("_p_all")).alias("_under"), F.sum(F.col("_p") * F.col("_n_own")).alias("_both"),
    )
    # Of a key there are as many ranges as its scores span, and a row for each range and part.
    before, mine = Window.partitionBy(*by).orderBy("_b").rangeBetween(*earlier), Window.partitionBy(*by, part).orderBy("_b").rowsBetween(*earlier)
    at = lambda x, w: F.coalesce(F.sum(x).over(w), zero)
    own = own.withColumns({"_p0": at("_p", before), "_n0": at("_n", before), "_own0": at("_n", mine)})
    per = own.groupBy(*by, part).agg(
        *[F.sum(x).alias(x) for x in ("_p", "_n", "_m")], F.sum(F.col("_over") + F.col("_p") * F.col("_n0")).alias("_over"),
        F.sum(F.col("_under") + F.col("_n") * F.col("_p0")).alias("_under"), F.sum(F.col("_both") + F.col("_p") * F.col("_own0")).alias("_both"),
    )
    sums = ("_p", "_n", "_m", "_over", "_under", "_both")
    every = per.groupBy(*by).agg(*[F.sum(x).alias(f"_all{x}") for x in sums[:4]], F.collect_list(F.struct(F.col(part).alias("part"), *sums)).alias("_each"))
    out = every.crossJoin(F.broadcast(parts)).withColumn("_own", F.get(F.filter("_each", lambda x: x["part"] == F.col(part)), F.lit(0)))
    less = {x: F.coalesce(F.col(f"_own.{x}"), zero) for x in sums}
    p, n, missing = (F.col(f"_all{x}") - less[x] for x in ("_p", "_n", "_m"))
    lost = less["_over"] + F.col("_all_p") * less["_n"] - less["_under"]  # pairs below its positives, pairs above its negatives
    ratio = F.when((p > 0) & (n > 0), (F.col("_all_over") - lost + less["_both"]) / (p.cast("double") * n))
    return out.filter(p + n + missing > 0).select(*by, part, ratio.alias("auc"), p.alias("pos"), missing.alias("missing"))


def rank_auc(df: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """The same by average ranks, an independent way to check auc(): the sum of the positives' ranks, less the least it can be.

    Ranks are those of value_counts, for each distinct score, so no window holds all rows of a key.
    """
    ranks = value_counts(df.filter(F.col(score).isNotNull()), keys, score, extra={"_p": F.sum(y), "_n": F.sum(1 - F.col(y))})
    p, n = F.sum("_p"), F.sum("_n")
    value = (F.sum((F.col("_below") + (F.col("_c") + 1) / 2) * F.col("_p")) - p * (p + 1) / 2) / (p.cast("double") * n)
    return ranks.groupBy(*keys).agg(F.when((p > 0) & (n > 0), value).alias("auc"))


def beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL and NaN keys meet their like, without other's keys.

    A merge join, as either side may have a row for each row of the table: Spark's size estimate is that of the files, which
    rows made by explode() exceed many times, so it would broadcast them through the driver.
    """
    other = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = df.join(other.hint("merge"), same, how) if keys else df.crossJoin(F.broadcast(other))  # without keys, other has one row
    return joined.drop(*[f"_of_{k}" for k in keys])


def value_counts(df: DataFrame, keys: list[str], column: str, grain: int = FINE, extra: dict[str, Column] | None = None) -> DataFrame:
    """Each distinct value of a numeric column, within keys: keys, column, _c (its rows), _below (the rows with less) and extra aggregates.

    NULL is less than every number and NaN more. Rows are summed by value before they are shuffled. The running sum is over
    a range of values, and a second one over the ranges, of which a key has some hundreds for each power of two it spans;
    so no window holds all of a key's values.
    """
    extra = extra or {}
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_c"), *[v.alias(n) for n, v in extra.items()])
    lowest = F.lit(-(2**40)).cast("bigint")
    counts = counts.withColumn("_b", F.when(F.col(column).isNull(), lowest).otherwise(score_range(F.col(column), grain)))
    earlier = (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(column).rowsBetween(*earlier)), F.lit(0))
    ranges = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(*earlier)), F.lit(0))
    ranges = ranges.select(*keys, "_b", before.alias("_before"))
    out = beside(counts.withColumn("_below", inside), ranges, [*keys, "_b"])
    return out.select(*keys, column, "_c", (F.col("_below") + F.col("_before")).alias("_below"), *extra)


def average_rank(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Ranks from 1 within keys, ties sharing their mean: counted by value_counts and joined to the rows by value.

    A value that very many rows share is a large join key, whose rows adaptive execution deals over tasks.
    """
    ranks = value_counts(df, keys, column).withColumn(name, F.col("_below") + (F.col("_c") + 1) / 2).drop("_c", "_below")
    return beside(df, ranks, [*keys, column])


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each named share, the linearly interpolated quantile of a numeric column; NULL doesn't count.

    Without keys there is one row, of NULLs if there is no value.

    The two order statistics about each quantile are picked from value_counts, so no buffer holds a group's values.
    """
    counts = value_counts(df.filter(F.col(column).isNotNull()), keys, column)
    counts = beside(counts, counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), keys)
    place = {name: F.lit(float(share)) * (F.col("_n") - 1) for name, share in shares.items()}
    here = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col(column).cast("double")))
    found = [here(whole(at)).alias(f"_{side}_{name}") for name, at in place.items() for side, whole in (("low", F.floor), ("high", F.ceil))]
    part = [F.max(at - F.floor(at)).alias(f"_part_{name}") for name, at in place.items()]
    out = counts.groupBy(*keys).agg(*found, *part)
    value = lambda n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")
    return out.select(*keys, *[value(n).alias(n) for n in shares])


def evaluable(df: DataFrame, models: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The classes that all models can be compared on: both labels present and no score missing in any model.

    df: class_id, model, score, y in long form. Returns keys and class_id.
    """
    if models is not None:
        df = df.filter(F.col("model").isin(models))
    each = df.groupBy(*keys, "class_id", "model").agg(
        ((F.sum("y") > 0) & (F.sum(1 - F.col("y")) > 0) & (F.count("*") == F.count("score"))).alias("ok")
    )
    fit = each.groupBy(*keys, "class_id").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n"))
    return fit.filter("ok" if models is None else F.col("ok") & (F.col("n") == len(models))).select(*keys, "class_id")


def macro_auc(df: DataFrame, mask: DataFrame | None = None, keys: tuple[str, ...] = ("model",), empty: float | None = 0.0) -> DataFrame:
    """The mean AUC over the classes of the mask for each key; `empty` if there is none."""
    if mask is not None:
        df = df.join(F.broadcast(mask), mask.columns, "left_semi")  # classes by key
    per = auc(df, [*keys, "class_id"])
    mean = F.avg("auc")
    return per.groupBy(*keys).agg((F.coalesce(mean, F.lit(empty)) if empty is not None else mean).alias("macro"), F.count("auc").alias("classes"))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """The rows of which every model has some score."""
    per = df.groupBy("row_id", "model").agg(F.count("score").alias("n")).groupBy("row_id").agg(F.min("n").alias("n"))
    return df.join(per.filter("n > 0").select("row_id").hint("merge"), "row_id", "left_semi")


def mask_untrained(df: DataFrame) -> DataFrame:
    """Scores become NULL where the other folds hold no positive of the class. df: fold, class_id, y, score."""
    total = df.filter("y = 1").groupBy("class_id", "fold").agg(F.countDistinct("row_id").alias("n"))
    every = total.groupBy("class_id").agg(F.sum("n").alias("all"))
    own = total.withColumnRenamed("n", "own")
    out = df.join(F.broadcast(every), "class_id", "left").join(F.broadcast(own), ["class_id", "fold"], "left")  # classes by fold
    trained = F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0)) > 0
    return out.withColumn("score", F.when(trained, F.col("score"))).drop("all", "own")


def ordered_mean(score: str, order: str) -> Column:
    """The mean of the scores that are there, added up in the order of a column: no order of arrival can change a bit of it."""
    held = F.sort_array(F.collect_list(F.when(F.col(score).isNotNull(), F.struct(F.col(order).alias("o"), F.col(score).alias("s")))))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x["s"])
    return F.when(F.count(score) > 0, total / F.count(score))


def with_mean(df: DataFrame, keys: tuple[str, ...] = ("row_id", "class_id"), carry: tuple[str, ...] = ("y", "fold", "author"), ord_: int = 99) -> DataFrame:
    """Adds the candidate `mean`, the models' mean score in the order of ord, NULL if any is NULL."""
    full = F.count("*") == F.count("score")
    mean = df.groupBy(*keys, *carry).agg(F.when(full, ordered_mean("score", "ord")).alias("score"))
    return df.unionByName(mean.withColumns({"model": F.lit("mean"), "ord": F.lit(ord_)}).select(*df.columns))


def candidates(packed: DataFrame, ord_: int = 99, whole: str | None = None) -> DataFrame:
    """with_mean() of scores that lie side by side: a row for each row and class becomes one for each candidate, without a shuffle.

    packed: any columns and scores, an array of (model, ord, score) in the order of ord. whole: the name of a column that says
    whether every model has a score there.
    """
    scores = F.col("scores")
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["score"])  # NULL if any is
    mean = F.when(F.size(scores) > 0, total / F.greatest(F.size(scores), F.lit(1)))
    kept = [c for c in packed.columns if c != "scores"]
    out = packed.withColumn("_mean", mean)
    more = F.array(F.struct(F.lit("mean").alias("model"), F.lit(ord_).alias("ord"), F.col("_mean").alias("score")))
    out = out.select(*kept, *([F.col("_mean").isNotNull().alias(whole)] if whole else []), F.explode(F.concat(scores, more)).alias("_s"))
    return out.select(*kept, *([whole] if whole else []), *[F.col(f"_s.{c}").alias(c) for c in ("model", "ord", "score")])


def complementarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """How two models' rights and wrongs go together, by class and on average.

    Right means (score > 0.5) == y. Q is skipped where its denominator is 0, classes without positives or with fewer than
    4 rows entirely. Returns class_id, pearson, spearman, q, double_fault.
    """
    x = df.filter(F.col("model") == a).select("row_id", "class_id", "y", F.col("score").alias("x"))
    z = df.filter(F.col("model") == b).select("row_id", "class_id", F.col("score").alias("z"))
    both = x.join(z.hint("merge"), ["row_id", "class_id"]).filter("x is not null and z is not null")
    both = average_rank(average_rank(both, ["class_id"], "x", "rx"), ["class_id"], "z", "rz")
    right = lambda c: ((F.col(c) > 0.5).cast("int") == F.col("y")).cast("int")
    both = both.withColumns({"p": right("x"), "q": right("z")})
    count = lambda p, q: F.sum(F.when((F.col("p") == p) & (F.col("q") == q), 1).otherwise(0)).cast("double")
    n = {(p, q): count(p, q) for p in (0, 1) for q in (0, 1)}
    top, bottom = n[1, 1] * n[0, 0] - n[0, 1] * n[1, 0], n[1, 1] * n[0, 0] + n[0, 1] * n[1, 0]
    out = both.groupBy("class_id").agg(
        F.corr("x", "z").alias("pearson"), F.corr("rx", "rz").alias("spearman"),
        F.when(bottom != 0, top / bottom).alias("q"), (n[0, 0] / F.count("*")).alias("double_fault"),
        F.sum("y").alias("_pos"), F.count("*").alias("_n"),
    )
    return out.filter("_pos > 0 and _n >= 4").drop("_pos", "_n")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b and the count of pairs, over the rows that have both values; tied pairs count in neither direction.

    In n log n, without pairs of rows. Two rows of different y part at the highest bit in which their ranks by y differ:
    among the rows that share the higher bits, that bit is a label and x a score, and concordant less discordant pairs are
    2 wins - positives x negatives. Ties in x are half a win, so they add nothing, and ties in y never part.
    """
    rows = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x is not null and _y is not null")
    below = value_counts(rows, [], "_y")
    codes = beside(rows, below.select("_y", F.col("_below").alias("_code")), ["_y"])
    top = rows.agg(F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.count("*"), F.lit(1))))).cast("int").alias("_top"))
    bits = codes.crossJoin(F.broadcast(top)).withColumn("_bit", F.explode(F.sequence(F.lit(0), "_top")))  # top: one row
    bits = bits.select("_bit", F.expr("shiftright(_code, _bit + 1)").alias("_high"), F.expr("shiftright(_code, _bit) & 1L").alias("_up"), "_x")
    parted = wins_of_counts(counted(bits, ["_bit", "_high"], "_x", "_up"), ["_bit", "_high"], FINE)
    lead = parted.agg(F.coalesce(F.sum(2 * F.col("wins") - F.col("pos") * F.col("neg")), F.lit(0.0)).alias("_lead"))
    tied = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    n = F.sum("_c")
    of_y = below.agg((n * (n - 1) / 2).cast("bigint").alias("pairs"), tied("_c").alias("_ty"))
    of_x = rows.groupBy("_x").agg(F.count("*").alias("_c")).agg(tied("_c").alias("_tx"))
    root = F.sqrt((F.col("pairs") - F.col("_tx")) * (F.col("pairs") - F.col("_ty")))
    return lead.crossJoin(of_x).crossJoin(of_y).select(F.when(root > 0, F.col("_lead") / root).alias("tau"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def summary(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, percentile interval, standard error (ddof 1), MDE and count of replicates; NULL replicates don't count.

    A group has a row for each replicate, which F.percentile holds; quantiles() is the way for groups that grow.
    """
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), q(0.025).alias("lo"), q(0.975).alias("hi"), F.stddev_samp(v).alias("se"),
        (1.96 * F.stddev_samp(v)).alias("mde"), F.count(v).alias("n"),
    )


def null_summary(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.05)).alias("p5"), F.percentile(v, F.lit(0.95)).alias("p95"),
        F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"),
    )
