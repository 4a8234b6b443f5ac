"""Post-processing knobs: score frames in, score frames out. Frames have row_id, class_id, score; missing counts as 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.labels import placed
from tallywright.operators.metrics import quantiles


def zero_missing(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.coalesce("score", F.lit(0.0)))


def genus_smoothing(df: DataFrame, genera: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(1 - alpha) p + alpha * the row's mean over the genus; genera of one class and classes without any score stay.

    genera: class_id, genus.
    """
    several = genera.withColumn("_n", F.count("*").over(Window.partitionBy("genus")))
    scored = df.groupBy("class_id").agg((F.count("score") > 0).alias("_any"))
    full = zero_missing(df).join(F.broadcast(several), "class_id").join(F.broadcast(scored), "class_id")
    mean = F.avg("score").over(Window.partitionBy("row_id", "genus"))
    new = F.when((F.col("_n") >= 2) & F.col("_any"), (1 - alpha) * F.col("score") + alpha * mean).otherwise(F.col("score"))
    return full.withColumn("score", new).drop("_n", "_any", "genus")


def taxon_gate(df: DataFrame, taxa: DataFrame, power: float = 0.5) -> DataFrame:
    """p * share ** power, where share is the taxon's part of the row's mass, clipped to [1e-6, 1].

    Rows are dealt by row_id and sorted by (row_id, taxon) once, which serves both sums.
    """
    full = zero_missing(df).repartition("row_id").join(F.broadcast(taxa), "class_id").sortWithinPartitions("row_id", "taxon")
    full = full.withColumn("_mass", F.sum("score").over(Window.partitionBy("row_id", "taxon")))
    full = full.withColumn("_total", F.sum("score").over(Window.partitionBy("row_id")) + 1e-9)
    share = F.least(F.lit(1.0), F.greatest(F.lit(1e-6), F.col("_mass") / F.col("_total")))
    return full.withColumn("score", F.col("score") * F.pow(share, F.lit(power))).drop("taxon", "_mass", "_total")


def taxon_mass(df: DataFrame, taxa: DataFrame) -> DataFrame:
    """The mass and share of each taxon in each row."""
    per = zero_missing(df).join(F.broadcast(taxa), "class_id").groupBy("row_id", "taxon").agg(F.sum("score").alias("mass"))
    return per.withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy("row_id")))


def imputed(coords: DataFrame) -> DataFrame:
    """Missing coordinates become the medians."""
    median = quantiles(coords, [], "lat", {"_a": 0.5}).crossJoin(quantiles(coords, [], "lon", {"_b": 0.5}))  # one row
    both = coords.crossJoin(F.broadcast(median))
    return both.withColumns({"lat": F.coalesce("lat", "_a"), "lon": F.coalesce("lon", "_b")}).drop("_a", "_b")


def grid_cells(coords: DataFrame, grid: int) -> DataFrame:
    """Each row's cell i, j of a grid over the bounding box."""
    box = coords.agg(F.min("lat").alias("_a0"), F.max("lat").alias("_a1"), F.min("lon").alias("_o0"), F.max("lon").alias("_o1"))

    def cell(x: str, low: str, high: str) -> Column:
        step = F.when(F.col(high) > F.col(low), (F.col(high) - F.col(low)) / grid).otherwise(1.0)
        return F.least(F.lit(grid - 1), F.greatest(F.lit(0), ((F.col(x) - F.col(low)) / step).cast("int")))

    both = coords.crossJoin(F.broadcast(box))
    return both.withColumns({"i": cell("lat", "_a0", "_a1"), "j": cell("lon", "_o0", "_o1")}).drop("_a0", "_a1", "_o0", "_o1")


def kernel(sigma: float) -> list[float]:
    """A normalised Gaussian of radius int(4 sigma + 0.5)."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def blurred(counts: DataFrame, keys: list[str], sigma: float, grid: int) -> DataFrame:
    """A separable Gaussian blur of keys, i, j, n with zeros outside: keys, i, j, density. Two joins with the kernel's few rows."""
    w = kernel(sigma)
    taps = F.array(*[F.struct(F.lit(k - len(w) // 2).alias("d"), F.lit(x).alias("w")) for k, x in enumerate(w)])

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        out = df.withColumn("_t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("_t.d"))
        out = out.filter((F.col(axis) >= 0) & (F.col(axis) < grid))
        return out.groupBy(*keys, axis, other).agg(F.sum(F.col("n") * F.col("_t.w")).alias("n"))

    return along(along(counts, "i", "j"), "j", "i").withColumnRenamed("n", "density")


def spatial_prior(df: DataFrame, coords: DataFrame, grid: int = 60, sigma: float = 2.0, strength: float = 0.3) -> DataFrame:
    """p * (1 + strength * (2 r - 1)), r the rank of the class's blurred density at the row's place among the fold's rows.

    df: row_id, class_id, fold, y, score. Densities come from the positives of the other folds; a class with fewer than
    two of them is left alone. Equal densities are ranked by row_id.
    """
    placed = grid_cells(imputed(coords), grid).select("row_id", "i", "j")
    rows = zero_missing(df).join(placed.hint("merge"), "row_id")
    folds = df.select(F.col("fold").alias("outer_fold")).distinct()
    seen = rows.filter("y = 1").join(F.broadcast(folds), F.col("outer_fold") != F.col("fold"))
    counts = seen.groupBy("outer_fold", "class_id", "i", "j").agg(F.count("*").cast("double").alias("n"))
    enough = counts.groupBy("outer_fold", "class_id").agg(F.sum("n").alias("_all")).filter("_all >= 2")
    density = blurred(counts.join(enough, ["outer_fold", "class_id"]).drop("_all"), ["outer_fold", "class_id"], sigma, grid)
    density = density.withColumnRenamed("outer_fold", "fold")
    enough = enough.select(F.col("outer_fold").alias("fold"), "class_id", F.lit(True).alias("_fit"))
    rows = rows.join(density, ["fold", "class_id", "i", "j"], "left").join(F.broadcast(enough), ["fold", "class_id"], "left")
    rows = normalised_rank(rows.withColumn("density", F.coalesce("density", F.lit(0.0))), ["fold", "class_id"], "density", "row_id")
    nudged = F.col("score") * (1 + strength * (2 * F.col("rank01") - 1))
    return rows.withColumn("score", F.when(F.col("_fit"), nudged).otherwise(F.col("score"))).drop("i", "j", "density", "_fit", "rank01")


def normalised_rank(df: DataFrame, keys: list[str], column: str, tie: str) -> DataFrame:
    """rank01, the place within keys over [0, 1], ties by tie."""
    out = placed(df, keys, [column, tie], "_place", "_size")
    return out.withColumn("rank01", F.col("_place") / F.greatest(F.col("_size") - 1, F.lit(1))).drop("_place", "_size")
