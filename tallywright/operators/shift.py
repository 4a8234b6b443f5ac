"""Domain shift: per-class drops, matched gaps, embedding distances and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.scalar import hash_draw
from tallywright.functions.tails import correlation_tail
from tallywright.operators.metrics import auc, average_rank


def domain_auc(df: DataFrame, missing: str = "kill") -> DataFrame:
    """class_id, auc in one domain. missing: "kill" drops classes with a missing score, "skip" leaves those rows out, "zero" counts them as 0."""
    if missing == "zero":
        df = df.withColumn("score", F.coalesce("score", F.lit(0.0)))
    if missing == "kill":
        full = df.groupBy("class_id").agg((F.count("*") == F.count("score")).alias("_full")).filter("_full")
        df = df.join(F.broadcast(full.select("class_id")), "class_id", "left_semi")
    return auc(df, ["class_id"]).filter("auc is not null").select("class_id", "auc", "pos")


def drops(source: DataFrame, target: DataFrame, missing: str = "kill") -> DataFrame:
    """class_id, source_auc, target_auc and drop over the classes common to both domains."""
    a = domain_auc(source, missing).select("class_id", F.col("auc").alias("source_auc"))
    b = domain_auc(target, missing).select("class_id", F.col("auc").alias("target_auc"))
    return a.join(b, "class_id").withColumn("drop", F.col("source_auc") - F.col("target_auc"))


def matched_gap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two models' drops: each on its own classes, and both on their common ones: native_one, native_two, matched_one, matched_two, gap, classes."""
    own = one.agg(F.avg("drop").alias("native_one")).crossJoin(two.agg(F.avg("drop").alias("native_two")))
    both = one.select("class_id", F.col("drop").alias("a")).join(two.select("class_id", F.col("drop").alias("b")), "class_id")
    return own.crossJoin(both.agg(F.avg("a").alias("matched_one"), F.avg("b").alias("matched_two"), F.count("*").alias("classes"))).withColumn("gap", F.col("matched_two") - F.col("matched_one"))


def moments(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean and standard deviation (ddof 0) of each dimension."""
    long = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def moment_shift(df: DataFrame, domain: str, vector: str, a, b) -> DataFrame:
    """L2 of the gap of means, and the ratio of mean standard deviations, between two domains."""
    m = moments(df, [domain], vector)
    one = m.filter(F.col(domain) == a).select("dim", F.col("mean").alias("ma"), F.col("std").alias("sa"))
    two = m.filter(F.col(domain) == b).select("dim", F.col("mean").alias("mb"), F.col("std").alias("sb"))
    gap = F.col("ma") - F.col("mb")
    return one.join(two, "dim").agg(F.sqrt(F.sum(gap * gap)).alias("l2"), (F.avg("sb") / F.avg("sa")).alias("std_ratio"))


def centroid_distance(df: DataFrame, domain: str, label: str, vector: str, a, b) -> DataFrame:
    """label, l2 between the label's mean vectors in two domains."""
    m = moments(df, [domain, label], vector)
    one = m.filter(F.col(domain) == a).select(label, "dim", F.col("mean").alias("ma"))
    two = m.filter(F.col(domain) == b).select(label, "dim", F.col("mean").alias("mb"))
    gap = F.col("ma") - F.col("mb")
    return one.join(two, [label, "dim"]).groupBy(label).agg(F.sqrt(F.sum(gap * gap)).alias("l2"))


def sampled(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """Exactly most rows (all, if fewer), by hash; sorted by key."""
    return df.orderBy(hash_draw(seed, F.col(key)), key).limit(most).orderBy(key)


def held(sample: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys and vectors of a sample, whose size is bounded by what it was drawn with."""
    rows = sample.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).toArrow()
    return rows.column("k").to_numpy(), np.array(rows.column("v").to_pylist(), np.float64).reshape(rows.num_rows, -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)


def pair_distances(df: DataFrame, key: str, vector: str, most: int = 2000, seed: int = 0) -> DataFrame:
    """k1, k2, d2: squared distances of a sample's pairs; the sample bounds the pairs, which is what the statistic is defined on.

    The sample is held by every task, which multiplies its rows by all of it in blocks.
    """
    s = sampled(df, key, most, seed)
    keys, matrix = held(s, key, vector)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("k").to_numpy()
            x = np.array(batch.column("v").to_pylist(), np.float64).reshape(len(ids), -1)
            for a in range(0, len(ids), 256):
                d2 = distances(x[a : a + 256], matrix)
                i, j = np.nonzero(ids[a : a + 256, None] < keys[None])
                yield pa.RecordBatch.from_pydict({"k1": pa.array(ids[a + i]), "k2": pa.array(keys[j]), "d2": pa.array(d2[i, j])})

    rows = s.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).repartition(8)
    return rows.mapInArrow(run, f"k1 {kind}, k2 {kind}, d2 double")


def median_gamma(df: DataFrame, key: str, vector: str, most: int = 2000, seed: int = 0) -> DataFrame:
    return pair_distances(df, key, vector, most, seed).agg((1 / (F.percentile("d2", F.lit(0.5)) + 1e-12)).alias("gamma"))


def mmd2(a: DataFrame, b: DataFrame, key: str, vector: str, gamma: float, most: int = 1500, seed: int = 0) -> DataFrame:
    """The unbiased squared MMD of two samples under exp(-gamma d^2).

    Both samples are held by every task; rows are multiplied by them in blocks, and only sums are kept.
    """
    s, t = sampled(a, key, most, seed), sampled(b, key, most, seed)
    _, x = held(s, key, vector)
    _, y = held(t, key, vector)
    own = lambda f, side: f.select(F.lit(side).alias("side"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = batch.column("side").to_numpy()
            v = np.array(batch.column("v").to_pylist(), np.float64).reshape(len(side), -1)
            k = [float(np.exp(-gamma * distances(v[side == n], m)).sum()) for n, m in ((0, x), (1, y), (0, y))]
            yield pa.RecordBatch.from_pydict({n: pa.array([value]) for n, value in zip(("aa", "bb", "ab"), k, strict=True)})

    sums = own(s, 0).unionByName(own(t, 1)).repartition(8).mapInArrow(run, "aa double, bb double, ab double").agg(*[F.sum(c).alias(c) for c in ("aa", "bb", "ab")])
    n, m = float(len(x)), float(len(y))
    within = lambda c, size: (F.col(c) - size) / (size * (size - 1)) if size > 1 else F.lit(None).cast("double")
    return sums.select((within("aa", n) + within("bb", m) - 2 * F.col("ab") / (n * m) if n and m else F.lit(None).cast("double")).alias("mmd2"))


def drop_rollup(df: DataFrame, value: str = "drop") -> DataFrame:
    """Drops by taxon, by stage and in all: taxon, stage, n, mean, median."""
    return df.groupingSets([["taxon"], ["stage"], []], "taxon", "stage").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median")
    )


def coverage(df: DataFrame) -> DataFrame:
    """Mapped and unmapped classes by class_name and in all. df: class_name, stage."""
    hit = F.col("stage") != "unmapped"
    return df.rollup("class_name").agg(F.sum(hit.cast("int")).alias("mapped"), F.sum((~hit).cast("int")).alias("unmapped"), F.count("*").alias("classes"))


def coverage_ceiling(df: DataFrame) -> DataFrame:
    """(mapped + unmapped / 2) / all over evaluable classes. df: evaluable, mapped (booleans)."""
    m = F.sum((F.col("evaluable") & F.col("mapped")).cast("int"))
    u = F.sum((F.col("evaluable") & ~F.col("mapped")).cast("int"))
    return df.agg(m.alias("mapped"), u.alias("unmapped"), ((m + 0.5 * u) / (m + u)).alias("ceiling"))


def predictors(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Pearson and Spearman of each predictor with the target and their p-values, the strongest first: predictor, pearson,
    pearson_p, spearman, spearman_p, n."""
    long = df.select(F.col(target).alias("t"), F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), F.col(n).cast("double").alias("x")) for n in names])).alias("e"))
    long = long.select("t", "e.predictor", "e.x").filter("x is not null and t is not null")
    ranked = average_rank(average_rank(long, ["predictor"], "x", "rx"), ["predictor"], "t", "rt")
    out = ranked.groupBy("predictor").agg(F.corr("x", "t").alias("pearson"), F.corr("rx", "rt").alias("spearman"), F.count("*").alias("n"))
    out = out.withColumns({"pearson_p": correlation_tail("pearson", "n"), "spearman_p": correlation_tail("spearman", "n")})
    return out.orderBy(F.abs("spearman").desc(), "predictor")


def pseudo_labels(df: DataFrame, k: int = 2) -> DataFrame:
    """The k highest scored classes of each row, ties to the smaller class; missing scores are never taken."""
    from pyspark.sql import Window

    order = Window.partitionBy("row_id").orderBy(F.col("score").desc_nulls_last(), "class_id")
    return df.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & F.col("score").isNotNull())


def covered_classes(df: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """How many distinct classes the top k of all rows cover, for each k."""
    top = pseudo_labels(df, max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rank <= k")
    return top.groupBy("k").agg(F.countDistinct("class_id").alias("classes"))


def window_grid(files: DataFrame, starts: list[int], length: int = 5) -> DataFrame:
    """A row for each file and start: filename, start_sec, end_sec."""
    every = files.select("filename", F.explode(F.array(*map(F.lit, starts))).alias("start_sec"))
    return every.withColumn("end_sec", F.col("start_sec") + length)
