"""Labels: multi-hot targets, vocabulary maps, keyed assembly of shards and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.scalar import gather, genus, index_list, label_list, list_literal
from tallywright.operators.metrics import beside, ordered_mean
from tallywright.sources.scratch import shared_folder


def multi_hot(rows: DataFrame, codes, classes: DataFrame, dense: bool = False) -> DataFrame:
    """row_id, class_id, y of the codes (an array column) that name a class; with dense, zeros too."""
    found = rows.select("row_id", F.explode(codes).alias("primary_label")).join(F.broadcast(classes.select("class_id", "primary_label")), "primary_label")
    found = found.select("row_id", "class_id", F.lit(1).alias("y")).distinct()
    if not dense:
        return found
    every = rows.select("row_id").distinct().crossJoin(F.broadcast(classes.select("class_id")))
    return every.join(found.hint("merge"), ["row_id", "class_id"], "left").select("row_id", "class_id", F.coalesce("y", F.lit(0)).alias("y"))


def primary_and_secondary(train: DataFrame, classes: DataFrame, dense: bool = False) -> DataFrame:
    codes = F.array_union(F.array("primary_label"), list_literal(F.col("secondary_labels")))
    return multi_hot(train, codes, classes, dense)


def window_labels(windows: DataFrame, classes: DataFrame, dense: bool = False) -> DataFrame:
    return multi_hot(windows, label_list(F.col("primary_label")), classes, dense)


def numbered(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Contiguous ids from 0 in an order that is stated; file order is never relied on.

    Rows are counted by range partition and numbered within it, so no task sorts the whole table. Spark draws the ranges
    from a sample, and another one each time it makes them, so the rows and their ranges are written to the shared folder
    once; the counts and the numbering read them there.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    path = f"{shared_folder(df.sparkSession)}/numbered"
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    inside = Window.partitionBy("_part").orderBy(*order)
    sizes = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", before.alias("_base"))  # a row for each partition
    return ranged.withColumn("_n", F.row_number().over(inside) - 1).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_n")).drop("_part", "_n", "_base")


def placed(df: DataFrame, keys: list[str], order: list[str], place: str, size: str) -> DataFrame:
    """Each row's place from 0 within keys, and the key's count of rows.

    Rows are numbered in the order of (keys, order), by range partitions that cut through keys and ties; a place is a number
    less the key's first.
    """
    known = numbered(df, "_at", [*keys, *order])
    ends = known.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count("*").alias(size))
    return beside(known, ends, keys).withColumn(place, F.col("_at") - F.col("_first")).drop("_at", "_first")


def factorized(df: DataFrame, column: str, row: str, name: str) -> DataFrame:
    """Codes from 0 in the order of first appearance by row."""
    first = df.groupBy(column).agg(F.min(row).alias("_first"))
    codes = first.withColumn(name, F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")
    codes = codes.withColumnRenamed(column, "_value")
    return df.join(codes, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def vocabulary_map(classes: DataFrame, vocabulary: DataFrame, none: str = "no_ebird_code") -> DataFrame:
    """Each class's indices in a vocabulary: by code, else by scientific name in lower case, else unmapped.

    vocabulary: idx, code, name. Returns class_id, stage (code, name, unmapped), idxs (sorted).
    """
    code = vocabulary.filter(F.col("code") != none).groupBy(F.col("code").alias("_c")).agg(F.sort_array(F.collect_list("idx")).alias("by_code"))
    name = vocabulary.groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.sort_array(F.collect_list("idx")).alias("by_name"))
    out = classes.join(F.broadcast(code), F.col("primary_label") == F.col("_c"), "left")
    out = out.join(F.broadcast(name), F.lower(F.trim("scientific_name")) == F.col("_n"), "left")
    stage = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "name").otherwise("unmapped")
    return out.select("class_id", stage.alias("stage"), F.coalesce("by_code", "by_name", F.array().cast("array<int>")).alias("idxs"))


def mapped_scores(heads: DataFrame, mapping: DataFrame, how: str = "max") -> DataFrame:
    """Class scores from a foundation model's head: row_id, class_id, score. heads: row_id, probs (array)."""
    every = heads.crossJoin(F.broadcast(mapping.select("class_id", "idxs")))
    return every.select("row_id", "class_id", gather(F.col("probs"), F.col("idxs"), how).alias("score"))


def parsed_map(raw: DataFrame) -> DataFrame:
    """A stored map's pipe-joined indices as arrays."""
    return raw.withColumn("idxs", index_list(F.col("idxs")))


def with_genus(classes: DataFrame) -> DataFrame:
    return classes.withColumn("genus", genus(F.col("scientific_name")))


def scattered(spine: DataFrame, shards: DataFrame) -> DataFrame:
    """Shards of row_id, class_id, score on the spine of all rows and classes; what no shard has stays NULL."""
    return spine.join(shards.select("row_id", "class_id", "score").hint("merge"), ["row_id", "class_id"], "left")


def seed_ensemble(shards: DataFrame) -> DataFrame:
    """The mean over seeds, ignoring missing ones, in the order of seeds: model, row_id, class_id, score."""
    return shards.groupBy("model", "row_id", "class_id").agg(ordered_mean("score", "seed").alias("score"))


def leave_one_seed_out(shards: DataFrame) -> DataFrame:
    """The ensemble without each seed: drop_seed, model, row_id, class_id, score.

    A row's seeds are gathered once, in their order, and not again for each seed that is left out.
    """
    seeds = F.broadcast(shards.select(F.col("seed").alias("drop_seed")).distinct())
    held = shards.groupBy("model", "row_id", "class_id").agg(F.sort_array(F.collect_list(F.struct("seed", "score"))).alias("_held"))
    rest = held.crossJoin(seeds).withColumn("_rest", F.filter("_held", lambda x: x["seed"] != F.col("drop_seed"))).filter(F.size("_rest") > 0)
    there = F.filter("_rest", lambda x: x["score"].isNotNull())
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x["score"]) / F.greatest(F.size(there), F.lit(1)))
    return rest.select("drop_seed", "model", "row_id", "class_id", mean.alias("score"))


def leakage(meta: DataFrame) -> DataFrame:
    """authors_in_many_folds, duplicated_files: both 0 if the split is clean. Counted from distinct pairs, not collected sets."""
    many = meta.groupBy("author").agg(F.countDistinct("fold").alias("n")).filter("n > 1").agg(F.count("*").alias("authors_in_many_folds"))
    again = meta.agg((F.count("*") - F.countDistinct("filename")).alias("duplicated_files"))
    return many.crossJoin(again)


def grouped_stratified_folds(labels: DataFrame, folds: int = 5) -> DataFrame:
    """A greedy author-grouped, label-stratified split: author, fold.

    labels: author, class_id, n. Authors go, the most uneven first, to the fold whose label counts they keep most even.
    The steps depend on one another, so one task walks over the authors' label counts; use author_splits beyond that.
    """
    import numpy as np
    import pandas as pd

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="author", columns="class_id", values="n", aggfunc="sum", fill_value=0).sort_index()
        counts, total = wide.to_numpy(float), wide.to_numpy(float).sum(axis=0)
        order = np.argsort(-counts.std(axis=1), kind="stable")
        held, out = np.zeros((folds, counts.shape[1])), np.zeros(len(wide), int)
        for a in order:
            trial = [np.mean(np.std((held + counts[a] * (np.arange(folds) == f)[:, None]) / np.maximum(total, 1), axis=0)) for f in range(folds)]
            out[a] = int(np.lexsort((held.sum(axis=1), np.round(trial, 12)))[0])
            held[out[a]] += counts[a]
        return pd.DataFrame({"author": wide.index, "fold": out})

    kind = labels.schema["author"].dataType.simpleString()
    return labels.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda p: assign(p), f"author {kind}, fold int")
