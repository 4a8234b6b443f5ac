"""Sinks: partitioned shards with resume, gated assembly, CSV, JSON and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions.scalar import hash_draw
from tallywright.schema import GateError, require_finite
from tallywright.sources.readers import MatrixSource


def write_shards(df: DataFrame, path: str, by: tuple[str, ...] = ("model", "seed", "fold")) -> None:
    """Replaces the partitions that df has, and no others; a partition is seen whole or not at all."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_npy(df: DataFrame, folder: str, classes: int, rows: int = 100_000) -> None:
    """row_id (from 0), class_id, score as dense float64 .npy shards of so many rows, row_<first row>.npy; NULL is NaN.

    Executors write the shards on the folder's own store; they are moved into place once all tasks have ended, and replace
    the folder's earlier shards. A task that fails, or writes twice, leaves no shard.
    """
    df.sparkSession.dataSource.register(MatrixSource)
    lot = F.floor(F.col("row_id") / rows)
    dealt = df.select(F.col("row_id").cast("bigint"), F.col("class_id").cast("int"), F.col("score").cast("double"))
    dealt = dealt.repartition(lot).sortWithinPartitions("row_id")
    dealt.write.format("npy").mode("overwrite").option("path", folder).option("classes", str(classes)).option("rows", str(rows)).save()


def mark_done(jobs: DataFrame, path: str) -> None:
    """Adds the keys of jobs to the flags beside the shards; called once their partitions are written."""
    jobs.distinct().write.mode("append").parquet(f"{path}-done")


def done(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The keys that are flagged as done, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-done")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{path}-done").select(*keys).distinct()


def pending(jobs: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """The jobs whose shards are not there yet."""
    return jobs if done is None else jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def assemble(spark: SparkSession, path: str, expected: DataFrame, keys: list[str]) -> DataFrame:
    """All shards, or an error that names what is missing; every score must be finite or NULL."""
    shards = spark.read.parquet(path)
    missing = expected.join(shards.select(*keys).distinct(), keys, "left_anti").limit(5).collect()
    if missing:
        raise GateError(f"missing shards: {missing}")
    return require_finite(shards, "score", path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame, digits: int | None = None) -> DataFrame:
    """One JSON text a row, doubles rounded half to even if asked."""
    if digits is not None:
        df = df.withColumns({c: F.bround(c, digits) for c, kind in df.dtypes if kind in ("double", "float")})
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_json(df: DataFrame, path: str, digits: int | None = None) -> None:
    as_json(df, digits).write.mode("overwrite").text(path)


def write_analysis(df: DataFrame, folder: str, name: str) -> DataFrame:
    """One table for each analysis, so that a crash loses no finished one; returns it as read back."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def validated(cache: DataFrame, fresh: DataFrame, keys: list[str], value: str, most: float = 1e-3, sample: int | None = None, seed: int = 0) -> DataFrame:
    """max_diff, ok and rows of a cache against freshly made values, of all keys or of a sample by hash."""
    if sample is not None:
        fresh = fresh.orderBy(hash_draw(seed, *[F.col(k) for k in keys]), *keys).limit(sample)
    both = fresh.join(cache.withColumnRenamed(value, "_cached"), keys)
    diff = F.max(F.abs(F.col(value) - F.col("_cached")))
    return both.agg(diff.alias("max_diff"), (diff <= most).alias("ok"), F.count("*").alias("rows"))


def row_text(df: DataFrame, columns: list[str], digits: int = 4) -> Column:
    """A markdown row of some columns; doubles with so many digits, NULL as a dash."""
    kinds = dict(df.dtypes)
    text = lambda c: F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")
    cells = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(text(c)) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def report(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Markdown rows: text."""
    return df.select(row_text(df, columns, digits).alias("text"))


def full_report(df: DataFrame, title: str, columns: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """A markdown table with its title, head and rows in order: line, text."""
    spark = df.sparkSession
    top = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    head = spark.createDataFrame(list(enumerate(top)), "line bigint, text string")
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint") + len(top) - 1  # a report's rows are few
    body = df.withColumn("_line", place)
    return head.unionByName(body.select(F.col("_line").alias("line"), row_text(body, columns, digits).alias("text")))


def disk_guard(path: str, most: float = 0.92) -> float:
    """The used share of a local disk; raises above most."""
    import shutil

    use = shutil.disk_usage(path)
    if (share := use.used / use.total) > most:
        raise GateError(f"{path} is {share:.0%} full")
    return share
