"""Incremental job: AUC boards that follow scores as they arrive.

Reads the files of a table of scores and truths that no earlier run has read (a file stream with a checkpoint, availableNow).
Each batch becomes counts: the positives and negatives of every part (a day), class, cluster and score, and nothing of it is
read again. A batch is a folder of the ledger by its number, so a batch that is retried replaces itself. From the ledger the
job makes again the boards of the parts that the run touched, and the board of all parts:

part (`all` for the board over everything), class_id, auc, pos, neg, rows, missing (rows without a score), clusters,
lead (the largest share of the positives that one cluster has).

Ledger and board hold counts, so they grow with distinct scores, not with how often the job runs over the same rows. A run
that finds nothing new changes nothing. Rows without a truth don't count; rows without part or class stand under `none`.

    python -m jobs.score_ledger --source <folder of Parquet files> --target <folder>
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, write_parts
from tallywright.operators.metrics import auc_of_counts

COUNTS = "part string, class_id string, cluster string, _s double, _p bigint, _n bigint"


def scored(rows: DataFrame, config: dict) -> DataFrame:
    """part, class_id, cluster, score and y of rows, by the config's SQL expressions."""
    named = {"part": "string", "class": "string", "cluster": "string", "score": "double", "truth": "boolean"}
    value = {k: F.expr(config[k]).cast(kind) for k, kind in named.items()}
    part, class_id = (F.coalesce(value[k], F.lit("none")) for k in ("part", "class"))
    score = F.when(~F.isnan(value["score"]), value["score"])  # NaN is no score
    out = rows.select(part.alias("part"), class_id.alias("class_id"), value["cluster"].alias("cluster"), score.alias("score"), value["truth"].cast("int").alias("y"))
    return out.filter("y is not null")


def counts_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "class_id", "cluster", F.col("score").alias("_s")).agg(F.sum("y").cast("long").alias("_p"), F.sum(1 - F.col("y")).cast("long").alias("_n"))


def board_of(counts: DataFrame) -> DataFrame:
    """The board of each part in counts."""
    keys = ["part", "class_id"]
    by_score = counts.groupBy(*keys, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    auc = auc_of_counts(by_score, keys)
    by_cluster = counts.groupBy(*keys, "cluster").agg(F.sum(F.when(F.col("_s").isNotNull(), F.col("_p"))).alias("_p"), F.sum(F.col("_p") + F.col("_n")).alias("_r"))
    shares = by_cluster.groupBy(*keys).agg(F.count("cluster").alias("clusters"), F.max("_p").alias("most"), F.sum("_r").cast("long").alias("rows"))
    lead = F.when(F.col("pos") > 0, F.col("most") / F.col("pos"))
    return auc.join(shares, keys).select(*keys, "auc", *[F.col(c).cast("long").alias(c) for c in ("pos", "neg", "rows", "missing", "clusters")], lead.alias("lead"))


def pattern(path: str) -> str:
    """The path as a pattern that fits it alone: file streams take a plain path for a folder, and a table may be one file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, target: str, config: dict) -> DataFrame:
    """Takes what is new in source into target/ledger and returns target/board as it then stands."""
    ledger = f"{target}/ledger"
    spark.createDataFrame([], COUNTS).write.mode("ignore").parquet(f"{ledger}/batch=-1")  # so that a ledger is there before the first batch
    taken: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        counts_of(scored(batch, config)).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        taken.append(number)

    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", int(config.get("files_per_batch", 1000))).parquet(pattern(source))
    stream = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    read = sum(p["numInputRows"] for p in stream.recentProgress)
    LOG.info("read %d new rows of %s in %d batches", read, source, len(taken))

    counts = spark.read.schema(f"{COUNTS}, batch int").parquet(ledger)
    board = f"{target}/board"
    stale = counts if not spark_has(spark, board) else touched(counts, board)
    whole = counts.withColumn("part", F.lit("all"))
    write_parts(board_of(stale.unionByName(whole)).withColumn("through", F.lit(counts.agg(F.max("batch")).first()[0])), board, "part")
    out = spark.read.schema(f"{BOARD}, through int, part string").parquet(board)
    LOG.info("wrote %d rows of boards to %s", out.count(), board)
    return out.drop("through")


BOARD = "class_id string, auc double, pos bigint, neg bigint, rows bigint, missing bigint, clusters bigint, lead double"


def touched(counts: DataFrame, board: str) -> DataFrame:
    """The counts of the parts that have a batch which their board doesn't have; also after a run that broke off between the two."""
    last = counts.sparkSession.read.schema(f"{BOARD}, through int, part string").parquet(board).filter("part <> 'all'").groupBy("part").agg(F.max("through").alias("through"))
    newest = counts.groupBy("part").agg(F.max("batch").alias("newest"))
    stale = newest.join(last, "part", "left").filter("through is null or newest > through").select("part")
    return counts.join(stale, "part", "left_semi")


def spark_has(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read the folder."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema("part string").parquet(path).limit(0).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


if __name__ == "__main__":
    command_line("score_ledger", __doc__, ["source", "target"], run)
