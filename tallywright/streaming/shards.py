"""An extension beyond the batch audit: score shards that arrive over time are appended once, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.schema import SCORES


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of score shards."""
    return spark.readStream.schema(SCORES).parquet(folder)


def append_new(stream: DataFrame, target: str, checkpoint: str):
    """Adds arriving shards to a table partitioned by batch and model; a batch that is retried replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["row_id", "class_id", "model"]).write.mode("overwrite").partitionBy("model").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
