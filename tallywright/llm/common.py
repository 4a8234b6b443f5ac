"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and are stripped from lines.
SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\f\r"
WORD = f"[^{SPACE}]+"
#: Stands for a null doc_id where documents need an order: after every other.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; a local one only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/tallywright"
    return f"{top.rstrip('/')}/tw-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: lost executors can't take it away, and its lineage ends here."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables of the shared folder that no frame reads any more, through the folder's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; its cleaner works beside this."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def bounded_batches(spark: SparkSession, size: str = "4m", rows: int = 1000) -> None:
    """Makes Arrow batches small: texts are long, and a batch is held by the executor and its Python worker at once.

    The session keeps the setting, as frames are evaluated after the operator has returned; so every operator that sends
    texts to Python calls this, and none depends on what ran before it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_crc(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bits_for(rows: int, per_bucket: int, most: int = 20) -> int:
    """The number of hash bits that leaves about per_bucket rows in a bucket."""
    return min(most, max(0, math.ceil(math.log2(max(rows, 1) / per_bucket)))) if rows > per_bucket else 0
