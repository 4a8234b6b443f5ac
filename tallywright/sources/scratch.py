"""A folder that driver and executors share, and files put there through its own file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; a local one only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/tallywright"
    return f"{top.rstrip('/')}/tw-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one file through the path's own file system: first beside it, then renamed, so that it is seen whole or not at all."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(bytearray(content))
    out.close()
    files.delete(where, False)
    if not files.rename(part, where):
        raise OSError(f"cannot rename to {path}")
