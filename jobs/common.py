"""What the jobs share: their command line and their log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("tallywright.jobs")


def config_of(job: str, path: str | None = None) -> dict:
    """The config file beside the job, or another, a file of the machine that starts the job."""
    return json.loads(Path(path or Path(__file__).with_name(f"{job}.json")).read_text())


def command_line(job: str, about: str, paths: list[str], run) -> None:
    """Parses the paths and the config file, creates the session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=about)
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help="a path that Spark reads or writes")
    parser.add_argument("--config", help="a config file instead of the job's own")
    told = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    config = config_of(job, told.pop("config"))
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config=config, **told)
    finally:
        spark.stop()


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
