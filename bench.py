"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tallywright.operators import metrics, nulls, postproc, resample, select, shift  # noqa: E402
from tallywright.plans import fixtures as fx  # noqa: E402
from tallywright.plans import metric_queries as mq  # noqa: E402
from tallywright.plans import stat_queries as sq  # noqa: E402


CLUSTERS = 4000


def clustered(spark, sf_dir, models="ac"):
    """Scores and their rows with 4000 clusters, as many as the audit's authors."""
    author = (F.col("row_id") * 2654435761 % 1000003 % CLUSTERS).alias("author")
    return fx.scores(spark, sf_dir, models).withColumn("author", author), fx.base(spark, sf_dir).select("row_id", author)


def bootstrap(reps):
    def run(spark, sf_dir):
        sc, rows = clustered(spark, sf_dir)
        per = resample.replicate_auc(sc, rows, "author", ["model", "class_id"], reps, 11)
        return metrics.summary(resample.paired_deltas(per, "a", ["c"]), "delta")

    return run


def permutations(spark, sf_dir):
    return metrics.null_summary(nulls.label_permutation(sq.cands(spark, sf_dir, "ac"), 50, 17), "headroom")


def mmd(spark, sf_dir):
    e = fx.vectors(spark, sf_dir).withColumn("side", F.col("row_id") % 2)
    return shift.mmd2(e.filter("side = 0"), e.filter("side = 1"), "row_id", "embedding", 0.01, 1500)


def postprocessed(spark, sf_dir):
    """Every knob's macro AUC on the common mask, beside that of the scores it starts from."""
    sc = fx.scores(spark, sf_dir, "a")
    knobs = {
        "none": postproc.zero_missing(sc),
        "genus": postproc.genus_smoothing(sc, mq.genera(spark)),
        "taxon": postproc.taxon_gate(sc, mq.taxa(spark)),
        "spatial": postproc.spatial_prior(sc, mq.coords(spark, sf_dir)),
    }
    frames = [f.select("row_id", "class_id", "y", "score", F.lit(n).alias("model")) for n, f in knobs.items()]
    every = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    return metrics.macro_auc(every, metrics.evaluable(every))


QUERIES = {
    "auc_and_mask": lambda s, d: metrics.macro_auc(sc := fx.scores(s, d), metrics.evaluable(sc)),
    "heldout_selector": sq.heldout_headroom,
    "all_cells": lambda s, d: select.heldout_headroom(sq.cell_frame(s, d), ("cell",)),
    "bootstrap_200": bootstrap(200),
    "bootstrap_1000": bootstrap(1000),
    "label_permutation_50": permutations,
    "nested_fusion": sq.Q["x8_nested_fusion"],
    "leave_one_author_out": sq.Q["x27_leave_one_author_out"],
    "post_processing": postprocessed,
    "mmd2_1500": mmd,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spent = {}
    for name, query in QUERIES.items():
        start = time.time()
        query(spark, sf_dir).collect()
        spent[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
