"""Labels dealt as bits: the same positives as by a row for each row and replicate, which is what large tables can't afford."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.operators import dealt, draws, nulls, resample
from tallywright.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"
BY = ["fold", "class_id", "model", "ord"]


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # as text, so that NaN equals itself


def plainly(df, own, reps, seed):
    """A row for each row, replicate and label, joined with the scores."""
    rows = df.select("row_id", "author", "class_id", "y").distinct().groupBy("row_id", "author").agg(F.collect_set(F.when(F.col("y") == 1, F.col("class_id"))).alias("ys"))
    each = resample.permuted_within(rows, "author", "row_id", ["ys"], reps, seed).select("rep", "row_id", F.explode("ys").alias("class_id"))
    new = df.filter(own).select("row_id", *BY, F.col("score").alias("_s")).join(each.hint("merge"), ["row_id", "class_id"])
    return new.groupBy("rep", *BY, "_s").agg(F.count("*").alias("_p"))


def summed(df):
    return df.groupBy("rep", *BY, "_s").agg(F.sum("_p").alias("_p"))


def table(spark, sizes, classes, seed):
    """Authors of so many rows; a model without some rows, scores that are missing, a row twice, rows without labels."""
    rng, rows, row = random.Random(seed), [], 0
    for a, size in enumerate(sizes):
        for _ in range(size):
            row += 1
            on = rng.sample(range(classes), rng.choice((0, 1, 1, 2)))
            for k, m in enumerate("ab"):
                if m == "b" and rng.random() < 0.2:
                    continue
                for c in range(classes):
                    score = None if rng.random() < 0.05 else rng.choice((-0.5, 0.0, 0.25, float("nan"), rng.random()))
                    rows.append((row * 7919 % 100003, f"author {a}", a % 3 if a else None, c, m, k, int(c in on), score))
    rows += rows[:classes]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "row_id long, author string, fold int, class_id int, model string, ord int, y int, score double")


@pytest.mark.parametrize("gathered", [1, dealt.GATHERED])
def test_dealt_positives_are_those_of_joined_rows(spark, gathered):
    df = table(spark, [1, 1, 2, 3, 60, 17, 1, 140], 11, 3).repartition(5)
    for own in (F.lit(True), F.col("model") == "b"):
        got = summed(dealt.dealt_positives(df, BY, own, 5, 17, gathered=gathered))
        assert rows_of(got) == rows_of(plainly(df, own, 5, 17))


def test_a_large_author_meets_its_labels_in_turns(spark):
    df = table(spark, [9500, 3, 4097], 2, 5).filter("model = 'a'")
    got = summed(dealt.dealt_positives(df, BY, F.lit(True), 3, 17, held=1, gathered=5000))
    assert rows_of(got) == rows_of(plainly(df, F.lit(True), 3, 17))


def test_scores_that_hardly_tie(monkeypatch):
    """More sums than a task makes at a time: the replicates are made in turns, which changes no sum."""
    rng = np.random.default_rng(7)
    n, whole = 90, np.full(90, 90)

    def told():
        g = dealt.Gathered([0, 1, 1], 1, 70)
        g.labels = [labels]
        g.add([np.arange(n), whole, whole, 0 * whole, 0 * whole, whole, 3 + 0 * whole], np.tile(np.arange(3), n), scores)
        return sorted(tuple(r.values()) for batch in g.told() for r in batch.to_pylist())

    labels, scores = rng.integers(0, 4, (n, 1)).astype(np.uint8), pa.array(rng.random(3 * n).astype(np.float32))
    at_once = told()
    assert sum(r[3] for r in at_once) == 70 * (int((labels & 1).sum()) + 2 * int((labels >> 1).sum()))
    for name in ("SUMS", "DEALT"):
        monkeypatch.setattr(dealt, name, 1000)
        assert told() == at_once


def test_nothing_to_deal(spark):
    df = table(spark, [2], 2, 1).filter("row_id < 0")
    assert rows_of(dealt.dealt_positives(df, BY, F.lit(True), 2, 17)) == []


def test_images_are_those_of_single_places():
    rng = np.random.default_rng(3)
    reps = np.array([0, 3, 49, 999])
    for size in (np.full(300, 299), rng.integers(1, 5000, 300)):
        place, h = (rng.random(300) * size).astype(np.int64), np.full(300, 5) if size[0] == size[1] else rng.integers(0, draws.PRIME, 300)
        want = [draws.image(place, size, np.full(300, r), h) for r in reps]
        assert (draws.images(place, size, h, reps) == np.stack(want, axis=1)).all()


def test_no_row_is_shuffled_once_for_each_replicate(spark):
    text = nulls.permuted_counts(fx.scores(spark, SMALL, "ac"), 50, 17)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(_place|row_id)", text) and "ArrowEvalPython" not in text
