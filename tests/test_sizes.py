"""What must hold for tables far above those of the tests: what is broadcast, shuffled and sorted, read off the plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobs import fold_audit
from tallywright.operators import fusion, labels, metrics, nulls, postproc, select
from tallywright.plans import fixtures as fx
from tallywright.plans import metric_queries as mq

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_are_merged_and_not_broadcast(spark):
    """Rows made by explode() are many times what Spark estimates, so a join of two such sides must not be left to it."""
    pair = mq.model_pair(spark, SMALL)
    assert "BroadcastHashJoin" not in plan(pair)
    assert "BroadcastHashJoin" not in plan(metrics.average_rank(pair, ["class_id"], "x", "r"))


def test_choices_are_broadcast_and_not_rows(spark):
    df = metrics.candidates(fx.packed(spark, SMALL))
    for chosen in (select.heldout(df)[0], select.in_sample(df)[0]):
        text = plan(chosen)
        assert "BuildRight" in text and "BuildLeft" not in text


def test_rank_auc_holds_no_class(spark):
    text = plan(metrics.rank_auc(fx.scores(spark, SMALL), ["model", "class_id"]))
    assert "rank(score" not in text and "_b#" in text


def test_candidates_need_no_shuffle_and_equal_the_means_of_rows(spark):
    packed = metrics.candidates(fx.packed(spark, SMALL))
    assert "Exchange" not in plan(packed)
    rows = metrics.with_mean(fx.scores(spark, SMALL))
    assert rows_of(packed.select(rows.columns)) == rows_of(rows)


def test_logits_side_by_side(spark):
    packed = fusion.packed_logits(fx.packed(spark, SMALL), ["c", "a", "b"])
    assert "Exchange" not in plan(packed)
    assert rows_of(packed) == rows_of(fusion.wide_logits(fx.scores(spark, SMALL), ["c", "a", "b"]))


@pytest.mark.parametrize("policy", ["kill", "pairwise"])
def test_selection_takes_folds_out(spark, policy):
    """The closed form against the AUC of the other folds' rows, with ties of 32-bit floats, gaps and a model without a fold."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        y, fold = int(rng.random() < 0.3), rng.randrange(4)
        for k, m in enumerate("abc"):
            s = None if m == "b" and i % 97 == 0 else rng.choice([rng.random(), 0.25, -0.5, 0.25 + 1e-12])
            if m != "c" or fold != 3:
                rows.append((i, i % 2, y, fold, m, k, s))
    df = spark.createDataFrame(rows, "row_id int, class_id int, y int, fold int, model string, ord int, score double")
    got = select.selection(df, policy=policy)
    outer = select.other_folds(df)
    if policy == "pairwise":
        whole = outer.groupBy("outer_fold", "row_id", "class_id").agg((F.count("*") == F.count("score")).alias("w")).filter("w").drop("w")
        outer = outer.join(whole, ["outer_fold", "row_id", "class_id"], "left_semi")
        named = df.join(df.groupBy("row_id").agg((F.count("*") == F.count("score")).alias("w")), "row_id")
        assert rows_of(select.selection(named, policy=policy, whole="w")) == rows_of(got)
    by = ["outer_fold", "class_id", "model", "ord"]
    want = metrics.auc_of_counts(metrics.counted(outer, by, single=True), by)
    want = want.select(*by, F.when(F.col("missing") == 0, F.col("auc")).alias("auc"), "pos")
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_gate_sorts_once(spark):
    text = plan(postproc.taxon_gate(fx.scores(spark, SMALL, "b"), mq.taxa(spark)))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_seeds_are_gathered_once(spark):
    shards = mq.seeds(spark, SMALL)
    again = shards.filter("seed <> 43").groupBy("model", "row_id", "class_id").agg(metrics.ordered_mean("score", "seed").alias("score"))
    got = labels.leave_one_seed_out(shards)
    assert rows_of(got.filter("drop_seed = 43").drop("drop_seed")) == rows_of(again)
    assert not re.search(r"hashpartitioning\(drop_seed#\d+, model", plan(got))


def test_audit_reads_texts_once(spark):
    rows = fold_audit.once(fold_audit.keyed(spark.read.parquet(f"{SMALL}/documents.parquet"), "source"))
    assert "text_key" in rows.columns and "regexp_replace" not in plan(rows)


def test_nulls_draw_once(spark):
    """The counts of all replicates are read back, not drawn for the selection, the oracle and the singles anew."""
    df = fx.scores(spark, SMALL, "ac")
    for null in (nulls.noise_null(df, "a", 2, 23, keep_best=True), nulls.prediction_permutation(df, "c", 2, 19)):
        text = plan(null)
        assert "md5" not in text and "ArrowEvalPython" not in text and re.search(r"Scan parquet \[rep#", text)


def test_counts_of_one_score_may_lie_in_rows(spark):
    """Noise is not summed by score first: equal draws in rows of their own give what their sum gives."""
    rng = random.Random(7)
    rows = [(rep, fold, 0, m, k, rng.randrange(6) / 5, y, 1 - y) for rep in (0, 1) for fold in range(3) for k, m in enumerate(("a", "noise")) for y in (0, 1, 0, 1, 0)]
    own = spark.createDataFrame(rows, "rep long, fold int, class_id int, model string, ord int, _s double, _p long, _n long")
    summed = own.groupBy("rep", "fold", "class_id", "model", "ord", "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    assert rows_of(nulls._headrooms(own, own)) == rows_of(nulls._headrooms(summed, own))
