"""Ranks, quantiles, Kendall's tau, places and influence in two levels, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import labels, metrics, postproc, resample

NAN, INF = float("nan"), float("inf")


def plain_ranks(values):
    """Average ranks in the order NULL, numbers, NaN."""
    key = lambda v: (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v + 0.0)
    keys = [key(v) for v in values]
    return [sum(k < me for k in keys) + (sum(k == me for k in keys) + 1) / 2 for me in keys]


def test_average_rank_with_nulls_ties_and_signs(spark):
    draw = np.random.default_rng(3)
    values = [None, None, NAN, NAN, INF, -INF, 0.0, -0.0, 1e-320, 1e308, -1e308, 5.0, 5.0] + [float(x) for x in np.round(draw.normal(size=300), 2)]
    rows = [(i, i % 3 if i % 7 else None, v) for i, v in enumerate(values)]
    got = {r.i: r.r for r in metrics.average_rank(spark.createDataFrame(rows, "i int, k int, v double"), ["k"], "v", "r").collect()}
    assert len(got) == len(rows)
    for k in (None, 0, 1, 2):
        mine = [(i, v) for i, kk, v in rows if kk == k]
        assert [got[i] for i, _ in mine] == plain_ranks([v for _, v in mine])
    whole = {r.i: r.r for r in metrics.average_rank(spark.createDataFrame(rows, "i int, k int, v double"), [], "v", "r").collect()}
    assert [whole[i] for i, _, _ in rows] == plain_ranks(values)


def test_ranks_of_an_empty_table(spark):
    none = spark.createDataFrame([], "k int, v double, y int, score double, author int, row_id int")
    assert metrics.average_rank(none, ["k"], "v", "r").count() == 0
    assert metrics.quantiles(none, ["k"], "v", {"q": 0.5}).collect() == []
    assert [tuple(r) for r in metrics.quantiles(none, [], "v", {"q": 0.5}).collect()] == [(None,)]
    assert metrics.kendall(none, "v", "score").first().asDict() == {"tau": None, "pairs": 0}
    assert postproc.normalised_rank(none, ["k"], "v", "row_id").count() == 0
    assert resample.influence(none, "author", ["k"]).count() == 0


def test_no_range_of_values_is_a_whole_key(spark):
    df = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") / 100_000).alias("v"))
    sizes = [r[0] for r in df.groupBy(metrics.score_range(F.col("v"), metrics.FINE)).count().select("count").collect()]
    assert max(sizes) < 400
    plan = metrics.average_rank(df, ["k"], "v", "r")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_c" not in line or "_b" in line.split("],")[1] for line in windows)
    assert metrics.average_rank(df, ["k"], "v", "r").filter("r <> v * 100000 + 1 and abs(r - v * 100000 - 1) > 1e-6").count() == 0


def test_quantiles_equal_numpy(spark):
    draw = np.random.default_rng(5)
    rows = [(k, None if i % 11 == 0 else float(round(x, 1))) for k in range(4) for i, x in enumerate(draw.normal(size=[1, 2, 50, 333][k]))] + [(9, None)]
    shares = {"p0": 0.0, "p05": 0.05, "third": 1 / 3, "half": 0.5, "p975": 0.975, "p100": 1.0}
    got = {r.k: r for r in metrics.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", shares).collect()}
    for k in {k for k, _ in rows}:
        mine = [v for kk, v in rows if kk == k and v is not None]
        assert (k in got) == bool(mine)
        for name, share in shares.items() if mine else ():
            assert got[k][name] == pytest.approx(np.quantile(mine, share), abs=1e-12)


def plain_tau(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None]
    lead = sx = sy = 0
    for i, (x, y) in enumerate(rows):
        for u, v in rows[:i]:
            a, b = (x > u) - (x < u), (y > v) - (y < v)
            lead, sx, sy = lead + a * b, sx + abs(a), sy + abs(b)
    return lead / math.sqrt(sx * sy) if sx * sy else None


@pytest.mark.parametrize("size,step", [(1, 1), (2, 1), (7, 2), (150, 1), (150, 10), (150, 200)])
def test_kendall_equals_all_pairs(spark, size, step):
    draw = np.random.default_rng(size + step)
    rows = [(float(a // step), float((a + b) // step)) for a, b in draw.integers(-60, 60, (size, 2))] + [(None, 1.0), (1.0, None)]
    got = metrics.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    want = plain_tau(rows)
    assert got.pairs == size * (size - 1) // 2 and (got.tau is None) == (want is None)
    assert want is None or got.tau == pytest.approx(want, abs=1e-12)


def test_kendall_over_many_keys(spark):
    """10^5 keys are 5 * 10^9 pairs: tau of a permutation with a known count of inversions."""
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("x"), F.when(F.col("id") < n // 2, F.col("id") + n // 2).otherwise(F.col("id") - n // 2).alias("y"))
    got = metrics.kendall(df, "x", "y").first()
    pairs, inversions = n * (n - 1) // 2, (n // 2) ** 2
    assert got.pairs == pairs and got.tau == pytest.approx((pairs - 2 * inversions) / pairs, abs=1e-12)


def test_places_over_a_hot_tie(spark):
    rows = [(1, 0.0, i) for i in range(500)] + [(1, float(i), 1000 + i) for i in range(-5, 6)] + [(None, 1.0, 1), (2, 1.0, 1)]
    got = labels.placed(spark.createDataFrame(rows, "k int, v double, t int"), ["k"], ["v", "t"], "at", "size").collect()
    assert len(got) == len(rows)
    for k in (None, 1, 2):
        mine = sorted((v, t) for kk, v, t in rows if kk == k)
        assert sorted((r.at, r.v, r.t) for r in got if r.k == k) == [(i, *row) for i, row in enumerate(mine)]
        assert {r["size"] for r in got if r.k == k} == {len(mine)}


def test_influence_over_many_ranges(spark):
    draw = np.random.default_rng(8)
    rows = [(int(c), None if i % 17 == 0 else float(round(s, 2)), int(y), int(a)) for i, (c, s, y, a) in enumerate(zip(draw.integers(0, 2, 400), draw.normal(0, 3, 400), draw.integers(0, 2, 400), draw.integers(0, 9, 400) ** 2 // 9))]
    got = {(r.class_id, r.author): r.auc for r in resample.influence(spark.createDataFrame(rows, "class_id int, score double, y int, author int"), "author", ["class_id"]).collect()}
    assert got
    for (c, a), auc in got.items():
        pos = [s for cc, s, y, aa in rows if cc == c and aa != a and y and s is not None]
        neg = [s for cc, s, y, aa in rows if cc == c and aa != a and not y and s is not None]
        assert auc == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]), abs=1e-12)
