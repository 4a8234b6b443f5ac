"""Distributed logistic fits against the local solver, and the fitted queries against plain versions."""

import numpy as np
import pytest

from tallywright.plans import fixtures as fx
from tallywright.operators import fusion


def table(spark, seed=4, size=900, dims=3):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(size):
        cls, fold = int(draw.integers(0, 3)), int(draw.integers(0, 4))
        x = draw.normal(size=dims) * [1, 5, 0.2][:dims] + [0, 3, -1][:dims]
        y = int(draw.random() < 1 / (1 + np.exp(-(x[0] - 0.4 * x[1] + cls - 1))))
        rows.append((i, cls, fold, y if cls < 2 else 0, None if i % 31 == 0 else [float(v) for v in x]))
    return rows, spark.createDataFrame(rows, "row_id int, class_id int, fold int, y int, x array<double>")


def local(rows, cls, outer, balanced=False, scale=False):
    mine = [(y, x) for _, k, f, y, x in rows if k == cls and f != outer and x is not None]
    y, x = np.array([m[0] for m in mine], float), np.array([m[1] for m in mine])
    mean, std = (x.mean(axis=0), x.std(axis=0)) if scale else (0.0, np.ones(x.shape[1]))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else None
    b = fusion.newton((x - mean) / std, y, 1.0, weight)
    w = b[:-1] / std
    return np.append(w, b[-1] - (w * mean).sum())


@pytest.mark.parametrize("balanced", [False, True])
def test_nested_fits_equal_the_local_solver(spark, balanced):
    rows, df = table(spark)
    got = {(r.class_id, r.outer_fold): r.coef for r in fusion.fit_all(df, ["class_id"], True, balanced=balanced, scale=balanced).collect()}
    assert set(got) == {(c, f) for c in (0, 1) for f in range(4)}  # class 2 has no positive
    for (c, f), coef in got.items():
        assert np.allclose(coef, local(rows, c, f, balanced, balanced), rtol=0, atol=1e-8)


def test_fits_over_all_rows(spark):
    rows, df = table(spark, 9)
    got = {r.class_id: r.coef for r in fusion.fit_all(df, ["class_id"], False).collect()}
    assert set(got) == {0, 1}
    for c, coef in got.items():
        assert np.allclose(coef, local(rows, c, -1), rtol=0, atol=1e-8)


def test_no_fit_without_both_labels(spark):
    kinds = "row_id int, class_id int, fold int, y int, x array<double>"
    one = spark.createDataFrame([(i, 0, i % 2, 1, [float(i)]) for i in range(8)] + [(9, 1, 0, 1, None)], kinds)
    for df in (one, one.limit(0)):
        assert fusion.fit_all(df, ["class_id"], True).collect() == []
    out = fusion.linear_probe(one)
    assert out.count() == 9 and out.filter("score is not null").count() == 0


def test_separable_rows_and_a_constant_input(spark):
    kinds = "row_id int, class_id int, fold int, y int, x array<double>"
    rows = [(i, 0, i % 3, int(i >= 30), [float(i), 7.0]) for i in range(60)]
    got = {r.outer_fold: r.coef for r in fusion.fit_all(spark.createDataFrame(rows, kinds), ["class_id"], True, scale=True).collect()}
    assert set(got) == {0, 1, 2} and all(np.isfinite(c).all() and c[0] > 0 for c in got.values())


def scored(spark, seed, size=240):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(size):
        for cls in (0, 1):
            y = int(draw.random() < 0.4)
            for o, m in enumerate("ab"):
                score = None if (i, m) == (5, "b") else float(np.clip(0.3 * y + 0.6 * draw.random(), 0, 1))
                rows.append((i, cls, i % 3, i % 20, y, m, o, score))
    return rows, spark.createDataFrame(rows, "row_id int, class_id int, fold int, author int, y int, model string, ord int, score double")


def inputs(rows):
    """row_id, class_id to fold, y and the logits of both models, or None."""
    held = {}
    for i, cls, fold, _, y, m, _, score in rows:
        held.setdefault((i, cls), (fold, y, {}))[2][m] = score
    clip = lambda p: np.clip(p, 1e-6, 1 - 1e-6)
    return {k: (f, y, None if None in s.values() else [float(np.log(clip(s[m]) / (1 - clip(s[m])))) for m in "ab"]) for k, (f, y, s) in held.items()}


def fitted(known, cls, outer):
    mine = [(y, x) for (_, k), (f, y, x) in known.items() if k == cls and f != outer and x is not None]
    return fusion.newton(np.array([x for _, x in mine]), np.array([y for y, _ in mine], float))


def test_nested_fusion_equals_a_plain_version(spark):
    rows, df = scored(spark, 2)
    known = inputs(rows)
    got = {(r.row_id, r.class_id): r.score for r in fusion.nested_fusion(df, ["a", "b"]).collect()}
    coefs = {(c, f): fitted(known, c, f) for c in (0, 1) for f in range(3)}
    assert set(got) == set(known)
    for key, (fold, _, x) in known.items():
        want = None if x is None else 1 / (1 + np.exp(-(np.dot(coefs[key[1], fold][:-1], x) + coefs[key[1], fold][-1])))
        assert (got[key] is None) == (want is None) and (want is None or abs(got[key] - want) < 1e-9)


def test_frozen_fusion_equals_a_plain_version(spark):
    rows, source = scored(spark, 6)
    others, target = scored(spark, 7)
    known, there = inputs(rows), inputs(others)
    got = {(r.row_id, r.class_id): r.score for r in fusion.frozen_fusion(source, target, ["a", "b"]).collect()}
    coefs = {c: fitted(known, c, -1) for c in (0, 1)}
    for key, (_, _, x) in there.items():
        if x is not None:
            assert abs(got[key] - 1 / (1 + np.exp(-(np.dot(coefs[key[1]][:-1], x) + coefs[key[1]][-1])))) < 1e-9


def test_few_fits_deal_no_rows_and_many_do(spark, monkeypatch):
    """Rows of few fits are read as they were written; dealt by key, they give the same coefficients."""
    dealt = []
    deal = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: dealt.append(a) or deal(self, *a))
    rows = [(i % 3, i % 4, (i * 7919 % 13 + i % 3) % 2, [i * 31 % 17 / 17.0, i * 57 % 29 / 29.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "class_id int, fold int, y int, x array<double>").repartition(5)
    dealt.clear()
    few = {(r.class_id, r.outer_fold): r.coef for r in fusion.fit_all(df, ["class_id"], True).collect()}
    assert not dealt
    monkeypatch.setattr(fusion, "HELD_NUMBERS", 10)
    many = {(r.class_id, r.outer_fold): r.coef for r in fusion.fit_all(df, ["class_id"], True).collect()}
    assert dealt and few.keys() == many.keys() and len(few) == 12
    for key, coef in few.items():
        assert coef == pytest.approx(many[key], abs=1e-8)


def test_coefficients_are_broadcast(spark):
    rows = fusion.packed_logits(fx.packed(spark, "/root/testdata/sf0.001"), ["a", "b", "c"])
    coefs = spark.createDataFrame([(0, 0, [1.0, 1.0, 1.0, 0.0])], "class_id int, fold int, coef array<double>")
    plan = fusion.predicted(rows, coefs, ["fold", "class_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
