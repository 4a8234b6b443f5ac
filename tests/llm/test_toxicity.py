import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import toxicity as tx


@pytest.mark.parametrize(("sf", "least"), [("0.01", 0.85), ("0.1", 0.95)])
def test_held_out_accuracy(spark, sf, least):
    d = f"/root/testdata/sf{sf}"
    got = tx.query(spark, d)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count() and len(rows) == labels.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = ([r.score for r in held if r.toxic == t] for t in (1, 0))
    auc = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert auc > least, auc
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.93


def plain_segments(values):
    """All maximal-scoring subsequences by their definition: the best run, then the same left and right of it."""
    if not values or max(values) <= 0:
        return []
    best, at = 0.0, None
    for a in range(len(values)):
        total = 0.0
        for b in range(a, len(values)):
            total += values[b]
            if total > best + 1e-12 or (at and abs(total - best) <= 1e-12 and b - a + 1 < at[1] - at[0]):
                best, at = total, (a, b + 1)
    a, b = at
    left = plain_segments(values[:a])
    right = [(s, x + b, y + b) for s, x, y in plain_segments(values[b:])]
    return [*left, (best, a, b), *right]


def test_passages_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(0, 40)
        values = [rng.choice([0.0, 0.0, 1.37, 2.61, -0.83, -1.92]) + rng.random() / 1000 for _ in range(n)]
        words = [chr(0x4E00 + k) for k in range(n)]  # every token once, so that no repeats are damped
        model = {w + "$": (5.0, v) for w, v in zip(words, values, strict=True)}
        got_n, got = tx.passages(tx.Worth(model), " ".join(words))
        assert got_n == n
        want = plain_segments([v - tx.DRIFT for v in values])
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_passages_of_slices_and_long_texts(monkeypatch):
    model = {"bad$": (9.0, 3.0), "good": (-5.0, -0.5)}
    text = ("fine goodness 7 words " * 40 + "BAD bad Bad ") * 30
    whole = tx.passages(tx.Worth(model), text)
    spans = tx.located(text, [(a, b, 0.0) for _, a, b in whole[1]])
    assert {text[s["start"] : s["end"]].split()[0].lower() for s in spans} == {"bad"}
    monkeypatch.setattr(tx, "SLICE", 50)
    monkeypatch.setattr(tx.slices, "__defaults__", (50,))
    again = tx.passages(tx.Worth(model), text)
    assert again[0] == whole[0] and np.allclose(again[1], whole[1])
    worst = "bad " + "fine " * 200_000  # linear in the text
    assert tx.passages(tx.Worth(model), worst * 2)[0] == 400_002


def test_law_is_recovered():
    """Maxima drawn from a known law give its rate and share back."""
    rng = np.random.default_rng(5)
    n = rng.integers(20, 4000, 4000).astype(float)
    best = (np.log(0.05 * n) + rng.gumbel(size=4000)) / 1.7
    law = tx.fitted_law(n, best)
    assert abs(law.rate - 1.7) < 0.35 and abs(np.log(law.share / 0.05)) < 1.2  # the trimmed tail makes it steeper
    curve = [law.surprise(100, [s]) for s in np.linspace(0, 20, 50)]
    assert all(a <= b for a, b in zip(curve, curve[1:])) and law.surprise(100, [8, 7, 6]) > law.surprise(100, [8]) and law.surprise(0, []) == 0


def test_edges(spark, edge, empty, clashing):
    kind = "doc_id bigint, quality int, toxic int"
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (5, 1, 1), (5, 1, 0), (None, 1, 1), (7, 0, 0), (0, 1, 1), (-4, 0, 0)], kind)
    got = tx.classify(clashing, marks)
    assert got.select("row.*").columns == clashing.columns and got.count() == clashing.count()
    key = lambda df: sorted(((r.row.doc_id, r.row.text, r.score, r.passages) for r in df.collect()), key=repr)
    assert key(got) == key(tx.classify(edge, marks))
    told = {r.row.doc_id: r.score for r in got.collect()}
    assert told[1] == told[2] == told[3] and all(0 <= s <= 1 for s in told.values())
    assert {r.score for r in tx.classify(edge, marks.limit(0)).collect()} == {0.5}
    assert all(r.score < 0.01 for r in tx.classify(edge, marks.withColumn("toxic", F.lit(0))).collect())
    assert tx.classify(empty, marks).count() == 0


def test_toxic_texts_are_caught_and_clean_ones_of_like_stems_left_alone(spark):
    """By the contract's own threshold, in every language: long clean texts have the shorter stems of toxic tokens too."""
    d = "/root/testdata/sf0.1"
    rows = tx.query(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    caught, left = ([r.predicted == t for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean(caught) > 0.85 and np.mean(left) > 0.95


def test_longest_stem_decides():
    worth = tx.Worth({"ba": (4.0, 1.0), "bad": (5.0, 2.0), "bade$": (1.0, 0.0)})
    assert [worth[w] for w in ("bat", "badly", "Bade", "fine")] == [1.0, 2.0, 0.0, 0.0]
