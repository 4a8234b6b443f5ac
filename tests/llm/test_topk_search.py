import math

import numpy as np
import pytest
from llm_helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_oracle import same

from tallywright.llm import topk_search as ts

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(data, modulus=100):
    good = []
    for i, v in data:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)))
    place = lambda i: (i is None, i)
    out = []
    for i, v in {x for x in good if x[0] is not None and x[0] % modulus == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w)), place(j), j) for j, w in good if j != i and len(w) == len(v)]
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(sorted(scores, key=lambda x: x[:2])[:10], 1)]
    return sorted(out, key=repr)


def test_same_as_sql(spark):
    assert same(spark, ts.query, ts.ORACLE) > 0


@pytest.mark.parametrize("block", [64, 8192])
def test_clusters_ties_and_edges(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5)) * 4
    data = [(i, (centres[i % 6] + rng.normal(size=5) * 0.05).tolist()) for i in range(900)]
    data += [(2000 + i, [1.0, 0.5, 0.0, -0.25, 0.125]) for i in range(100)]
    data += [(100, [1.0] * 5), (100, [1.0] * 5), (None, [2.0] * 5), (4000, None), (4100, []), (4200, [1.0, None, 0.0, 0.0, 0.0]), (4300, [math.nan] * 5), (4400, [math.inf] * 5), (4500, [1.0, 2.0]), (4501, [3.0, 1.0]), (-100, [0.0] * 5)]
    df = spark.createDataFrame(data, SCHEMA)
    columns = "query_id", "rank", "vec_id", "score"
    assert rows(ts.search(df, block=block, queries=3), *columns) == brute(data)
    assert ts.search(spark.createDataFrame([], SCHEMA)).count() == 0
    from pyspark.sql import functions as F

    more = df.select("*", *[F.lit("x").alias(n) for n in ("v", "dim", "block", "group", "score", "query")])
    assert rows(ts.search(more, block=block), *columns) == brute(data)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 400), st.integers(1, 60), st.floats(0.01, 3))
def test_dual_trees_are_exact(seed, points, queries, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 4)) * 300
    p = np.floor(centres[rng.integers(0, 5, points)] + rng.normal(size=(points, 4)) * 100 * spread).astype(np.int64)
    q = np.floor(centres[rng.integers(0, 5, queries)] + rng.normal(size=(queries, 4)) * 100 * spread).astype(np.int64)
    ids, qid = rng.permutation(points), np.arange(queries) + 10**6
    tree, nodes = ts.Tree.over(q, qid, qid, ts.QUERY_LEAF)
    assert sorted(tree.ids.tolist()) == qid.tolist() and tree.hi[0] == queries and tree.end[0] == len(nodes)
    half = points // 2  # two blocks, the second with the scores of the first carried along
    first, second = ts.Search(tree, 10), None
    if half:
        first.visit(ts.Tree.over(p[:half], ids[:half], ids[:half], ts.LEAF)[0])
    second = ts.Search(tree, 10, first.worst)
    second.visit(ts.Tree.over(p[half:], ids[half:], ids[half:], ts.LEAF)[0])
    for n in range(queries):
        both = np.concatenate([first.tops[n], second.tops[n]])
        both = both[np.lexsort((both[:, 1], -both[:, 0]))][:10]
        scores = p @ tree.points[n]
        order = np.lexsort((ids, -scores))[:10]
        assert both.tolist() == list(map(list, zip(scores[order].tolist(), ids[order].tolist())))


def clustered(rng, points, dims=16):
    centres = rng.normal(size=(40, dims)) * 1000
    return np.floor(centres[rng.integers(0, 40, points)] + rng.normal(size=(points, dims)) * 5).astype(np.int64)


def test_node_pairs_are_pruned():
    p = clustered(np.random.default_rng(2), 8000)
    ids = np.arange(8000)
    s = ts.Search(ts.Tree.over(p[:300], ids[:300], ids[:300], ts.QUERY_LEAF)[0], 10)
    s.visit(ts.Tree.over(p, ids, ids, ts.LEAF)[0])
    assert s.dropped > s.pairs / 3 and s.products < 300 * 8000 / 4


def test_blocks_are_pruned_on_clustered_data(spark):
    """Most pairs of a group and a block, and most products, are never formed; the result is that of brute force."""
    p = clustered(np.random.default_rng(3), 6000)
    df = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(p)], "vec_id bigint, embedding array<double>")
    found = ts.searched(df, modulus=20, block=200, queries=64)
    report = found["report"].first()
    assert report.products < 300 * 6000 / 20 and report.block_pairs < 100
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found["best"].collect()}
    assert len(got) == 3000
    for q in range(0, 6000, 20):
        scores = p @ p[q]
        scores[q] = -(1 << 62)
        order = np.lexsort((np.arange(6000), -scores))[:10]
        assert [got[q, n] for n in range(1, 11)] == list(zip(order.tolist(), scores[order].tolist()))


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, ([0.5] * 6 if i % 3 == 0 else rng.normal(size=6).tolist())) for i in range(1200)]
    got = rows(ts.search(spark.createDataFrame(data, SCHEMA), block=50, queries=2), "query_id", "rank", "vec_id", "score")
    assert got == brute(data)
