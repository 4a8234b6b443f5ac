import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import DOCS, rows
from pyspark.sql import functions as F

from tallywright.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    docs = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for _, w in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * (k := len(x & y)) >= 4 * (len(x) + len(y) - k):
                top[find(i)] = find(j)
    place = lambda d: float("inf") if d is None else d
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min((d, low.get(find(i), d)), key=place)
    return sorted(((d, low[find(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def held(docs):
    assert rows(nd.near_duplicates(docs), "doc_id", "class_id") == brute(docs)


def test_whole_table(spark):
    held(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_edges(edge, empty, clashing):
    held(edge)
    held(clashing)
    assert nd.near_duplicates(empty).count() == 0
    kept = nd.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([1, 2, 3, None, 5, 7, 8, 9, 0, -4], key=repr)
    assert nd.one_of_each(empty).count() == 0


def test_chains_and_large_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(300)]
    docs, text = [], list(base)
    for i in range(60):  # a chain: neighbours are similar, ends are not
        text = [rng.choice(words) if rng.random() < 0.02 else w for w in text]
        docs.append((100 + i, " ".join(text)))
    for i in range(150):  # near copies of one text, many of them not of one another
        docs.append((1000 + i, " ".join(rng.choice(words) if rng.random() < 0.018 else w for w in base)))
    docs += [(5000 + i, docs[70][1]) for i in range(30)]
    held(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS))


def test_blocks_of_large_buckets(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9000)]
    base = [rng.choice(words) for _ in range(120)]
    docs = [(i, " ".join(rng.choice(words) if rng.random() < 0.035 else w for w in base)) for i in range(160)]
    monkeypatch.setattr(nd, "FEW", 4)
    monkeypatch.setattr(nd, "BLOCK", 4000)
    held(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS))


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    wa, wb = rng.integers(1, 9, 40).astype(float), rng.integers(1, 9, 40).astype(float)
    wa[:8], wb[-8:] = 0, 0
    want = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(40) if wa[i] and wb[i])
    agree = []
    for k in range(60):
        e = nd.mixed(np.arange(40, dtype=np.uint64) + np.uint64(1000 * k))
        ia, ib = np.flatnonzero(wa), np.flatnonzero(wb)
        s = nd.probminhash(np.repeat([0, 1], [len(ia), len(ib)]), np.concatenate([e[ia], e[ib]]), np.concatenate([wa[ia], wb[ib]]), 2)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - want) < 0.02


def test_bands_do_not_depend_on_how_often_shingles_stand():
    """500 shared shingles, 100 of them 50 times in one version: 25 bands miss 5e-5 of such pairs at a Jaccard of 0.8."""
    rng = random.Random(11)
    for own, most in ((0, 0), (55, 2)):  # a Jaccard of about 1 and of about 0.8
        texts, pairs = [], 300
        for _ in range(pairs):
            base = [f"w{rng.randrange(10**6)}" for _ in range(504)]
            ends = [[f"w{rng.randrange(10**6)}" for _ in range(own)] for _ in range(2)]
            texts += [" ".join(base + ends[0]), " ".join(base[:104] * 50 + base + ends[1])]
        batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(texts))), "fp": pa.array([str(i).encode() for i in range(len(texts))]), "text": pa.array(texts)})
        bands = [set(x) for b in nd.signed(iter([batch])) for x in b.column("bands").to_pylist()]
        assert sum(bands[2 * i].isdisjoint(bands[2 * i + 1]) for i in range(pairs)) <= most


@pytest.mark.parametrize("times", [5, 20, 100])
def test_recall_where_one_version_repeats_half_of_its_passages(times):
    """Pairs of a set Jaccard of 0.8 to 0.87 of which one repeats half of the shingles: all but 5e-5 meet in a band."""
    rng, texts = random.Random(times), []
    for _ in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        own = rng.randint(14, 22)
        ends = [[f"w{rng.randrange(10**6)}" for _ in range(own)] for _ in range(2)]
        texts += [" ".join(base + ends[0]), " ".join(base[:104] * times + base + ends[1])]
    found = nd.shingles(texts, nd.WordHashes())
    alike = [len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in zip(found[::2], found[1::2], strict=True)]
    assert min(alike) >= 0.79
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(texts))), "fp": pa.array([str(i).encode() for i in range(len(texts))]), "text": pa.array(texts)})
    bands = [set(x) for b in nd.signed(iter([batch])) for x in b.column("bands").to_pylist()]
    met = [not bands[2 * i].isdisjoint(bands[2 * i + 1]) for i in range(len(texts) // 2) if alike[i] >= 0.8]
    assert len(met) > 50 and np.mean(met) >= 0.99


def test_large_buckets_of_short_texts(spark):
    """6000 texts of 8 shingles in one bucket: blocks are bounded by members, every link between components is found."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 60, 8) for _ in range(1500)]
    sets = [np.unique(np.concatenate([base[i % 1500][:7], rng.integers(0, 1 << 60, 1)]) if i >= 1500 and i % 3 else base[i % 1500]) for i in range(6000)]
    frame = spark.createDataFrame([(i.to_bytes(4, "big"), s.tolist()) for i, s in enumerate(sets)], "fp binary, shingles array<bigint>")
    open_ = frame.selectExpr("1 AS band", "fp", "fp AS root", "6000L AS members", "48000L AS total")
    sizes = open_.select(F.ceil(F.greatest(F.col("total") / nd.BLOCK, F.col("members") / nd.MEMBERS)).alias("n")).first().n
    assert sizes == 6
    top = list(range(6000))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in nd.links_of_blocks(open_, frame).collect():
        a, b = int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")
        k = len(np.intersect1d(sets[a], sets[b]))
        assert 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k)
        top[find(a)] = find(b)
    of = [find(i) for i in range(6000)]
    by = {}
    for i, s in enumerate(sets):
        by.setdefault(tuple(s.tolist()), []).append(of[i])
    assert all(len(set(x)) == 1 for x in by.values())  # equal sets are linked, at the least
    assert len(set(of)) < 6000


def test_memory_of_a_full_block():
    import tracemalloc

    n = 2 * nd.MEMBERS
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 4000, 2 * nd.BLOCK // n).tolist() for _ in range(n)]
    block = pa.table({"fp": [i.to_bytes(4, "big") for i in range(n)], "root": [b"r"] * n, "shingles": pa.array(sets, pa.list_(pa.int64()))})
    tracemalloc.start()
    assert nd.linked(block).num_rows == 0
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
