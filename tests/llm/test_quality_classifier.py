import zlib

import numpy as np

from tallywright.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = qc.query(spark, d).cache()
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95, auc
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93


def test_scores_are_the_plain_convolution():
    rng = np.random.default_rng(0)
    net = qc.Network(rng.normal(size=(8, 256, 16)), rng.normal(size=16), rng.normal(size=32), 0.3)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 120, 121, 127, 128, 129, 256, 257, 1000)]
    got = qc.score(net, net.pairs(), texts)
    for text, s in zip(texts, got, strict=True):
        padded = text + bytes(8)
        r = [sum(net.taps[k][padded[i + k]] for k in range(8)) for i in range(len(text))] or [np.full(16, -1e9)]
        n = max(1, -(-len(text) // 128))
        chunks = [np.maximum(np.max(r[128 * j : 128 * j + 256], axis=0) + net.bias, 0) for j in range(max(1, n - 1))]
        want = 1 / (1 + np.exp(-(np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ net.weights + net.offset)))
        assert abs(want - s) < 1e-4


def test_edges(spark, edge, empty, clashing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (5, 1, 0), (5, 1, 0), (None, 1, 1), (7, 0, 0), (0, 1, 0), (-4, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = qc.classify(clashing, marks)
    assert got.select("row.*").columns == clashing.columns and got.count() == clashing.count()
    key = lambda rows: sorted(((r.row.doc_id, r.row.text, r.score) for r in rows), key=repr)
    assert key(got.collect()) == key(qc.classify(edge, marks).collect())
    told = {r.row.doc_id: r.score for r in got.collect()}
    assert told[1] == told[2] and all(0 <= s <= 1 for s in told.values())
    assert {r.score for r in qc.classify(edge, none).collect()} == {0.5}
    assert qc.classify(empty, marks).count() == 0


def test_sample_takes_whole_texts_up_to_its_bounds(spark):
    docs = spark.createDataFrame([(i, f"{i} " * (10 + 997 * i)) for i in range(40)] + [(3, "again"), (3, "again")], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    whole = {(r.doc_id, r.text.encode()) for r in docs.collect()}
    texts, labels, _ = qc.sample(docs, marks, most=8)
    assert all(any(t == text for _, text in whole) for t in texts) and 0 < len(texts) <= 16 and set(labels) == {0.0, 1.0}
    assert len(set(texts)) == len(texts)
    few, labels, _ = qc.sample(docs, marks, most=8, size=1)  # the first of each class reaches the bound
    assert len(few) == 2 and set(labels) == {0.0, 1.0} and set(few) <= set(texts)


def test_memory_of_a_very_long_text():
    import tracemalloc

    net = qc.train([], np.zeros(0), np.zeros(0))
    pairs, text = net.pairs(), b"a line of text. " * (1 << 20)
    tracemalloc.start()
    score = qc.score(net, pairs, [text])
    assert tracemalloc.get_traced_memory()[1] < 6 * len(text) and 0 <= score[0] <= 1
    tracemalloc.stop()
