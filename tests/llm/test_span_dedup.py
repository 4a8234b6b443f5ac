import hashlib
import random

import pytest
from llm_helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import span_dedup as sd
from tallywright.llm.suffix_array import equal_windows, suffix_array


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=60).map(str.encode) | st.text("a", max_size=30).map(str.encode), st.integers(1, 4))
def test_suffix_array_is_the_sorted_one(text, times):
    text *= times
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    classes = {}
    for s in range(len(text) - 2):
        classes.setdefault(text[s : s + 3], []).append(s)
    assert [sorted(c) for c in equal_windows(text, list(range(len(text) - 2)), 3)] == [classes[k] for k in sorted(classes)]


def brute(docs):
    docs = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    place = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            first[w] = min(first.get(w, place(d)), place(d))
    out = []
    for d, t in docs:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < place(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(gone[i] and not gone[i + 1] for i in range(len(t)))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def held(docs, monkeypatch):
    monkeypatch.setattr(sd, "table", lambda *_: docs)
    assert rows(sd.query(docs.sparkSession, ""), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(docs)


def test_whole_table(spark, monkeypatch):
    held(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), monkeypatch)
    held(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), monkeypatch)


def test_edges(edge, empty, clashing, monkeypatch):
    held(edge, monkeypatch)
    held(empty, monkeypatch)
    out = sd.dedup_spans(clashing)
    assert out.select("row.*").columns == clashing.columns
    assert rows(out, "row.doc_id", "kept", "removed") == rows(sd.dedup_spans(edge), "row.doc_id", "kept", "removed")


@pytest.mark.parametrize("block", [1 << 8, 1 << 14])
def test_shifted_passages_and_runs(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [noise(n) for n in (49, 50, 51, 70, 120, 400)]
    docs = []
    for i in range(120):
        p = rng.choice(passages)
        cut = rng.randrange(len(p))
        docs.append((rng.randrange(90), noise(rng.randrange(60)) + p[:cut] + noise(rng.randrange(2)) + p[cut:] + noise(30) + rng.choice(passages)))
    docs += [(200, "x" * 300), (201, "y" + "x" * 120), (202, "xy" * 100), (203, "yx" * 100), (204, ""), (205, None)]
    held(spark.createDataFrame(docs, "doc_id bigint, text string"), monkeypatch)


def test_runs_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for _ in range(300):
        h = np.sort(rng.integers(0, 6, 20))
        doc = rng.integers(0, 3, 20)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        cuts = np.sort(rng.integers(0, 21, 5))
        batches = [pa.RecordBatch.from_pydict({"h": pa.array(a), "p1": pa.array(b), "known": pa.array([False] * len(a))}) for a, b in zip(np.split(h, cuts), np.split(doc, cuts))]
        got = [r for b in sd.shared_anchors(iter(batches)) for r in zip(b.column("h").to_pylist(), b.column("p1").to_pylist())]
        assert len(set(got)) == len(got) and set(got) == {(int(a), int(b)) for a, b in zip(h, doc) if len(set(doc[h == a])) > 1}


def test_contexts_over_batches():
    import pyarrow as pa

    rng = random.Random(7)
    base = bytes(rng.randrange(97, 123) for _ in range(200))
    rows_ = sorted({(rng.randrange(3), base[a : a + 60], 20, rng.randrange(6), 0, 0, a) for a in (rng.randrange(12) for _ in range(150))})

    def bytes_of(sizes):
        out, at = [], 0
        for n in sizes:
            h, context, anchor, doc, p1, p2, start = zip(*rows_[at : at + n], strict=True)
            out.append(pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "context": pa.array(context, pa.binary()), "anchor": pa.array(anchor, pa.int32()), "doc": pa.array(doc, pa.int64()), "p1": pa.array(p1, pa.int64()), "p2": pa.array(p2, pa.int64()), "start": pa.array(start, pa.int64())}))
            at += n
        got = [r for b in sd.covered(iter(out)) for r in b.to_pylist()]
        return {(r["doc"], i) for r in got for i in range(r["start"], r["end"])}

    whole = bytes_of([len(rows_)])
    assert whole and all(bytes_of([n] * (len(rows_) // n) + [len(rows_) % n] * bool(len(rows_) % n)) == whole for n in (1, 2, 3, 7))


def stretches(seed, units, docs, lengths, ends):
    """Documents of noise around stretches of one unit, some with a shared passage before or after."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passages = [noise(40) for _ in range(ends)]
    out = []
    for i in range(docs):
        unit, n = rng.choice(units), rng.choice(lengths)
        before, after = (rng.choice(passages) if ends else "" for _ in range(2))
        out.append((i, noise(30) + before + (unit * n)[:n] + after + noise(30)))
    return out


def levels(contexts, most):
    """The ranges of all levels, as dedup_spans has them, given what context_rows gave."""
    import pyarrow as pa

    order = [(n, "ascending") for n in ("h", "context", "anchor", "doc", "start")]
    for length, finer in ((sd.ANCHOR, sd.FINE), (sd.FINE, sd.WIDTH)):
        batches = pa.Table.from_batches(contexts).sort_by(order).combine_chunks().to_batches()
        contexts = []
        for b in sd.covered(iter(batches), length, finer, most):
            yield from (r for r in b.to_pylist() if r["end"] is not None)
            anew = b.filter(b.column("end").is_null())
            if anew.num_rows:
                start = anew.column("start").cast(pa.int32())
                contexts.append(pa.RecordBatch.from_pydict({n: anew.column(n) for n in ("h", "context", "anchor", "doc", "p1", "p2")} | {"start": start}))
        if not contexts:
            return
    least, last = {}, [r for b in contexts for r in b.to_pylist()]
    assert all(len(r["context"]) == sd.WIDTH for r in last)
    for r in last:
        least[r["context"]] = min(least.get(r["context"], r["doc"]), r["doc"])
    yield from (r | {"end": r["start"] + sd.WIDTH} for r in last if r["doc"] > least[r["context"]])


def covered_bytes(docs, most=sd.HELD, hot=False):
    """What the operator's Arrow functions cover, and what brute force does: two dicts of doc to byte places."""
    import pyarrow as pa

    ids, texts = pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])
    found = {}
    batch = pa.RecordBatch.from_pydict({"p1": ids, "text": texts})
    dealt = pa.Table.from_batches(sd.anchor_rows(batch.slice(a, 7) for a in range(0, len(docs), 7)))
    for h, d in zip(dealt["h"].to_pylist(), dealt["p1"].to_pylist()):
        found.setdefault(h, set()).add(d)
    assert all(len(found[h]) > 2 for h, known in zip(dealt["h"].to_pylist(), dealt["known"].to_pylist()) if known)
    kept = [r for b in sd.shared_anchors(iter(dealt.sort_by([("h", "ascending"), ("p1", "ascending")]).to_batches())) for r in zip(*b.to_pydict().values())]
    assert set(kept) == {(h, d) for h, own in found.items() if len(own) > 1 for d in own}
    lists = [[h for h, own in found.items() if len(own) > 1 and d in own] for d, _ in docs]
    batch = pa.RecordBatch.from_pydict({"doc": ids, "p1": ids, "p2": ids, "text": texts, "shared": pa.array(lists, pa.list_(pa.int64()))})
    contexts = list(sd.context_rows(batch.slice(a, 9) for a in range(0, len(docs), 9)))
    got, want, first = {d: set() for d, _ in docs}, {d: set() for d, _ in docs}, {}
    if contexts:
        if hot:  # every anchor counts as hot
            fine = pa.Table.from_batches(sd.refined(iter(contexts), sd.FINE)).sort_by([(n, "ascending") for n in ("h", "context", "anchor", "doc", "start")])
            found = [r for b in sd.covered(iter(fine.combine_chunks().to_batches()), sd.FINE, sd.WIDTH) for r in b.to_pylist()]
        else:
            found = levels(contexts, most)
        for r in found:
            got[r["doc"]].update(range(r["start"], r["end"]))
    for d, t in docs:
        for i in range(len(t) - 49):
            if first.setdefault(t[i : i + 50], d) < d:
                want[d].update(range(i, i + 50))
    return got, want


@pytest.mark.parametrize("unit", ["- ", "x", "=-+", "abcdefg", "lorem ipsum sit ", "a period of thirty-one letters "])
def test_pairs_with_repeating_stretches_of_other_lengths(unit):
    shared = "and here is the passage that both of them share."
    pairs = [[(1, "A first text. " + unit * 30 + shared), (2, "Some other start: " + unit * 22 + shared)]]
    pairs += [stretches(seed, [unit], 2, range(20, 120), 1) for seed in range(300)]
    for docs in pairs:
        got, want = covered_bytes(docs)
        assert got == want


@pytest.mark.parametrize("block", [1 << 8, 1 << 14, 1 << 24])
@pytest.mark.parametrize("unit", ["x", "/", "xy", "+-"])
def test_a_stretch_of_many_documents_below_and_above_the_block(monkeypatch, unit, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    for docs in (stretches(6, [unit], 100, [90], 0), stretches(6, [unit], 500, [90], 0), stretches(7, [unit, "- "], 200, range(1, 200), 3)):
        got, want = covered_bytes(docs)
        assert got == want


@st.composite
def periodic(draw):
    """A few documents of periodic pieces, cut anywhere, mixed with noise; some pieces stand in several documents."""
    letters = st.text("abcd", min_size=1, max_size=40)
    units = draw(st.lists(letters, min_size=1, max_size=3))
    seed = draw(st.integers(0, 1 << 30))
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passages = [noise(rng.randrange(20, 130)) for _ in range(2)]
    docs = []
    for i in range(rng.randrange(2, 7)):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            unit, kind = rng.choice(units), rng.randrange(4)
            at = rng.randrange(len(unit))
            text += noise(rng.randrange(40)) if kind == 0 else rng.choice(passages) if kind == 1 else (unit * 200)[at : at + rng.randrange(20, 150)]
        docs.append((i, text))
    return docs


@settings(max_examples=1500, deadline=None)
@given(periodic(), st.sampled_from([1 << 8, 1 << 10, sd.BLOCK]))
def test_periods_up_to_40_mixed_with_noise(docs, block):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sd, "BLOCK", block)
        got, want = covered_bytes(docs)
        assert got == want


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from([1 << 8, sd.BLOCK]))
def test_random_pieces_with_a_string_that_stands_twice(seed, block):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    twice = noise(20)
    pieces = [noise(rng.randrange(60, 400)) for _ in range(4)]
    pieces += [noise(40) + twice + noise(rng.randrange(12)) + twice + noise(40) for _ in range(2)]
    docs = []
    for i in range(12):
        whole = rng.choice(pieces)
        a = rng.randrange(0, 30)
        docs.append((i, noise(rng.randrange(50)) + whole[a:] + noise(rng.randrange(50)) + rng.choice(pieces)[: rng.randrange(40, 200)]))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sd, "BLOCK", block)
        got, want = covered_bytes(docs)
        assert got == want


def test_many_null_ids_and_copies(spark, monkeypatch):
    """Rows of a null id with different texts are one document; copies go whole, but for the smallest id's rows."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    shared, text = noise(80), noise(200)
    docs = [(None, noise(40) + (shared if i % 3 == 0 else "") + noise(40)) for i in range(300)]
    docs += [(i, text) for i in range(10, 60)] + [(10, text), (11, text), (None, text), (None, text)]
    docs += [(5, text[:120]), (70, noise(30) + shared + noise(20)), (71, "é" * 24), (72, "é" * 24 + "x" * 3), (73, "é" * 25), (74, "é" * 25)]
    held(spark.createDataFrame(docs, "doc_id bigint, text string"), monkeypatch)


def test_an_anchor_of_many_texts_is_no_hot_key():
    """A batch sends two rows of an anchor that all its texts hold, and one of equal contexts, to be dealt by hash."""
    import pyarrow as pa

    passage = "a passage that stands in every one of the documents, word for word, from its first to its last letter. "
    texts = [f"own start {i}: " + passage * 2 for i in range(200)]
    ids = pa.array(range(200), pa.int64())
    dealt = pa.Table.from_batches(sd.anchor_rows(iter([pa.RecordBatch.from_pydict({"p1": ids, "text": pa.array(texts)})]))).to_pandas()
    assert dealt[~dealt.known].groupby("h").size().max() == 2 and dealt.groupby("h").size().max() == 200
    shared = [dealt[dealt.p1 == i].h.tolist() for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc": ids, "p1": ids, "p2": ids, "text": pa.array(texts), "shared": pa.array(shared, pa.list_(pa.int64()))})
    contexts = pa.Table.from_batches(sd.context_rows(iter([batch]))).to_pandas()
    sent = contexts[contexts.context.notna()]
    assert (sent.groupby(["h", "context"]).doc.nunique() == 1).all() and contexts.context.isna().sum() > 1000


@settings(max_examples=400, deadline=None)
@given(periodic() | st.builds(stretches, st.integers(0, 99), st.just(["x", "ab", "lorem ipsum sit "]), st.just(30), st.just(range(1, 150)), st.just(2)), st.integers(1, 5), st.booleans())
def test_contexts_dealt_anew(docs, most, hot):
    got, want = covered_bytes(docs, most, hot)
    assert got == want


@pytest.mark.parametrize("hot, most", [(8, 1 << 14), (1 << 16, 3), (8, 3)])
def test_hot_anchors_of_a_table(spark, monkeypatch, hot, most):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "HELD", most)
    held(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), monkeypatch)


def test_memory_of_an_anchor_with_many_contexts():
    """A phrase of 24 bytes with 80 000 different surroundings: little is held, and its contexts go to many keys."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n, phrase = np.random.default_rng(1), 80_000, b"a phrase of 24 bytes in "
    noise = rng.integers(97, 123, (n, 60), np.uint8).tobytes()
    contexts = sorted(noise[i : i + 28] + phrase + noise[i + 28 : i + 56] for i in range(0, 60 * n, 60))

    def batches():
        for a in range(0, n, 1000):
            own = contexts[a : a + 1000]
            columns = {"h": pa.array([5] * len(own), pa.int64()), "context": pa.array(own, pa.binary()), "anchor": pa.array([28] * len(own), pa.int32())}
            columns |= {k: pa.array(range(a, a + len(own)), pa.int64()) for k in ("doc", "p1", "p2")}
            yield pa.RecordBatch.from_pydict(columns | {"start": pa.array([0] * len(own), pa.int32())})

    tracemalloc.start()
    keys, rows_ = set(), 0
    for b in sd.covered(batches()):
        keys.update(b.column("h").to_pylist()[:50])
        rows_ += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows_ > n and len(keys) > 1000 and peak < 150 << 20


def test_anchors_sort_as_one_number():
    """The low bits of an anchor's hash are those of its text's digest; texts that agree in these may stand in any order."""
    import numpy as np
    import pyarrow as pa

    text = pa.array(["one line of words that is long enough to have windows, and some more of them"] * 2)
    dealt = pa.Table.from_batches(sd.anchor_rows(iter([pa.RecordBatch.from_pydict({"p1": pa.array([1, 2]), "text": text})])))
    h = dealt.column("h").to_numpy()
    assert len(h) and not (h & ~sd.KEPT).any()
    rng = np.random.default_rng(1)
    for _ in range(100):
        h, doc = np.sort(rng.integers(0, 6, 20)), rng.integers(0, 3, 20)
        cuts = np.sort(rng.integers(0, 21, 5))
        batches = [pa.RecordBatch.from_pydict({"h": pa.array(a), "p1": pa.array(b), "known": pa.array([False] * len(a))}) for a, b in zip(np.split(h, cuts), np.split(doc, cuts))]
        got = {r for b in sd.shared_anchors(iter(batches)) for r in zip(b.column("h").to_pylist(), b.column("p1").to_pylist())}
        assert got == {(int(a), int(b)) for a, b in zip(h, doc) if len(set(doc[h == a])) > 1}
