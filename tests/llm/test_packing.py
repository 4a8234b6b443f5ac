import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallywright.llm import packing

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [0]


def held(docs):
    """Every id lies in one piece, pieces lie gapless in sequences, digests are right."""
    out = packing.pack_documents(docs, with_ids=True).collect()
    want = Counter((r.doc_id, tuple(ids_of(r.text))) for r in docs.collect())
    firsts = [r for r in out if r.start == 0]
    assert Counter((r.doc_id, r.doc_tokens) for r in firsts) == Counter((d, len(i)) for d, i in want.elements())
    groups = defaultdict(list)
    for r in out:
        groups[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for d, texts in {d: [i for e, i in want.elements() if e == d] for d, _ in want}.items():
        pieces = Counter((p.start, tuple(p.ids)) for p in groups[d])
        assert pieces == Counter((a, i[a : a + 1024]) for i in texts for a in range(0, len(i), 1024))
    ends = defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert all(n <= 1024 for n in ends.values())
    assert not ends or set(ends) == set(range(len(ends)))
    return ends


def test_little_padding(small):
    ends = held(small)
    assert 1024 * len(ends) < 1.02 * sum(ends.values())


def test_edges(edge, empty, clashing):
    held(edge)
    held(clashing)
    assert held(empty) == {}


def test_latin_ids_agree():
    encode = packing.encoder()
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c} ", f"{c}{c}1{c}x'{c}", f"\n{c}\t {c}  ", f"'s{c} 12{c}"):
            assert encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text() | st.text("ab é'\n\t1.<|endoftext>"))
def test_ids_agree(text):
    assert packing.encoder()(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_special_and_long_runs():
    for text in ("a<|endoftext|>b", "x" * 30_000, "é" * 3000 + " b"):
        assert packing.encoder()(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6)), st.integers(0, 30))
def test_fill_is_the_closest(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    used = packing.fill(dict(counts), room)
    assert sum(n * u for n, u in used.items()) == max(sums) and all(u <= counts[n] for n, u in used.items())


def test_plan_uses_every_piece():
    counts = {n: n * 7919 % 23 for n in range(1, 1025)}
    windows = packing.plan(counts)
    used = Counter()
    for window, times in windows:
        assert sum(n * u for n, u in window.items()) <= 1024
        for n, u in window.items():
            used[n] += u * times
    assert used == +Counter(counts)


def test_one_text_in_many_rows_without_an_id(spark):
    """Such rows are dealt over the buckets, not into one."""
    docs = spark.createDataFrame([(None, "the same text each time"), (3, "x")] * 2000, "doc_id bigint, text string")
    held(docs)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([None, 3, None], pa.int64()), "text": ["a", "b", "a b " * 1500]})] * 2
    out = [r for b in packing.cutter(1024, False)(iter(batches)) for r in b.to_pylist()]
    assert [(r["doc_id"], r["salt"]) for r in out if r["start"] == 0] == [(None, 0), (3, 0), (None, 2), (None, 3), (3, 0), (None, 5)]
