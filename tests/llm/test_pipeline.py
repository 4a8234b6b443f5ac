import sys
from collections import Counter
from pathlib import Path

import pytest
import test_line_dedup
import test_near_dedup
import test_packing
from llm_helpers import DOCS

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402

from tallywright.llm import mixing  # noqa: E402


def test_stages_against_plain_versions(spark):
    """Each stage, on the rows that the stage before it kept."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for (name, stage), given in zip(cp.STAGES, range(5), strict=True):
        out = stage(spark, docs, sf_dir)
        if given < 4:
            assert out.columns == names, name
            out = spark.createDataFrame(out.collect(), docs.schema)
        if name == "language_id":
            assert out.count() == docs.filter("text rlike '\\\\p{L}'").count()
        elif name == "line_dedup":
            want = {(d, kept) for d, kept, n, gone in test_line_dedup.brute(docs) if not gone or kept.strip()}
            assert {(r.doc_id, r.text) for r in out.collect()} == want
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dedup":
            assert {r.doc_id for r in out.collect()} == {c for _, c in test_near_dedup.brute(docs)}
            assert out.count() == len({c for _, c in test_near_dedup.brute(docs)})
        elif name == "mix_sources":
            taken = mixing.mix_sources(docs)["taken"].collect()
            want = Counter({r.doc_id: int(r.taken / r["size"] + 0.5) for r in taken if r["size"]})
            assert Counter(r.doc_id for r in out.collect()) == +want
        else:
            sizes = Counter((r.doc_id, len(test_packing.ids_of(r.text))) for r in docs.collect())
            assert Counter((r.doc_id, r.doc_tokens) for r in out.collect() if r.start == 0) == sizes
        docs = out


@pytest.mark.parametrize("which", ["edge", "empty", "clashing"])
def test_edges(spark, request, which):
    docs = request.getfixturevalue(which)
    names = docs.columns
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = cp.STAGES[4][1](spark, docs, "")
    assert (out.count() == 0) == (which == "empty")


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    assert DOCS
