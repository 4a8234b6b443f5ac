import re
from collections import Counter

import pyarrow.parquet as pq
from llm_helpers import rows
from llm_oracle import same
from pyspark.sql import functions as F

from tallywright.llm import mixing


def test_same_as_sql(spark):
    assert same(spark, mixing.query, mixing.ORACLE) > 0


def test_edges(spark, edge, empty, clashing):
    got = mixing.mix_sources(edge, block=64)["taken"]
    assert got.count() == edge.count()
    columns = "doc_id", "size", "source_size", "target", "taken"
    assert rows(got, *columns) == rows(mixing.mix_sources(clashing, block=64)["taken"], *columns)
    assert all(r.taken <= 3 * r.size for r in got.collect())
    sums = {r.src: (r.t, r.w) for r in got.groupBy("src").agg({"taken": "sum", "target": "max"}).toDF("src", "t", "w").collect()}
    assert all(abs(t - w) <= 0.5 for t, w in sums.values())
    assert mixing.mix_sources(empty)["taken"].count() == 0
    assert mixing.mixed_documents(empty).columns == empty.columns


def test_slots_follow_the_weights(small):
    mix = mixing.mix_sources(small, block=16)
    share = {r.src: r.words for r in mix["targets"].collect()}
    slots = [r.src for r in mix["slots"].orderBy("slot").collect()]
    total, half = sum(share.values()), Counter(slots[: len(slots) // 2])
    assert len(set((r.src, r["rank"]) for r in mix["slots"].collect())) == len(slots)
    assert all(abs(half[s] - len(slots) / 2 * w / total) < 12 for s, w in share.items())


def test_mixed_documents(spark, clashing):
    taken = mixing.mix_sources(clashing, block=8)["taken"].collect()
    out = mixing.mixed_documents(clashing, block=8)
    assert out.columns == clashing.columns
    want = Counter()
    for r in taken:
        if r["size"]:
            want[r.doc_id] += int(r.taken / r["size"] + 0.5)
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_the_mix_is_in_the_order_of_the_schedule(spark, small, tmp_path):
    """Every prefix of the emitted documents, read back in the order of their files, holds the sources near their weights."""
    targets = {r.source: r.words for r in mixing.mix_sources(small, block=64)["targets"].collect()}
    mixing.mixed_documents(small, block=64).write.parquet(f"file://{tmp_path}/mix")
    got = []
    for part in sorted((tmp_path / "mix").glob("part-*.parquet")):
        got += [(r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in pq.read_table(part).to_pylist()]
    total, longest = sum(targets.values()), max(n for _, n in got)
    done, sums, apart = 0, Counter(), 0
    for source, n in got:
        done += n
        sums[source] += n
        apart = max(apart, *(abs(sums[s] - done * w / total) for s, w in targets.items()))
    shuffled = sorted(got, key=repr)  # source after source, for comparison
    far, done, sums = 0, 0, Counter()
    for source, n in shuffled:
        done += n
        sums[source] += n
        far = max(far, *(abs(sums[s] - done * w / total) for s, w in targets.items()))
    assert apart < longest + 64 * 12 < far, (apart, longest, far)


def test_first_slot_is_that_of_the_first_block(small):
    mix = mixing.mix_sources(small, block=64)
    slot = {(r.src, r["rank"]): r.slot for r in mix["slots"].collect()}
    for r in mix["taken"].collect():
        assert r.first_slot == (slot[r.src, r.start // 64] if r.taken else None)


def test_rows_without_an_id_are_no_hot_key(spark):
    """Dealt by their texts, they spread over the ranges of keys as rows with ids do."""
    docs = spark.range(100_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('text number ', id) AS text", "'s' AS source")
    keys = mixing.sized(docs, "mix").groupBy(F.substring("key", 1, 2)).count()  # buckets are ranges of keys
    sizes = sorted(r["count"] for r in keys.collect())
    assert len(sizes) == 256 and sizes[-1] < 3 * sizes[len(sizes) // 2]
