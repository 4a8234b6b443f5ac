import duckdb
import pytest
from llm_helpers import EDGE, rows
from llm_oracle import same
from pyspark.sql import functions as F

from tallywright.llm import ranked_search as rs


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql_agrees(spark, sf):
    assert same(spark, rs.query, rs.ORACLE, f"/root/testdata/sf{sf}") > 0


ITEMS = [(1, "And a second line stands below it."), (2, None), (3, ""), (None, "ten words are one item Été"), (None, "nine"), (5, "nosuchterm"), (1, "token here"), (9, "hunter2hunter2 line \U0001f600")]


def tables(tmp_path, docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("CREATE TABLE i (item_id BIGINT, text VARCHAR)")
    if docs:
        con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", docs)
    con.executemany("INSERT INTO i VALUES (?, ?)", items)
    con.execute(f"COPY d TO '{tmp_path}/documents.parquet'; COPY i TO '{tmp_path}/benchmark.parquet'")
    return str(tmp_path)


def test_sql_agrees_on_edge_rows(spark, tmp_path):
    crowd = [(None, f"line {i % 7} stands below without an id", "en", "a", 1) for i in range(90)] + [(6, "a line that repeats", "en", "a", 1)] * 70
    d = tables(tmp_path, EDGE + crowd, ITEMS)
    assert same(spark, rs.query, rs.ORACLE, d, ["documents", "benchmark"]) > 100


def test_small_tops_and_blocks_agree(spark, tmp_path):
    """Blocks of items, thresholds that cut lists and ties at the kth place change nothing."""
    d = tables(tmp_path, EDGE + [(i, f"line {'stands ' * (i % 5)} below token {i % 3}", "en", "a", 1) for i in range(10, 60)], ITEMS)
    items, docs = spark.read.parquet(f"{d}/benchmark.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    whole = rs.ranked(items, docs, top=1000)
    for top, block in ((1, 10), (3, 4), (7, 1000)):
        want = rows(whole.filter(F.col("rank") <= top), "item_id", "rank", "doc_id", "score")
        assert rows(rs.ranked(items, docs, top, block), "item_id", "rank", "doc_id", "score") == want


def test_empty_tables_and_clashing_names(spark, clashing, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    more = items.select("*", *[F.lit(0).alias(n) for n in ("row", "term", "item", "score", "rank", "w", "q")])
    assert rs.ranked(more, empty).count() == 0 and rs.ranked(items.limit(0), clashing).count() == 0
    assert rs.ranked(more, clashing).columns == ["item_id", "rank", "doc_id", "score"]


def test_slices_cut_no_term(monkeypatch):
    text = "Aé-b_c 12 " * 50 + "x" * 90 + " ß\U0001f600ß"
    whole = rs.counted_terms(text)
    monkeypatch.setattr(rs, "SLICE", 7)
    assert rs.counted_terms(text) == whole and whole["aé".encode()] == 50 and whole["ß\U0001f600ß".encode()] == 1


def test_terms_of_every_document_weigh_nothing(spark, tmp_path):
    d = tables(tmp_path, [(i, f"zz line {i}", "en", "a", 1) for i in range(1100)], [(1, "zz 7 line"), (2, "zz")])
    assert same(spark, rs.query, rs.ORACLE, d, ["documents", "benchmark"]) == 1
