import pytest
from llm_helpers import rows
from llm_oracle import same

from tallywright.llm import line_dedup

BLANK = " \t\n\x0b\f\r"


def brute(docs):
    docs = [(r.doc_id, r.text or "") for r in docs.collect()]
    place = lambda d: float("inf") if d is None else d
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    first = {}
    for d, text in docs:
        for line in text.split("\n"):
            if len(k := key(line)) >= 10:
                first[k] = min(first.get(k, place(d)), place(d))
    out = []
    for d, text in docs:
        lines = text.split("\n")
        stay = [x for x in lines if not first.get(key(x), place(d)) < place(d)]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def held(docs, **more):
    got = line_dedup.dedup_lines(docs, **more)
    assert rows(got, "row.doc_id", "kept", "n_lines", "n_dropped") == brute(docs)
    return got


def test_same_as_sql(spark):
    assert same(spark, line_dedup.query, line_dedup.ORACLE) > 0


@pytest.mark.parametrize("batches", [1, 5])
def test_whole_table(small, batches):
    held(small, batches=batches)


def test_edges(edge, empty, clashing):
    held(edge)
    assert held(clashing, batches=2).select("row.*").columns == clashing.columns
    assert held(empty).count() == 0


def test_hot_line_and_ascii_case(spark):
    docs = [(i, f"the common line of all\nÉTÉ été étés {i % 3}\nown line number {i}\nshort") for i in range(200)]
    docs += [(500, "éTé été étés 1"), (501, "été été étés 1"), (502, "THE common LINE of all \x0b")]
    held(spark.createDataFrame(docs, "doc_id bigint, text string"), batches=3)


def test_many_rows_without_an_id(spark):
    docs = [(None, f"the common line of all\nown line number {i}\nthe common line of all") for i in range(300)] + [(4, "the common line of all"), (4, "Own line number 7")]
    held(spark.createDataFrame(docs, "doc_id bigint, text string"))


def test_a_failed_run_leaves_no_tables(spark, monkeypatch):
    before = spark.catalog.listTables()
    monkeypatch.setattr(line_dedup.Runs, "unseen", lambda self, df: 1 / 0 if self.held else df)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dedup_lines(spark.createDataFrame([(i, f"a line of some length {i}") for i in range(50)], "doc_id bigint, text string"))
    assert spark.catalog.listTables() == before
