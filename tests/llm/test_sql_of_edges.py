"""The SQL of the operators over nulls, repeated ids and rows, ties and empty texts."""

import duckdb
import pytest
from llm_helpers import EDGE
from llm_oracle import same

from tallywright.llm import registry


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_line_dedup", "op6_quality_rules", "op10_mix_sources"])
def test_sql_agrees_on_edge_rows(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    more = [(5, "another text of the same id.\nAnd a second line stands below it.", "en", "b", 1)]
    more += [(None, f"line {i} of a row without an id\nAnd a second line stands below it.", "en", "a", 1) for i in range(30)]
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", [*EDGE, *more])
    con.execute(f"COPY d TO '{tmp_path}/documents.parquet'")
    assert same(spark, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path), ["documents"]) == len(EDGE) + len(more)
