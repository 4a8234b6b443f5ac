import hashlib
import re

from llm_helpers import DOCS, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_oracle import same

from tallywright.llm import secrets
from tallywright.llm.trigrams import ANY, trigram_query

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PLAIN = {"access": (re.compile(r"AKIA[A-Z0-9]+"), 20), "hex": (re.compile(r"[0-9a-f]+"), 24)}


def base(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for k, (name, (p, n)) in enumerate(PLAIN.items(), 1):
        spans += [(m.start(), k, m.end(), name) for m in p.finditer(text) if len(m[0]) >= n]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def every(text):
    spans = [(m.start(), n, m.end(), r.kind) for n, r in enumerate(secrets.BASE + secrets.MORE) for m in re.finditer(r.pattern, text, re.A) if len(m[r.group]) >= r.least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def held(spark, docs, monkeypatch):
    monkeypatch.setattr(secrets, "table", lambda *_: docs)
    want = [(r.doc_id, every(r.text or ""), hashlib.sha256(base(r.text or "").encode()).hexdigest()) for r in docs.collect()]
    got = secrets.query(spark, "")
    assert rows(got, "doc_id", "spans", "base_sha256") == sorted(want, key=repr)
    return got


def test_whole_table(spark, small, monkeypatch):
    held(spark, small, monkeypatch)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert held(spark, docs, monkeypatch).filter("n_assign > 0").count() > 0


def test_same_as_sql(spark):
    assert same(spark, secrets.query, secrets.oracle(), "/root/testdata/sf0.01") > 0


def test_edges(spark, edge, empty, clashing, monkeypatch):
    held(spark, edge, monkeypatch)
    held(spark, clashing, monkeypatch)
    assert held(spark, empty, monkeypatch).count() == 0


def test_more_kinds(spark, monkeypatch):
    texts = [
        "-----BEGIN RSA PRIVATE KEY----- and é ghp_" + "a1B2" * 9,
        "xoxb-1234567890-ab sk_live_" + "x9" * 12 + " AIza" + "Zz09_" * 7,
        "eyJhbGciOiJI.eyJzdWIiOiIx.abc_-9 at ftp://me:secret1@host/",
        "token=" + "q" * 5 + " token='" + "q" * 6 + "' TOKEN : é token=\"a.b=c-d/e\"",
        "api_key=secret:abcdef123456 " * 50,
    ]
    got = held(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS), monkeypatch)
    seen = {s.split(":")[0] for r in got.collect() for s in r.spans.split(",")}
    assert {r.kind for r in secrets.MORE} <= seen


def holds(query, text):
    if query == ANY:
        return True
    return query[1] in text if query[0] == "tri" else (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_queries_never_lose_a_match(data):
    for rule in secrets.BASE + secrets.MORE:
        pattern = re.compile(rule.pattern, re.A)
        text = data.draw(st.from_regex(pattern))
        assert holds(trigram_query(rule.pattern), text.lower())


def test_only_hex_lacks_trigrams():
    assert [r.kind for r in secrets.BASE + secrets.MORE if trigram_query(r.pattern) == ANY] == ["hex"]
