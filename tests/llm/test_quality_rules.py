import re
from collections import Counter

from llm_helpers import rows

from llm_oracle import same

from tallywright.llm.quality_rules import ORACLE, quality_rules, query

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return doc_id, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def held(docs):
    want = sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert rows(quality_rules(docs), *COLUMNS) == want


def test_base_counts_of_whole_tables(small):
    held(small)


def test_same_as_sql(spark):
    assert same(spark, query, ORACLE, "/root/testdata/sf0.01") > 0


def test_edges(edge, empty, clashing):
    held(edge)
    held(clashing)
    assert quality_rules(empty).count() == 0
    assert not [r for r in quality_rules(edge).collect() if r.base_failed and r.kept]


def test_line_first_verdict(spark):
    prose = [f"Line {i} tells of {'abcdefghij'[i]}{i} and {i * 7} more, in words that no other line{i} has." for i in range(10)]
    menu = "Home | About | Contact | Help | Shop"
    docs = spark.createDataFrame(
        [(1, "\n".join(prose[:5])), (2, "\n".join([*prose[:2], *[f"{menu} | x{i} y{i * 3}" for i in range(9)]])), (3, "\n".join([*prose[:4], menu]))],
        "doc_id bigint, text string",
    )
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert got[1].kept and not got[2].kept and got[3].kept
    assert "Home" not in got[3].cleaned and got[1].cleaned.count("\n") == 4


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    got = quality_rules(docs).join(labels, "doc_id").filter("not base_failed").selectExpr("avg(cast(kept as int))").first()[0]
    assert got > 0.99


def test_boilerplate_phrases_are_whole_words_of_short_lines(spark):
    lines = {
        "Log in or sign up to read the rest of it.": True,
        "Tous droits réservés par la maison.": True,
        "Datenschutzerklärung und mehr davon hier.": True,
        "A catalog in print and a blog in colour.": False,
        "Design up close, and the cookiecutter too.": False,
        "She gave each child a cookie, and the talk went on about the garden, the weather of that year, the harvest and the road to town.": False,
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r.doc_id: r.lost_chars > 0 for r in quality_rules(docs).collect()}
    assert got == {i: bad for i, bad in enumerate(lines.values())}
    only = quality_rules(docs, phrases={"xx": ("weather",)}).collect()
    assert not any(r.lost_chars for r in only)
