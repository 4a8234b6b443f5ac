"""Secret scans over a trigram inverted index, built of DataFrame functions only.

The index has a posting list for each block of documents and each trigram that the rules name: the sorted ids of the
block's documents that hold it. A rule's Boolean trigram query is answered within each block by intersecting and uniting
posting lists; only the documents it leaves are searched with the rule's pattern. Rules without a mandatory trigram (runs
of hex digits) search every text.

A block spans 4096 neighbouring ids, so no posting list grows with the table. An id only narrows the search: rows with one
id share an entry, whose texts are all searched. A row without an id goes by its text's hash, so that such rows are no hot
key. The named trigrams are looked up one by one: measured, that takes 3.2 s where one pass of a regular expression for all
of them takes 5.8 s.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import let, table
from tallywright.llm.trigrams import ANY, trigram_query, trigrams

BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group and least: a match counts only if this group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds, in their order. Runs are maximal, so the two bounds may stand in the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
#: Further kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login_url", r"[a-z]{3,8}://[^/\x20\x09-\x0D:@]{1,64}:[^/\x20\x09-\x0D:@]{3,64}@"),
)
SPAN = "array<struct<start:int,kind:int,end:int>>"


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64("text"))


def postings(docs: DataFrame, names: list[str]) -> DataFrame:
    """The index: block, trigram, ids (sorted), for the named trigrams."""
    low = docs.select(key_of().alias("key"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in names]))
    pairs = low.select("key", F.explode(held).alias("trigram"))
    pairs = pairs.withColumn("block", F.shiftright("key", 12))
    return pairs.groupBy("block", "trigram").agg(F.sort_array(F.collect_set("key")).alias("ids"))


def answer(query, lists: Column) -> Column:
    """The ids of a block that a query leaves; lists maps trigrams to ids."""
    if query[0] == "tri":
        return F.coalesce(F.try_element_at(lists, F.lit(query[1])), F.array().cast("array<bigint>"))
    parts = [answer(q, lists) for q in query[1]]
    out = parts[0]
    for part in parts[1:]:
        out = F.array_intersect(out, part) if query[0] == "and" else F.array_union(out, part)
    return out


def candidates(index: DataFrame, asked: dict[int, tuple]) -> DataFrame:
    """The documents that each query leaves: key and rules (their numbers)."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    found = F.array(*[F.struct(F.lit(n).alias("rule"), answer(q, F.col("lists")).alias("keys")) for n, q in asked.items()])
    found = lists.select(F.explode(found).alias("f")).select("f.rule", F.explode("f.keys").alias("key"))
    return found.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans_of(rule: Rule, number: int, text: Column) -> Column:
    """The spans of a rule's matches, leftmost and not overlapping, in code points with the end exclusive.

    The pieces between matches and the matches themselves alternate, so their lengths add up to the places.
    """
    pattern = F.lit(rule.pattern)
    long = lambda g: F.length(g) >= rule.least

    def places(pieces: Column) -> Column:
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), long)
        steps = F.arrays_zip(F.transform(pieces, lambda p: F.length(p)).alias("gap"), F.transform(matches, lambda m: F.length(m)).alias("len"), kept.alias("ok"))
        none = F.array().cast(SPAN)
        span = lambda a, s: F.struct((a["at"] + s["gap"]).alias("start"), F.lit(number).alias("kind"), (a["at"] + s["gap"] + s["len"]).alias("end"))
        return F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + F.coalesce(s["len"], F.lit(0))).alias("at"),
                F.when(s["ok"], F.concat(a["spans"], F.array(span(a, s)))).otherwise(a["spans"]).cast(SPAN).alias("spans"),
            ),
            lambda a: a["spans"],
        )

    return let(F.split(text, rule.pattern, -1), lambda p: F.when(F.size(p) > 1, places(p)).otherwise(F.array().cast(SPAN)))


def told(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda n: F.get(F.array(*[F.lit(k) for k in kinds]), n)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The spans of every document: doc_id, found, an array of (start, kind, end) by start, then kind in the rules' order.

    docs: doc_id, text; other columns are not read. A null text is empty. Repeated rows and ids give a row each, an
    empty table none.
    """
    asked = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY}
    rows = docs.select("doc_id", key_of().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if asked:
        index = postings(docs, sorted(set().union(*map(trigrams, asked.values()))))
        found = candidates(index, asked).hint("shuffle_hash")
        rows = rows.join(found, "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    wanted = lambda n: F.coalesce(F.array_contains("rules", n), F.lit(False)) if n in asked else F.lit(True)
    each = [F.when(wanted(n), spans_of(r, n, F.col("text"))).otherwise(F.array().cast(SPAN)) for n, r in enumerate(rules)]
    return rows.select("doc_id", F.sort_array(F.concat(*each)).alias("found"))


def query(spark, sf_dir) -> DataFrame:
    """Query op1: counts and digests of the spans of all documents."""
    rules = BASE + MORE
    kinds = [r.kind for r in rules]
    found = secret_spans(table(spark, sf_dir, "documents"), rules)
    count = lambda n: F.size(F.filter("found", lambda s: s["kind"] == n)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(told(base, kinds).cast("binary"), 256).alias("base_sha256"),
        told(F.col("found"), kinds).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = BASE + MORE) -> str:
    """DuckDB SQL of the query."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"SELECT rid, {n} AS n, '{r.kind}' AS kind, regexp_extract_all(text, {quoted(r.pattern)}) AS m, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS g, "
        f"string_split_regex(text, {quoted(r.pattern)}) AS s, {r.least} AS least FROM d"
        for n, r in enumerate(rules)
    ]
    told = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, n){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each_ AS (SELECT rid, n, kind, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT rid, n, kind, length(m[i]) AS size,
         list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM each_ WHERE length(g[i]) >= least),
k AS (SELECT rid, n, kind, CAST(start AS BIGINT) AS a, CAST(start + size AS BIGINT) AS b FROM spans)
SELECT doc_id, CAST(coalesce(sum(CASE WHEN n = 0 THEN 1 END), 0) AS BIGINT) AS n_assign, CAST(coalesce(sum(CASE WHEN n = 1 THEN 1 END), 0) AS BIGINT) AS n_access, CAST(coalesce(sum(CASE WHEN n = 2 THEN 1 END), 0) AS BIGINT) AS n_hex,
       sha256({told.format(" FILTER (WHERE n < 3)")}) AS base_sha256, {told.format("")} AS spans
FROM d LEFT JOIN k USING (rid) GROUP BY rid, doc_id
"""
