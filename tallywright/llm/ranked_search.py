"""Ranked lexical search by TPUT, the three-phase uniform threshold, over postings partitioned by term.

Each text's terms that some item asks for are counted once; a term's postings are dealt by the term and a part of its rows
(so that a frequent term is no hot key), best first. For every item of m terms that weigh anything:

1. The heads of its lists, k postings each, give partial scores; of the documents that lead by these, the exact scores are
   looked up, and the kth highest is a lower bound of the kth best score.
2. A document that reaches the bound has a term that brings at least an m-th of it. Every list gives its postings at or
   above that threshold. Their partial scores give a better bound; what a document can still gain is bounded by its
   missing terms' thresholds and maxima, and documents that can't reach the bound go.
3. The candidates' postings are looked up, and the exact scores are ranked.

Between phases postings travel by document, not as pairs of item and document: a bucket of documents meets all items of
the block in one matrix, so that a posting is shuffled once however many items ask for its term.

Nothing is cut: ties with the kth score stay candidates, and where fewer than k documents are seen the threshold is zero.
Items are taken in blocks, so that the terms that every task looks up are bounded; the usual number of blocks is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import LAST_ID, bounded_batches, discard, shared_folder, table, written

#: Terms as runs of UTF-8 bytes: ASCII digits and letters, and all that is not ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TOP = 50
#: Pairs of item and term in a block: what is broadcast and sent to the tasks is bounded by it.
BLOCK = 200_000
#: A term's rows are dealt in so many parts.
PARTS = 64
#: Rows of documents whose postings a task holds at once, and cells of the matrix of their scores.
BUCKET = 4096
CELLS = 1 << 21
SLICE = 1 << 20


def counted_terms(text: str) -> Counter:
    """How often each term stands in the text, by slices that cut none."""
    data, start = text.encode("utf-8", "surrogatepass").lower(), 0  # bytes: only A-Z are lower-cased
    found: Counter = Counter()
    while start < len(data):
        cut = BREAK.search(data, start + SLICE)
        end = cut.end() if cut else len(data)
        found.update(TERM.findall(data, start, end))
        start = end
    return found


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(i, t.decode("utf-8", "replace")) for i, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in counted_terms(text or "")]
        yield pa.RecordBatch.from_pydict({"item": pa.array([p[0] for p in pairs], pa.int64()), "word": pa.array([p[1] for p in pairs], pa.string())})


def counter(numbers: dict[bytes, int]):
    """Rows of doc_id and text to row (a number that no other row of the written table has), doc_id, n and the asked terms' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            size, terms, often = [], [], []
            for text in batch.column("text").to_pylist():
                found = counted_terms(text or "")
                own = [(k, n) for t, n in found.items() if (k := numbers.get(t)) is not None]
                size.append(sum(found.values()))
                terms.append([k for k, _ in own])
                often.append([n for _, n in own])
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(range(row, row + len(size)), pa.int64()), "doc_id": batch.column("doc_id"), "n": pa.array(size, pa.int64()),
                    "terms": pa.array(terms, pa.list_(pa.int32())), "often": pa.array(often, pa.list_(pa.int64())),
                }
            )
            row += len(size)

    return run


def ranked(items: DataFrame, docs: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Each item's `top` highest-scoring documents: item_id, rank, doc_id, score; the score is that of op12's contract.

    items: item_id, text; docs: doc_id, text; further columns of any name are not looked at. Rows of items with one id are
    one item with all their terms; null ids are one item too. Every row of docs is a document of its own, rows that repeat
    included; equal scores go by ascending doc_id, null last. Null and empty texts have no terms. Items without terms and
    documents without any of them give no rows, and so do empty tables.
    """
    bounded_batches(docs.sparkSession)
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    asked = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(LAST_ID)).alias("item"), "text")
    pairs = written(asked.mapInArrow(item_terms, "item bigint, word string").distinct(), folder, "asked")
    number = pairs.count()
    blocks = max(1, -(-number // block))
    out = None
    for k in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else pairs
        part = ranked_block(own, docs.select("doc_id", "text"), top, f"{folder}/block-{k}")
        out = part if out is None else out.unionByName(part)
    discard(spark, folder, "asked")
    kind = items.schema["item_id"].dataType
    return out.withColumn("item_id", F.nullif("item", F.lit(LAST_ID)).cast(kind)).select("item_id", "rank", "doc_id", "score")


def ranked_block(pairs: DataFrame, docs: DataFrame, top: int, folder: str) -> DataFrame:
    """One block's ranking. pairs: item, word, whose number is bounded."""
    spark = docs.sparkSession
    words = sorted(r["word"] for r in pairs.select("word").distinct().collect())  # at most BLOCK and one item's terms
    names = spark.createDataFrame(list(enumerate(words)), "term int, word string")
    terms_of = written(pairs.join(F.broadcast(names), "word").select("item", "term"), folder, "terms-of")
    forward = written(docs.mapInArrow(counter({w.encode(): i for i, w in enumerate(words)}), f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, terms array<int>, often array<bigint>"), folder, "forward")

    n_docs, length = forward.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = 50 + F.expr(f"(50 * n * {n_docs}L) div {max(length, 1)}L")
    lists = forward.select("row", m.alias("m"), F.explode(F.arrays_zip("terms", "often")).alias("t"))
    tf = F.col("t.often")
    lists = lists.select(F.col("t.terms").alias("term"), "row", tf.alias("tf"), "m").withColumn("q", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)"))
    lists = lists.select("term", "row", "q").repartition("term", F.pmod(F.xxhash64("row"), F.lit(PARTS))).sortWithinPartitions("term", F.desc("q"))
    lists = written(lists, folder, "lists")

    weigh = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    known = lists.groupBy("term").agg(F.count("*").alias("df"), F.max("q").alias("most")).withColumn("w", weigh).filter("w > 0").select("term", "most", "w")
    every = Window.partitionBy("item")
    asked = terms_of.join(F.broadcast(known), "term").withColumn("m", F.count("*").over(every))  # a row for each term of the block
    asked = written(asked, folder, "asked")

    buckets = max(1, -(-forward.count() // BUCKET))

    # 1: the heads' partial scores, and the exact ones of the best of them
    heads = lists.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("q")))).filter(F.col("place") <= top)
    partial = heads.join(F.broadcast(asked), "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("q")).alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    promising = partial.withColumn("place", place).filter(F.col("place") <= 2 * top).select("item", "row")
    asks = Asked.of(asked, len(words))
    bound = written(kth(exact(lists, written(promising, folder, "promising"), asks, buckets), top), folder, "bounds")
    asks = asks.bounded({r["item"]: r["kth"] for r in bound.collect()})  # a row for each item of the block

    # 2: postings at or above an m-th of the bound
    least = spark.createDataFrame(asks.least_of_terms(), "term int, least bigint")
    fetched = lists.join(F.broadcast(least), "term").filter(F.col("q") >= F.col("least")).select("row", "term", "q")
    fetched = fetched.withColumn("bucket", bucket(buckets))
    seen = written(fetched.groupBy("bucket").applyInArrow(thresholded(asks), "item bigint, row bigint, score bigint, most bigint"), folder, "seen")
    better = F.broadcast(kth(seen, top))  # a row for each item of the block
    candidates = seen.join(better, "item", "left").filter(F.col("most") >= F.coalesce("kth", F.lit(0)))
    candidates = written(candidates.select("item", "row"), folder, "candidates")

    # 3: the candidates' exact scores, then their ids
    found = exact(lists, candidates, asks, buckets).join(forward.select("row", "doc_id"), "row")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")
    out = written(out, folder, "ranked")
    discard(spark, folder, "terms-of", "forward", "lists", "asked", "promising", "bounds", "seen", "candidates")
    return out


def bucket(buckets: int):
    return F.pmod(F.xxhash64("row"), F.lit(buckets))


@dataclass
class Asked:
    """A block's pairs of term and item, by term: pairs at[t] to at[t + 1] are term t's.

    least: the smallest q that reaches the item's threshold; cap: what the pair can bring below it.
    """

    items: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    item: np.ndarray
    w: np.ndarray
    most: np.ndarray
    m: np.ndarray
    least: np.ndarray
    cap: np.ndarray
    bound: np.ndarray

    @staticmethod
    def of(asked: DataFrame, size: int) -> Asked:
        """asked: item, term, most, w, m, whose rows are bounded by BLOCK and one item's terms; size: the number of terms."""
        rows = asked.toArrow()
        item, term, most, w, m = (rows.column(n).to_numpy().astype(np.int64) for n in ("item", "term", "most", "w", "m"))
        order = np.lexsort((item, term))
        items, place = np.unique(item, return_inverse=True)
        at = np.searchsorted(term[order], np.arange(size + 1))
        none = np.zeros(len(term), np.int64)
        return Asked(items, at, term[order], place[order], w[order], most[order], m[order], none, none, np.zeros(len(items), np.int64))

    def bounded(self, bounds: dict[int, int]) -> Asked:
        """With the thresholds that follow from lower bounds of the items' last scores."""
        bound = np.array([bounds.get(i, 0) for i in self.items.tolist()], np.int64)
        weight = self.m * self.w
        least = -(-bound[self.item] // np.maximum(weight, 1))
        return replace(self, least=least, cap=np.minimum(self.most, np.maximum(least - 1, 0)) * self.w, bound=bound)

    def least_of_terms(self) -> list[tuple[int, int]]:
        """Of each term that reaches some item's threshold, the least q that does."""
        own = self.most >= self.least
        terms, first = np.unique(self.terms[own], return_index=True)
        least = np.minimum.reduceat(self.least[own], first) if len(first) else first
        return list(zip(terms.tolist(), least.tolist(), strict=True))

    def sums(self, row: np.ndarray, term: np.ndarray, q: np.ndarray, fetched: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The rows' scores for all items, as matrices of some rows at a time: rows, scores, caps of what was added.

        Sums are whole numbers below 2**53, so that doubles hold them exactly.
        """
        order = np.argsort(row, kind="stable")
        row, term, q = row[order], term[order], q[order]
        rows, begin = np.unique(row, return_index=True)
        begin = np.append(begin, len(row))
        width = max(1, len(self.items))
        step = max(1, CELLS // width)
        for a in range(0, len(rows), step):
            own = rows[a : a + step]
            score, cap = np.zeros(len(own) * width), np.zeros(len(own) * width)
            for c in range(begin[a], begin[a + len(own)], CELLS // 64):
                part = slice(c, min(c + CELLS // 64, begin[a + len(own)]))
                t, each = term[part], self.at[term[part] + 1] - self.at[term[part]]
                total = int(each.sum())
                pair = np.repeat(self.at[t] - (np.cumsum(each) - each), each) + np.arange(total)
                value = np.repeat(q[part], each)
                cell = np.repeat(np.searchsorted(own, row[part]) * width, each) + self.item[pair]
                if fetched:
                    keep = value >= self.least[pair]
                    pair, value, cell = pair[keep], value[keep], cell[keep]
                    cap += np.bincount(cell, self.cap[pair], len(cap))
                score += np.bincount(cell, self.w[pair] * value, len(score))
            yield own, score.reshape(-1, width), cap.reshape(-1, width)


def thresholded(asked: Asked):
    """A bucket's fetched postings to item, row, score and the most that the row can have, where that reaches the bound."""
    caps = np.bincount(asked.item, asked.cap, len(asked.items))

    def run(postings: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 4]
        for rows, score, cap in asked.sums(*(postings.column(n).to_numpy() for n in ("row", "term", "q")), True):
            most = score + caps - cap
            r, i = np.nonzero((score > 0) & (most >= asked.bound))
            out.append([asked.items[i], rows[r], score[r, i].astype(np.int64), most[r, i].astype(np.int64)])
        return pa.table(dict(zip(("item", "row", "score", "most"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def exact(lists: DataFrame, pairs: DataFrame, asked: Asked, buckets: int) -> DataFrame:
    """Pairs of item and row with their exact scores, if above 0, from the postings of their rows."""

    def run(postings: pa.Table, own: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 3]
        item, row = np.searchsorted(asked.items, own.column("item").to_numpy()), own.column("row").to_numpy()
        for rows, score, _ in asked.sums(*(postings.column(n).to_numpy() for n in ("row", "term", "q")), False):
            place = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
            here = rows[place] == row
            value = score[place[here], item[here]]
            up = value > 0
            out.append([asked.items[item[here][up]], row[here][up], value[up].astype(np.int64)])
        return pa.table(dict(zip(("item", "row", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    postings = lists.join(pairs.select("row").distinct(), "row", "left_semi").select("row", "term", "q").withColumn("bucket", bucket(buckets))
    own = pairs.select("item", "row").withColumn("bucket", bucket(buckets))
    return postings.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(run, "item bigint, row bigint, score bigint")


def kth(scores: DataFrame, top: int) -> DataFrame:
    """The top-th highest score of each item that has so many."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return scores.select("item", "score").withColumn("place", place).filter(F.col("place") <= top).filter(F.col("place") == top).select("item", F.col("score").alias("kth"))


def query(spark, sf_dir) -> DataFrame:
    """Query op12: each benchmark item's 50 best documents."""
    return ranked(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT row, doc_id, term, size, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS size, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
c AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * n) // l))) AS c FROM p JOIN w USING (term), s),
t AS (SELECT item_id, row, doc_id, CAST(sum(c) AS BIGINT) AS score FROM c JOIN i USING (term) GROUP BY ALL HAVING sum(c) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM t
QUALIFY rank <= {TOP}
"""
