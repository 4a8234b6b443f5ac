"""Packing token sequences by minimum bin slack.

A document longer than a sequence fills whole sequences, and its rest is one piece. Pieces of equal length are alike, so
the packing is planned over the histogram of lengths, which never has more rows than a sequence has tokens: the longest
piece left opens a window, a bitset subset-sum over the counts of the remaining lengths finds the fill closest to the
capacity, and backtracking gives the counts of each length. The window is repeated while the counts last. The plan is
then dealt to the pieces by their rank among the pieces of their length, which two levels of sums give without bringing
a length into one task.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import bits_for, bounded_batches, shared_folder, table, written

CAPACITY = 1024
#: Fixed value: the id that ends every document.
END = 0
PER_BUCKET = 8192
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Texts of these characters give the same ids from the rank file's faster encoder; the tests hold all of them together.
NOT_LATIN = re.compile("[^\x00-ɏ]")
LONG_RUN = re.compile(r"[^ ]{2000}")


@cache
def encoder(name: str = "byte_bpe_50k"):
    """A function from a text to its ids as numpy uint32."""
    import public_tokenizers as files
    import tiktoken

    @cache
    def whole():  # loaded where a text needs it, as a worker keeps it
        from tokenizers import Tokenizer

        return Tokenizer.from_file(files.path(f"{name}.json"))

    with open(files.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(files.path(f"{name}.json"), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if NOT_LATIN.search(text) or LONG_RUN.search(text) or any(s in text for s in special):
            return np.array(whole().encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def pieces_of(text: str | None, encode, capacity: int) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """The number of a document's tokens, and its pieces as (start, ids)."""
    ids = np.append(encode(text or ""), np.array([END], "<u4")).astype("<u4")
    return len(ids), [(a, ids[a : a + capacity]) for a in range(0, len(ids), capacity)]


def cutter(capacity: int, with_ids: bool):
    """doc_id, text to a row for each piece. salt: the row's number in its task where doc_id is null, else 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(), 0
        for batch in batches:
            at, out = [], {n: [] for n in ("start", "length", "ids_crc32", "doc_tokens", "ids")}
            for k, text in enumerate(batch.column("text")):
                total, pieces = pieces_of(text.as_py(), encode, capacity)
                for start, ids in pieces:
                    at.append(k)
                    for n, v in zip(out, (start, len(ids), zlib.crc32(ids.tobytes()), total, ids), strict=True):
                        if n != "ids" or with_ids:
                            out[n].append(v)
            ids = {"ids": pa.array([x.astype(np.int32) for x in out.pop("ids")], pa.list_(pa.int32()))} if with_ids else {}
            rows = pa.array(at, pa.int64())
            docs = batch.column("doc_id").take(rows)
            salt = pc.if_else(pc.is_null(docs), pc.add(rows, seen), pa.scalar(0, pa.int64()))
            seen += batch.num_rows
            yield pa.RecordBatch.from_pydict({"doc_id": docs} | {n: pa.array(v, pa.int64()) for n, v in out.items() if n != "ids"} | ids | {"salt": salt})

    return cut


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length come closest to room without passing it: bounded subset-sum over a bitset.

    Longer lengths are offered first and a sum is backtracked to the earliest offer that reaches it, so short pieces,
    which fit anywhere, are spared.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (part * length)) & mask
            left, part = left - part, part * 2
        if reach >> room:
            break
    best, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + part
            best -= part * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows as (pieces of each length, times)."""
    counts, windows = {n: c for n, c in counts.items() if c}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        window = fill(counts, capacity - longest)
        counts[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(counts[n] // u for n, u in window.items())
        for n, u in window.items():
            counts[n] -= u * times
            if not counts[n]:
                del counts[n]
        windows.append((window, times))
    return windows


def dealer(windows: list[tuple[dict[int, int], int]]):
    """Adds sequence_id and offset by length and rank, and drops rank."""
    taken: dict[int, int] = {}
    entries, first = [], 0
    for window, times in windows:
        offset = 0
        for length in sorted(window, reverse=True):
            low = taken.get(length, 0)
            entries.append((length << 44 | low, low, window[length], first, offset))
            taken[length] = low + window[length] * times
            offset += length * window[length]
        first += times
    key, low, uses, base, offset = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5).T

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            turn, slot = np.divmod(rank - low[at], uses[at])
            rest = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            yield pa.RecordBatch.from_pydict(rest | {"sequence_id": pa.array(base[at] + turn), "offset": pa.array(offset[at] + slot * length)})

    return deal


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most capacity tokens.

    docs: doc_id, text; other columns are not read. A null text is empty: one piece, the end id. Each row is a document
    of its own, repeated rows and ids too; an empty table gives no rows. Returns a row for each piece: doc_id, start (of
    its document's ids), length, ids_crc32, doc_tokens, sequence_id, offset (in the sequence) and, with_ids, ids.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids
    pieces = written(docs.select("doc_id", "text").mapInArrow(cutter(capacity, with_ids), f"{schema}, salt bigint"), folder, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not histogram:
        return spark.createDataFrame([], schema + ", sequence_id bigint, offset bigint")
    buckets = 1 << bits_for(sum(histogram.values()), PER_BUCKET, 24)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "salt")
    ranked = pieces.join(sums, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "rank")
    return ranked.mapInArrow(dealer(plan(histogram, capacity)), schema + ", sequence_id bigint, offset bigint")


def query(spark, sf_dir) -> DataFrame:
    """Query op3: the pieces of all documents."""
    return pack_documents(table(spark, sf_dir, "documents"))
