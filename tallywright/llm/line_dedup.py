"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches by ascending id. A run is a table of line hashes, bucketed and sorted by hash, that earlier
batches have seen; runs stand in levels. Each batch merge-anti-joins the runs to find the lines that are new, and adds
these as a run of level 0; when a level holds `fanout` runs they are merged into one run of the next level, so a batch
meets few runs and a hash is rewritten once a level. As batches ascend, the first document that brings a line is the
smallest that holds it: it owns the line, and every other document loses it.

Runs and decisions are tables in the shared folder, so a lost executor costs the tasks it ran, and plans stay short. A
line that stands in a third of all documents is one row of a run. The joins that find a document's lost lines are keyed
by line and document, so such a line doesn't gather in one task; a document's lost lines are gathered by id and text, so
rows without an id don't either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import BLANKS, LAST_ID, bounded_batches, discard, release, shared_folder, table, written

#: Fixed value: shorter keys are never dropped.
LEAST = 10
STRIP = BLANKS.encode()
HASHES = ["h1", "h2"]


def keys(text: str | None) -> Iterator[tuple[bytes, bytes | None]]:
    """Each line and its key's 16-byte hash; None if the key has fewer than 10 code points."""
    data = (text or "").encode()
    for line, low in zip(data.split(b"\n"), data.lower().split(b"\n"), strict=True):  # bytes.lower() changes A-Z alone
        key = low.strip(STRIP)
        long = len(key) >= 4 * LEAST or len(key) >= LEAST and len(key.decode()) >= LEAST
        yield line, xxhash.xxh3_128_digest(key) if long else None


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, part, text to a row for each text and line hash in it."""
    for batch in batches:
        row, found = [], []
        for k, text in enumerate(batch.column("text")):
            own = {h for _, h in keys(text.as_py()) if h}
            row += [k] * len(own)
            found += own
        at = pa.array(row, pa.int64())
        two = pa.Array.from_buffers(pa.int64(), 2 * len(found), [None, pa.py_buffer(b"".join(found))]).to_numpy()
        yield pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(at), "part": batch.column("part").take(at), "h1": pa.array(two[0::2]), "h2": pa.array(two[1::2])})


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, lost to row and what stays of its text without the lines whose hashes stand in lost."""
    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, lost in zip(batch.column("row").field("text"), batch.column("lost"), strict=True):
            gone = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for x in lost.as_py() or () for a, b in [(x["h1"], x["h2"])]}
            pairs = list(keys(text.as_py()))
            stay = [line for line, h in pairs if h not in gone] if gone else [line for line, _ in pairs]
            kept.append(b"\n".join(stay).decode())
            lines.append(len(pairs))
            dropped.append(len(pairs) - len(stay))
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "kept": pa.array(kept, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})


class Runs:
    """The levelled runs: (level, table name) pairs, newest last."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.held: list[tuple[int, str]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"tw_run_{uuid.uuid4().hex}"
        rows = df.select(*HASHES).repartition(self.buckets, *HASHES)
        rows.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.folder}/runs/{name}").saveAsTable(name)
        self.held.append((level, name))

    def unseen(self, df: DataFrame) -> DataFrame:
        """The rows of df whose hash no run holds."""
        for _, name in self.held:
            df = df.join(self.spark.table(name).hint("merge"), HASHES, "left_anti")
        return df

    def add(self, df: DataFrame) -> None:
        """Adds new hashes as a run of level 0 and merges the levels that are full."""
        self._write(df, 0)
        level = 0
        while len(full := [n for lv, n in self.held if lv == level]) >= self.fanout:
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._write(merged, level + 1)
            self.held = [(lv, n) for lv, n in self.held if n not in full]
            self._drop(*full)
            level += 1

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, self.folder, f"runs/{name}")

    def close(self) -> None:
        self._drop(*[name for _, name in self.held])
        self.held = []


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Removes every line that a document with a smaller id holds too; see the contract of op2.

    docs: doc_id, text and any further columns, whatever their names; they come back in the struct row. A null or empty
    text is one empty line. Rows with the same id are one document; a null id is one document after all others. An
    empty table gives no rows. Returns row, kept (the text that stays), n_lines and n_dropped. Keys are compared by
    128-bit hashes. batches: ids are cut into so many ranges of about equal counts.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    bounded_batches(spark)
    part = F.xxhash64("text")
    plain = docs.select(doc.alias("doc"), part.alias("part"), "text")
    cuts = plain.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    schema = "doc bigint, part bigint, h1 bigint, h2 bigint"
    lines = plain.mapInArrow(hashed, schema).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/lines")
    runs = Runs(spark, folder, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    lost = None
    try:
        for n in range(len(cuts) + 1):
            own = lines.filter(F.col("batch") == n).drop("batch")
            owners = written(runs.unseen(own.groupBy(*HASHES).agg(F.min("doc").alias("doc"))), folder, f"owners-{n}")
            gone = written(own.join(owners, [*HASHES, "doc"], "left_anti"), folder, f"lost-{n}")
            lost = gone if lost is None else lost.unionByName(gone)
            runs.add(owners)
            discard(spark, folder, f"owners-{n}")
    finally:
        runs.close()
        discard(spark, folder, "lines")
    del own, owners, lines
    release(spark)
    lost = lost.groupBy("doc", "part").agg(F.collect_list(F.struct(*HASHES)).alias("lost"))  # a text's lines
    lost = lost.withColumnsRenamed({"doc": "lost_doc", "part": "lost_part"})
    rows = docs.select(F.struct("*").alias("row"), doc.alias("doc"), part.alias("part"))
    rows = rows.join(lost.hint("shuffle_hash"), (F.col("doc") == F.col("lost_doc")) & (F.col("part") == F.col("lost_part")), "left").select("row", "lost")
    out = rows.select("row").schema.simpleString().removeprefix("struct<row:")[:-1]
    return rows.mapInArrow(cleaned, f"row {out}, kept string, n_lines bigint, n_dropped bigint")


def query(spark, sf_dir) -> DataFrame:
    """Query op2: line counts and the digest of what stays of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), E'\n') AS lines FROM documents),
l AS (
  SELECT rid, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, n, line,
         translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM d)),
f AS (SELECT k, min(doc) AS first FROM l WHERE length(k) >= 10 GROUP BY k),
j AS (SELECT l.*, coalesce(f.first < l.doc, false) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
