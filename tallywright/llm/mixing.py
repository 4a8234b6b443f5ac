"""Mixing sources to target weights by a low-discrepancy schedule, built of DataFrame functions only.

Each source's documents are laid end to end in a shuffled order, its stream, which is cut into blocks of equal words;
the stream starts anew when it is used up. The schedule is a row of slots. Slot i has the point frac(i * golden ratio),
which the cumulative target weights map to a source; the slot's rank among its source's slots is the block it takes. As
golden-ratio points are spread evenly, any stretch of the mix holds the sources near their weights. The slot of its first
block is a document's place in the mix, and the mixed documents are written in that order.

No step puts a source into one task. Streams and slots are laid out in two levels: hash buckets (or chunks of slots) are
summed first, the sums are accumulated, and rows are placed within their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import shared_folder, table, word_count, written

#: 2**31 divided by the golden ratio, the step of the points; the product of two such numbers fits a long.
POINTS = 1 << 31
STEP = 1327217885
#: The unit interval is cut into cells so that points find their source by an equality join.
CELLS = 4096
CHUNK = 4096
PER_BUCKET = 1024
BITS = 20


def source_targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """A row for each source: src (its place by code point, null last), source_size, weight and target words.

    Targets share out all words by weight. A source's target stops at most times its size, and the excess goes to the
    others by weight until none is above: water-filling in closed form over the sources ordered by size a weight.
    sizes: source, size, rows (the number of documents); the result has a row for each source, so its windows are small.
    """
    every, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("source_rows"))
    s = s.withColumn("src", (F.row_number().over(order) - 1).cast("int"))
    s = s.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("src") % len(weights)))
    s = s.withColumn("cap", most * F.col("source_size").cast("double"))
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), zero)
    s = s.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)))
    s = s.withColumn("final", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(every))
    s = s.withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))))
    return s.select("source", "src", "source_size", "source_rows", "weight", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"))


def sized(docs: DataFrame, seed: str, whole: bool = False) -> DataFrame:
    """The rows that are mixed: doc_id, source, size and key, the shuffled order; with whole, the given row too.

    The key is a hash of id and text, so that rows without an id, or with one id, are no hot key unless they are copies.
    """
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    row = [F.struct("*").alias("row")] if whole else []
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *row)


def streams(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Places every row in its source's stream: adds src, source_size, target, words and start, the words before it.

    The order is by key, then doc_id and size; rows equal in all three are alike. A source has as many buckets as leave
    about PER_BUCKET rows in each, so that the buckets of all sources are about as large.
    """
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("source_rows") / PER_BUCKET)))).cast("int")
    code = F.conv(F.substring("key", 1, 5), 16, 10).cast("int")
    known = targets.withColumnRenamed("source", "known_source").withColumn("bits", bits).drop("weight", "source_rows")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("known_source"))).withColumn("code", code)
    rows = rows.withColumn("bucket", F.expr(f"shiftright(code, {BITS} - bits)")).drop("known_source", "bits", "code")
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.select("src", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(sums, ["src", "bucket"])
    return rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("base", "bucket")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The slots of the mix: slot (the order), src and rank, the source's block that the slot takes.

    A source has as many slots as blocks fit its target, no more and no fewer: points beyond them are void, and the few
    that the points leave out (the discrepancy grows with the logarithm of the slots) follow at the end.
    """
    spark = targets.sparkSession
    quota = targets.filter("words > 0").withColumn("quota", F.ceil(F.col("words") / block).cast("long"))
    total = quota.agg(F.sum("quota")).first()[0] or 0
    slots = total + total // 64 + 64
    order, every = Window.orderBy("src"), Window.partitionBy()
    upto = F.sum("words").over(order) / F.sum("words").over(every)
    spans = quota.select("src", "quota", upto.alias("hi"))
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    last = F.max("src").over(every) == F.col("src")
    spans = spans.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)))
    cells = spans.withColumn("cell", F.explode(cells))
    point = ((F.col("slot") + 1) % POINTS * STEP % POINTS) / POINTS
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point)
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").filter("u >= lo and u < hi")
    hit = hit.select("slot", "src", "quota", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = hit.groupBy("src", "chunk").count()
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("src", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = hit.join(bases, ["src", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    given = counts.groupBy("src").agg(F.sum("count").alias("given"))
    late = quota.join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < quota")
    late = late.select("src", F.explode(F.sequence(F.col("given"), F.col("quota") - 1)).alias("rank"))
    late = late.select((slots + F.col("rank")).alias("slot"), "src", "rank")
    return ranked.filter("rank < quota").select("slot", "src", "rank").unionByName(late)


def blocks(placed: DataFrame, block: int, most: int = 3, first_only: bool = False) -> DataFrame:
    """The pieces of documents in their source's blocks: rank (of the block) and words, one row for each document and block.

    A stream that is used up starts anew, up to most times. Rows of the target's rest have no piece and stay with nulls.
    first_only: only the block in which each pass over a document begins; lo and hi are the words of the pass.
    """
    passes = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.col("start") + p * F.col("source_size"))
    begins = F.filter(passes, lambda lo: lo < F.col("words"))
    span = placed.withColumn("lo", F.explode_outer(begins)).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words")))
    ranks = F.sequence(F.floor(F.col("lo") / block), F.floor((F.when(F.lit(first_only), F.col("lo") + 1).otherwise(F.col("hi")) - 1) / block))
    span = span.withColumn("rank", F.explode_outer(ranks))
    part = F.least(F.col("hi"), (F.col("rank") + 1) * block) - F.greatest(F.col("lo"), F.col("rank") * block)
    return span.withColumn("part", part)


def scheduled(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """Adds slot, the place in the mix of the block that a piece lies in; null if the schedule doesn't take it."""
    hit = slots.select(F.col("src").alias("slot_src"), F.col("rank").alias("slot_rank"), "slot")
    return pieces.join(hit, (F.col("src") == F.col("slot_src")) & (F.col("rank") == F.col("slot_rank")), "left").drop("slot_src", "slot_rank")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), most: int = 3, block: int = 1024, seed: str = "mix") -> dict[str, DataFrame]:
    """Mixes all documents so that sources reach their target words.

    docs: doc_id, text, source; other columns are not read. Sources are ordered by code point, null last, and weigh
    weights, repeating. A text's size is its words (null: 0); documents without words are taken 0 times. Repeated rows
    and ids are documents of their own. An empty table gives empty frames. Returns targets (see source_targets), slots
    (see schedule) and taken: doc_id, size, source_size, target, taken, first_slot (of the first block that brings the
    document; null if none does), src, start, a row for each document. A document is taken at most `most` times, and a
    source's taken words are its target, rounded. The seed fixes the order, so reruns agree.
    """
    folder = shared_folder(docs.sparkSession)
    rows = written(sized(docs, seed), folder, "sizes")
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), weights, most), folder, "targets")
    placed = streams(rows, targets)
    slots = written(schedule(targets, block), folder, "slots")
    pieces = scheduled(blocks(placed.filter("size > 0"), block, most), slots)
    part = F.when(F.col("slot").isNotNull(), F.col("part"))
    taken = pieces.groupBy("src", "start", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "src", "start"]
    none = placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}).select(columns)
    return {"targets": targets, "slots": slots, "placed": placed, "taken": taken.select(columns).unionByName(none)}


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), most: int = 3, block: int = 1024, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken: the rows of docs, whole, in the order of the schedule.

    Each time a document is taken, it stands at the slot of the block in which that pass over it begins. A source's last
    document may be taken in part; it is in the mix if at least half of it is. Documents without words are not in it.
    Extra columns stay, whatever their names. Partitions are ranges of slots, sorted, so a table written from this frame
    holds the mix in its order.
    """
    mix = mix_sources(docs, weights, most, block, seed)
    passes = blocks(mix["placed"].filter("size > 0"), block, most, first_only=True)
    passes = passes.filter((F.col("hi") - F.col("lo")) * 2 >= F.col("size"))
    at = scheduled(passes, mix["slots"]).filter("slot is not null").groupBy("src", "start").agg(F.collect_list(F.struct("slot", "lo")).alias("slots"))  # at most `most`
    placed = streams(sized(docs, seed, whole=True), mix["targets"]).filter("size > 0").select("src", "start", "row")
    found = placed.join(at, ["src", "start"]).select("row", F.explode("slots").alias("at"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = (mix["slots"].agg(F.max("slot")).first()[0] or 0) + 1
    stretch = F.floor(F.col("at.slot") * F.lit(parts) / F.lit(end)).cast("int")  # slots are even, so no sample has to tell the ranges
    return found.select("row", "at.slot", "at.lo", stretch.alias("stretch")).repartitionById(parts, F.col("stretch")).sortWithinPartitions("slot", "lo").select("row.*")


def query(spark, sf_dir) -> DataFrame:
    """Query op10: what the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents"))["taken"].drop("src", "start")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 3e0 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0e0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0e0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS final FROM l),
t AS (
  SELECT source, source_size, src, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.src, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT src, words, CAST(ceil(words / 1024) AS BIGINT) AS quota
  FROM (SELECT DISTINCT src, words FROM p WHERE words > 0)),
c AS (
  SELECT src, quota, sum(words) OVER (ORDER BY src) AS upto, sum(words) OVER () AS every,
         sum(words) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under,
         max(src) OVER () = src AS last FROM q),
n AS (SELECT CAST(sum(quota) + sum(quota) // 64 + 64 AS BIGINT) AS slots FROM c),
u AS (SELECT i AS slot, ((i + 1) % 2147483648) * 1327217885 % 2147483648 / 2147483648 AS u
      FROM n, unnest(range(slots)) AS g(i)),
h AS (SELECT slot, src, quota, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank
      FROM u JOIN c ON u.u >= coalesce(CAST(under AS DOUBLE) / every, 0) AND u.u < CASE WHEN last THEN 2 ELSE CAST(upto AS DOUBLE) / every END),
late AS (
  SELECT CAST(slots + r AS BIGINT) AS slot, src, r AS rank
  FROM (SELECT src, quota, unnest(range(coalesce(given, 0), quota)) AS r FROM c LEFT JOIN (SELECT src, count(*) AS given FROM h GROUP BY src) USING (src)), n),
sched AS (SELECT slot, src, rank FROM h WHERE rank < quota UNION ALL SELECT * FROM late)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, slot AS first_slot,
       CAST(greatest(0, least(start + size, words) - start)
          + greatest(0, least(start + source_size + size, words) - (start + source_size))
          + greatest(0, least(start + 2 * source_size + size, words) - (start + 2 * source_size)) AS BIGINT) AS taken
FROM p LEFT JOIN sched ON p.src = sched.src AND CAST(p.start // 1024 AS BIGINT) = sched.rank AND p.start < p.words AND p.size > 0
"""
