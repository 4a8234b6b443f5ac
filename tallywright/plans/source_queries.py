"""Queries of sources and sinks: tables are written to the shared folder by a sink and read again by a source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.functions import audio
from tallywright.operators import labels, spectra
from tallywright.plans import fixtures as fx
from tallywright.plans.fixtures import SQL, draw_sql, table
from tallywright.plans.metric_queries import r9
from tallywright.sources import readers, sinks
from tallywright.sources.scratch import put, shared_folder

Q: dict = {}
S: dict = {}


def add(name, run, sql):
    Q[name] = run
    S[name] = f"WITH {SQL} {sql}" if not sql.lstrip().startswith("WITH") else sql.replace("WITH", f"WITH {SQL},", 1)


def names(s, d):
    """The nations, 25 rows, as files are named after them."""
    return [(r[0], r[1], r[2]) for r in table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def csv_scan(s, d):
    folder, b = shared_folder(s), fx.base(s, d).select("row_id", "author", "fold")
    sinks.write_csv(b, f"{folder}/folds")
    return readers.csv(s, f"{folder}/folds", b.schema).groupBy("fold").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"), F.countDistinct("author").alias("authors"))


add("s1_k2_csv_scan", csv_scan, "SELECT fold, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids, count(DISTINCT author) AS authors FROM base GROUP BY fold")


def vocabulary(s, d):
    path = f"{shared_folder(s)}/words.csv"
    put(s, path, "\n".join(["code", *[f"{name.title()} " for _, name, _ in names(s, d)]]).encode())
    return readers.vocabulary(s, path, 25)


add("s2_vocabulary", vocabulary, "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, lower(trim(n_name)) AS code FROM nation")


def npy(s, d):
    """Model b as a dense matrix, in shards; rows are numbered by row_id."""
    folder, sc = shared_folder(s), fx.scores(s, d, "b")
    place = labels.numbered(sc.select("row_id").distinct(), "k", ["row_id"])
    sinks.write_npy(sc.join(place, "row_id").select(F.col("k").alias("row_id"), "class_id", "score"), folder, 5, 2000)
    return readers.matrices(s, folder).groupBy("class_id").agg(F.count("score").alias("scored"), F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("score"), F.max("row_id").alias("last"))


add("s3_s4_k1_npy_matrix", npy, "SELECT class_id, count(score) AS scored, count(*) AS n, round(sum(score), 5) AS score, (SELECT count(*) - 1 FROM base) AS last FROM scores WHERE model = 'b' GROUP BY class_id")


def npy_class(s, d):
    """One class of a dense matrix's shards, the others left where they are."""
    folder, sc = shared_folder(s), fx.scores(s, d, "b")
    place = labels.numbered(sc.select("row_id").distinct(), "k", ["row_id"])
    sinks.write_npy(sc.join(place, "row_id").select(F.col("k").alias("row_id"), "class_id", "score"), folder, 5, 2000)
    one = readers.matrix(s, folder, classes=[2]).withColumnRenamed("row_id", "k").join(place, "k")
    return r9(one.groupBy("class_id").agg(F.count("score").alias("scored"), F.count("*").alias("n"), F.sum(F.col("score") * (F.col("row_id") % 7)).alias("score")), "score").withColumn("score", F.round("score", 5))


add("s4_k1_npy_one_class", npy_class, "SELECT class_id, count(score) AS scored, count(*) AS n, round(sum(score * (row_id % 7)), 5) AS score FROM scores WHERE model = 'b' AND class_id = 2 GROUP BY class_id")


def optional(s, d):
    folder, sc = shared_folder(s), fx.scores(s, d, "a")
    for seed in (41, 43):
        sc.withColumn("seed", F.lit(seed)).write.parquet(f"{folder}/seed{seed}")
    got = readers.optional(s, [f"{folder}/seed{k}" for k in range(41, 46)])
    none = readers.optional(s, [f"{folder}/none"])
    return got.groupBy("seed").agg(F.count("*").alias("n"), F.lit(none is None).alias("other_absent"))


add("s5_optional_artifacts", optional, "SELECT CAST(seed AS INTEGER) AS seed, count(*) AS n, true AS other_absent FROM scores, (SELECT unnest([41, 43]) AS seed) WHERE model = 'a' GROUP BY seed")


def waves(s, d):
    """A folder with a WAV file for each nation: sample i is i * (key + 1) mod 50, of 10 + 2 key samples."""
    folder = shared_folder(s)
    for key, name, _ in names(s, d):
        put(s, f"{folder}/{name}.ogg", audio.as_wav(np.arange(10 + 2 * key) * (key + 1) % 50 / 32768, 8))
    return folder


def listing(s, d):
    labelled = table(s, d, "nation").filter("n_regionkey = 1").select(F.concat("n_name", F.lit(".ogg")).alias("filename"))
    return readers.unlabelled(readers.listed(s, waves(s, d)), labelled).select("filename")


add("s6_unlabelled_files", listing, "SELECT n_name || '.ogg' AS filename FROM nation WHERE n_regionkey <> 1")


def windows(s, d, centre):
    raw = s.read.format("binaryFile").option("pathGlobFilter", "*.ogg").load(waves(s, d))
    decoded = readers.decoded(raw, audio.wav)
    window = readers.centred(F.col("samples"), 30) if centre else readers.window_at(F.col("samples"), F.lit(1), 8, 16)
    total = F.aggregate(window, F.lit(0.0), lambda a, x: a + x.cast("double") * 32768)
    return decoded.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.size(window).alias("n"), total.alias("total"))


WAVES = "smp AS (SELECT n_nationkey AS k, n_name, 10 + 2 * n_nationkey AS size, unnest(range(10 + 2 * n_nationkey)) AS i FROM nation)"
add("s7_centred_window", lambda s, d: windows(s, d, True), f"WITH {WAVES} SELECT n_name || '.ogg' AS filename, CAST(30 AS INTEGER) AS n, CAST(sum(CASE WHEN i >= greatest(0, (size - 30) // 2) AND i < greatest(0, (size - 30) // 2) + 30 THEN i * (k + 1) % 50 ELSE 0 END) AS DOUBLE) AS total FROM smp GROUP BY n_name")
add("s8_window_at_offset", lambda s, d: windows(s, d, False), f"WITH {WAVES} SELECT n_name || '.ogg' AS filename, CAST(16 AS INTEGER) AS n, CAST(sum(CASE WHEN i >= 8 AND i < 24 THEN i * (k + 1) % 50 ELSE 0 END) AS DOUBLE) AS total FROM smp GROUP BY n_name")


def cells(s, d):
    folder = shared_folder(s)
    for key, name, _ in names(s, d):
        put(s, f"{folder}/cell_{key:02d}.json", f'{{"ord": {key}, "cell": "{name}", "value": {key}.25}}'.encode())
    return readers.cells(s, folder, 25, "ord int, cell string, value double")


add("s10_result_cells", cells, "SELECT CAST(n_nationkey AS INTEGER) AS ord, n_name AS cell, n_nationkey + 0.25e0 AS value FROM nation ORDER BY 1")


def rounded(s, d):
    path = f"{shared_folder(s)}/json"
    rows = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 64).cast("double").alias("v")).withColumn("v", F.col("v") / 32)
    sinks.write_json(rows, path, 4)
    return readers.json(s, path, "c_custkey bigint, v double", lines=True)


add("k3_json_half_even", rounded, "SELECT c_custkey, round_even(CAST(c_custkey % 64 AS DOUBLE) / 32, 4) AS v FROM customer")


def dumps(s, d):
    """Analyses are written one by one; a later run of one replaces it alone."""
    folder, b = shared_folder(s), fx.base(s, d)
    for name, rows in (("first", b.filter("fold = 0")), ("second", b), ("first", b.filter("fold < 2"))):
        sinks.write_analysis(rows.groupBy("fold").agg(F.count("*").alias("n")), folder, name)
    both = [s.read.parquet(f"{folder}/{name}").withColumn("name", F.lit(name)) for name in ("first", "second")]
    return both[0].unionByName(both[1])


add("k4_incremental_dump", dumps, "SELECT 'second' AS name, fold, count(*) AS n FROM base GROUP BY fold UNION ALL SELECT 'first', fold, count(*) FROM base WHERE fold < 2 GROUP BY fold")


def resumed(s, d):
    """Folds 0 to 2 of model a and b are done; fold 1 of a is written again. What is left, and what stands."""
    path, keys, sc = f"{shared_folder(s)}/shards", ["model", "fold"], fx.scores(s, d)
    jobs = sc.select(*keys).distinct()
    now = sc.filter("model <> 'c' and fold < 3")
    left = sinks.pending(jobs, sinks.done(s, path, keys), keys).count()
    for part in (now, now.filter("model = 'a' and fold = 1")):
        sinks.write_shards(part, path, ("model", "fold"))
        sinks.mark_done(part.select(*keys), path)
    rest = sinks.pending(jobs, sinks.done(s, path, keys), keys).select("model", F.col("fold").cast("int").alias("fold"), F.lit(0).cast("bigint").alias("rows"))
    there = s.read.parquet(path).groupBy("model", F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("rows"))
    return rest.unionByName(there).withColumn("jobs", F.lit(left))


add("k5_m9_resumed_shards", resumed, "SELECT model, fold, CASE WHEN model <> 'c' AND fold < 3 THEN count(*) ELSE 0 END AS rows, CAST(15 AS INTEGER) AS jobs FROM scores GROUP BY model, fold")


def assembled(s, d):
    path, keys, sc = f"{shared_folder(s)}/shards", ["model", "fold"], fx.scores(s, d)
    sinks.write_shards(sc, path, ("model", "fold"))
    return sinks.assemble(s, path, sc.select(*keys).distinct(), keys).groupBy("model").agg(F.count("score").alias("scored"), F.count("*").alias("n"))


add("k6_assembled_shards", assembled, "SELECT model, count(score) AS scored, count(*) AS n FROM scores GROUP BY model")


def validated(s, d):
    fresh = fx.scores(s, d, "a").select("row_id", "class_id", "score")
    cache = fresh.withColumn("score", F.col("score") + (F.col("row_id") % 3).cast("double") / 4096)
    return r9(sinks.validated(cache, fresh, ["row_id", "class_id"], "score", 1e-3, 300, 3), "max_diff")


add("k8_validated_cache", validated, f"""WITH v AS (SELECT row_id FROM scores WHERE model = 'a' ORDER BY {draw_sql('3', 'row_id', 'class_id')}, row_id, class_id LIMIT 300)
    SELECT round(max(CAST(row_id % 3 AS DOUBLE) / 4096), 9) AS max_diff, max(CAST(row_id % 3 AS DOUBLE) / 4096) <= 1e-3 AS ok, count(*) AS rows FROM v""")


def reported(s, d):
    rows = table(s, d, "nation").select("n_name", "n_regionkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey").cast("double") / 8).alias("value"))
    return sinks.full_report(rows, "Results", ["n_name", "n_regionkey", "value"], ["n_regionkey", "n_name"], 3)


add("k9_markdown_report", reported, """SELECT * FROM (VALUES (0::BIGINT, '## Results'), (1, ''), (2, '| n_name | n_regionkey | value |'), (3, '|---|---|---|')) t(line, text)
    UNION ALL SELECT row_number() OVER (ORDER BY n_regionkey, n_name) + 3, '| ' || n_name || ' | ' || n_regionkey || ' | ' || CASE WHEN n_nationkey % 4 <> 0 THEN printf('%.3f', n_nationkey / 8e0) ELSE '-' END || ' |' FROM nation""")


def filter_bank(s, d):
    """Each supplier's quantities, in order, as a signal of 8 kHz."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    signal = table(s, d, "lineitem").select("l_suppkey", (F.row_number().over(order) - 1).alias("i"), F.col("l_quantity").cast("double").alias("x"))
    return spectra.filter_bank(signal, ["l_suppkey"], "i", "x", 8000, 23).withColumn("energy", F.round("energy", 6))


add("f17_filter_bank", filter_bank, """
    WITH signal AS (
      SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS i, CAST(l_quantity AS DOUBLE) AS x
      FROM lineitem),
    cut AS (
      SELECT l_suppkey, f AS frame, i - 80 * f AS j, x - avg(x) OVER (PARTITION BY l_suppkey, f) AS x, count(*) OVER (PARTITION BY l_suppkey, f) AS n
      FROM (SELECT *, unnest(range(CAST(greatest(0, (i - 120) // 80) AS BIGINT), CAST(i // 80 AS BIGINT) + 1)) AS f FROM signal) WHERE i - 80 * f < 200),
    windowed AS (
      SELECT l_suppkey, frame, j, (x - 0.97e0 * coalesce(lag(x) OVER (PARTITION BY l_suppkey, frame ORDER BY j), x)) * (0.5e0 - 0.5e0 * cos(2 * pi() * j / 199)) ** 0.85e0 AS x
      FROM cut WHERE n = 200),
    power AS (
      SELECT l_suppkey, frame, k, sum(x * cos(2 * pi() * ((j * k) % 256) / 256)) ** 2 + sum(x * sin(2 * pi() * ((j * k) % 256) / 256)) ** 2 AS p
      FROM windowed, range(128) AS g(k) GROUP BY ALL),
    ends AS (SELECT 1127 * ln(1 + 20e0 / 700) AS low, (1127 * ln(1 + 4000e0 / 700) - 1127 * ln(1 + 20e0 / 700)) / 24 AS step),
    bank AS (
      SELECT k, b AS band, greatest(0, 1 - abs(1127 * ln(1 + k * 8000e0 / 256 / 700) - (low + (b + 1) * step)) / step) AS w
      FROM range(128) AS g(k), range(23) AS h(b), ends)
    SELECT l_suppkey, frame, CAST(band AS INTEGER) AS band, round(ln(greatest(sum(p * w), 1.1920928955078125e-7)), 6) AS energy
    FROM power JOIN bank USING (k) WHERE w > 0 GROUP BY l_suppkey, frame, band""")
