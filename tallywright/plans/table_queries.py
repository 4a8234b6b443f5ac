"""Queries of scans, projections, joins, sets, top-k and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.functions import scalar as fn
from tallywright.operators import labels, metrics, select, shift
from tallywright.plans import fixtures as fx
from tallywright.plans.fixtures import SQL, table
from tallywright.plans.metric_queries import STAGES, r9, stages

Q: dict = {}
S: dict = {}


def add(name, run, sql=None):
    Q[name] = run
    if sql:
        S[name] = f"WITH {SQL} {sql}" if not sql.lstrip().startswith("WITH") else sql.replace("WITH", f"WITH {SQL},", 1)


add("p1_column_selection", lambda s, d: fx.base(s, d).select("row_id", "fold", "author"), "SELECT row_id, fold, author FROM base")
add("p2_all_outer_folds", lambda s, d: select.other_folds(fx.truth(s, d)).groupBy("outer_fold", "class_id").agg(F.sum("y").alias("pos"), F.count("*").alias("n")),
    "SELECT f.fold AS outer_fold, class_id, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM truth t JOIN (SELECT DISTINCT fold FROM base) f ON f.fold <> t.fold GROUP BY ALL")
add("p3_membership_mask", lambda s, d: fx.base(s, d).filter(F.col("fold").isin(1, 3)).agg(F.count("*").alias("n"), F.sum("row_id").alias("ids")), "SELECT count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM base WHERE fold IN (1, 3)")


def gappy(s, d):
    """Scores of which every class is missing where the row is divisible by 10, and in model c by 15."""
    gone = (F.col("row_id") % 10 == 0) | ((F.col("model") == "c") & (F.col("row_id") % 15 == 0))
    return fx.scores(s, d).withColumn("score", F.when(~gone, F.col("score")))


GAPPY = "gappy AS (SELECT * REPLACE (CASE WHEN NOT (row_id % 10 = 0 OR (model = 'c' AND row_id % 15 = 0)) THEN score END AS score) FROM scores)"
add("p4_drop_empty_rows", lambda s, d: metrics.drop_empty_rows(gappy(s, d)).groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("rows")),
    f"WITH {GAPPY}, k AS (SELECT row_id FROM (SELECT row_id, model, count(score) AS n FROM gappy GROUP BY ALL) GROUP BY row_id HAVING min(n) > 0) SELECT model, count(*) AS n, count(DISTINCT row_id) AS rows FROM gappy SEMI JOIN k USING (row_id) GROUP BY model")


def rare(s, d):
    """Model a with the positives of class 2 kept in fold 1 only."""
    return fx.scores(s, d, "a").withColumn("y", F.when((F.col("class_id") == 2) & (F.col("fold") != 1), 0).otherwise(F.col("y")))


add("p5_mask_untrained", lambda s, d: metrics.mask_untrained(rare(s, d)).groupBy("class_id", "fold").agg(F.count("score").alias("scored"), F.count("*").alias("n")),
    """WITH rare AS (SELECT * REPLACE (CASE WHEN class_id = 2 AND fold <> 1 THEN 0 ELSE y END AS y) FROM scores WHERE model = 'a'), p AS (SELECT class_id, fold, sum(y) AS own, sum(sum(y)) OVER (PARTITION BY class_id) AS every FROM rare GROUP BY class_id, fold)
    SELECT class_id, fold, count(CASE WHEN every - own > 0 THEN score END) AS scored, count(*) AS n FROM rare JOIN p USING (class_id, fold) GROUP BY ALL""")
MASK = "SELECT class_id FROM (SELECT class_id, model, sum(y) > 0 AND sum(1 - y) > 0 AND count(*) = count(score) AS ok FROM {t} GROUP BY ALL) GROUP BY class_id HAVING bool_and(ok)"
add("p6_common_evaluable_mask", lambda s, d: metrics.evaluable(fx.scores(s, d)), MASK.format(t="scores"))
add("p7_fixed_mask_with_definedness", lambda s, d: metrics.auc(sc := fx.scores(s, d), ["model", "class_id", "fold"]).join(metrics.evaluable(sc), "class_id", "left_semi").groupBy("fold").agg(F.count("auc").alias("defined"), F.count("*").alias("n")),
    f"SELECT fold, count(a) AS defined, count(*) AS n FROM (SELECT model, class_id, fold, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN 1 END AS a FROM scores SEMI JOIN ({MASK.format(t='scores')}) m USING (class_id) GROUP BY ALL) GROUP BY fold")
add("p8_missing_as_zero", lambda s, d: r9(shift.domain_auc(fx.scores(s, d, "b"), "zero"), "auc"), f"SELECT class_id, round(auc, 9) AS auc, pos FROM ({fx.auc_sql('(SELECT * REPLACE (coalesce(score, 0) AS score) FROM scores WHERE model = $$b$$)', 'class_id')})")
add("g5_missing_policies", lambda s, d: r9(shift.domain_auc(fx.scores(s, d, "b"), "kill").withColumn("policy", F.lit("kill")).unionByName(shift.domain_auc(fx.scores(s, d, "b"), "skip").withColumn("policy", F.lit("skip"))), "auc"),
    f"WITH k AS ({fx.auc_sql('(SELECT * FROM scores WHERE model = $$b$$)', 'class_id')}) SELECT class_id, round(auc, 9) AS auc, pos, 'skip' AS policy FROM k UNION ALL SELECT class_id, round(auc, 9), pos, 'kill' FROM k WHERE class_id <> 4")


def train(s, d):
    b = fx.base(s, d)
    text = F.concat(F.lit("['"), F.col("own").cast("string"), F.lit("', \"zz\", '"), ((F.col("own") + 2) % 7).cast("string"), F.lit("']"))
    return b.select("row_id", F.col("own").cast("string").alias("primary_label"), F.when(F.col("row_id") % 3 == 0, text).otherwise("none").alias("secondary_labels"))


def classes(s):
    return s.createDataFrame([(k, str(k)) for k in range(5)], "class_id int, primary_label string")


add("p9_multi_hot", lambda s, d: labels.primary_and_secondary(train(s, d), classes(s), dense=True).groupBy("class_id").agg(F.sum("y").alias("pos"), F.count("*").alias("n")),
    "SELECT class_id, CAST(sum(CASE WHEN class_id = own OR (row_id % 3 = 0 AND class_id = (own + 2) % 7) THEN 1 ELSE 0 END) AS BIGINT) AS pos, count(*) AS n FROM base, (SELECT CAST(unnest(range(5)) AS INTEGER) AS class_id) GROUP BY class_id")
add("p10_window_labels", lambda s, d: labels.window_labels(fx.base(s, d).select("row_id", F.concat_ws("; ", F.col("own").cast("string"), ((F.col("own") + 1) % 6).cast("string")).alias("primary_label")), classes(s)).groupBy("class_id").agg(F.count("*").alias("pos")),
    "SELECT class_id, count(*) AS pos FROM base, (SELECT CAST(unnest(range(5)) AS INTEGER) AS class_id) WHERE class_id = own OR class_id = (own + 1) % 6 GROUP BY class_id")
add("p11_scatter_shards", lambda s, d: labels.scattered(fx.truth(s, d), fx.scores(s, d, "a").filter("fold <> 2")).groupBy("fold").agg(F.count("score").alias("scored"), F.count("*").alias("n")),
    "SELECT fold, count(CASE WHEN fold <> 2 THEN score END) AS scored, count(*) AS n FROM scores WHERE model = 'a' GROUP BY fold")
add("p12_pivot_and_stack", lambda s, d: fx.scores(s, d).groupBy("row_id", "class_id").pivot("model", ["a", "b", "c"]).agg(F.first("score")).unpivot(["row_id", "class_id"], ["a", "b", "c"], "model", "score").groupBy("model").agg(F.count("score").alias("scored"), F.count("*").alias("n")),
    "SELECT model, count(score) AS scored, count(*) AS n FROM scores GROUP BY model")


def zero_shot(s, d, how="max"):
    heads = fx.vectors(s, d).select("row_id", F.transform("embedding", lambda x: fn.sigmoid(x.cast("double"))).alias("probs"))
    mapping = s.range(10).select(F.col("id").cast("int").alias("class_id"), F.when(F.col("id") == 9, F.array().cast("array<int>")).otherwise(F.sequence(F.col("id").cast("int"), F.lit(59), F.lit(10))).alias("idxs"))
    return labels.mapped_scores(heads, mapping, how)


HEAD = "h AS (SELECT vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS dim, 1 / (1 + exp(-CAST(unnest(embedding) AS DOUBLE))) AS p FROM embeddings), c AS (SELECT row_id, CAST(dim % 10 AS INTEGER) AS class_id, {agg} AS score FROM h WHERE dim < 60 AND dim % 10 <> 9 GROUP BY ALL)"
TOLD = "SELECT class_id, round(sum(score), 6) AS score, count(score) AS n FROM c GROUP BY class_id UNION ALL SELECT 9, NULL, 0"


def told(df):
    return df.groupBy("class_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("score").alias("n"))


add("p13_gather_max", lambda s, d: told(zero_shot(s, d)), f"WITH {HEAD.format(agg='max(p)')} {TOLD}")
add("f3_noisy_or", lambda s, d: told(zero_shot(s, d, "noisy_or")), f"WITH {HEAD.format(agg='1 - product(1 - p)')} {TOLD}")
add("f1_sigmoid_f2_logit", lambda s, d: fx.vectors(s, d).select("class_id", F.explode("embedding").alias("x")).select("class_id", fn.sigmoid(F.col("x").cast("double")).alias("p")).groupBy("class_id").agg(F.round(F.sum("p"), 6).alias("p"), F.round(F.sum(fn.logit(F.col("p"))), 6).alias("z")),
    "SELECT label AS class_id, round(sum(p), 6) AS p, round(sum(ln(p / (1 - p))), 6) AS z FROM (SELECT label, least(greatest(1 / (1 + exp(-CAST(unnest(embedding) AS DOUBLE))), 1e-6), 1 - 1e-6) AS p FROM embeddings) GROUP BY 1")
add("f4_mean_candidate", lambda s, d: metrics.with_mean(fx.scores(s, d)).filter("model = 'mean'").groupBy("class_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("score").alias("n")),
    "SELECT class_id, round(sum(score), 6) AS score, count(score) AS n FROM cands WHERE model = 'mean' GROUP BY class_id")
add("p14_factorize", lambda s, d: labels.factorized(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "code").groupBy("o_orderpriority").agg(F.max("code").alias("code"), F.count("*").alias("n")),
    "SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS code, count(*) AS n FROM orders GROUP BY 1")
add("p15_ordinals", lambda s, d: labels.numbered(table(s, d, "orders").select("o_orderkey"), "cache_row", ["o_orderkey"]), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS cache_row FROM orders")
add("p16_class_dictionary", lambda s, d: fx.base(s, d).withColumn("code", F.concat(F.lit("k"), F.col("own"))).join(F.broadcast(classes(s).withColumn("code", F.concat(F.lit("k"), "primary_label"))), "code").groupBy("code", "class_id").agg(F.count("*").alias("n")),
    "SELECT 'k' || own AS code, own AS class_id, count(*) AS n FROM base GROUP BY ALL")

add("j1_metadata_join", lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_name").isNull()).alias("missing")),
    "SELECT c_mktsegment, count(*) AS n, CAST(count_if(c_name IS NULL) AS BIGINT) AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("j3_common_classes", lambda s, d: metrics.evaluable(fx.scores(s, d, "b")).join(metrics.evaluable(fx.scores(s, d, "c")), "class_id"),
    MASK.format(t="(SELECT * FROM scores WHERE model = 'b')") + " INTERSECT " + MASK.format(t="(SELECT * FROM scores WHERE model = 'c')"))
add("j4_three_way_intersection", lambda s, d: fx.base(s, d).filter("fold = 0").select("author").intersect(fx.base(s, d).filter("two").select("author")).intersect(fx.base(s, d).filter("own = 1").select("author")),
    "SELECT author FROM base WHERE fold = 0 INTERSECT SELECT author FROM base WHERE two INTERSECT SELECT author FROM base WHERE own = 1")
add("j5_anti_join", lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def two_stage(s, d):
    n = table(s, d, "nation")
    taxonomy = n.select(F.col("n_nationkey").alias("class_id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("code"), "n_nationkey")).otherwise("absent").alias("primary_label"), F.upper("n_name").alias("scientific_name"))
    words = n.filter("n_nationkey % 5 <> 1").select(F.col("n_nationkey").alias("idx"), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("code"), "n_nationkey")).otherwise("no_ebird_code").alias("code"), F.initcap("n_name").alias("name"))
    return labels.vocabulary_map(taxonomy, words).select("class_id", "stage", F.array_join(F.col("idxs").cast("array<string>"), "|").alias("idxs"))


add("j6_two_stage_fallback", two_stage, "SELECT n_nationkey AS class_id, CASE WHEN n_nationkey % 5 = 1 THEN 'unmapped' WHEN n_nationkey % 4 = 0 THEN 'code' ELSE 'name' END AS stage, CASE WHEN n_nationkey % 5 = 1 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END AS idxs FROM nation")


def fitted(s, d):
    a, b = fx.scores(s, d, "a"), fx.scores(s, d, "c")
    return a.join(b.select("row_id", "class_id", F.col("score").alias("other")), ["row_id", "class_id"]).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("score") - F.col("other"))), 9).alias("gap"))


add("j7_aligned_matrices", fitted, "SELECT count(*) AS n, round(max(abs(a.score - c.score)), 9) AS gap FROM scores a JOIN scores c USING (row_id, class_id) WHERE a.model = 'a' AND c.model = 'c'")
add("j9_pairs_of_folds", lambda s, d: (f := fx.base(s, d).select("fold").distinct()).select(F.col("fold").alias("a")).join(f.select(F.col("fold").alias("b")), F.col("a") < F.col("b")), "SELECT x.fold AS a, y.fold AS b FROM (SELECT DISTINCT fold FROM base) x JOIN (SELECT DISTINCT fold FROM base) y ON x.fold < y.fold")
add("j10_pair_kernel", lambda s, d: shift.pair_distances(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 40).agg(F.round(F.sum(F.exp(-0.01 * F.col("d2"))), 6).alias("k"), F.count("*").alias("n")),
    f"WITH s AS (SELECT vec_id, embedding AS e FROM embeddings ORDER BY {fx.draw_sql('0', 'vec_id')}, vec_id LIMIT 40) SELECT round(sum(exp(-0.01e0 * list_sum(list_transform(list_zip(a.e, b.e), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))))), 6) AS k, count(*) AS n FROM s a JOIN s b ON a.vec_id < b.vec_id")
#: The same with the reference's size, without SQL; a test holds it to brute force.
add("j10_pair_kernel_2000", lambda s, d: shift.pair_distances(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 2000).agg(F.round(F.sum(F.exp(-0.01 * F.col("d2"))), 6).alias("k"), F.count("*").alias("n")))

add("t1_largest_drops", lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC NULLS LAST, class_id) AS rank FROM scores WHERE model = 'b' QUALIFY score IS NOT NULL)"
add("t2_top_k_per_row", lambda s, d: shift.pseudo_labels(fx.scores(s, d, "b"), 2).select("row_id", "class_id", "rank"), f"WITH {TOP} SELECT row_id, class_id, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 2")
add("t3_covered_classes", lambda s, d: shift.covered_classes(fx.scores(s, d, "b")), f"WITH {TOP} SELECT CAST(k AS INTEGER) AS k, count(DISTINCT class_id) AS classes FROM top, (SELECT unnest([1, 2, 3, 5]) AS k) WHERE rank <= k GROUP BY k")
add("t4_max_probability_percentiles", lambda s, d: r9(metrics.quantiles(fx.scores(s, d, "a").groupBy("row_id").agg(F.max("score").alias("m")), [], "m", {f"p{p}": p / 100 for p in (50, 75, 90, 95, 99)}), "p50", "p75", "p90", "p95", "p99"),
    "SELECT " + ", ".join(f"round(quantile_cont(m, {p / 100}), 9) AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM (SELECT row_id, max(score) AS m FROM scores WHERE model = 'a' GROUP BY 1)")
add("t5_best_single_model", lambda s, d: metrics.macro_auc(fx.scores(s, d, "ac")).withColumn("k", F.row_number().over(Window.orderBy(F.desc("macro"), "model"))).filter("k = 1").select("model", F.round("macro", 9).alias("macro")),
    f"SELECT model, round(avg(auc), 9) AS macro FROM ({fx.auc_sql('scores', 'model, class_id')}) WHERE model IN ('a', 'c') GROUP BY model ORDER BY avg(auc) DESC, model LIMIT 1")
add("t6_top_five_indices", lambda s, d: fx.vectors(s, d).select("row_id", F.array_join(F.transform(F.slice(F.sort_array(F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, 5), lambda e: e["i"]), ",").alias("top")),
    "SELECT row_id, string_agg(CAST(dim AS VARCHAR), ',' ORDER BY k) AS top FROM (SELECT vec_id AS row_id, dim, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS k FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM embeddings)) WHERE k <= 5 GROUP BY row_id")
add("t7_sorted_unique", lambda s, d: table(s, d, "events").select("event_type").distinct().orderBy("event_type"), "SELECT DISTINCT event_type FROM events ORDER BY 1")
add("t8_sample_without_replacement", lambda s, d: shift.sampled(table(s, d, "events").select("event_id"), "event_id", 25, 9), f"SELECT event_id FROM (SELECT event_id FROM events ORDER BY {fx.draw_sql('9', 'event_id')}, event_id LIMIT 25) ORDER BY event_id")

add("u1_union_of_masks", lambda s, d: fx.base(s, d).filter("fold = 0").select("author").union(fx.base(s, d).filter("own = 4").select("author")).distinct(), "SELECT author FROM base WHERE fold = 0 UNION SELECT author FROM base WHERE own = 4")
add("u2_intersection", lambda s, d: fx.base(s, d).select("author").intersect(table(s, d, "nation").select(F.col("n_nationkey").cast("bigint"))), "SELECT author FROM base INTERSECT SELECT n_nationkey FROM nation")
add("u3_difference", lambda s, d: table(s, d, "nation").select("n_nationkey").exceptAll(table(s, d, "customer").filter("c_acctbal > 9000").select("c_nationkey").distinct()), "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
add("u4_append_training_rows", lambda s, d: fx.truth(s, d).withColumn("part", F.lit("focal")).unionByName(fx.truth(s, d).filter("fold = 1 and y = 1").withColumn("part", F.lit("pseudo"))).groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("pos")),
    "SELECT 'focal' AS part, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM truth UNION ALL SELECT 'pseudo', count(*), CAST(sum(y) AS BIGINT) FROM truth WHERE fold = 1 AND y = 1")
add("u5_vertical_stack", lambda s, d: table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(s, d, "customer").select("c_nationkey")).groupBy("k").agg(F.count("*").alias("n")), "SELECT k, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY k")

add("f8_genus_token", lambda s, d: table(s, d, "part").select(fn.genus(F.regexp_replace("p_name", "_", " ")).alias("genus")).groupBy("genus").agg(F.count("*").alias("n")), r"SELECT lower(regexp_split_to_array(trim(replace(p_name, '_', ' ')), '\s+')[1]) AS genus, count(*) AS n FROM part GROUP BY 1")
add("f9_string_functions", lambda s, d: stages(s, d).select("class_id", F.array_join(F.split(F.lower(F.trim("primary_label")), "_"), "-").alias("label")), f"WITH {STAGES} SELECT class_id, replace(lower(trim(primary_label)), '_', '-') AS label FROM stages")
add("f10_clock_to_seconds", lambda s, d: table(s, d, "events").select("event_id", fn.seconds(F.date_format("ts", "HH:mm:ss")).alias("sec")), "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS sec FROM events")
add("f11_list_literal", lambda s, d: train(s, d).select("row_id", F.array_join(fn.list_literal(F.col("secondary_labels")), "|").alias("codes")), "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN own || '|zz|' || ((own + 2) % 7) ELSE '' END AS codes FROM base")
add("f12_normal_tail", lambda s, d: s.range(9).select(F.col("id"), F.round(fn.normal_upper((F.col("id") - 4).cast("double")), 12).alias("p"), F.round(fn.normal_ppf((F.col("id") + 1) / 10), 9).alias("z")))
add("f13_clip_where", lambda s, d: fx.vectors(s, d).select("class_id", F.explode("embedding").alias("x")).groupBy("class_id").agg(F.round(F.sum(fn.clip(F.col("x").cast("double"), -0.5, 0.5)), 6).alias("v")),
    "SELECT label AS class_id, round(sum(greatest(least(x, 0.5), -0.5)), 6) AS v FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
add("f14_half_and_single", lambda s, d: fx.scores(s, d, "a").groupBy("score").agg(F.count("*").alias("n")).select("score", "n", F.col("score").cast("float").cast("double").alias("single"), fn.half("score").alias("half")))
add("f16_round_half_even", lambda s, d: table(s, d, "customer").select("c_custkey", F.bround((F.col("c_custkey") % 8).cast("double") / 16, 3).alias("v")), "SELECT c_custkey, round_even(CAST(c_custkey % 8 AS DOUBLE) / 16, 3) AS v FROM customer")
add("s9_json_fields", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
add("x34_window_grid", lambda s, d: shift.window_grid(table(s, d, "nation").select(F.col("n_name").alias("filename")), [0, 5, 10]), "SELECT n_name AS filename, CAST(k AS INTEGER) AS start_sec, CAST(k + 5 AS INTEGER) AS end_sec FROM nation, (SELECT unnest([0, 5, 10]) AS k)")
add("x39_map_audit", lambda s, d: stages(s, d).join(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("class_id")).agg(F.count("*").alias("pos")), "class_id", "left").groupBy("stage").agg(F.sum(F.coalesce("pos", F.lit(0))).alias("pos"), F.count("*").alias("classes")),
    f"WITH {STAGES} SELECT stage, CAST(sum(coalesce(pos, 0)) AS BIGINT) AS pos, count(*) AS classes FROM stages LEFT JOIN (SELECT c_nationkey AS class_id, count(*) AS pos FROM customer GROUP BY 1) USING (class_id) GROUP BY stage")
add("x40_range_check", lambda s, d: r9(fx.scores(s, d).groupBy("model").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"), F.bool_and((F.col("score") >= 0) & (F.col("score") <= 1)).alias("fine")), "mean"),
    "SELECT model, min(score) AS low, max(score) AS high, round(avg(score), 9) AS mean, bool_and(score BETWEEN 0 AND 1) AS fine FROM scores GROUP BY model")
