"""Queries of masks, AUC, aggregations and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.functions import scalar as fn
from tallywright.operators import labels, metrics, shift
from tallywright.plans import fixtures as fx
from tallywright.plans.fixtures import SQL, auc_sql, mean_sql, table, wauc_sql

Q: dict = {}
S: dict = {}


def add(name, run, sql=None):
    Q[name] = run
    if sql:
        S[name] = f"WITH {SQL} {sql}" if not sql.lstrip().startswith("WITH") else sql.replace("WITH", f"WITH {SQL},", 1)


def r9(df, *columns):
    """Rounded to 9 places, as sums differ in their last digits between engines."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


MASK = "SELECT class_id FROM (SELECT class_id, model, sum(y) > 0 AND sum(1 - y) > 0 AND count(*) = count(score) AS ok FROM scores GROUP BY ALL) GROUP BY class_id HAVING bool_and(ok)"

add("a1_auc_ties", lambda s, d: r9(metrics.auc(fx.scores(s, d), ["model", "class_id"]), "auc"),
    f"SELECT model, class_id, round(auc, 9) AS auc, pos, neg FROM ({auc_sql('scores', 'model, class_id')})")
add("a1_auc_single_precision", lambda s, d: r9(metrics.auc(fx.scores(s, d), ["model", "class_id", "fold"], single=True), "auc"),
    f"SELECT model, class_id, fold, round(auc, 9) AS auc, pos, neg FROM ({auc_sql('scores', 'model, class_id, fold', 'FLOAT')})")
add("a2_auc_by_ranks", lambda s, d: r9(metrics.rank_auc(fx.scores(s, d), ["model", "class_id"]), "auc"),
    f"SELECT model, class_id, round(auc, 9) AS auc FROM ({auc_sql('scores', 'model, class_id')})")
add("a4_macro_auc_on_mask", lambda s, d: r9(metrics.macro_auc(sc := fx.scores(s, d), metrics.evaluable(sc)), "macro"),
    f"WITH mask AS ({MASK}) SELECT model, round(coalesce(avg(auc), 0), 9) AS macro, count(auc) AS classes FROM ({auc_sql('scores SEMI JOIN mask USING (class_id)', 'model, class_id')}) GROUP BY model")
add("a5_macro_auc_shared_mask", lambda s, d: r9(metrics.macro_auc(sc := fx.scores(s, d, "ac"), metrics.evaluable(sc, ["a", "c"]), empty=None), "macro"),
    f"SELECT model, round(avg(auc), 9) AS macro, count(auc) AS classes FROM ({auc_sql('scores', 'model, class_id')}) WHERE model IN ('a', 'c') GROUP BY model")
add("a6_macro_auc_self_mask", lambda s, d: r9(metrics.macro_auc(fx.scores(s, d)), "macro"),
    f"SELECT model, round(avg(auc), 9) AS macro, count(auc) AS classes FROM ({auc_sql('scores', 'model, class_id')}) GROUP BY model")
add("a7_macro_auc_class_list", lambda s, d: r9(metrics.macro_auc(fx.scores(s, d).filter(F.col("class_id").isin(1, 3))), "macro"),
    f"SELECT model, round(avg(auc), 9) AS macro, count(auc) AS classes FROM ({auc_sql('scores', 'model, class_id')}) WHERE class_id IN (1, 3) GROUP BY model")


def scorer_check(s, d):
    sc = fx.scores(s, d)
    both = metrics.auc(sc, ["model", "class_id"]).join(metrics.rank_auc(sc, ["model", "class_id"]).withColumnRenamed("auc", "other"), ["model", "class_id"])
    return both.agg((F.max(F.abs(F.col("auc") - F.col("other"))) < 1e-6).alias("agree"), F.count("*").alias("n"))


add("a8_scorer_cross_check", scorer_check,
    f"SELECT max(abs(r.auc - c.auc)) < 1e-6 AS agree, count(*) AS n FROM ({auc_sql('scores', 'model, class_id')}) r JOIN ({wauc_sql('(SELECT *, 1 AS w FROM scores)', 'model, class_id')}) c USING (model, class_id)")
add("a9_distinct_folds_per_author", lambda s, d: fx.base(s, d).groupBy("author").agg(F.countDistinct("fold").alias("folds")).filter("folds >= 1"),
    "SELECT author, count(DISTINCT fold) AS folds FROM base GROUP BY author HAVING count(DISTINCT fold) >= 1")
add("a10_duplicates", lambda s, d: table(s, d, "orders").agg((F.count("*") - F.countDistinct("o_custkey")).alias("duplicated")),
    "SELECT count(*) - count(DISTINCT o_custkey) AS duplicated FROM orders")
add("a11_value_counts", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
add("a12_conditional_counts", lambda s, d: fx.truth(s, d).groupBy("fold", "class_id").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("rows")),
    "SELECT fold, class_id, count_if(y = 1)::BIGINT AS pos, count(*) AS rows FROM truth GROUP BY ALL")


def seeds(s, d):
    """Model a as five seeds: its scores with small steps, missing where (row + seed) mod 11 is 0."""
    sc = fx.scores(s, d, "a").withColumn("seed", F.explode(F.sequence(F.lit(41), F.lit(45))))
    value = F.col("score") + ((F.col("row_id") * F.col("seed")) % 7).cast("double") / 100
    return sc.withColumn("score", F.when((F.col("row_id") + F.col("seed")) % 11 != 0, value))


SEEDS = """seeds AS (SELECT row_id, class_id, y, fold, author, model, seed,
  CASE WHEN (row_id + seed) % 11 <> 0 THEN score + CAST((row_id * seed) % 7 AS DOUBLE) / 100e0 END AS score
  FROM scores, (SELECT unnest(range(41, 46)) AS seed) WHERE model = 'a')"""


def seed_spread(s, d):
    per = metrics.macro_auc(seeds(s, d), keys=("seed",))
    return r9(per.agg(F.avg("macro").alias("mean"), F.stddev_pop("macro").alias("std"), F.min("macro").alias("low"), F.max("macro").alias("high")), "mean", "std", "low", "high")


add("a13_seed_ensemble", lambda s, d: r9(labels.seed_ensemble(seeds(s, d)).groupBy("class_id").agg(F.avg("score").alias("score"), F.count("score").alias("n")), "score"),
    f"WITH {SEEDS} SELECT class_id, round(avg(score), 9) AS score, count(score) AS n FROM (SELECT row_id, class_id, {mean_sql('seed')} AS score FROM seeds GROUP BY ALL) GROUP BY class_id")
add("a13_seed_spread", seed_spread,
    f"WITH {SEEDS} SELECT round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std, round(min(m), 9) AS low, round(max(m), 9) AS high FROM (SELECT seed, avg(auc) AS m FROM ({auc_sql('seeds', 'seed, class_id')}) GROUP BY seed)")
add("a14_replicate_summary", lambda s, d: r9(metrics.summary(table(s, d, "events"), "value", ("event_type",)), "mean", "lo", "hi", "se", "mde"),
    "SELECT event_type, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi, round(stddev_samp(value), 9) AS se, round(1.96e0 * stddev_samp(value), 9) AS mde, count(value) AS n FROM events GROUP BY 1")
add("a15_null_summary", lambda s, d: r9(metrics.null_summary(table(s, d, "events"), "value"), "mean", "p5", "p95", "max", "std"),
    "SELECT round(avg(value), 9) AS mean, round(quantile_cont(value, 0.05), 9) AS p5, round(quantile_cont(value, 0.95), 9) AS p95, round(max(value), 9) AS max, round(stddev_pop(value), 9) AS std, count(value) AS n FROM events")

PAIR = "pair AS (SELECT x.row_id, x.class_id, x.y, x.score AS x, z.score AS z FROM scores x JOIN scores z USING (row_id, class_id) WHERE x.model = 'a' AND z.model = 'b' AND x.score IS NOT NULL AND z.score IS NOT NULL)"
RANKED = PAIR + """, ranked AS (SELECT *, rank() OVER (PARTITION BY class_id ORDER BY x) + (count(*) OVER (PARTITION BY class_id, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY class_id ORDER BY z) + (count(*) OVER (PARTITION BY class_id, z) - 1) / 2e0 AS rz,
  CASE WHEN (x > 0.5) = (y = 1) THEN 1 ELSE 0 END AS p, CASE WHEN (z > 0.5) = (y = 1) THEN 1 ELSE 0 END AS q FROM pair),
n AS (SELECT class_id, corr(x, z) AS pearson, corr(rx, rz) AS spearman, CAST(count_if(p = 1 AND q = 1) AS DOUBLE) AS n11, CAST(count_if(p = 0 AND q = 0) AS DOUBLE) AS n00,
  CAST(count_if(p = 1 AND q = 0) AS DOUBLE) AS n10, CAST(count_if(p = 0 AND q = 1) AS DOUBLE) AS n01, count(*) AS n, sum(y) AS pos FROM ranked GROUP BY class_id)"""


def model_pair(s, d):
    sc = fx.scores(s, d)
    a = sc.filter("model = 'a'").select("row_id", "class_id", F.col("score").alias("x"))
    b = sc.filter("model = 'b'").select("row_id", "class_id", F.col("score").alias("z"))
    return a.join(b.hint("merge"), ["row_id", "class_id"]).filter("x is not null and z is not null")


add("a16_pearson", lambda s, d: r9(model_pair(s, d).agg(F.corr("x", "z").alias("pearson")), "pearson"), f"WITH {PAIR} SELECT round(corr(x, z), 9) AS pearson FROM pair")
add("a17_spearman", lambda s, d: r9(metrics.average_rank(metrics.average_rank(model_pair(s, d), ["class_id"], "x", "rx"), ["class_id"], "z", "rz").groupBy("class_id").agg(F.corr("rx", "rz").alias("spearman")), "spearman"),
    f"WITH {RANKED} SELECT class_id, round(spearman, 9) AS spearman FROM n")
add("a18_kendall", lambda s, d: r9(metrics.kendall(table(s, d, "nation").join(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("v")), "n_nationkey"), "n", "v"), "tau"),
    """WITH t AS (SELECT c_nationkey AS k, count(*) AS n, round(sum(c_acctbal), 2) AS v FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY 1),
    p AS (SELECT sign(a.n - b.n) AS sx, sign(a.v - b.v) AS sy FROM t a JOIN t b ON a.k < b.k)
    SELECT round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 9) AS tau, count(*) AS pairs FROM p""")
add("a19_complementarity", lambda s, d: r9(metrics.complementarity(fx.scores(s, d), "a", "b"), "pearson", "spearman", "q", "double_fault"),
    f"WITH {RANKED} SELECT class_id, round(pearson, 9) AS pearson, round(spearman, 9) AS spearman, round(CASE WHEN n11 * n00 + n01 * n10 <> 0 THEN (n11 * n00 - n01 * n10) / (n11 * n00 + n01 * n10) END, 9) AS q, round(n00 / n, 9) AS double_fault FROM n WHERE pos > 0 AND n >= 4")


def stages(s, d):
    """Nations as classes: the region is the class_name, the key mod 3 the stage."""
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    stage = F.when(F.col("n_nationkey") % 3 == 0, "unmapped").when(F.col("n_nationkey") % 3 == 1, "code").otherwise("name")
    return n.select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("primary_label"), F.col("r_name").alias("class_name"), stage.alias("stage"))


STAGES = "stages AS (SELECT n_nationkey AS class_id, n_name AS primary_label, r_name AS class_name, CASE n_nationkey % 3 WHEN 0 THEN 'unmapped' WHEN 1 THEN 'code' ELSE 'name' END AS stage FROM nation JOIN region ON n_regionkey = r_regionkey)"


def drop_table(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("class_id")).agg(F.round(F.avg("c_acctbal"), 4).alias("drop"), F.count("*").alias("focal_pos"), F.max("c_acctbal").alias("top"))
    return c.join(F.broadcast(stages(s, d)), "class_id").withColumnRenamed("class_name", "taxon")


DROPS = STAGES + ", drops AS (SELECT class_id, class_name AS taxon, stage, dr AS drop, focal_pos, top FROM stages JOIN (SELECT c_nationkey AS class_id, round(avg(c_acctbal), 4) AS dr, count(*) AS focal_pos, max(c_acctbal) AS top FROM customer GROUP BY 1) USING (class_id))"
add("a20_taxon_rollup", lambda s, d: shift.coverage(stages(s, d)),
    f"WITH {STAGES} SELECT class_name, CAST(count_if(stage <> 'unmapped') AS BIGINT) AS mapped, CAST(count_if(stage = 'unmapped') AS BIGINT) AS unmapped, count(*) AS classes FROM stages GROUP BY ROLLUP (class_name)")
add("a21_drop_by_taxon_and_stage", lambda s, d: r9(shift.drop_rollup(drop_table(s, d)), "mean", "median"),
    f"WITH {DROPS} SELECT taxon, stage, count(*) AS n, round(avg(\"drop\"), 9) AS mean, round(quantile_cont(\"drop\", 0.5), 9) AS median FROM drops GROUP BY GROUPING SETS ((taxon), (stage), ())")


def tail_sql(r):
    """Two-sided p of a correlation of n points: Student's distribution as a finite sum over its n - 2 degrees of freedom."""
    chain = lambda j, top, bottom: f"coalesce(list_product(list_transform(range(1, {j} + 1), lambda i: ({top}) / CAST({bottom} AS DOUBLE))), 1)"
    terms = lambda count, top, bottom: f"coalesce(list_sum(list_transform(range(0, CAST({count} AS BIGINT)), lambda j: {chain('j', top, bottom)} * pow(1 - {r} * {r}, j))), 0)"
    odd = f"1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * {terms('(n - 3) // 2', '2 * i', '2 * i + 1')})"
    even = f"1 - abs({r}) * {terms('(n - 2) // 2', '2 * i - 1', '2 * i')}"
    return f"CASE WHEN n >= 3 AND abs({r}) < 1 THEN CASE WHEN n % 2 = 1 THEN {odd} ELSE {even} END WHEN n >= 3 THEN 0e0 END"


add("a22_predictors_of_drop", lambda s, d: r9(shift.predictors(drop_table(s, d), "drop", ["focal_pos", "top"]), "pearson", "pearson_p", "spearman", "spearman_p"),
    f"""WITH {DROPS}, l AS (SELECT "drop" AS t, 'focal_pos' AS predictor, CAST(focal_pos AS DOUBLE) AS x FROM drops UNION ALL SELECT "drop", 'top', top FROM drops),
    k AS (SELECT *, rank() OVER (PARTITION BY predictor ORDER BY x) + (count(*) OVER (PARTITION BY predictor, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY predictor ORDER BY t) + (count(*) OVER (PARTITION BY predictor, t) - 1) / 2e0 AS rt FROM l),
    c AS (SELECT predictor, corr(x, t) AS pearson, corr(rx, rt) AS spearman, count(*) AS n FROM k GROUP BY predictor)
    SELECT predictor, round(pearson, 9) AS pearson, round({tail_sql('pearson')}, 9) AS pearson_p, round(spearman, 9) AS spearman, round({tail_sql('spearman')}, 9) AS spearman_p, n FROM c""")


def tertiles(s, d):
    prev = fx.truth(s, d).groupBy("class_id", "fold").agg(F.sum("y").alias("pos"))
    cut = metrics.quantiles(prev, [], "pos", {"c1": 1 / 3, "c2": 2 / 3})
    band = F.when(F.col("pos") <= F.col("c1"), "low").when(F.col("pos") <= F.col("c2"), "mid").otherwise("high")
    per = metrics.auc(fx.scores(s, d, "ac"), ["model", "class_id", "fold"]).select("model", "class_id", "fold", "auc")
    out = per.join(prev.crossJoin(F.broadcast(cut)), ["class_id", "fold"]).groupBy("model", band.alias("stratum")).agg(F.avg("auc").alias("macro"), F.count("auc").alias("n"))
    return r9(out, "macro")


add("a23_prevalence_tertiles", tertiles, f"""WITH prev AS (SELECT class_id, fold, sum(y) AS pos FROM truth GROUP BY ALL),
    cut AS (SELECT quantile_cont(pos, 1/3e0) AS c1, quantile_cont(pos, 2/3e0) AS c2 FROM prev),
    per AS ({auc_sql("scores", "model, class_id, fold")})
    SELECT model, CASE WHEN prev.pos <= c1 THEN 'low' WHEN prev.pos <= c2 THEN 'mid' ELSE 'high' END AS stratum, round(avg(auc), 9) AS macro, count(auc) AS n
    FROM per JOIN prev USING (class_id, fold), cut WHERE model IN ('a', 'c') GROUP BY 1, 2""")
add("a24_coverage_ceiling", lambda s, d: r9(shift.coverage_ceiling(stages(s, d).select((F.col("class_id") > 1).alias("evaluable"), (F.col("stage") != "unmapped").alias("mapped"))), "ceiling"),
    f"WITH {STAGES} SELECT CAST(count_if(stage <> 'unmapped') AS BIGINT) AS mapped, CAST(count_if(stage = 'unmapped') AS BIGINT) AS unmapped, round((count_if(stage <> 'unmapped') + 0.5e0 * count_if(stage = 'unmapped')) / count(*), 9) AS ceiling FROM stages WHERE class_id > 1")

HALF = "v AS (SELECT vec_id AS row_id, embedding AS e, label, vec_id % 2 AS side FROM embeddings), x AS (SELECT row_id, label, side, generate_subscripts(e, 1) - 1 AS dim, CAST(unnest(e) AS DOUBLE) AS x FROM v)"


def sides(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label", (F.col("vec_id") % 2).alias("side"))


add("a25_moment_shift", lambda s, d: r9(shift.moment_shift(sides(s, d), "side", "embedding", 0, 1), "l2", "std_ratio"),
    f"WITH {HALF}, m AS (SELECT side, dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY ALL) SELECT round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 9) AS l2, round(avg(b.s) / avg(a.s), 9) AS std_ratio FROM m a JOIN m b USING (dim) WHERE a.side = 0 AND b.side = 1")
D2 = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))"
PICK = "s AS (SELECT * FROM v WHERE row_id % 2 = {side} ORDER BY " + fx.draw_sql("0", "row_id") + ", row_id LIMIT 60)"
add("a26_mmd2", lambda s, d: r9(shift.mmd2(sides(s, d).filter("side = 0"), sides(s, d).filter("side = 1"), "row_id", "embedding", 0.01, 60), "mmd2"),
    f"""WITH {HALF}, s0 AS (SELECT * FROM v WHERE side = 0 ORDER BY {fx.draw_sql('0', 'row_id')}, row_id LIMIT 60), s1 AS (SELECT * FROM v WHERE side = 1 ORDER BY {fx.draw_sql('0', 'row_id')}, row_id LIMIT 60)
    SELECT round((SELECT avg(exp(-0.01e0 * {D2})) FROM s0 a JOIN s0 b ON a.row_id < b.row_id) + (SELECT avg(exp(-0.01e0 * {D2})) FROM s1 a JOIN s1 b ON a.row_id < b.row_id) - 2 * (SELECT avg(exp(-0.01e0 * {D2})) FROM s0 a, s1 b), 9) AS mmd2""")
add("a27_median_gamma", lambda s, d: r9(shift.median_gamma(sides(s, d), "row_id", "embedding", 100), "gamma"),
    f"WITH {HALF}, s AS (SELECT * FROM v ORDER BY {fx.draw_sql('0', 'row_id')}, row_id LIMIT 100) SELECT round(1 / (quantile_cont({D2}, 0.5) + 1e-12), 9) AS gamma FROM s a JOIN s b ON a.row_id < b.row_id")
#: The same with the reference's sizes, without SQL; tests hold them to brute force.
add("a26_mmd2_1500", lambda s, d: r9(shift.mmd2(sides(s, d).filter("side = 0"), sides(s, d).filter("side = 1"), "row_id", "embedding", 0.01, 1500), "mmd2"))
add("a27_median_gamma_2000", lambda s, d: r9(shift.median_gamma(sides(s, d), "row_id", "embedding", 2000), "gamma"))

TAXA = {0: "x", 1: "x", 2: "y", 3: "y", 4: "z"}


def taxa(s):
    return s.createDataFrame([(k, v) for k, v in TAXA.items()], "class_id int, taxon string")


from tallywright.operators import postproc  # noqa: E402

add("a28_taxon_mass", lambda s, d: r9(postproc.taxon_mass(fx.scores(s, d, "a"), taxa(s)).groupBy("taxon").agg(F.avg("mass").alias("mass"), F.avg("share").alias("share")), "mass", "share"),
    "WITH m AS (SELECT row_id, CASE WHEN class_id < 2 THEN 'x' WHEN class_id < 4 THEN 'y' ELSE 'z' END AS taxon, sum(coalesce(score, 0)) AS mass FROM scores WHERE model = 'a' GROUP BY ALL), k AS (SELECT *, mass / sum(mass) OVER (PARTITION BY row_id) AS share FROM m) SELECT taxon, round(avg(mass), 9) AS mass, round(avg(share), 9) AS share FROM k GROUP BY taxon")
GENUS = "CASE WHEN class_id < 2 THEN 'g' WHEN class_id < 4 THEN 'h' ELSE 'i' END"


def genera(s):
    return s.createDataFrame([(0, "g"), (1, "g"), (2, "h"), (3, "h"), (4, "i")], "class_id int, genus string")


def by_class(df):
    return r9(df.groupBy("class_id").agg(F.sum("score").alias("score"), F.max("score").alias("top"), F.count("score").alias("n")), "score", "top").withColumn("score", F.round("score", 4))


add("a29_genus_mean", lambda s, d: r9(fx.scores(s, d, "a").join(F.broadcast(genera(s)), "class_id").groupBy("row_id", "genus").agg(F.avg("score").alias("m")).groupBy("genus").agg(F.avg("m").alias("m"), F.count("*").alias("n")), "m"),
    f"SELECT genus, round(avg(m), 9) AS m, count(*) AS n FROM (SELECT row_id, {GENUS} AS genus, avg(score) AS m FROM scores WHERE model = 'a' GROUP BY ALL) GROUP BY genus")
add("f5_genus_smoothing", lambda s, d: by_class(postproc.genus_smoothing(fx.scores(s, d, "b"), genera(s))),
    f"WITH k AS (SELECT row_id, class_id, coalesce(score, 0) AS p, {GENUS} AS g FROM scores WHERE model = 'b'), m AS (SELECT class_id, CASE WHEN g <> 'i' THEN 0.9e0 * p + 0.1e0 * avg(p) OVER (PARTITION BY row_id, g) ELSE p END AS p FROM k) SELECT class_id, round(sum(p), 4) AS score, round(max(p), 9) AS top, count(p) AS n FROM m GROUP BY class_id")
add("f6_taxon_gate", lambda s, d: by_class(postproc.taxon_gate(fx.scores(s, d, "b"), taxa(s))),
    "WITH k AS (SELECT row_id, class_id, coalesce(score, 0) AS p, CASE WHEN class_id < 2 THEN 'x' WHEN class_id < 4 THEN 'y' ELSE 'z' END AS t FROM scores WHERE model = 'b'), m AS (SELECT class_id, p * pow(least(1e0, greatest(1e-6, sum(p) OVER (PARTITION BY row_id, t) / (sum(p) OVER (PARTITION BY row_id) + 1e-9))), 0.5e0) AS p FROM k) SELECT class_id, round(sum(p), 4) AS score, round(max(p), 9) AS top, count(p) AS n FROM m GROUP BY class_id")


def coords(s, d):
    b = fx.base(s, d)
    lat = F.when(F.col("row_id") % 13 != 0, (F.col("row_id") * 37 % 1009).cast("double"))
    return b.select("row_id", lat.alias("lat"), (F.col("row_id") * 53 % 887).cast("double").alias("lon"))


COORDS = "raw AS (SELECT row_id, CASE WHEN row_id % 13 <> 0 THEN CAST(row_id * 37 % 1009 AS DOUBLE) END AS lat, CAST(row_id * 53 % 887 AS DOUBLE) AS lon FROM base), coords AS (SELECT row_id, coalesce(lat, (SELECT quantile_cont(lat, 0.5) FROM raw)) AS lat, lon FROM raw)"
CELLS = COORDS + ", box AS (SELECT min(lat) a0, max(lat) a1, min(lon) o0, max(lon) o1 FROM coords), cells AS (SELECT row_id, least(59, greatest(0, CAST(trunc((lat - a0) / ((a1 - a0) / 60)) AS INTEGER))) AS i, least(59, greatest(0, CAST(trunc((lon - o0) / ((o1 - o0) / 60)) AS INTEGER))) AS j FROM coords, box)"
add("j2_median_imputation", lambda s, d: r9(postproc.imputed(coords(s, d)).agg(F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.count("lat").alias("n")), "lat", "lon"),
    f"WITH {COORDS} SELECT round(sum(lat), 9) AS lat, round(sum(lon), 9) AS lon, count(lat) AS n FROM coords")
add("a30_histogram_2d", lambda s, d: postproc.grid_cells(postproc.imputed(coords(s, d)), 60).groupBy("i", "j").agg(F.count("*").alias("n")),
    f"WITH {CELLS} SELECT i, j, count(*) AS n FROM cells GROUP BY i, j")
add("f7_spatial_prior", lambda s, d: by_class(postproc.spatial_prior(fx.scores(s, d, "a"), coords(s, d))))
add("w2_normalised_rank", lambda s, d: r9(postproc.normalised_rank(fx.scores(s, d, "a"), ["fold", "class_id"], "score", "row_id").groupBy("fold", "class_id").agg(F.sum(F.col("rank01") * F.col("y")).alias("r")), "r"),
    "WITH k AS (SELECT fold, class_id, y, (row_number() OVER (PARTITION BY fold, class_id ORDER BY score, row_id) - 1) / CAST(greatest(count(*) OVER (PARTITION BY fold, class_id) - 1, 1) AS DOUBLE) AS r FROM scores WHERE model = 'a') SELECT fold, class_id, round(sum(r * y), 9) AS r FROM k GROUP BY ALL")
add("w1_average_rank", lambda s, d: metrics.average_rank(fx.scores(s, d, "a"), ["class_id"], "score", "r").groupBy("class_id", "score").agg(F.max("r").alias("r"), F.count("*").alias("n")),
    "SELECT class_id, score, max(r) AS r, count(*) AS n FROM (SELECT class_id, score, rank() OVER (PARTITION BY class_id ORDER BY score) + (count(*) OVER (PARTITION BY class_id, score) - 1) / 2e0 AS r FROM scores WHERE model = 'a') GROUP BY ALL")
add("w3_group_head", lambda s, d: fx.base(s, d).withColumn("k", F.row_number().over(Window.partitionBy("fold").orderBy("row_id"))).filter("k <= 4").select("fold", "row_id", "k"),
    "SELECT fold, row_id, CAST(k AS INTEGER) AS k FROM (SELECT fold, row_id, row_number() OVER (PARTITION BY fold ORDER BY row_id) AS k FROM base) WHERE k <= 4")
add("w8_grid_bounds", lambda s, d: r9(coords(s, d).agg(F.min("lat").alias("low"), F.max("lat").alias("high")).crossJoin(metrics.quantiles(coords(s, d), [], "lon", {"q25": 0.25})), "q25"),
    f"WITH {COORDS} SELECT min(raw.lat) AS low, max(raw.lat) AS high, round(quantile_cont(lon, 0.25), 9) AS q25 FROM raw")
add("a31_verdict_rollup", lambda s, d: fx.scores(s, d).groupBy("model").agg(F.bool_and(F.col("score").isNotNull()).alias("all_there"), F.bool_or(F.col("score") > 0.9).alias("any_high"), F.count_if(F.col("score") > 0.5).alias("n"), F.max("score").alias("top")),
    "SELECT model, bool_and(score IS NOT NULL) AS all_there, bool_or(score > 0.9) AS any_high, CAST(count_if(score > 0.5) AS BIGINT) AS n, max(score) AS top FROM scores GROUP BY model")
add("a32_centroid_distance", lambda s, d: r9(shift.centroid_distance(sides(s, d), "side", "label", "embedding", 0, 1), "l2"),
    f"WITH {HALF}, m AS (SELECT side, label, dim, avg(x) AS m FROM x GROUP BY ALL) SELECT label, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 9) AS l2 FROM m a JOIN m b USING (label, dim) WHERE a.side = 0 AND b.side = 1 GROUP BY label")
add("f15_distances", lambda s, d: r9(sides(s, d).groupBy("label").agg(F.sum(fn.l2(F.col("embedding"))).alias("l2")), "l2"),
    f"WITH {HALF} SELECT label, round(sum(n), 9) AS l2 FROM (SELECT row_id, label, sqrt(sum(x * x)) AS n FROM x GROUP BY ALL) GROUP BY label")
