"""Audit tables made of the test tables, the same in Spark and in DuckDB.

board: orders are rows, the five priorities classes; an order of status F has the next class as a second label. Authors
are customers mod 40 and folds customers mod 5, so an author is in one fold. Three models score in integer steps, with
many ties; model b misses class 4 in fold 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = (("a", 0, 31, 17, 40), ("b", 1, 57, 29, 60), ("c", 2, 83, 11, 25))
CLASSES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 40).alias("author"), (F.col("o_custkey") % 5).cast("int").alias("fold"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("own"), (F.col("o_orderstatus") == "F").alias("two"), "o_totalprice",
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    y = (F.col("class_id") == F.col("own")) | (F.col("two") & (F.col("class_id") == (F.col("own") + 1) % 5))
    return rows.select("row_id", "class_id", y.cast("int").alias("y"), "fold", "author")


def packed(spark: SparkSession, sf_dir: str, models: str = "abc") -> DataFrame:
    """The models' scores side by side, as matrices with the same rows are read: scores, an array of (model, ord, score)."""

    def one(m: str, o: int, a: int, b: int, k: int):
        value = ((F.col("row_id") * a + F.col("class_id") * b) % 97 + k * F.col("y")).cast("double") / 160.0
        there = ~((F.col("fold") == 0) & (F.col("class_id") == 4)) if m == "b" else F.lit(True)
        return F.struct(F.lit(m).alias("model"), F.lit(o).alias("ord"), F.when(there, value).alias("score"))

    return truth(spark, sf_dir).withColumn("scores", F.array(*[one(*m) for m in MODELS if m[0] in models]))


def scores(spark: SparkSession, sf_dir: str, models: str = "abc") -> DataFrame:
    t = packed(spark, sf_dir, models).withColumn("m", F.explode("scores"))
    return t.select("row_id", "class_id", "y", "fold", "author", *[F.col(f"m.{c}").alias(c) for c in ("model", "ord", "score")])


def vectors(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("class_id"), (F.col("vec_id") % 5).cast("int").alias("fold"), (F.col("vec_id") % 40).alias("author"))


def mean_sql(order: str) -> str:
    """SQL of operators.metrics.ordered_mean."""
    return f"list_reduce(list(score ORDER BY {order}) FILTER (score IS NOT NULL), lambda p, q: p + q) / count(score)"


SQL = f"""
base AS (SELECT o_orderkey AS row_id, o_custkey % 40 AS author, CAST(o_custkey % 5 AS INTEGER) AS fold, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS own, o_orderstatus = 'F' AS two, o_totalprice FROM orders),
truth AS (SELECT row_id, class_id, CASE WHEN class_id = own OR (two AND class_id = (own + 1) % 5) THEN 1 ELSE 0 END AS y, fold, author
          FROM base, (SELECT CAST(unnest(range(5)) AS INTEGER) AS class_id)),
scores AS (SELECT row_id, class_id, y, fold, author, model, ord,
           CASE WHEN NOT (model = 'b' AND fold = 0 AND class_id = 4) THEN CAST((row_id * a + class_id * b) % 97 + k * y AS DOUBLE) / 160e0 END AS score
           FROM truth, (VALUES ('a', 0, 31, 17, 40), ('b', 1, 57, 29, 60), ('c', 2, 83, 11, 25)) m(model, ord, a, b, k)),
cands AS (SELECT row_id, class_id, y, fold, author, model, ord, score FROM scores
          UNION ALL SELECT row_id, class_id, y, fold, author, 'mean', 99, CASE WHEN count(*) = count(score) THEN {mean_sql('ord')} END FROM scores GROUP BY ALL)
"""


def auc_sql(source: str, keys: str, cast: str = "DOUBLE") -> str:
    """SQL of ROC-AUC by average ranks."""
    return f"""SELECT {keys}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(y * r) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) END AS auc,
    CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
    FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY CAST(score AS {cast})) + (count(*) OVER (PARTITION BY {keys}, CAST(score AS {cast})) - 1) / 2e0 AS r
          FROM (SELECT * FROM {source}) WHERE score IS NOT NULL) GROUP BY {keys}"""


def wauc_sql(source: str, keys: str) -> str:
    """SQL of weighted ROC-AUC; source has w."""
    return f"""SELECT {keys}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (coalesce(below, 0) + 0.5e0 * n)) / (CAST(sum(p) AS DOUBLE) * sum(n)) END AS auc
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
          FROM (SELECT {keys}, score, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM {source} WHERE score IS NOT NULL GROUP BY {keys}, score)) GROUP BY {keys}"""


def draw_sql(*parts: str) -> str:
    """SQL of functions.scalar.hash_draw."""
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8) AS BIGINT)"


def slot_sql(seed: str) -> str:
    """SQL of the draw of slot in rep, operators.draws.drawn."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(rep AS VARCHAR), CAST(slot // 4 AS VARCHAR))), CAST(1 + 8 * (slot % 4) AS INTEGER), 8) AS BIGINT)"


def dealt_sql(reps: int, seed: int) -> str:
    """CTE g: rep, row_id and giver, the row of the same author whose values it gets; SQL of operators.draws.image."""
    mix = lambda x: f"((({x}) * ({x})) % 2147483647 * 48271 + ({x})) % 2147483647"
    rounds, stages = 6, "SELECT *, y // b AS l0, y % b AS r0 FROM {source}"
    for k in range(rounds):
        own, other, side = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        stages = f"SELECT *, {mix(f'(h + rep * 69621 + {k * 16807}) % 2147483647')} AS key{k} FROM ({stages})"
        stages = f"SELECT *, {mix(f'({other}{k} + key{k}) % 2147483647')} AS once{k} FROM ({stages})"
        stages = f"SELECT *, ({own}{k} + {mix(f'once{k}')}) % {side} AS {own}{k + 1}, {other}{k} AS {other}{k + 1} FROM ({stages})"
    turn = lambda source: f"SELECT rep, row_id, author, k, size, a, b, h, l{rounds} * b + r{rounds} AS y FROM ({stages.replace('{source}', source)})"
    return f"""pl AS (SELECT row_id, author, row_number() OVER (PARTITION BY author ORDER BY row_id) - 1 AS k, count(*) OVER (PARTITION BY author) AS size FROM base),
    st AS (SELECT rep, row_id, author, k, size, CAST(ceil(sqrt(size)) AS BIGINT) AS a, CAST(ceil(size / ceil(sqrt(size))) AS BIGINT) AS b, {draw_sql(str(seed), 'author')} % 2147483647 AS h, k AS y FROM pl, (SELECT unnest(range({reps})) AS rep)),
    walk AS (WITH RECURSIVE wk AS ({turn('st')} UNION ALL {turn('(SELECT * FROM wk WHERE y >= size)')}) SELECT * FROM wk WHERE y < size),
    g AS (SELECT w.rep, w.row_id, o.row_id AS giver FROM walk w JOIN pl o ON o.author = w.author AND o.k = w.y)"""
