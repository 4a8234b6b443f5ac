"""The jobs as queries: each runs twice over the whole tables into one new folder, and returns what stands there then."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import fold_audit, score_ledger
from jobs.common import config_of
from tallywright.plans.fixtures import draw_sql
from tallywright.sources.scratch import shared_folder


def ledger(s, d):
    target = shared_folder(s)
    for _ in range(2):
        out = score_ledger.run(s, f"{d}/events.parquet", target, config_of("score_ledger"))
    return out.withColumns({"auc": F.round("auc", 9), "lead": F.round("lead", 9)})


def folds(s, d):
    target = shared_folder(s)
    for _ in range(2):
        out = fold_audit.run(s, f"{d}/documents.parquet", f"{d}/labels.parquet", target, config_of("fold_audit"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("leaks", "train_for")})


Q = {"job1_score_ledger": ledger, "job2_fold_audit": folds}
S = {
    "job1_score_ledger": """
WITH own AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS part, event_type AS class_id, CAST(user_id AS VARCHAR) AS cluster,
       CASE WHEN NOT isnan(value) THEN value END AS score, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 50 AS INTEGER) AS y FROM events),
e AS (SELECT coalesce(part, 'none') AS part, coalesce(class_id, 'none') AS class_id, cluster, score, y FROM own WHERE y IS NOT NULL),
r AS (SELECT * FROM e UNION ALL SELECT * REPLACE ('all' AS part) FROM e),
ranked AS (SELECT part, class_id, y, rank() OVER (PARTITION BY part, class_id ORDER BY score) + (count(*) OVER (PARTITION BY part, class_id, score) - 1) / 2e0 AS k FROM r WHERE score IS NOT NULL),
a AS (SELECT part, class_id, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(y * k) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) END AS auc FROM ranked GROUP BY ALL),
t AS (SELECT part, class_id, count(*) AS rows, count(*) FILTER (WHERE score IS NULL) AS missing, count(DISTINCT cluster) AS clusters,
      count(*) FILTER (WHERE y = 1 AND score IS NOT NULL) AS pos, count(*) FILTER (WHERE y = 0 AND score IS NOT NULL) AS neg FROM r GROUP BY ALL),
l AS (SELECT part, class_id, max(n) AS most FROM (SELECT part, class_id, cluster, count(*) FILTER (WHERE y = 1 AND score IS NOT NULL) AS n FROM r GROUP BY ALL) GROUP BY ALL)
SELECT part, class_id, round(auc, 9) AS auc, pos, neg, rows, missing, clusters, CASE WHEN pos > 0 THEN round(most / pos, 9) END AS lead
FROM t JOIN l USING (part, class_id) LEFT JOIN a USING (part, class_id)""",
    "job2_fold_audit": rf"""
WITH k AS (SELECT *, CASE WHEN plain <> '' THEN md5(plain) END AS text_key FROM (SELECT doc_id, source, lang,
       trim(translate(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS plain FROM documents)),
g AS (SELECT doc_id, coalesce(source, 'copies of ' || coalesce(text_key, 'nothing')) AS grp, lang, text_key FROM k),
p AS (SELECT grp, CAST((row_number() OVER (ORDER BY {draw_sql('7', 'grp')}, grp) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT grp FROM g)),
f AS (SELECT g.*, fold FROM g JOIN p USING (grp)),
c AS (SELECT text_key, count(*) AS n, list(DISTINCT fold) AS held FROM f WHERE text_key IS NOT NULL GROUP BY text_key),
m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT f.doc_id, grp, lang, f.text_key, coalesce(n, 0) AS copies, fold, quality, toxic,
       array_to_string(list_filter([0, 1, 2, 3, 4], lambda x: x <> fold AND coalesce(list_contains(held, x), false)), ',') AS leaks,
       array_to_string(list_filter([0, 1, 2, 3, 4], lambda x: x <> fold AND NOT coalesce(list_contains(held, x), false)), ',') AS train_for
FROM f LEFT JOIN c ON f.text_key = c.text_key LEFT JOIN m ON m.doc_id = f.doc_id""",
}
