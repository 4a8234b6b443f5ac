"""Cluster bootstrap, permutations and influence.

A bootstrap draw only changes how often a row counts, so a replicate is a table of weights by cluster, and its AUC is a
weighted count. Scores are sorted once, in runs over all tasks; the replicates are then evaluated together, and never as
copies of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.scalar import hash_draw
from tallywright.operators.draws import PRIME, DrawnPlaces, blocks, image_of, matrix
from tallywright.operators.inference import two_sided
from tallywright.operators.labels import numbered
from tallywright.operators.metrics import FINE, auc, auc_of_counts, evaluable, score_range, summary


def places(clusters: DataFrame, key: str) -> tuple[DataFrame, int]:
    """key and _i, the clusters' places in their order, and how many there are."""
    listed = clusters.select(key).filter(F.col(key).isNotNull()).distinct()
    return numbered(listed, "_i", [key]), listed.count()


def hash_weights(clusters: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """rep, key, w: how often each cluster is drawn in each replicate, from as many draws as there are clusters.

    Draws are hashes of seed, replicate and slot, so they don't depend on partitions and any engine can repeat them. A
    table function makes each replicate's on the executors.
    """
    listed, n = places(clusters, key)
    each = clusters.sparkSession.range(reps).withColumnRenamed("id", "rep")
    drawn = each.lateralJoin(DrawnPlaces(F.lit(seed), F.col("rep").outer(), F.lit(n)))
    return drawn.join(listed, "_i").select("rep", key, "w")


def numpy_weights(clusters: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """The same from NumPy's generator: a draw of the sorted clusters for each replicate. Clusters must be few."""
    names = [r[0] for r in clusters.select(key).distinct().orderBy(key).collect()]
    rng = np.random.default_rng(seed)
    rows = []
    for rep in range(reps):
        got = np.bincount(rng.integers(0, len(names), len(names)), minlength=len(names))
        rows += [(rep, names[i], int(got[i])) for i in np.flatnonzero(got)]
    return clusters.sparkSession.createDataFrame(rows, f"rep bigint, {key} {clusters.schema[key].dataType.simpleString()}, w bigint")


#: Rows of weights that are broadcast; more are joined by a shuffle.
FEW_WEIGHTS = 1_000_000


def replicate_auc_plain(df: DataFrame, weights: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Weighted AUC for each replicate by joining weights to counts, as SQL can say it; any number of weights will do.

    Rows are summed by (by, score, cluster) first. Weights are broadcast if they are few, and shuffled with the counts by
    cluster if not.
    """
    own = [c for c in (*by, "score") if c != key]
    counts = df.groupBy(*own, key).agg(F.sum("y").alias("_y"), F.count("*").alias("_rows"))
    few = weights.limit(FEW_WEIGHTS + 1).count() <= FEW_WEIGHTS
    joined = counts.join(F.broadcast(weights) if few else weights.hint("shuffle_merge"), key)
    rows = joined.filter(F.col("score").isNotNull()).select("rep", *by, F.col("score").alias("_s"), (F.col("w") * F.col("_y")).alias("_p"), (F.col("w") * (F.col("_rows") - F.col("_y"))).alias("_n"))
    counted_ = rows.groupBy("rep", *by, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return auc_of_counts(counted_, ["rep", *by]).drop("missing")


#: Replicates that a kernel takes at a time, and that a row of partial sums holds.
WIDTH = 64


def replicate_auc(df: DataFrame, clusters: DataFrame, key: str, by: list[str], reps: int, seed: int, parts: int | None = None) -> DataFrame:
    """Weighted AUC for each replicate and key, with hash_weights' draws: rep, by, auc (NULL if a class is absent or a weighted score is missing).

    Two levels. Rows are summed by (by, score, cluster) and dealt by ranges of (by, score), so that each task holds a
    sorted run and none a whole model and class. A run gives, for every replicate, its weighted positives and negatives and
    the pairs that are concordant within it; then a group's few runs are added up in their order. Executors make the
    weights from the seed, in blocks of replicates of at most 64 MB. All sums are whole numbers and halves, so the order of
    adding changes no bit while pairs stay below 2**52.
    """
    spark = df.sparkSession
    listed, n = places(clusters, key)
    spans = blocks(reps, n)
    counts = df.groupBy(*by, "score", key).agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))
    counts = counts.filter(" and ".join(f"{k} is not null" for k in by)).join(listed, key).select(*by, "score", "_i", "p", "n")
    first = F.broadcast(spark.createDataFrame([(a, b) for a, b in spans], "_a int, _b int"))  # a row for each block
    order = ["_a", *by, "score"]
    runs = counts.crossJoin(first).repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    sums = ", ".join(f"{c} array<double>" for c in ("p", "n", "pairs", "gone"))
    partial = runs.mapInArrow(run_sums(by, seed, n), f"{kinds}, _first int, _run int, {sums}")
    found = partial.groupBy(*by, "_first").applyInArrow(added_runs(by), f"{kinds}, rep bigint, auc double")
    return found.select("rep", *by, "auc")


class Run:
    """The sums of one key's sorted run, for the replicates of one block."""

    def __init__(self, key: tuple, weights: np.ndarray):
        self.key, self.weights = key, weights
        self.p, self.n, self.pairs, self.gone = np.zeros((4, weights.shape[1]))

    def add(self, cluster: np.ndarray, p: np.ndarray, n: np.ndarray, step: np.ndarray, missing: np.ndarray) -> None:
        """Rows in the order of their scores, ties whole; step: where a new score begins; missing: rows without one, first."""
        skip = int(missing.sum())
        if skip:
            self.gone += (p[:skip] + n[:skip]) @ self.weights[cluster[:skip]]
            cluster, p, n, step = cluster[skip:], p[skip:], n[skip:], np.flatnonzero(step[skip:])
        else:
            step = np.flatnonzero(step)
        if not len(cluster):
            return
        for a in range(0, self.weights.shape[1], WIDTH):
            own = slice(a, a + WIDTH)
            w = self.weights[:, own][cluster].astype(np.float64)
            wp, wn = np.add.reduceat(w * p[:, None], step, axis=0), np.add.reduceat(w * n[:, None], step, axis=0)
            below = np.cumsum(wn, axis=0) - wn + self.n[own]
            self.pairs[own] += (wp * (below + 0.5 * wn)).sum(axis=0)
            self.p[own] += wp.sum(axis=0)
            self.n[own] += wn.sum(axis=0)


def run_sums(by: list[str], seed: int, places_: int):
    """Sorted rows of _a, _b, by, score, _i, p, n to the sums of each key's run in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, held = TaskContext.get().partitionId(), None, None

        def changes(t: pa.Table, names: list[str]) -> np.ndarray:
            new = np.ones(len(t), bool)
            new[1:] = False
            for c in names:
                x = t.column(c).combine_chunks()
                other = pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
                void = x.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= other | (void[1:] != void[:-1])
            return new

        def take(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal state
            keys = ["_a", *by]
            starts = np.flatnonzero(changes(t, keys))
            step, missing = changes(t, [*keys, "score"]), t.column("score").is_null().to_numpy()
            cluster, p, n = (t.column(c).to_numpy() for c in ("_i", "p", "n"))
            for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
                key = tuple(t.column(c)[int(a)].as_py() for c in ("_a", "_b", *by))
                if state is None or state.key != key:
                    if state is not None:
                        yield from told(state)
                    state = Run(key, matrix(seed, places_, key[0], key[1]))
                own = slice(a, b)
                state.add(cluster[own], p[own], n[own], step[own], missing[own])

        def told(state: Run) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(state.p), WIDTH):
                own = slice(a, a + WIDTH)
                row = dict(zip(by, state.key[2:], strict=True)) | {"_first": state.key[0] + a, "_run": part}
                row |= {c: getattr(state, c)[own].tolist() for c in ("p", "n", "pairs", "gone")}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                kinds = [(k, batch.schema.field(k).type) for k in by]
                schema = pa.schema([*kinds, ("_first", pa.int32()), ("_run", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("p", "n", "pairs", "gone")]])
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not len(t):
                continue
            last = int(np.flatnonzero(changes(t, ["_a", *by, "score"]))[-1])  # ties may go on in the next batch
            yield from take(t.slice(0, last)) if last else ()
            held = t.slice(last)
        if held is not None and len(held):
            yield from take(held)
        if state is not None:
            yield from told(state)

    return run


def added_runs(by: list[str]):
    """A key's runs, in their order, to the AUC of each replicate of a block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_run")
        p, n, pairs, gone = (np.stack([np.asarray(v) for v in t.column(c).to_pylist()]) for c in ("p", "n", "pairs", "gone"))
        pairs = pairs.sum(axis=0) + (p * (np.cumsum(n, axis=0) - n)).sum(axis=0)
        p, n, gone = p.sum(axis=0), n.sum(axis=0), gone.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            auc = pairs / (p * n)
        void = (p == 0) | (n == 0) | (gone > 0)
        first = t.column("_first")[0].as_py()
        keys = {k: pa.array([t.column(k)[0].as_py()] * len(auc), t.schema.field(k).type) for k in by}
        return pa.table(keys | {"rep": pa.array(np.arange(first, first + len(auc)), pa.int64()), "auc": pa.array(auc, pa.float64(), mask=void)})

    return run


def paired_deltas(per: DataFrame, ref: str, tests: list[str], common: bool = True) -> DataFrame:
    """Macro test minus macro ref in each replicate: rep, model, delta.

    per: rep, model, class_id, auc. Classes count in a replicate only where every model has an AUC (one mask for all
    tests, as with one shared draw).
    """
    per = per.filter(F.col("model").isin(ref, *tests))
    if common:
        ok = per.groupBy("rep", "class_id").agg((F.count("auc") == 1 + len(tests)).alias("_ok"))
        per = per.join(ok.filter("_ok").drop("_ok"), ["rep", "class_id"], "left_semi")
    macro = per.groupBy("rep", "model").agg(F.avg("auc").alias("m"))
    base = macro.filter(F.col("model") == ref).select("rep", F.col("m").alias("base"))
    return macro.filter(F.col("model") != ref).join(base, "rep").select("rep", "model", (F.col("m") - F.col("base")).alias("delta"))


def multi_test(df: DataFrame, weights: DataFrame, key: str, ref: str, tests: list[str]) -> DataFrame:
    """Macro test minus macro ref in each replicate, one draw for all tests: rep, model, delta.

    Classes are those that every one of these models can be compared on over all rows, and in each replicate those of them
    in which every model has an AUC.
    """
    rows = df.filter(F.col("model").isin(ref, *tests))
    rows = rows.join(F.broadcast(evaluable(rows, [ref, *tests])), "class_id", "left_semi")
    return paired_deltas(replicate_auc_plain(rows, weights, key, ["model", "class_id"]), ref, tests)


def class_deltas(per: DataFrame, ref: str, test: str) -> DataFrame:
    """The mean over classes of test minus ref in each replicate, 0 where no class has both: rep, delta. per: rep, model, class_id, auc."""
    wide = per.groupBy("rep", "class_id").pivot("model", [ref, test]).agg(F.first("auc"))
    return wide.groupBy("rep").agg(F.coalesce(F.avg(F.col(test) - F.col(ref)), F.lit(0.0)).alias("delta"))


def class_delta_test(df: DataFrame, weights: DataFrame, key: str, ref: str, test: str) -> DataFrame:
    """point (over all rows), se, lo, hi, n of the replicates' class deltas, and z and two-sided p of point over se."""
    rows = df.filter(F.col("model").isin(ref, test))
    deltas = class_deltas(replicate_auc_plain(rows, weights, key, ["model", "class_id"]), ref, test)
    one = class_deltas(auc(rows, ["model", "class_id"]).withColumn("rep", F.lit(0)), ref, test).select(F.col("delta").alias("point"))
    return two_sided(one.crossJoin(summary(deltas, "delta").select("se", "lo", "hi", "n")))  # one row each


def value_bootstrap(values: DataFrame, key: str, value: str, reps: int, seed: int) -> DataFrame:
    """Independent bootstrap of a small table's values: rep and their mean."""
    w = hash_weights(values, key, reps, seed)
    return values.join(w, key).groupBy("rep").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def permuted_within(df: DataFrame, key: str, row: str, columns: list[str], reps: int, seed: int) -> DataFrame:
    """Deals the columns anew among the rows of each cluster, in each replicate: rep, row and the dealt columns.

    df has a row for each row id. Places are numbered once, in the order of ids; in a replicate the row at place k gets the
    values of the row at place draws.image(k). A cluster's rows are not gathered anywhere.
    """
    known = numbered(df.filter(F.col(key).isNotNull()), "_at", [key, row])
    bounds = known.groupBy(key).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    known = known.join(bounds.hint("merge"), key).withColumn("_place", F.col("_at") - F.col("_first"))
    h = hash_draw(seed, F.col(key)) % PRIME
    every = known.select(key, row, "_place", "_size", h.alias("_h")).crossJoin(F.broadcast(df.sparkSession.range(reps).withColumnRenamed("id", "rep")))
    to = every.select("rep", key, row, image_of(F.col("_place"), F.col("_size"), F.col("rep"), F.col("_h")).alias("_place"))
    return to.join(known.select(key, "_place", *columns).hint("merge"), [key, "_place"]).select("rep", key, row, *columns)


def influence(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The AUC without each cluster, for each key: by, key, auc, in closed form from one pass of counts.

    Concordant pairs K of all rows lose those with a positive or a negative of the cluster, and regain those with both.
    All sums run over ranges of scores first; a second level adds the ranges up, so no task holds a whole key's scores or
    a whole cluster's.
    """
    c = df.filter("score is not null").groupBy(*by, "score", key).agg(F.sum("y").alias("_cp"), F.sum(1 - F.col("y")).alias("_cn"))
    c = c.withColumn("_b", score_range(F.col("score"), FINE))
    upto = Window.partitionBy(*by, "_b").orderBy("score")  # ties included
    tie = Window.partitionBy(*by, "_b", "score")
    earlier = (Window.unboundedPreceding, -1)
    mine = Window.partitionBy(*by, "_b", key).orderBy("score").rowsBetween(*earlier)
    zero = F.lit(0)
    c = c.withColumns({"_p": F.sum("_cp").over(tie), "_n": F.sum("_cn").over(tie), "_pu": F.sum("_cp").over(upto), "_nu": F.sum("_cn").over(upto)})
    c = c.withColumn("_own", F.coalesce(F.sum("_cn").over(mine), zero))
    part = c.groupBy(*by, "_b", key).agg(
        F.sum("_cp").alias("_op"), F.sum("_cn").alias("_on"),
        F.sum(F.col("_cp") * (F.col("_nu") - 0.5 * F.col("_n"))).alias("_over"), F.sum(F.col("_cn") * (F.col("_pu") - 0.5 * F.col("_p"))).alias("_under"),
        F.sum(F.col("_cp") * (F.col("_own") + 0.5 * F.col("_cn"))).alias("_both"),
    )
    # Of a key there are as many ranges as its scores span.
    ranges = part.groupBy(*by, "_b").agg(F.sum("_op").alias("_p"), F.sum("_on").alias("_n"), F.sum("_over").alias("_k"))
    before, every = Window.partitionBy(*by).orderBy("_b").rowsBetween(*earlier), Window.partitionBy(*by)
    ranges = ranges.withColumns({"_p0": F.coalesce(F.sum("_p").over(before), zero), "_n0": F.coalesce(F.sum("_n").over(before), zero)})
    ranges = ranges.select(*by, "_b", "_p0", "_n0", F.sum("_p").over(every).alias("_tp"), F.sum("_n").over(every).alias("_tn"), F.sum(F.col("_k") + F.col("_p") * F.col("_n0")).over(every).alias("_k"))
    own = Window.partitionBy(*by, key).orderBy("_b").rowsBetween(*earlier)
    out = part.withColumn("_own0", F.coalesce(F.sum("_on").over(own), zero)).join(ranges, [*by, "_b"]).groupBy(*by, key).agg(
        F.first("_k").alias("_k"), F.first("_tp").alias("_tp"), F.first("_tn").alias("_tn"), F.sum("_op").alias("_op"), F.sum("_on").alias("_on"),
        F.sum(F.col("_over") + F.col("_op") * F.col("_n0")).alias("_over"), F.sum(F.col("_under") + F.col("_on") * F.col("_p0")).alias("_under"),
        F.sum(F.col("_both") + F.col("_op") * F.col("_own0")).alias("_both"),
    )
    p, n = F.col("_tp") - F.col("_op"), F.col("_tn") - F.col("_on")
    lost = F.col("_over") + F.col("_tp") * F.col("_on") - F.col("_under")  # pairs below its positives, pairs above its negatives
    return out.select(*by, key, F.when((p > 0) & (n > 0), (F.col("_k") - lost + F.col("_both")) / (p.cast("double") * n)).alias("auc"))
