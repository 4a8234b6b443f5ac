"""Logistic fits: calibrated fusion of models, linear probes, and their transfer.

A fit minimises C * sum(loss) + |w|^2 / 2 with a free intercept, by Newton's method. All fits of a table take each step
together: tasks add up gradients and Hessians of the classes they hold, for every outer fold that doesn't hold out the row;
executors sum these by fit and solve for the next point, and what comes to the driver is the coefficients. So no class is
in one task, and rows aren't copied for each outer fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.scalar import logit
from tallywright.sources.scratch import shared_folder

#: Tasks that a class's rows are dealt to.
LOTS = 8
#: The most numbers that the coefficients of all fits may have; they are sent to every task.
MOST_NUMBERS = 16_000_000
#: The most numbers that the Hessians of all fits may have for a task to hold them all, so that rows need not be dealt by key.
HELD_NUMBERS = 1_000_000


def newton(x: np.ndarray, y: np.ndarray, c: float = 1.0, weight: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Coefficients with the intercept last, minimising c * sum(weight * logloss) + |w|^2 / 2; damped until the loss falls."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.append(np.ones(x.shape[1] - 1), 0.0)
    b = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        m = x @ b
        return c * float((weight * (np.logaddexp(0, m) - y * m)).sum()) + 0.5 * float((ridge * b * b).sum())

    now = loss(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        g = c * x.T @ (weight * (p - y)) + ridge * b
        if np.abs(g).max() < 1e-10 * max(1, len(x)):
            break
        h = c * (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-12 * np.eye(len(b))
        d, t = np.linalg.solve(h, g), 1.0
        while t > 1e-8 and (new := loss(b - t * d)) > now:
            t /= 2
        if t <= 1e-8:
            break
        b, now = b - t * d, new
    return b


def wide_logits(df: DataFrame, models: list[str]) -> DataFrame:
    """A row for each row and class with x, the models' logits in the given order, or NULL if one is missing."""
    own = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models]  # one shuffle; pivot() takes two
    wide = df.groupBy("row_id", "class_id", "fold", "author", "y").agg(*own)
    full = sum((F.col(m).isNull().cast("int") for m in models), F.lit(0)) == 0
    return wide.select("row_id", "class_id", "fold", "author", "y", F.when(full, F.array(*[logit(F.col(m)) for m in models])).alias("x"))


def packed_logits(packed: DataFrame, models: list[str]) -> DataFrame:
    """wide_logits() of scores that lie side by side, as metrics.candidates takes them, without a shuffle."""
    own = lambda m: lambda s: s["model"] == m
    found = [F.filter("scores", own(m)) for m in models]
    each = [F.when(F.size(f) > 0, F.get(f, F.lit(0))["score"]) for f in found]
    full = F.forall(F.array(*each), lambda v: v.isNotNull())
    return packed.select("row_id", "class_id", "fold", "author", "y", F.when(full, F.array(*[logit(v) for v in each])).alias("x"))


@dataclass(frozen=True)
class Fit:
    """A fit's weights and scale, the best point so far with its loss, the step from there, and the point to look at next."""

    size: float
    pos: float
    mean: np.ndarray
    std: np.ndarray
    at: np.ndarray
    best: np.ndarray | None = None
    loss: float = np.inf
    step: np.ndarray | None = None
    part: float = 1.0
    done: bool = False

    def moved(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> Fit:
        """The fit after its next point was looked at; a step is halved until the loss falls, but for rounding."""
        if loss > self.loss + 1e-13 * abs(self.loss):
            part = self.part / 2
            if part <= 1e-8:
                return replace(self, at=self.best, done=True)
            return replace(self, at=self.best - part * self.step, part=part)
        if np.abs(gradient).max() < 1e-10 * max(1.0, self.size):
            return replace(self, best=self.at, loss=loss, done=True)
        step = np.linalg.solve(hessian + 1e-12 * np.eye(len(self.at)), gradient)
        return replace(self, best=self.at, loss=loss, step=step, part=1.0, at=self.at - step)

    def coef(self) -> list[float]:
        """Coefficients of the inputs as they came, the intercept last."""
        point = self.at if self.best is None else self.best
        w = point[:-1] / self.std
        return [*map(float, w), float(point[-1] - (w * self.mean).sum())]


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """key, fold, y, x of each run of equal keys in the batches, each batch being sorted by key first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.sort_by([(k, "ascending") for k in by])
        changes = np.zeros(batch.num_rows - 1, bool)
        for k in by:
            changes |= np.diff(batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()) != 0
        fold, y = batch.column("fold").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        bounds = [0, *(np.flatnonzero(changes) + 1), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            yield tuple(batch.column(k)[int(start)].as_py() for k in by), fold[start:end], y[start:end], x[start:end]


def moments(by: list[str], kinds: pa.Schema):
    """Batches to by, fold, size, pos, and the sums of x and of its squares; a task adds up what HELD_NUMBERS holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (key, f), m in sums.items():
                row = dict(zip(by, key, strict=True)) | {"fold": f, "size": float(m[0, 0]), "pos": float(m[1, 0])}
                yield pa.RecordBatch.from_pylist([row | {"sx": m[0, 1:].tolist(), "sxx": m[1, 1:].tolist()}], schema=kinds)
            sums.clear()

        for key, fold, y, x in runs(batches, by):
            for f in np.unique(fold):
                own = fold == f
                m = np.array([[own.sum(), *x[own].sum(axis=0)], [y[own].sum(), *(x[own] ** 2).sum(axis=0)]])
                if (key, int(f)) in sums:
                    sums[key, int(f)] += m
                else:
                    sums[key, int(f)] = m
                    held += m.size
            if held > HELD_NUMBERS:
                yield from told()
                held = 0
        yield from told()

    return run


def partial_sums(by: list[str], fits, kinds: pa.Schema, c: float, balanced: bool, few: bool = False):
    """Batches to the loss, gradient and Hessian that each run of a key adds to the key's open fits.

    few: a task holds the sums of all keys; else batches are sorted by key, and it holds those of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_fits: dict[tuple, list[tuple[int, Fit]]] = {}
        for (*key, outer), fit in fits.value.items():
            if not fit.done:
                open_fits.setdefault(tuple(key), []).append((outer, fit))
        held, sums = None, {}

        def told() -> Iterator[pa.RecordBatch]:
            for (key, outer), (loss, g, h) in sums.items():
                row = dict(zip(by, key, strict=True)) | {"outer_fold": outer, "loss": loss, "g": g.tolist(), "h": h.ravel().tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

        for key, fold, y, x in runs(batches, by):
            if key != held and not few:
                yield from told()
                held, sums = key, {}
            for outer, fit in open_fits.get(key, ()):
                own = fold != outer  # without folds, outer is none of them
                z, t = np.column_stack([(x[own] - fit.mean) / fit.std, np.ones(int(own.sum()))]), y[own]
                w = c * (np.where(t == 1, fit.size / (2 * fit.pos), fit.size / (2 * (fit.size - fit.pos))) if balanced else np.ones(len(t)))
                m = z @ fit.at
                p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                loss, g, h = float((w * (np.logaddexp(0, m) - t * m)).sum()), z.T @ (w * (p - t)), (z * (w * p * (1 - p))[:, None]).T @ z
                if (key, outer) in sums:
                    loss, g, h = (a + b for a, b in zip(sums[key, outer], (loss, g, h), strict=True))
                sums[key, outer] = (loss, g, h)
        yield from told()

    return run


def next_points(by: list[str], fits, kinds: pa.Schema):
    """All sums of a fit to what its step changes: at, best, loss, step, part, done."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("loss")  # an order that doesn't depend on arrival
        key = tuple(t.column(k)[0].as_py() for k in (*by, "outer_fold"))
        fit = fits.value[key]
        n = len(fit.at)
        ridge = np.append(np.ones(n - 1), 0.0)
        loss = float(np.sum(t.column("loss").to_numpy())) + 0.5 * float((ridge * fit.at**2).sum())
        g = np.sum([np.asarray(v) for v in t.column("g").to_pylist()], axis=0) + ridge * fit.at
        h = np.sum([np.asarray(v) for v in t.column("h").to_pylist()], axis=0).reshape(n, n) + np.diag(ridge)
        new = fit.moved(loss, g, h)
        row = dict(zip((*by, "outer_fold"), key, strict=True)) | {"loss": new.loss, "part": new.part, "done": new.done}
        row |= {c: None if (v := getattr(new, c)) is None else v.tolist() for c in ("at", "best", "step")}
        return pa.Table.from_pylist([row], schema=kinds)

    return run


def fit_all(rows: DataFrame, by: list[str], nested: bool, c: float = 1.0, min_pos: int = 2, balanced: bool = False, scale: bool = False, steps: int = 100) -> DataFrame:
    """Coefficients of each fit: by, outer_fold, coef (the intercept last); no row where the labels don't allow a fit.

    rows: by, y, x (NULL if an input is missing) and, if nested, fold (integer): there is then a fit for each fold, over the
    rows of the others; else outer_fold is -1. Rows without label or fold teach nothing. Rows are written once, as they lie, and
    each step reads them again. Where the Hessians of all fits exceed HELD_NUMBERS, rows are written once more, dealt to LOTS tasks a
    key and sorted by it, so that a task holds those of one key. Coefficients of all fits are held by the driver, MOST_NUMBERS at most.
    """
    spark = rows.sparkSession
    fold = F.col("fold").cast("int") if nested else F.lit(0)
    rows = rows.filter("x is not null and y is not null" + (" and fold is not null" if nested else "")).select(*by, fold.alias("fold"), F.col("y").cast("int").alias("y"), F.col("x").cast("array<double>").alias("x"))

    def kept(rows: DataFrame) -> DataFrame:
        path = f"{shared_folder(spark)}/rows"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    rows = kept(rows)
    names = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)

    def kinds(columns: str) -> tuple[str, pa.Schema]:
        from pyspark.sql import types as T
        from pyspark.sql.pandas.types import to_arrow_schema

        text = f"{names}, {columns}"
        return text, to_arrow_schema(T.StructType.fromDDL(text))

    text, arrow = kinds("fold int, size double, pos double, sx array<double>, sxx array<double>")
    told = rows.mapInArrow(moments(by, arrow), text)
    spread = told.select(*by, "fold", "size", "pos", F.posexplode(F.arrays_zip("sx", "sxx")).alias("dim", "e"))
    spread = spread.groupBy(*by, "fold", "dim").agg(*[F.sum(v).alias(n) for n, v in (("sx", "e.sx"), ("sxx", "e.sxx"), ("size", "size"), ("pos", "pos"))])
    known = spread.groupBy(*by, "fold").agg(F.first("size").alias("size"), F.first("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("dim", "sx", "sxx"))).alias("m"))
    fits = first_points(known, by, nested, min_pos, scale)
    few = sum(len(f.at) ** 2 for f in fits.values()) <= HELD_NUMBERS
    if not few:
        rows = kept(rows.repartition(*[F.col(k) for k in by], F.pmod(F.xxhash64("x", "y"), F.lit(LOTS))).sortWithinPartitions(*by))
    while steps and any(not f.done for f in fits.values()):
        sent = spark.sparkContext.broadcast(fits)
        text, arrow = kinds("outer_fold int, loss double, g array<double>, h array<double>")
        sums = rows.mapInArrow(partial_sums(by, sent, arrow, c, balanced, few), text)
        text, arrow = kinds("outer_fold int, loss double, part double, done boolean, at array<double>, best array<double>, step array<double>")
        for r in sums.groupBy(*by, "outer_fold").applyInArrow(next_points(by, sent, arrow), text).collect():
            key = tuple(r[k] for k in (*by, "outer_fold"))
            fits[key] = replace(fits[key], loss=r.loss, part=r.part, done=r.done, **{n: None if r[n] is None else np.asarray(r[n]) for n in ("at", "best", "step")})
        sent.destroy()
        steps -= 1
    return spark.createDataFrame([(*key, fit.coef()) for key, fit in fits.items()], f"{names}, outer_fold int, coef array<double>")


def first_points(known: DataFrame, by: list[str], nested: bool, min_pos: int, scale: bool) -> dict[tuple, Fit]:
    """A fit at zero for each key and outer fold whose labels allow one; an outer fold's sums are the key's less its own."""
    folds: dict[tuple, dict[int, np.ndarray]] = {}
    numbers = 0
    for r in known.toLocalIterator():
        folds.setdefault(tuple(r[k] for k in by), {})[r.fold] = np.array([[r["size"], r.pos], *[[e.sx, e.sxx] for e in r.m]])
        numbers += len(r.m)
        if numbers > MOST_NUMBERS:
            raise ValueError(f"the fits have more than {MOST_NUMBERS} coefficients; fit fewer classes at a time")
    outer = sorted({f for own in folds.values() for f in own}) if nested else [-1]
    found = {}
    for key, own in folds.items():
        total = sum(own.values())
        for f in outer:
            rest = total - own.get(f, 0)
            (size, pos), m = rest[0], rest[1:]
            if pos < min_pos or pos >= size or not pos:
                continue
            mean = m[:, 0] / size if scale else np.zeros(len(m))
            std = np.sqrt(np.maximum(m[:, 1] / size - mean**2, 0)) if scale else np.ones(len(m))
            std = np.where(std > 1e-12 * np.maximum(1, np.abs(mean)), std, 1.0)
            found[(*key, f)] = Fit(size, pos, mean, std, np.zeros(len(m) + 1))
    return found


def predicted(rows: DataFrame, coefs: DataFrame, on: list[str]) -> DataFrame:
    """Adds score, the fitted probability; NULL without a fit or with a missing input. Coefficients are broadcast, as for the fits."""
    z = F.aggregate(F.zip_with("x", F.slice("coef", 1, F.size("coef") - 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    p = 1 / (1 + F.exp(-(z + F.element_at("coef", -1))))
    return rows.join(F.broadcast(coefs), on, "left").withColumn("score", F.when(F.col("x").isNotNull() & F.col("coef").isNotNull(), p)).drop("coef")


def nested_fusion(df: DataFrame, models: list[str], c: float = 1.0) -> DataFrame:
    """Calibrated fusion: for each outer fold and class a logistic on the models' logits of the other folds, applied to the fold."""
    return nested_fusion_of(wide_logits(df, models), c)


def nested_fusion_of(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """nested_fusion() of rows with their logits, from wide_logits or packed_logits."""
    coefs = fit_all(rows, ["class_id"], True, c).withColumnRenamed("outer_fold", "fold")
    out = predicted(rows, coefs, ["fold", "class_id"])
    return out.select("row_id", "class_id", "fold", "author", "y", F.lit("fusion").alias("model"), "score")


def linear_probe(rows: DataFrame, c: float = 1.0, standardise: bool = True) -> DataFrame:
    """A balanced logistic on x for each outer fold and class; x is standardised by the training folds if asked."""
    coefs = fit_all(rows, ["class_id"], True, c, min_pos=1, balanced=True, scale=standardise)
    return predicted(rows, coefs.withColumnRenamed("outer_fold", "fold"), ["fold", "class_id"])


def frozen_fusion(source: DataFrame, target: DataFrame, models: list[str], c: float = 1.0) -> DataFrame:
    """Fusion learned on the source domain and applied to the target; the models' mean where a class couldn't be fitted."""
    coefs = fit_all(wide_logits(source, models), ["class_id"], False, c).drop("outer_fold")
    rows = wide_logits(target, models)
    out = predicted(rows, coefs, ["class_id"])
    mean = target.filter(F.col("model").isin(models)).groupBy("row_id", "class_id").agg(F.avg("score").alias("mean"))
    return out.join(mean.hint("merge"), ["row_id", "class_id"]).withColumn("score", F.coalesce("score", "mean")).drop("mean", "x")


def frozen_choice(source: DataFrame, target: DataFrame) -> DataFrame:
    """The class's best candidate on the source, applied to the target."""
    from tallywright.operators.metrics import auc
    from tallywright.operators.select import best

    choice = best(auc(source, ["class_id", "model", "ord"], single=True), ["class_id"])
    return target.join(F.broadcast(choice.select("class_id", "model")), ["class_id", "model"]).withColumn("model", F.lit("frozen"))
