"""Positives of labels that are permuted within clusters, without a row for each row and replicate.

A row's labels are bits, and a replicate is arithmetic over places (draws.image), so rows pass their scores on once, and a
task that holds a range of rows gets the bits of the clusters in it: as many bytes as rows, for up to eight classes. It makes
all replicates there and sums the positives by score before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.scalar import hash_draw
from tallywright.operators.draws import PRIME, images
from tallywright.sources.scratch import shared_folder

#: Bytes of one cluster's labels that a task holds at a time; rows of a larger cluster meet its labels in turns.
HELD = 64 << 20
#: Bytes of labels in one record.
BLOCK = 4096
#: Scores that a task gathers before it makes their replicates.
GATHERED = 1 << 20
#: Bytes of dealt labels at a time, and sums.
DEALT, SUMS = 1 << 24, 1 << 22


def dealt_positives(df: DataFrame, by: list[str], own: Column, reps: int, seed: int, held: int = HELD, gathered: int = GATHERED) -> DataFrame:
    """rep, by, _s, _p: the positives at each score, in one row or more, with label rows permuted within authors.

    df: row_id, author, class_id, y, score and by, which has class_id. The labels are those of all rows of df, a class being a
    label where any of a row's y is 1; scores count where own holds. Places are in the order of row ids. What by can be (folds,
    classes, candidates) is few, and passes through the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    few = df.select(*by).filter("class_id is not null").distinct().orderBy("class_id", *by).collect()
    classes = {c: i for i, c in enumerate(dict.fromkeys(r["class_id"] for r in few))}
    bits = [classes[r["class_id"]] for r in few]
    width = max(1, -(-len(classes) // 8))
    cells = spark.createDataFrame([(i, b, *r) for i, (b, r) in enumerate(zip(bits, few, strict=True))], "_cell int, _bit int, " + ", ".join(f"_of_{k} {kind[k]}" for k in by))
    coded = df.join(F.broadcast(cells), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by], "left")
    coded = coded.select("author", "row_id", F.when(own, F.col("_cell")).alias("_cell"), F.when(F.col("y") == 1, F.col("_bit")).alias("_bit"), "score")

    keys, lists = f"author {kind['author']}", f"labels binary, cells array<int>, scores array<{kind['score']}>"
    path = shared_folder(spark)
    whole = f"{keys}, row_id {kind['row_id']}, {lists}"
    coded.mapInArrow(pieces(width), whole).write.parquet(f"{path}/packed")
    packed = spark.read.schema(whole).parquet(f"{path}/packed")  # ranges are drawn from a sample, for which all rows would be packed once more
    ranged = packed.repartitionByRange(parts, "author", "row_id").sortWithinPartitions("author", "row_id")
    schema = f"{keys}, _part int, _kind int, _at bigint, _n bigint, {lists}"
    ranged.mapInArrow(placed_rows(width), schema).write.parquet(f"{path}/placed")
    saved = spark.read.schema(schema).parquet(f"{path}/placed")

    blocks = saved.filter("_kind = 0").select("author", "_part", "_at", "_n", "labels")
    each = Window.partitionBy("author")
    spans = blocks.groupBy("author", "_part").agg(F.sum("_n").alias("_here"))
    before = F.coalesce(F.sum("_here").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("author", "_part", before.alias("_base"), F.sum("_here").over(each).alias("_size"))
    # An author's parts: as many as its rows take up, at most all.
    spans = spans.withColumns({"_to": F.collect_list(F.struct("_part", "_base")).over(each), "_h": hash_draw(seed, F.col("author")) % PRIME})
    turn = max(held, BLOCK) // width
    labels = blocks.join(spans.hint("merge"), ["author", "_part"]).withColumn("_at", F.col("_at") + F.col("_base")).drop("_part", "_base")
    labels = labels.withColumn("_to", F.explode("_to")).select(
        F.col("_to._part").alias("_part"), "author", F.floor(F.col("_at") / turn).alias("_turn"), F.lit(0).alias("_kind"), "_at", "_n", "_size", F.col("_to._base").alias("_base"), "_h", "labels")
    # Clusters of more labels than a task holds: one for each 64 MB of labels there are at most.
    large = spans.filter(F.col("_size") > turn).select("author", F.floor((F.col("_size") - 1) / turn).alias("_last")).distinct()
    rows = saved.filter("_kind = 1").drop("labels").join(F.broadcast(large), "author", "left")
    rows = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_last", F.lit(0).cast("bigint"))))).drop("_last")
    both = labels.unionByName(rows, allowMissingColumns=True).repartitionById(parts, F.col("_part"))
    both = both.sortWithinPartitions("_part", "author", "_turn", "_kind", "_at")
    new = both.mapInArrow(dealt_sums(bits, width, reps, held, gathered), f"rep bigint, _cell int, _s {kind['score']}, _p bigint")
    return new.join(F.broadcast(cells), "_cell").select("rep", *[F.col(f"_of_{k}").alias(k) for k in by], "_s", "_p")


def changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in names:
        x = t.column(c).combine_chunks()
        other = pc.not_equal(x.slice(1), x.slice(0, max(len(x) - 1, 0))).fill_null(False).to_numpy(zero_copy_only=False)
        void = x.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= other | (void[1:] != void[:-1])
    return new


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values, each from one start to the next."""
    ends = np.append(starts, len(data)) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def listed(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """A list column's values, and where each row's begin, with the end."""
    whole = column.combine_chunks()
    sizes = pc.list_value_length(whole).to_numpy(zero_copy_only=False)
    return whole.flatten(), np.append(0, np.cumsum(sizes)).astype(np.int64)


def pieces(width: int):
    """Rows of author, row_id, _cell, _bit, score: those of one row id that lie together become one, with labels as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            starts = np.flatnonzero(changes(t, ["author", "row_id"]))
            row = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(t)))
            cell, bit = (pc.fill_null(t.column(c).combine_chunks(), -1).to_numpy() for c in ("_cell", "_bit"))
            labels, on = np.zeros((len(starts), width), np.uint8), bit >= 0
            np.bitwise_or.at(labels, (row[on], bit[on] >> 3), (1 << (bit[on] & 7)).astype(np.uint8))
            scored = np.flatnonzero(cell >= 0)
            offsets = np.searchsorted(scored, np.append(starts, len(t)))
            kept = t.select(["author", "row_id"]).take(starts).combine_chunks()
            score = t.column("score").combine_chunks().take(pa.array(scored))
            columns = [kept.column(0), kept.column(1), binaries(labels, np.arange(len(starts))), listed(offsets, pa.array(cell[scored], pa.int32())), listed(offsets, score)]
            yield from pa.table(columns, names=["author", "row_id", "labels", "cells", "scores"]).to_batches()

    return run


def placed_rows(width: int):
    """Sorted pieces to whole rows with their place within author and partition (_kind 1), and to blocks of labels (_kind 0)."""
    names = ["author", "_part", "_kind", "_at", "_n", "labels", "cells", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last, gone = TaskContext.get().partitionId(), None, None, 0

        def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal last, gone
            starts = np.flatnonzero(changes(t, ["author", "row_id"]))
            labels = np.bitwise_or.reduceat(bytes_of(t.column("labels"), width), starts, axis=0)
            author = t.select(["author"]).take(starts).combine_chunks()
            n = len(author)
            runs = np.flatnonzero(changes(author, ["author"]))
            since = np.arange(n) - np.repeat(runs, np.diff(runs, append=n))
            same = last is not None and last == author.column(0)[0]
            at = since + np.where(np.arange(n) < np.append(runs, n)[1], gone if same else 0, 0)
            last, gone = author.column(0)[n - 1], int(at[-1]) + 1
            few = lambda value, size, kind: pa.array(np.full(size, value), kind)
            cut = np.flatnonzero(since % max(1, BLOCK // width) == 0)
            sizes = np.diff(cut, append=n)
            void = [pa.nulls(len(cut), t.schema.field(c).type) for c in ("cells", "scores")]
            yield from pa.table([author.column(0).take(pa.array(cut)), few(part, len(cut), pa.int32()), few(0, len(cut), pa.int32()), pa.array(at[cut]), pa.array(sizes), binaries(labels, cut), *void], names=names).to_batches()
            values = []
            for c in ("cells", "scores"):
                own, offsets = flat(t.column(c))
                values.append(listed(offsets[np.append(starts, len(t))], own))
            yield from pa.table([author.column(0), few(part, n, pa.int32()), few(1, n, pa.int32()), pa.array(at), few(1, n, pa.int64()), pa.nulls(n, pa.binary()), *values], names=names).to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not len(t):
                continue
            end = int(np.flatnonzero(changes(t, ["author", "row_id"]))[-1])  # the last row may go on in the next batch
            if end:
                yield from told(t.slice(0, end))
            held = t.slice(end)
        if held is not None and len(held):
            yield from told(held)

    return run


class Gathered:
    """Rows, their scores and their clusters' labels, until their replicates are made."""

    def __init__(self, bits: list[int], width: int, reps: int):
        self.bits, self.width, self.reps = np.array(bits, np.int64), width, reps
        self.labels, self.stored, self.rows, self.scores = [], 0, [], 0

    def add(self, rows: list[np.ndarray], cells: np.ndarray, scores: pa.Array) -> None:
        """rows: place, size, h, shift (from a place to its labels here), low, high (the places whose labels are here), scores a row."""
        self.rows.append((rows, cells, scores))
        self.scores += len(cells) + len(rows[0])

    def keep(self, start: int) -> None:
        """Forgets the rows, and the labels before start."""
        self.labels = [np.concatenate(self.labels)[start:]] if self.labels else []
        self.stored, self.rows, self.scores = self.stored - start, [], 0

    def told(self) -> Iterator[pa.RecordBatch]:
        """rep, _cell, _s, _p: where the dealt labels are positive, summed by score."""
        if not self.rows:
            return
        place, size, h, shift, low, high, lengths = (np.concatenate(x) for x in zip(*[r[0] for r in self.rows], strict=True))
        cell, scores = np.concatenate([r[1] for r in self.rows]).astype(np.int64), pa.concat_arrays([r[2] for r in self.rows])
        if not len(cell):
            return
        n, row, labels = len(place), np.repeat(np.arange(len(place)), lengths), np.concatenate(self.labels)
        scores = scores.dictionary_encode(null_encoding="encode")
        values = scores.dictionary
        known = pa.array(cell * len(values) + scores.indices.to_numpy()).dictionary_encode()
        found = known.dictionary.to_numpy()
        rank = np.empty(len(found), np.int64)
        rank[np.argsort(found)] = np.arange(len(found))
        code, found = rank[known.indices.to_numpy()], np.sort(found)
        bit = self.bits[found // len(values)]  # rises, as cells are in the order of classes
        order = np.argsort(self.bits[cell], kind="stable")
        ends = np.searchsorted(self.bits[cell][order], np.arange(self.bits[-1] + 2))
        groups = []  # class, first code, codes, and the code of each row, or -1, once for each candidate
        for b in np.unique(bit):
            own = order[ends[b] : ends[b + 1]]
            first, last = np.searchsorted(bit, [b, b + 1])
            r = row[own]
            new = np.append(True, r[1:] != r[:-1])
            layer = np.arange(len(r)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            table = np.full((layer.max() + 1, n), -1, np.int64)
            table[layer, r] = code[own] - first
            groups.append((int(b), first, last - first, table))
        step = max(1, min(self.reps, DEALT // (n * self.width), SUMS // max(g[2] for g in groups)))
        for a in range(0, self.reps, step):
            reps = np.arange(a, min(a + step, self.reps))
            dealt = np.empty((n, len(reps), self.width), np.uint8)
            for i in range(0, n, 4096):
                s = slice(i, i + 4096)
                at = images(place[s], size[s], h[s], reps)
                here = (at >= low[s, None]) & (at < high[s, None])
                dealt[s] = labels[np.where(here, at + shift[s, None], 0)]
                dealt[s][~here] = 0
            for b, first, codes, table in groups:
                i, r = np.divmod(np.flatnonzero(dealt[:, :, b >> 3] & (1 << (b & 7))), len(reps))
                sums = np.zeros(codes * len(reps), np.int64)
                for of_row in table:
                    k = of_row[i]
                    there = k >= 0
                    k = k * len(reps) + r
                    sums += np.bincount(k if there.all() else k[there], minlength=len(sums))
                on = np.flatnonzero(sums)
                k, r = np.divmod(on, len(reps))
                what, score = np.divmod(found[first + k], len(values))
                out = pa.table([pa.array(r + a), pa.array(what, pa.int32()), values.take(pa.array(score)), pa.array(sums[on])], names=["rep", "_cell", "_s", "_p"])
                yield from out.to_batches(max_chunksize=1 << 16)


def dealt_sums(bits: list[int], width: int, reps: int, most: int, gathered: int):
    """A sorted part's labels and rows, each cluster's labels first, to the positives by replicate, cell and score."""
    keys = ["_part", "author", "_turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, before, now, since = Gathered(bits, width, reps), None, None, 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            head = t.select(keys)
            new = changes(pa.concat_tables([before, head]), keys)[1:] if before is not None else changes(head, keys)
            before, cluster = head.slice(len(head) - 1), np.cumsum(new)  # cluster 0 goes on from the last batch
            # Of each cluster: where its labels start here, the first place and the place after the last, size, base, h.
            info = np.zeros((cluster[-1] + 1, 6), np.int64)
            info[0] = now if now is not None else 0
            kind, at = t.column("_kind").to_numpy(), t.column("_at").to_numpy()
            own, rest = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if len(own):
                told = t.select(["_n", "_size", "_base", "_h", "labels"]).take(own)
                n, c = told.column("_n").to_numpy(), cluster[own]
                which, first = np.unique(c, return_index=True)
                first, which = first[which > 0], which[which > 0]
                start = g.stored + np.cumsum(n) - n
                info[which, 0], info[which, 1], info[which, 2] = start[first], at[own[first]], at[own[first]]
                for k, name in enumerate(("_size", "_base", "_h"), 3):
                    info[which, k] = told.column(name).to_numpy()[first]
                np.add.at(info[:, 2], c, n)
                g.labels.append(bytes_of(told.column("labels"), width))
                g.stored, since = g.stored + int(n.sum()), since + int(n.sum())
            rest = rest[info[cluster[rest], 2] > info[cluster[rest], 1]]  # a block of labels that began in the turn before may hold a last turn's
            if len(rest):
                start, low, high, size, base, h = info[cluster[rest]].T
                told = t.select(["cells", "scores"]).take(rest)
                cells, offsets = flat(told.column("cells"))
                g.add([at[rest] + base, size, h, start - low, low, high, np.diff(offsets)], cells.to_numpy(), flat(told.column("scores"))[0])
            now = info[-1]
            if g.scores >= gathered or since * width >= most:
                yield from g.told()
                g.keep(int(now[0]))
                now[0], since = 0, 0
        yield from g.told()

    return run
