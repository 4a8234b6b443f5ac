"""Exact top-k search by inner product with dual cover trees.

Vectors become integers, floor(1024 * x), so scores are exact. Rows go to the nearest of a bounded number of pivots, and a
pivot's rows are split by hash into blocks, so a block's rows lie near one another and no pivot's are too many. A cover
tree is built over each block, once, and written; so are trees over the queries, in groups. A node has a centre and a
covering radius; its children cover balls of a smaller radius around greedily chosen, separated centres, and what the
balls leave stays with the node.

For a query node with centre a and radius r, and a data node with centre b and radius s, no score exceeds
a.b + |a|s + r|b| + rs. Trees are searched together, and a pair of nodes is dropped if this is below the worst kth score of
the node's queries. That is done in two rounds: each group of queries first meets the block that it lies in, which gives
its queries a worst kth score; then only the blocks whose root can reach the worst of a group's are met, the most
promising first, and the scores so far are carried along. What no block or node can rule out is compared, so the result
is exact; on vectors without structure that is every row.

A task holds one group and a few blocks. Queries and blocks are replicated for the pairs that are left, never as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import LAST_ID, shared_folder, table, written

K = 10
SCALE = 1024.0
BLOCK = 8192
QUERIES = 4096
#: Pivots, and numbers in all of them, that are sent to every task; vectors that each is chosen from.
PIVOTS = 1024
SAMPLE = 8
PIVOT_NUMBERS = 1 << 22
#: Cells whose counts are broadcast; more are joined.
MOST_CELLS = 100_000
#: Blocks that a task of the second round holds; roots of groups and of blocks that are compared at once.
TOGETHER = 16
ROOTS = 2048
#: Cover trees: radii shrink by this base; balls of fewer points than a leaf stay with their node; centres a node.
BASE = 1.3
LEAF = 48
QUERY_LEAF = 4
CENTRES = 64
EXACT = float(1 << 53)
#: A tree's nodes in preorder. Members are the places lo to hi, of which those up to rest are in no child; end is the
#: number of the next node that is not below.
NODE = np.dtype([("centre", "i8"), ("radius", "f8"), ("norm", "f8"), ("lo", "i8"), ("rest", "i8"), ("hi", "i8"), ("end", "i8")])
TREE = "dim int, part bigint, ids binary, marks binary, points binary, nodes binary, centre array<double>, radius double, norm double"


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A cover tree over the rows of points (float64): the order of the rows, in which members lie together, and the nodes."""
    order: list[np.ndarray] = []
    nodes: list[list] = []
    placed = 0

    def build(members: np.ndarray, pivot: int) -> None:
        nonlocal placed
        distance = np.sqrt(((points[members] - points[pivot]) ** 2).sum(axis=1))
        radius = float(distance.max())
        at, low, children, small, left = len(nodes), placed, [], [], members
        nodes.append([pivot, radius * (1 + 1e-9), float(np.sqrt((points[pivot] ** 2).sum())), low, 0, 0, 0])
        if len(members) > leaf and radius > 0:
            reach = radius / BASE
            for _ in range(CENTRES):
                if not len(left):
                    break
                near_to = pivot if len(left) == len(members) else int(left[0])
                near = np.sqrt(((points[left] - points[near_to]) ** 2).sum(axis=1)) <= reach
                ball, left = left[near], left[~near]
                if len(ball) < leaf or len(ball) == len(members):
                    small.append(ball)
                else:
                    children.append((ball, near_to))
        rest = np.concatenate([left, *small]) if children else members
        order.append(rest)
        placed += len(rest)
        nodes[at][4] = placed
        for ball, centre in children:
            build(ball, centre)
        nodes[at][5:] = placed, len(nodes)

    build(np.arange(len(points)), 0)
    where = np.concatenate(order)
    back = np.empty(len(where), np.int64)
    back[where] = np.arange(len(where))
    table_ = np.array([tuple(n) for n in nodes], NODE)
    table_["centre"] = back[table_["centre"]]
    return where, table_


class Tree:
    """A cover tree with its points; marks tell queries of one id apart."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, marks: np.ndarray, nodes: np.ndarray):
        self.points, self.ids, self.marks = points, ids, marks
        self.flat = points.astype(np.float64)
        self.largest = float(np.abs(self.flat).max(initial=0))
        self.centre, self.radius, self.norm, self.lo, self.rest, self.hi, self.end = (nodes[n].tolist() for n in NODE.names)

    @classmethod
    def over(cls, points: np.ndarray, ids: np.ndarray, marks: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
        where, nodes = cover_tree(points.astype(np.float64), leaf)
        return cls(points[where], ids[where], marks[where], nodes), nodes

    @classmethod
    def read(cls, row: dict) -> Tree:
        ids, marks = (np.frombuffer(row[n], np.int64) for n in ("ids", "marks"))
        kind = np.int32 if len(row["points"]) == len(ids) * row["dim"] * 4 else np.int64
        points = np.frombuffer(row["points"], kind).astype(np.int64).reshape(len(ids), row["dim"])
        return cls(points, ids, marks, np.frombuffer(row["nodes"], NODE))

    def children(self, node: int) -> list[int]:
        out, at = [], node + 1
        while at < self.end[node]:
            out.append(at)
            at = self.end[at]
        return out


def bounds(a: np.ndarray, a_radius, a_norm, b: np.ndarray, b_radius, b_norm) -> np.ndarray:
    """The most that a product of a point in a's ball and one in b's can be, and a little for rounding."""
    a_radius, a_norm = np.asarray(a_radius)[..., None], np.asarray(a_norm)[..., None]
    top = a @ b.T + a_norm * b_radius + a_radius * b_norm + a_radius * b_radius
    return top + 1e-9 * (a_norm + a_radius) * (b_norm + b_radius)


class Search:
    """The best k candidates of each query, ties to the smaller id, among the blocks that it meets."""

    def __init__(self, queries: Tree, k: int, worst: np.ndarray | None = None):
        self.q, self.k = queries, k
        self.tops = [np.zeros((0, 2), np.int64)] * len(queries.ids)  # score, id
        self.worst = np.full(len(queries.ids), -np.inf) if worst is None else worst.copy()
        self.pairs = self.dropped = self.products = 0

    def meet(self, p: Tree, a: slice, b: slice) -> None:
        """Scores the queries a against the points b."""
        step = max(1, 2_000_000 // max(1, a.stop - a.start))
        for start in range(b.start, b.stop, step):
            part = slice(start, min(b.stop, start + step))
            self.products += (a.stop - a.start) * (part.stop - part.start)
            if (self.q.largest + 1) * (p.largest + 1) * (p.points.shape[1] + 1) < EXACT:
                scores = (self.q.flat[a] @ p.flat[part].T).astype(np.int64)
            else:
                scores = self.q.points[a] @ p.points[part].T  # 64-bit integers; scores beyond them wrap
            ids = p.ids[part]
            for row, query in zip(scores, range(a.start, a.stop), strict=True):
                good = np.flatnonzero((row >= self.worst[query]) & (ids != self.q.ids[query]))
                if len(good) > 4 * self.k:  # only those above the kth count, and its ties
                    kth = np.partition(row[good], len(good) - self.k)[len(good) - self.k]
                    good = good[row[good] >= kth]
                if len(good):
                    both = np.concatenate([self.tops[query], np.stack([row[good], ids[good]], axis=1)])
                    both = both[np.lexsort((both[:, 1], -both[:, 0]))[: self.k]]
                    self.tops[query] = both
                    if len(both) == self.k:
                        self.worst[query] = max(self.worst[query], both[-1, 0])

    def visit(self, p: Tree) -> None:
        """Searches a block for all queries."""
        q = self.q
        grandchildren = {}

        def below(tree: Tree, node: int) -> list[int]:
            key = (tree is q, node)
            if key not in grandchildren:
                grandchildren[key] = tree.children(node)
            return grandchildren[key]

        def reach(a: int, b: list[int]) -> np.ndarray:
            c = [p.centre[n] for n in b]
            return bounds(q.flat[q.centre[a]][None], [q.radius[a]], [q.norm[a]], p.flat[c], np.array([p.radius[n] for n in b]), np.array([p.norm[n] for n in b]))[0]

        #: (query node, its own rest only, data node, its own rest only, bound)
        stack = [(0, False, 0, False, float(reach(0, [0])[0]))]
        while stack:
            a, a_rest, b, b_rest, top = stack.pop()
            self.pairs += 1
            own = slice(q.lo[a], q.rest[a] if a_rest else q.hi[a])
            if own.start == own.stop or top < self.worst[own].min():
                self.dropped += 1
                continue
            a_parts = [] if a_rest else below(q, a)
            b_parts = [] if b_rest else below(p, b)
            if b_parts and (p.radius[b] >= q.radius[a] or not a_parts):
                tops = reach(a, b_parts)
                if p.rest[b] > p.lo[b]:
                    stack.append((a, a_rest, b, True, top))
                stack += [(a, a_rest, b_parts[n], False, float(tops[n])) for n in np.argsort(tops)]
            elif a_parts:
                if q.rest[a] > q.lo[a]:
                    stack.append((a, True, b, b_rest, top))
                stack += [(c, False, b, b_rest, float(reach(c, [b])[0])) for c in a_parts]
            else:
                self.meet(p, own, slice(p.lo[b], p.rest[b] if b_rest else p.hi[b]))


def planted(leaf: int):
    """dim, part, vec_id, mark, v of one part to its tree, a row."""

    def plant(key: tuple, rows: pa.Table) -> pa.Table:
        dim, part = key[0].as_py(), key[1].as_py()
        points = np.array(rows.column("v").combine_chunks().flatten().to_numpy(), np.int64).reshape(len(rows), dim)
        ids, marks = rows.column("vec_id").to_numpy(), rows.column("mark").to_numpy()
        order = np.lexsort((marks, ids))  # the tree doesn't depend on the order of arrival
        tree, nodes = Tree.over(points[order], ids[order], marks[order], leaf)
        small = tree.points.astype(np.int32) if tree.largest < 1 << 31 else tree.points
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int64()), "ids": [tree.ids.tobytes()], "marks": [tree.marks.tobytes()], "points": [small.tobytes()],
                "nodes": [nodes.tobytes()], "centre": pa.array([tree.flat[tree.centre[0]]], pa.list_(pa.float64())), "radius": [tree.radius[0]], "norm": [tree.norm[0]],
            }
        )

    return plant


TOPS = "dim int, part bigint, query_id bigint, mark bigint, vec_id bigint, score bigint, worst double, pairs bigint, dropped bigint, products bigint"


def tops_of(dim: int, part: int, search: Search, all_: bool) -> pa.Table:
    """The best of each query found here; with all_, a row without vec_id for queries that found none. Counters stand in the first row."""
    out: dict[str, list] = {n: [] for n in ("query_id", "mark", "vec_id", "score", "worst")}
    for n, (query, mark, top) in enumerate(zip(search.q.ids.tolist(), search.q.marks.tolist(), search.tops, strict=True)):
        rows = top.tolist() or ([[None, None]] if all_ else [])
        for score, vec_id in rows:
            for name, value in zip(out, (query, mark, vec_id, score, float(search.worst[n])), strict=True):
                out[name].append(value)
    if not out["query_id"]:
        for name in out:
            out[name].append(None)
    size = len(out["query_id"])
    counters = {n: pa.array([v] + [0] * (size - 1), pa.int64()) for n, v in (("pairs", search.pairs), ("dropped", search.dropped), ("products", search.products))}
    kinds = {"worst": pa.float64()}
    return pa.table({"dim": pa.array([dim] * size, pa.int32()), "part": pa.array([part] * size, pa.int64())} | {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()} | counters)


def first_round(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """A group's queries against the block that it lies in."""
    if not len(queries):
        return tops_none()
    row = queries.to_pylist()[0]
    search = Search(Tree.read(row), K)
    for block in blocks.to_pylist():
        search.visit(Tree.read(block))
    return tops_of(row["dim"], row["part"], search, True)


def tops_none() -> pa.Table:
    kinds = {"dim": pa.int32(), "worst": pa.float64()}
    return pa.table({n: pa.array([], kinds.get(n, pa.int64())) for n in ("dim", "part", "query_id", "mark", "vec_id", "score", "worst", "pairs", "dropped", "products")})


def second_round(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """A group's queries, with their worst kth scores so far, against some blocks, the most promising first."""
    if not len(queries) or not len(blocks):
        return tops_none()
    row = queries.to_pylist()[0]
    tree = Tree.read(row)
    known = {(w["query_id"], w["mark"]): w["worst"] for w in row["so_far"]}
    search = Search(tree, K, np.array([known[key] for key in zip(tree.ids.tolist(), tree.marks.tolist(), strict=True)], np.float64))
    for block in sorted(blocks.to_pylist(), key=lambda b: b["place"]):
        search.visit(Tree.read(block))
    return tops_of(row["dim"], row["part"], search, False)


def reachable(groups: pa.Table, blocks: pa.Table) -> pa.Table:
    """The pairs of a group and a block whose bound is not below the group's worst kth score: dim, part, block, top."""
    out: dict[str, list] = {"part": [], "block": [], "top": []}
    if len(groups) and len(blocks):
        matrix = lambda t: np.array(t.column("centre").to_pylist(), np.float64)
        plain = lambda t, n: t.column(n).to_numpy()
        top = bounds(matrix(groups), plain(groups, "radius"), plain(groups, "norm"), matrix(blocks), plain(blocks, "radius"), plain(blocks, "norm"))
        met = plain(groups, "own")[:, None] == plain(blocks, "part")[None]
        a, b = np.nonzero((top >= plain(groups, "worst")[:, None]) & ~met)
        out = {"part": plain(groups, "part")[a], "block": plain(blocks, "part")[b], "top": top[a, b]}
    dim = groups.column("dim")[0].as_py() if len(groups) else 0
    size = len(out["part"])
    return pa.table({"dim": pa.array([dim] * size, pa.int32()), "part": pa.array(out["part"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "top": pa.array(out["top"], pa.float64())})


def apart(points: np.ndarray, most: int) -> np.ndarray:
    """So many of the points, each the farthest from those before it."""
    taken = [0]
    distance = ((points - points[0]) ** 2).sum(axis=1)
    while len(taken) < min(most, len(points)):
        taken.append(int(distance.argmax()))
        distance = np.minimum(distance, ((points - points[taken[-1]]) ** 2).sum(axis=1))
    return points[taken]


def nearest(pivots: dict[int, np.ndarray]):
    """Adds cell, the nearest pivot among those of the vector's length."""

    def run(batches):
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                own = pivots.get(dim)
                if own is not None and len(own) > 1 and dim:
                    v = np.array(batch.column("v").take(pa.array(rows)).flatten().to_numpy(), np.float64).reshape(len(rows), dim)
                    half = (own**2).sum(axis=1) / 2
                    for a in range(0, len(rows), 4096):
                        cell[rows[a : a + 4096]] = (half - v[a : a + 4096] @ own.T).argmin(axis=1)
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("vec_id", "v", "dim", "mark")} | {"cell": pa.array(cell)})

    return run


def parted(rows: DataFrame, size: int) -> DataFrame:
    """Splits each cell's rows by hash into parts of about so many; part numbers are cell << 32 | piece."""
    counts = rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > size)
    counts = counts.select("dim", "cell", F.ceil(F.col("n") / size).cast("long").alias("pieces"))
    few = counts.limit(MOST_CELLS + 1).count() <= MOST_CELLS  # as a rule: there are no more cells than pivots
    rows = rows.join(F.broadcast(counts) if few else counts, ["dim", "cell"], "left")
    piece = F.pmod(F.xxhash64("mark", "vec_id"), F.coalesce("pieces", F.lit(1).cast("long")))
    return rows.select("dim", "vec_id", "mark", "v", F.shiftleft(F.col("cell").cast("long"), 32).bitwiseOR(piece).alias("part"))


def searched(vectors: DataFrame, modulus: int = 100, block: int = BLOCK, queries: int = QUERIES) -> dict[str, DataFrame]:
    """search()'s result as best, and report: how many pairs of nodes were met and dropped, pairs of blocks and groups, and products."""
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & fine)
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    rows = rows.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(LAST_ID)).alias("vec_id"), ints.alias("v"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("mark", F.xxhash64("vec_id", "v"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(PIVOTS).collect()}
    pivots = {}
    for dim, n in counts.items():
        most = min(2 * -(-n // block), PIVOTS, PIVOT_NUMBERS // max(1, dim * len(counts)))
        if n > block and most > 1:
            some = rows.filter(F.col("dim") == dim).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE * most).collect()
            pivots[dim] = apart(np.array([r["v"] for r in some], np.float64), most)
    celled = written(rows.mapInArrow(nearest(pivots), "vec_id bigint, v array<bigint>, dim int, mark bigint, cell int"), folder, "cells")
    trees = written(parted(celled, block).groupBy("dim", "part").applyInArrow(planted(LEAF), TREE), folder, "blocks")
    asked = celled.filter((F.col("vec_id") % modulus == 0) & (F.col("vec_id") != LAST_ID)).distinct()
    groups = written(parted(asked, queries).groupBy("dim", "part").applyInArrow(planted(QUERY_LEAF), TREE), folder, "groups")

    home = F.shiftleft(F.shiftright("part", 32), 32)  # the first block of the group's cell
    first = trees.groupBy("dim", home.alias("home")).agg(F.min("part").alias("own"))
    groups = groups.withColumn("home", home).join(first, ["dim", "home"]).drop("home")
    one = groups.withColumn("pair", F.col("part")).groupBy("dim", "own", "pair")
    met = trees.join(groups.select("dim", F.col("own").alias("part"), F.col("part").alias("pair")), ["dim", "part"]).withColumnRenamed("part", "own")
    near = written(one.cogroup(met.groupBy("dim", "own", "pair")).applyInArrow(first_round, TOPS), folder, "near")

    worst = near.filter("query_id is not null").groupBy("dim", "part", "query_id", "mark").agg(F.min("worst").alias("worst"))
    worst = worst.groupBy("dim", "part").agg(F.collect_list(F.struct("query_id", "mark", "worst")).alias("so_far"), F.min("worst").alias("worst"))  # a group's queries
    worst = written(worst, folder, "worst")
    roots = groups.select("dim", "part", "own", "centre", "radius", "norm").join(worst.select("dim", "part", "worst"), ["dim", "part"])
    lots = {n: max(1, -(-f.count() // ROOTS)) for n, f in (("groups", groups), ("blocks", trees))}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(lots[n] - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("part"), F.lit(lots[n])).cast("int")
    left = roots.withColumn("i", dealt("groups")).withColumn("j", every("blocks"))
    right = trees.select("dim", "part", "centre", "radius", "norm").withColumn("j", dealt("blocks")).withColumn("i", every("groups"))
    pairs = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(reachable, "dim int, part bigint, block bigint, top double")
    place = F.row_number().over(Window.partitionBy("dim", "part").orderBy(F.desc("top"), "block")) - 1
    pairs = written(pairs.withColumn("place", place).withColumn("lot", F.floor(F.col("place") / TOGETHER)), folder, "pairs")

    lot = pairs.select("dim", "part", F.col("lot").alias("deal")).distinct()
    left = groups.join(lot, ["dim", "part"]).join(worst.select("dim", "part", "so_far"), ["dim", "part"])
    right = trees.withColumnRenamed("part", "block").join(pairs.select("dim", "part", "block", "place", "lot"), ["dim", "block"])
    far = left.groupBy("dim", "part", "deal").cogroup(right.groupBy("dim", "part", "lot")).applyInArrow(second_round, TOPS)
    far = written(far, folder, "far")

    tops = near.unionByName(far).filter("vec_id is not null")
    best = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    ranked = tops.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K)
    ranked = ranked.select("query_id", "rank", F.when(F.col("vec_id") != LAST_ID, F.col("vec_id")).alias("vec_id"), "score")
    report = near.unionByName(far).agg(F.sum("pairs").alias("node_pairs"), F.sum("dropped").alias("dropped"), F.sum("products").alias("products"))
    report = report.crossJoin(pairs.agg(F.count("*").alias("block_pairs")))  # one row each
    return {"best": ranked, "report": report}


def search(vectors: DataFrame, modulus: int = 100, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The K best rows by inner product for each row whose vec_id is divisible by modulus.

    vectors: vec_id, embedding; other columns are not read. Vectors that are null or hold a null, NaN or infinite
    component take no part; vectors of different lengths never meet. Rows with a query's own vec_id are not its
    candidates; a row that is repeated is one query and as many candidates. A null vec_id is no query, and as a
    candidate comes last in ties. An empty table gives no rows. Returns query_id, rank (from 1), vec_id, score. Scores
    beyond 64 bits wrap.
    """
    return searched(vectors, modulus, block, queries)["best"]


def query(spark, sf_dir) -> DataFrame:
    """Query op8: the ten best rows of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
