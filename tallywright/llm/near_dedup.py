"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification, connected components.

Every element (a distinct shingle of five words) is a Poisson process whose rate is its weight; each arrival hits a
random register, and a register keeps its earliest arrival's element. A process ends when its next arrival is later than
all registers' earliest, so long texts cost little more than one arrival an element. Two texts agree in a register with
the probability Jaccard of their weighted elements. All shingles weigh the same here, however often they stand in a text,
so that is the Jaccard similarity of the shingle sets, by which pairs are judged.

Texts that agree in a band of registers are candidates, and a candidate pair counts if the Jaccard similarity of its
shingle sets is 0.8 or more. Copies share a node of the graph (the digest of their words), so they are never paired.
Within a band's bucket, members are first compared with a leader; what that joins is one component, and only members of
different components are compared further, at last each with each, so no link is lost. Buckets of few members emit
these pairs as rows; larger ones are compared as blocks, by products of incidence matrices, and emit no more links than
join what was apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import LAST_ID, SPACE, WORD, bounded_batches, discard, release, shared_folder, table, written

#: Words in a shingle and the least similarity, as a fraction.
SHINGLE = 5
LEAST = (4, 5)
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
GROUP = 1 << 21
#: Buckets of more members are compared as blocks of about so many shingles and members at most.
FEW = 32
BLOCK = 400_000
MEMBERS = 1024
WORDS = re.compile(WORD)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


def shingles(texts: list[str | None], hashes: WordHashes) -> list[np.ndarray]:
    """The shingle hashes of each text, in order; a text of one to four words is one shingle, one without words has none."""
    words = [WORDS.findall(t or "") for t in texts]
    out = []
    for own in words:
        w = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
        n = min(SHINGLE, len(w))
        h = np.full(max(0, len(w) - n + 1) if n else 0, U(n))
        for k in range(n):
            h = h * U(0x9E3779B97F4A7C15) + w[k : k + len(h)]
        out.append(mixed(h))
    return out


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The signatures, docs x registers, of weighted elements given with their documents.

    All processes advance together, an arrival a round; those whose next arrival is later than their document's latest
    register drop out. Documents without elements have zeros.
    """
    first = np.full(docs * registers, np.inf)
    found = np.zeros(docs * registers, np.uint64)
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        r = mixed(element + U((step * 0xD1342543DE82EF95 + 1) % (1 << 64)))
        time = time - np.log(((r >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        at = doc * registers + (mixed(r + U(0x9E3779B97F4A7C15)) % U(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        found[at[won]] = element[won]
        last = first.reshape(docs, registers).max(axis=1)
        stay = time < last[doc]
        doc, element, weight, time = doc[stay], element[stay], weight[stay], time[stay]
        step += 1
    return found.reshape(docs, registers)


def grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, n in enumerate(sizes):
        if size and size + n > GROUP:
            yield start, k
            start, size = k, 0
        size += n
    if sizes:
        yield start, len(sizes)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, fp, text to doc, fp, n (distinct shingles) and bands."""
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in grouped([len(t or "") for t in texts]):
            sets = [np.unique(h) for h in shingles(texts[a:b], hashes)]
            n = np.array([len(s) for s in sets], np.int64)
            doc = np.repeat(np.arange(b - a), n)
            found = probminhash(doc, np.concatenate(sets), np.ones(len(doc)), b - a)
            bands = np.zeros((b - a, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                bands = mixed(bands * U(0x9E3779B97F4A7C15) + found[:, k::ROWS])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(bands.astype(np.int64).ravel()))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_pydict({"doc": part.column("doc"), "fp": part.column("fp"), "n": pa.array(n), "bands": lists})


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, text to fp and its set of shingles."""
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in grouped([len(t or "") for t in texts]):
            sets = [np.unique(h).astype(np.int64) for h in shingles(texts[a:b], hashes)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_pydict({"fp": batch.column("fp").slice(a, b - a), "shingles": lists})


def fingerprint(text: Column) -> Column:
    """128 bits of a text's words."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.unhex(F.md5(words.cast("binary")))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node and root, the smallest node of its connected component, for the nodes of edges a, b.

    Minimum labels spread along edges and jump to their labels' labels; each round is a table in the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), folder, f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = labels.join(near, "node").join(jump, "root", "left")
        new = new.select("node", F.least("root", "near", F.coalesce("far", "root")).alias("root"), F.col("root").alias("old"))
        new = written(new, folder, f"{name}-{step}")
        labels = new.select("node", "root")
        discard(edges.sparkSession, folder, f"{name}-{step - 1}")
        if new.filter("root <> old").isEmpty():
            discard(edges.sparkSession, folder, f"{name}-edges")
            return labels


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose shingle sets are similar enough."""
    one = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("x", "y"))
    least, of = LEAST
    return joined.filter(of * shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b")


def linked(block: pa.Table) -> pa.Table:
    """fp, root, shingles of a block, or of two, to links a, b that join nodes of different roots."""
    size = np.array([len(x) for x in block.column("shingles")])
    values = block.column("shingles").combine_chunks().flatten().to_numpy()
    fps, roots = block.column("fp").to_pylist(), block.column("root").to_pylist()
    count = len(size)
    _, place, often = np.unique(values, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(count), size)
    column = np.cumsum(often > 1) - 1
    keep = often[place] > 1
    doc, place = doc[keep], column[place[keep]]
    shared = np.zeros((count, count), np.float32)
    order = np.argsort(place, kind="stable")
    doc, place = doc[order], place[order]
    for a in range(0, int((often > 1).sum()), 4096):
        part = slice(*np.searchsorted(place, [a, a + 4096]))
        held = np.zeros((count, min(4096, int((often > 1).sum()) - a)), np.float32)
        held[doc[part], place[part] - a] = 1
        shared += held @ held.T
    least, of = LEAST
    similar = of * shared >= least * (size[:, None] + size[None] - shared)
    seen, links = np.zeros(count, bool), []
    for start in range(count):
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            k = stack.pop()
            new = np.flatnonzero(similar[k] & ~seen)
            seen[new] = True
            links += [(fps[k], fps[j]) for j in new if roots[k] != roots[j]]
            stack += new.tolist()
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})


def links_of_blocks(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """The links within large buckets: band, fp, n, root, members and total (the bucket's shingles).

    A task meets two blocks, so its matrices have about (2 * MEMBERS) ** 2 cells however short the texts are.
    """
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK, F.col("members") / MEMBERS)).cast("int")
    own = open_.withColumn("i", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.select("band", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp", "root").join(sets, "fp")
    return own.groupBy("band", "i", "j").applyInArrow(lambda t: linked(t), "a binary, b binary").distinct()


def close(n: str, m: str) -> Column:
    """The sizes allow enough similarity."""
    least, of = LEAST
    return of * F.least(n, m) >= least * F.greatest(n, m)


def classes(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows as doc, fp, n, and the nodes' classes: fp, root and class_doc, the class's smallest document.

    Only nodes that share a class with another are in the second frame.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(doc_key().alias("doc"), fingerprint(F.col("text")).alias("fp"), "text")
    rows = written(rows.mapInArrow(signed, "doc bigint, fp binary, n bigint, bands array<bigint>"), folder, "signatures")
    nodes = rows.filter("n > 0").groupBy("fp").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes, folder, "nodes")
    member = nodes.select("fp", "doc", "n", F.explode("bands").alias("band"))
    leaders = member.groupBy("band").agg(F.count("*").alias("members"), F.min(F.struct("doc", "fp", "n")).alias("leader"))
    member = written(member.join(leaders.filter("members > 1").select("band", "leader"), "band"), folder, "buckets")

    wanted = member.select("fp", "doc").distinct()
    texts = docs.select(doc_key().alias("doc"), fingerprint(F.col("text")).alias("fp"), "text")
    texts = texts.join(wanted.hint("shuffle_hash"), ["doc", "fp"], "left_semi")
    sets = written(texts.select("fp", "text").mapInArrow(sets_of, "fp binary, shingles array<bigint>").dropDuplicates(["fp"]), folder, "sets")

    root_of = None
    tested = None

    def roots(frame: DataFrame) -> DataFrame:
        """Adds root, a node's component so far."""
        if root_of is None:
            return frame.withColumn("root", F.col("fp"))
        known = root_of.withColumnRenamed("node", "fp").withColumnRenamed("root", "known")
        return frame.join(known, "fp", "left").withColumn("root", F.coalesce("known", "fp")).drop("known")

    for step in range(3):
        open_ = roots(member)
        if step:
            mixed_ = open_.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
            open_ = written(open_.join(mixed_.select("band"), "band", "left_semi"), folder, f"open-{step}")
            if open_.isEmpty():
                break
        if step == 0:
            pairs = open_.select(F.col("fp").alias("a"), F.col("leader.fp").alias("b"), "n", F.col("leader.n").alias("m"))
        elif step == 1:
            order = F.xxhash64("fp")
            other = open_.groupBy("band").agg(F.min(F.struct(order.alias("o"), "fp", "n", "root")).alias("lead"))
            pairs = open_.join(other, "band").filter("root <> lead.root")
            pairs = pairs.select(F.col("fp").alias("a"), F.col("lead.fp").alias("b"), "n", F.col("lead.n").alias("m"))
        else:
            many = open_.groupBy("band").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
            open_ = open_.join(many, "band")
            large = links_of_blocks(open_.filter(F.col("members") > FEW), sets)
            open_ = open_.filter(F.col("members") <= FEW)
            peers = open_.select("band", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("root").alias("peer"))
            pairs = open_.select("band", F.col("fp").alias("a"), "n", "root").join(peers, "band").filter(F.col("root") < F.col("peer"))
            pairs = pairs.select("a", "b", "n", "m")
        pairs = pairs.filter((F.col("a") != F.col("b")) & close("n", "m"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, folder, f"pairs-{step}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = verified(pairs, sets)
        if step == 2:
            links = links.unionByName(large)
        if root_of is not None:
            links = links.unionByName(root_of.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        root_of = components(links, folder, f"components-{step}")
        release(docs.sparkSession)

    low = root_of.join(nodes.select(F.col("fp").alias("node"), "doc"), "node")
    first = low.groupBy("root").agg(F.min(F.struct("doc", F.col("node").alias("fp"))).alias("head"))
    found = low.join(first, "root").select(F.col("node").alias("fp"), "root", F.col("head.doc").alias("class_doc"), F.col("head.fp").alias("class_fp"))
    found = written(found, folder, "classes")
    steps = range(3)
    discard(docs.sparkSession, folder, "nodes", "buckets", "sets", *[f"open-{k}" for k in steps], *[f"pairs-{k}" for k in steps])
    return rows.select("doc", "fp", "n"), found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The class of every document: doc_id, class_id (the smallest doc_id of its class), n_shingles.

    docs: doc_id, text; other columns are not read. Texts with the same words are one class, and so are texts linked by
    a chain of pairs with a similarity of 0.8 or more. A text of one to four words has one shingle; texts without words
    (null, empty, blank) are in classes of their own. Repeated rows give a row each. A null id comes after all others: a
    class of null ids has a null class_id. An empty table gives no rows.
    """
    rows, found = classes(docs, shared_folder(docs.sparkSession))
    smallest = rows.filter("n > 0").groupBy("fp").agg(F.min("doc").alias("own_doc"))
    known = smallest.join(found.select("fp", "class_doc"), "fp", "left").select("fp", F.coalesce("class_doc", "own_doc").alias("class_doc"))
    out = rows.join(known, "fp", "left")
    plain = lambda c: F.when(c != LAST_ID, c)
    of = F.when(F.col("n") > 0, F.col("class_doc")).otherwise(F.col("doc"))
    return out.select(plain(F.col("doc")).alias("doc_id"), plain(of).alias("class_id"), F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns; texts without words all stay."""
    rows, found = classes(docs, shared_folder(docs.sparkSession))
    heads = rows.filter("n > 0").groupBy("fp").agg(F.min("doc").alias("doc"))
    heads = heads.join(found, "fp", "left").filter(F.col("class_fp").isNull() | (F.col("class_fp") == F.col("fp"))).select("doc", "fp")
    given = docs.select(F.struct("*").alias("row"), doc_key().alias("doc"), fingerprint(F.col("text")).alias("fp"), F.coalesce(F.col("text"), F.lit("")).rlike(f"[^{SPACE}]").alias("said"))
    kept = given.filter("said").join(heads.hint("shuffle_hash"), ["doc", "fp"], "left_semi").dropDuplicates(["doc", "fp"])
    return kept.select("row.*").unionByName(given.filter("not said").select("row.*"))


def query(spark, sf_dir) -> DataFrame:
    """Query op9: the near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
