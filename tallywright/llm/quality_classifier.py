"""Quality classifier: a byte-level convolutional network in numpy.

Filters of 8 bytes run over every byte of a document. Their responses are max-pooled over chunks of 256 places that
overlap by half and cover the whole document; the document's features are the mean and the maximum of its chunks'
pooled responses, and a logistic unit combines them into one probability. Training is plain backpropagation with Adam
over the whole texts of a sample of labelled documents, bounded by rows and by bytes.

A filter bank is one table of responses for each of its 8 places and each byte value; for scoring, neighbouring places
are paired, so that a place costs four look-ups. Scoring is a map over the documents: no shuffle, and no more memory than
a batch of texts and a slice of responses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import bounded_batches, id_crc, table

FILTERS = 16
WIDTH = 8
BLOCK = 128
SLICE = 256 * BLOCK
GROUP = 1 << 20
#: The bounds of the sample: labelled documents of each class, taken in the order of a hash of their ids, until so many
#: bytes are reached. Texts are never cut: the last one taken is whole too.
SAMPLE = 1500
SAMPLE_BYTES = 24 << 20
SEED = 11


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the mean, of the maximum
    offset: float

    def pairs(self) -> np.ndarray:
        t = self.taps.astype(np.float32)
        out = np.empty((WIDTH // 2, 256, 256, t.shape[2]), np.float32)
        for k in range(0, WIDTH, 2):
            np.add(t[k][:, None], t[k + 1][None], out=out[k // 2])
        return out.reshape(WIDTH // 2, -1, t.shape[2])


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts padded to blocks, each with zeros behind it; the number of blocks and of bytes of each."""
    sizes = np.array([len(t) for t in texts])
    blocks = (sizes + WIDTH - 1 + BLOCK - 1) // BLOCK
    parts = [x for t, n in zip(texts, blocks, strict=True) for x in (t, bytes(int(n) * BLOCK - len(t)))]
    return np.frombuffer(b"".join([*parts, bytes(WIDTH)]), np.uint8), blocks, sizes


def responses(pairs: np.ndarray, data: np.ndarray, a: int, b: int) -> np.ndarray:
    two = data[a : b + WIDTH - 2].astype(np.uint16) << 8 | data[a + 1 : b + WIDTH - 1]
    n = b - a
    out = pairs[0].take(two[:n], axis=0)
    for k in range(1, WIDTH // 2):
        out += pairs[k].take(two[2 * k : 2 * k + n], axis=0)
    return out


def pooled(pairs: np.ndarray, texts: list[bytes], where: bool = False):
    """Block maxima of the texts' responses, the blocks of each text, and with where the places of the maxima."""
    data, blocks, sizes = laid_out(texts)
    ends = np.cumsum(blocks) * BLOCK
    total = int(ends[-1]) if len(ends) else 0
    padding = [np.arange(e - n * BLOCK + size, e) for e, n, size in zip(ends, blocks, sizes, strict=True)]
    void = np.concatenate(padding) if padding else np.zeros(0, np.int64)  # the places behind each text
    best, at = [], []
    for a in range(0, total, SLICE):
        b = min(a + SLICE, total)
        r = responses(pairs, data, a, b)
        r[void[slice(*np.searchsorted(void, [a, b]))] - a] = -1e9
        r = r.reshape(-1, BLOCK, r.shape[1])
        best.append(r.max(axis=1))
        if where:
            at.append(r.argmax(axis=1) + a + BLOCK * np.arange(len(r))[:, None])
    filters = pairs.shape[2]
    best = np.concatenate(best) if best else np.zeros((0, filters), np.float32)
    return best, blocks, np.maximum(1, (sizes + BLOCK - 1) // BLOCK), (np.concatenate(at) if at else None), data


def chunks_of(blocks: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk's first and second block, and where each text's chunks begin."""
    count = np.maximum(1, full - 1)
    begin = np.concatenate(([0], np.cumsum(count)))
    first = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(np.cumsum(blocks) - blocks, count)
    return first, first + np.repeat((full > 1).astype(np.int64), count), begin


def features(net: Network, pairs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The mean and the maximum over chunks, for each text."""
    best, blocks, full, _, _ = pooled(pairs, texts)
    first, second, begin = chunks_of(blocks, full)
    c = np.maximum(np.maximum(best[first], best[second]) + net.bias, 0)
    mean = np.add.reduceat(c, begin[:-1], axis=0) / np.diff(begin)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(c, begin[:-1], axis=0)], axis=1)


def score(net: Network, pairs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(features(net, pairs, texts) @ net.weights + net.offset, -30, 30)))


def grouped(texts: list[bytes]) -> Iterator[slice]:
    """Slices of about GROUP bytes."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def train(texts: list[bytes], labels: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Network:
    """Fits the network by Adam on the weighted log loss."""
    rng = np.random.default_rng(SEED)
    net = Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    prior = float(np.average(labels, weights=weight)) if len(labels) else 0.5
    net.offset = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        return net
    state = {n: [0.0, 0.0] for n in ("taps", "bias", "weights", "offset")}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            best, blocks, full, at, data = pooled(net.pairs(), [texts[k] for k in own], where=True)
            first, second, begin = chunks_of(blocks, full)
            pick = np.where(best[first] >= best[second], first[:, None], second[:, None])
            top = np.take_along_axis(best, pick, axis=0)
            c = np.maximum(top + net.bias, 0)
            number = np.diff(begin)
            mean = np.add.reduceat(c, begin[:-1], axis=0) / number[:, None]
            most = np.maximum.reduceat(c, begin[:-1], axis=0)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([mean, most], axis=1) @ net.weights + net.offset, -30, 30)))
            g = (p - labels[own]) * weight[own] / weight[own].sum()
            grads = {"weights": np.concatenate([mean, most], axis=1).T @ g + 1e-4 * net.weights, "offset": float(g.sum())}
            doc = np.repeat(np.arange(len(own)), number)
            dc = (g[:, None] * net.weights[:FILTERS] / number[:, None])[doc]
            is_most = c == most[doc]
            ties = np.add.reduceat(is_most.astype(float), begin[:-1], axis=0)[doc]
            dc = (dc + is_most * (g[:, None] * net.weights[FILTERS:])[doc] / ties) * (c > 0)
            grads["bias"] = dc.sum(axis=0)
            place = np.take_along_axis(at, pick, axis=0)
            column, flat = np.arange(FILTERS), dc.ravel()
            taps = [np.bincount((data[place + k].astype(np.int64) * FILTERS + column).ravel(), flat, 256 * FILTERS) for k in range(WIDTH)]
            grads["taps"] = np.reshape(taps, net.taps.shape) + 1e-6 * net.taps
            step += 1
            for n, grad in grads.items():
                m, v = state[n]
                state[n] = m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                setattr(net, n, getattr(net, n) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return net


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, size: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """At most `most` labelled documents of each class, whole, in the order of a hash of the id: texts, labels and weights.

    A class's documents are taken until their texts reach size bytes, so what comes to the driver is bounded by that and
    one text a class. Only rows whose crc32(doc_id as text) mod 3 is not 1 are read. A document with both labels counts as
    good. The weights give the classes their shares among all labelled rows.
    """
    marks = labels.filter((id_crc("doc_id", 3) != 1) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max((F.col("quality") >= 1).cast("int")).alias("mark"))
    shares = {r["mark"]: r["n"] for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(SEED), "doc_id")
    some = None
    for mark in (0, 1):
        part = marks.filter(F.col("mark") == mark).orderBy(order, "doc_id").limit(most)
        some = part if some is None else some.unionByName(part)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id")  # at most 2 * most ids
    digest = F.sha2(F.col("text").cast("binary"), 256)
    sizes = found.select("doc_id", "mark", order.alias("o"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    sizes = sizes.distinct().orderBy("o", "doc_id", "digest").limit(2 * most)
    before = Window.partitionBy("mark").orderBy("o", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    taken = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).filter(F.col("before") < size)
    taken = [(r["doc_id"], r["digest"]) for r in taken.select("doc_id", "digest").collect()]  # at most 2 * most rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = docs.sparkSession.createDataFrame(taken, f"doc_id {kind}, digest string")
    rows = found.withColumn("digest", digest).join(F.broadcast(taken), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    rows = sorted(((r["doc_id"], r["digest"], r["mark"], r["text"]) for r in rows.collect()), key=lambda r: r[:2])
    marks_of = np.array([r[2] for r in rows], float)
    held = {m: max(1, int((marks_of == m).sum())) for m in (0, 1)}
    weight = np.array([shares[r[2]] / held[r[2]] for r in rows])
    return [r[3].encode() for r in rows], marks_of, weight


def scorer(net: Network):
    """Adds score to rows with text, and drops text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            parts = [score(net, pairs, texts[s]) for s in grouped(texts)]
            rest = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(rest | {"score": pa.array(np.concatenate([np.zeros(0), *parts]))})

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The probability of good quality for every document.

    docs: doc_id, text and any further columns, whatever their names; they come back in the struct row. A null text is
    empty; empty texts get the score of a text without any pattern. Repeated rows and ids get equal scores. If the labels
    hold one class only, every score is 0.999 or 0.001; without labels it is 0.5. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    net = train(*sample(docs, labels))
    rows = docs.select(F.struct("*").alias("row"), "text")
    out = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(scorer(net), f"row {out}, score double")


def query(spark, sf_dir) -> DataFrame:
    """Query op4: the quality of every document."""
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    good = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return out.select(F.col("row.doc_id"), "score", good.alias("predicted")).withColumn("held_out", id_crc("doc_id", 3) == 1)
