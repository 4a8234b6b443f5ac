"""Language ID with hyperdimensional profiles.

Each letter has a random vector of -1 and 1. A trigram's vector binds its letters' vectors, permuted by their place, by
multiplication; a text's vector bundles those of its trigrams by addition, and so does a language's prototype over all
its training texts. A text gets the language whose prototype has the largest cosine with the text's vector.

Bundling is linear, so a prototype is the sum of its texts' vectors: executors bundle whole texts, a row of DIMS numbers
for each language and task, and these rows are summed by language and place before the driver gets them. A letter's vector
is drawn from a hash of its code point, so every letter of every script has its own. The table of prototypes, which is
broadcast, has a row of DIMS numbers for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import bounded_batches, id_crc, table

DIMS = 1024
SEED = 7
#: Bits of a letter's number within a trigram.
BITS = 21
#: Texts are worked on in groups of about so many characters, longer ones in pieces of as many, and so many texts.
GROUP = 1 << 20
GROUP_TEXTS = 512
#: Rows of letter and trigram vectors that a worker keeps; beyond them they are made anew.
KEPT = 1 << 14
#: Trigrams that are bundled at once.
ROWS = 1 << 13
UNKNOWN = "und"
#: Most languages that prototypes are made for; more are refused rather than broadcast.
MOST_LANGUAGES = 4096
U = np.uint64


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """The vectors of -1 and 1 of code points; 0 stands for what is no letter. Bits are hashes of the point and the place."""
    word = np.arange(-(-dims // 64), dtype=np.uint64)
    x = points.astype(np.uint64)[:, None] * U(0x9E3779B97F4A7C15) + word * U(0xD1342543DE82EF95) + U(SEED)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> U(shift))) * U(factor)
    bits = np.unpackbits((x ^ (x >> U(32))).view(np.uint8).reshape(len(points), -1), axis=1)[:, :dims]
    return bits.astype(np.int8) * 2 - 1


def trigram_vectors(trigrams: np.ndarray, dims: int) -> np.ndarray:
    """The bound vectors of trigrams; a letter's vector is rolled by two, one or no places."""
    parts = [trigrams >> 2 * BITS, trigrams >> BITS & ((1 << BITS) - 1), trigrams & ((1 << BITS) - 1)]
    points, at = np.unique(np.concatenate(parts), return_inverse=True)
    v = letter_vectors(points, dims)
    one, two, three = np.split(at, 3)
    return np.roll(v, 2, axis=1)[one] * np.roll(v, 1, axis=1)[two] * v[three]


def lines_of(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts as (first text, letters, the text of each from 0), a space before and behind each text.

    What is no letter is 0, and runs of it are one. A text longer than a group comes in pieces, each with the last two
    places of the piece before it, so that no trigram is lost or counted twice.
    """

    def squeezed(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.where(letters()[codes], codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
        return codes[keep].astype(np.int64), doc[keep]

    points = lambda text: np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and end < start + GROUP_TEXTS and (end == start or size + len(texts[end]) < GROUP):
            size += len(texts[end])
            end += 1
        if size <= 2 * GROUP:
            yield start, *squeezed(points("".join(f" {t} " for t in texts[start:end])), np.repeat(np.arange(end - start), [len(t) + 2 for t in texts[start:end]]))
        else:
            text, last = texts[start], np.array([32], np.uint32)
            for a in range(0, len(text), GROUP):
                more = points(text[a : a + GROUP] + (" " if a + GROUP >= len(text) else ""))
                line, doc = squeezed(np.concatenate([last, more]), np.zeros(len(last) + len(more), np.int64))
                last = line[-2:].astype(np.uint32)
                yield start, line, doc
        start = end


def numbered(x: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x, sorted, and the place of each among them; by a table where values are below a small number."""
    if below > 1 << 22:
        return np.unique(x, return_inverse=True)
    place = np.zeros(below, np.int32)
    place[x] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found))
    return found, place[x]


def counted(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of lines_of its first text, its trigrams, and by text in the group: text, place of the trigram, count."""
    for start, line, doc in lines_of([(t or "").lower() for t in texts]):
        known, small = numbered(line, 0x110000)  # few letters in a group: a trigram and its text sort as one number
        size, small = len(known), small.astype(np.int64)
        both = ((doc[2:] * size + small[:-2]) * size + small[1:-1]) * size + small[2:]
        both = np.sort(both[doc[2:] == doc[:-2]])
        edge = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        number = np.diff(np.append(edge, len(both)))
        text, code = np.divmod(both[edge], max(1, size**3))
        found, place = numbered(code, size**3)
        trigrams = known[found // size**2] << 2 * BITS | known[found // size % size] << BITS | known[found % size] if len(found) else found
        yield start, trigrams, text, place, number


class Vectors:
    """Trigram vectors, kept while there is room."""

    def __init__(self, dims: int):
        self.dims = dims
        self.clear()

    def clear(self) -> None:
        self.rows, self.known, self.place = np.zeros((0, self.dims), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, trigrams: np.ndarray) -> np.ndarray:
        """The vectors of distinct trigrams."""
        at = np.minimum(np.searchsorted(self.known, trigrams), max(0, len(self.known) - 1))
        new = trigrams[self.known[at] != trigrams] if len(self.known) else trigrams
        if len(self.rows) + len(new) > KEPT:
            self.clear()
            new = trigrams
        if len(new) > KEPT:
            return trigram_vectors(trigrams, self.dims).astype(np.float32)
        if len(new):
            known = np.concatenate([self.known, new])
            place = np.concatenate([self.place, np.arange(len(self.rows), len(self.rows) + len(new))])
            order = np.argsort(known)
            self.known, self.place = known[order], place[order]
            self.rows = np.concatenate([self.rows, trigram_vectors(new, self.dims).astype(np.float32)])
        return self.rows[self.place[np.searchsorted(self.known, trigrams)]]


def bundled(texts: list[str | None], vectors: Vectors, owner: np.ndarray | None = None) -> np.ndarray:
    """The sums of trigram vectors: whole numbers, exact. A row for each text, or for each owner, if texts are given theirs."""
    owner = np.arange(len(texts)) if owner is None else owner
    out = np.zeros((int(owner.max(initial=-1)) + 1, vectors.dims))
    for start, trigrams, text, place, counts in counted(texts):
        if len(text):
            own = owner[start + text]
            low, high = int(own.min()), int(own.max()) + 1
            for a in range(0, len(trigrams), ROWS):
                part = trigrams[a : a + ROWS]
                here = slice(None) if len(trigrams) <= ROWS else (place >= a) & (place < a + ROWS)
                cell = (own[here] - low) * len(part) + place[here] - a
                bag = np.bincount(cell, counts[here], (high - low) * len(part)).reshape(-1, len(part))
                out[low:high] += bag.astype(np.float32) @ vectors.of(part)  # sums below 2**24: a group has no more places
    return out


def bundle(dims: int):
    """lang, text to each language's sum of vectors over the task's texts: lang and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        vectors = Vectors(dims)
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            own = bundled(batch.column("text").to_pylist(), vectors, langs.indices.to_numpy())
            for lang, row in zip(langs.dictionary.to_pylist(), own, strict=False):
                sums[lang] = sums.get(lang, 0) + row
            if len(sums) > MOST_LANGUAGES:
                raise ValueError(f"over {MOST_LANGUAGES} languages; their prototypes are not broadcast")
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([s.astype(np.int64) for s in sums.values()], pa.list_(pa.int64()))})

    return run


def fit(training: DataFrame, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and their prototypes as unit rows. training: text and lang, both not null.

    What comes to the driver is a row of dims numbers for each language, whose number is checked first.
    """
    sums = training.select("lang", "text").mapInArrow(bundle(dims), "lang string, sums array<bigint>")
    sums = sums.select("lang", F.posexplode("sums").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    each = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda e: e["x"]).alias("sums"))  # dims numbers
    rows = sorted(each.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages; their prototypes are not broadcast")
    out = np.array([r["sums"] for r in rows], np.float64).reshape(len(rows), dims)
    return [r["lang"] for r in rows], out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predictor(names: list[str], prototypes: np.ndarray):
    """Adds lang_pred and score to rows, by their text."""
    protos = prototypes.astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(protos.shape[1])
        for batch in batches:
            texts = batch.column("row").field("text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                own = bundled(texts, vectors)
                cosines = own.astype(np.float32) @ protos.T / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                best = cosines.argmax(axis=1)
                for k, text in enumerate(texts):
                    if text and has_letter(text):
                        lang[k] = names[best[k]]
                        score[k] = min(1.0, max(0.0, float(cosines[k, best[k]])))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    return predict


def learned(docs: DataFrame) -> DataFrame:
    """The rows that prototypes may learn from."""
    return docs.filter((id_crc("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def identify(docs: DataFrame, training: DataFrame | None = None, dims: int = DIMS) -> DataFrame:
    """Predicts the language of every document.

    docs: doc_id, text, lang and any further columns, whatever their names; they come back in the struct row. A text
    that is null or has no letter is `und` with score 0; so is any text if nothing could be learned, as in an empty
    table. Repeated rows and ids give a row each. score: the cosine, at least 0. Equal cosines go to the smaller name.
    training: the rows to learn from; those of docs that the contract allows if not given.
    """
    bounded_batches(docs.sparkSession)
    names, prototypes = fit(learned(docs) if training is None else training, dims)
    rows = docs.select(F.struct("*").alias("row"))
    out = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(predictor(names, prototypes), f"row {out}, lang_pred string, score double")


def known_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents whose language is known with a score of at least `least`, with all their columns."""
    return identify(docs).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def query(spark, sf_dir) -> DataFrame:
    """Query op7: the language of every document."""
    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select(F.col("row.doc_id"), "lang_pred", "score").withColumn("held_out", id_crc("doc_id", 4) == 2)
