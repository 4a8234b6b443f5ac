"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

A token is a run of letters, lower-cased. Its stems are its prefixes of 2 to 8 letters and the whole token; each has
log-odds between toxic and clean labelled texts under a Dirichlet prior, PRIOR tokens strong, that is the shares of the next
shorter stem, or the classes' for the shortest. A token is worth the log-odds of the longest stem that two documents have,
shrunk by its standard error; stems within SURE errors are worth nothing, and every token costs DRIFT, so that clean text
falls. So a stem that only some toxic tokens begin with tells nothing against the clean ones beside them. The k-th time a
token stands in a text counts 1/k, in counting as in scoring: repetition alone proves little.

A linear scan (all maximal-scoring subsequences) finds each passage that can't be extended or cut without loss. In clean
text of n tokens the best passage's score S follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-L x)); L and K are
fitted to clean labelled documents, each scored by stems counted without its fold. A document's surprise is that of the sum
of its best r normalised passages, for the best r, and a logistic curve over its logarithm gives the probability.

Stems are counted by Spark over the sample and only those that stand out come to the driver; scoring is a map over the
documents: no shuffle, and no more memory than a slice of a text's tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import bounded_batches, id_crc, shared_folder, table, written

TOKEN = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")
STEMS = range(2, 9)
#: Tokens that a labelled text counts as at the most; a longer text's tokens share them.
MASS = 200
PRIOR = 20.0
SURE = 3.0
DRIFT = 0.05
FOLDS = 4
#: Passages expected by chance in a clean document, at and below which a passage is reported.
CHANCE = 0.01
#: The bound of the sample: labelled documents of each class, in the order of a hash of their ids. Texts are whole.
SAMPLE = 6000
SEED = 11
SLICE = 1 << 20


def harmonic(k: int) -> float:
    """About 1 + 1/2 + ... + 1/k."""
    return 1.0 if k == 1 else math.log(k) + 0.57722 + 0.5 / k


def stems(word: str) -> list[str]:
    """The prefixes of a lower-cased token, and the token with an end mark."""
    return [word[:k] for k in STEMS if k < len(word)] + [word + "$"]


def slices(text: str, size: int = SLICE) -> Iterator[tuple[int, str]]:
    """The text in pieces that cut no token, with their starts."""
    start = 0
    while start < len(text):
        cut = GAP.search(text, start + size) if start + size < len(text) else None
        end = cut.end() if cut else len(text)
        yield start, text[start:end]
        start = end


def counted(text: str) -> Counter:
    """How much each stem of the text counts: at most MASS over all tokens."""
    words: Counter = Counter()
    for _, piece in slices(text):
        words.update(w.lower() for w in TOKEN.findall(piece))
    held = {w: harmonic(k) for w, k in words.items()}
    share = min(1.0, MASS / max(1.0, sum(held.values())))
    out: Counter = Counter()
    for word, much in held.items():
        for stem in stems(word):
            out[stem] += much * share
    return out


def stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of text, mark and fold to stem, fold, mark, n and docs, summed by batch."""
    for batch in batches:
        much: dict = {}
        for text, mark, fold in zip(*(batch.column(n).to_pylist() for n in ("text", "mark", "fold")), strict=True):
            for stem, n in counted(text).items():
                old = much.get((stem, fold, mark), (0.0, 0))
                much[stem, fold, mark] = old[0] + n, old[1] + 1
        keys, values = list(much), list(much.values())
        yield pa.RecordBatch.from_pydict(
            {
                "stem": pa.array([k[0] for k in keys], pa.string()), "fold": pa.array([k[1] for k in keys], pa.int32()), "mark": pa.array([k[2] for k in keys], pa.int32()),
                "n": pa.array([v[0] for v in values], pa.float64()), "docs": pa.array([v[1] for v in values], pa.int64()),
            }
        )


class Worth(dict):
    """Token to its worth, filled as tokens come."""

    def __init__(self, model: dict[str, tuple[float, float]]):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        found = [self.model[s] for s in stems(word.lower()) if s in self.model]
        self[word] = value = found[-1][1] if found else 0.0  # the longest
        return value


def passages(worth: Worth, text: str) -> tuple[int, list[tuple[float, int, int]]]:
    """The number of tokens, and (score, first token, last token + 1) of every maximal-scoring passage.

    A candidate's link is the nearest candidate before it that starts lower; following links instead of steps makes the
    scan linear.
    """
    n, total = 0, 0.0
    held: list[tuple[int, int, float, float, int]] = []  # first, end, score before, score after, link
    seen: Counter = Counter()
    for _, piece in slices(text):
        if len(worth) > 1_000_000:
            worth.clear()
        words = TOKEN.findall(piece)
        values = np.fromiter(map(worth.__getitem__, words), np.float64, len(words))
        fall = np.concatenate(([0.0], np.cumsum(np.minimum(values, 0.0) - DRIFT)))
        risen = total
        for i in np.flatnonzero(values > 0).tolist():
            word = words[i].lower()
            seen[word] += 1
            gain = float(values[i]) / seen[word]
            before = risen + float(fall[i])
            risen += gain
            if gain <= DRIFT:
                continue
            first, low, after = n + i, before, before + gain - DRIFT
            link = len(held) - 1
            while True:
                while link >= 0 and held[link][2] >= low:
                    link = held[link][4]
                if link < 0 or held[link][3] >= after:
                    held.append((first, n + i + 1, low, after, link))
                    break
                first, _, low, _, back = held[link]
                del held[link:]
                link = back
        total = risen + float(fall[-1])
        n += len(words)
    return n, [(after - before, a, b) for a, b, before, after, _ in held]


@dataclass
class Law:
    """The extreme-value law of clean text and the curve from surprise to probability."""

    rate: float = 1.0
    share: float = 1.0
    offset: float = 0.0
    slope: float = 0.0

    def normalised(self, score: float, n: int) -> float:
        return self.rate * score - math.log(self.share * max(n, 1))

    def surprise(self, n: int, scores: list[float]) -> float:
        """Minus the log probability of passages like these in clean text: the best over r of the sum of the best r."""
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            z = self.normalised(score, n)
            if r == 1:  # the law itself
                total = z
                best = z if z > 30 else -math.log(-math.expm1(-math.exp(-z))) if z > -6 else 0.0
            elif z <= 0:
                break
            else:
                total += z
                chance = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
                best = max(best, chance)
        return max(best, 0.0)

    def probability(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.offset + self.slope * math.log1p(surprise), -30), 30)))


def fitted_law(n: np.ndarray, best: np.ndarray) -> Law:
    """Maximum likelihood over clean documents' best scores, again without the twentieth that fits worst: labels err."""

    def fit(n: np.ndarray, x: np.ndarray) -> Law:
        low, high = 1e-3, 20.0
        for _ in range(60):
            rate = (low + high) / 2
            w = n * np.exp(-rate * (x - x.min()))
            low, high = (rate, high) if 1 / rate - x.mean() + (w * x).sum() / w.sum() > 0 else (low, rate)
        return Law(rate, len(x) / float((n * np.exp(-rate * x)).sum()))

    if not len(best):
        return Law()
    law = fit(n, best)
    z = law.rate * best - np.log(law.share * n)
    keep = z <= np.quantile(z, 0.95)
    return fit(n[keep], best[keep])


def fitted_curve(law: Law, surprise: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> Law:
    """Weighted logistic regression of the marks on log(1 + surprise), by Newton's steps; never falling."""
    x = np.stack([np.ones(len(marks)), np.log1p(surprise)], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.array([1e-9, 1e-3])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (marks - p)) - ridge * beta)
        beta += np.clip(step, -4, 4)
    return Law(law.rate, law.share, float(beta[0]), float(max(beta[1], 0.0)))


def chosen(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """At most `most` labelled documents of each class: text, mark and fold; and how many ids have each mark.

    Only rows whose crc32(doc_id as text) mod 4 is not 2 are read; a document with both labels counts as toxic. Equal texts
    of one class and fold are taken once.
    """
    marks = labels.filter((id_crc("doc_id", 4) != 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max((F.col("toxic") >= 1).cast("int")).alias("mark"))
    shares = {r["mark"]: r["n"] for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(SEED), "doc_id")
    part = [marks.filter(F.col("mark") == m).orderBy(order, "doc_id").limit(most) for m in (0, 1)]
    some = part[0].unionByName(part[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS)).cast("int"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # at most 2 * most ids
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return rows.withColumn("digest", digest).dropDuplicates(["digest", "mark", "fold"]).select("text", "mark", "fold"), shares


def models(rows: DataFrame) -> list[dict[str, tuple[float, float]]]:
    """Stem to (log-odds in standard errors, worth): without each fold, and at last of all folds.

    A stem has to stand in two documents. Only stems that stand out come to the driver, and with a worth of 0 those that don't
    although the next shorter stem does.
    """
    sums = rows.mapInArrow(stem_counts, "stem string, fold int, mark int, n double, docs bigint")
    kept = range(FOLDS + 1)
    one = lambda k, mark: F.sum(F.when((F.col("fold") != k) & (F.col("mark") == mark), F.col("n")).otherwise(0.0))
    sides = [one(k, m).alias(f"y{m}_{k}") for k in kept for m in (0, 1)]
    held = [F.sum(F.when(F.col("fold") != k, F.col("docs")).otherwise(0)).alias(f"d_{k}") for k in kept]
    counts = sums.groupBy("stem").agg(*sides, *held)
    whole = rows.mapInArrow(text_mass, "fold int, mark int, n double")
    mass = whole.groupBy().agg(*[one(k, m).alias(f"y{m}_{k}") for k in kept for m in (0, 1)]).first()
    body = F.length("stem") - F.when(F.col("stem").endswith("$"), 2).otherwise(1)
    counts = written(counts, shared_folder(rows.sparkSession), "toxicity-stems")  # read three times below
    counts = counts.withColumn("shorter", F.when(body >= STEMS[0], F.substring("stem", F.lit(1), F.least(body, F.lit(STEMS[-1])))))
    above = counts.select(F.col("stem").alias("shorter"), *[F.col(f"y{m}_{k}").alias(f"up{m}_{k}") for k in kept for m in (0, 1)])
    known = counts.join(above, "shorter", "left")
    out = []
    for k in kept:
        toxic, clean = mass[f"y1_{k}"] or 0.0, mass[f"y0_{k}"] or 0.0
        root = toxic / (toxic + clean) if toxic and clean else 0.5
        up1, up0 = (F.coalesce(f"up{m}_{k}", F.lit(0.0)) for m in (1, 0))
        share = (up1 + PRIOR * root) / (up1 + up0 + PRIOR)
        a1, a0 = F.col(f"y1_{k}") + PRIOR * share, F.col(f"y0_{k}") + PRIOR * (1 - share)
        odds = F.log(a1 / a0) - math.log(root / (1 - root))
        z = odds / F.sqrt(1 / a1 + 1 / a0)
        worth = F.when(F.abs(z) > SURE, odds * (1 - SURE * SURE / (z * z))).otherwise(0.0)
        out.append(F.when(F.col(f"d_{k}") >= 2, F.struct(z.alias("z"), worth.alias("worth"))).alias(f"m_{k}"))
    known = known.select("stem", "shorter", *out)
    apart = known.select(F.col("stem").alias("shorter"), *[(F.col(f"m_{k}.worth") != 0).alias(f"up_{k}") for k in kept])
    told = known.join(apart, "shorter", "left").select("stem", *[F.when((F.col(f"m_{k}.worth") != 0) | F.col(f"up_{k}"), F.col(f"m_{k}")).alias(f"m_{k}") for k in kept])
    told = told.filter(F.coalesce(*[f"m_{k}" for k in kept]).isNotNull()).collect()  # stems of at most 2 * SAMPLE documents
    return [{r["stem"]: (r[f"m_{k}"]["z"], r[f"m_{k}"]["worth"]) for r in told if r[f"m_{k}"] is not None} for k in kept]


def text_mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each text's tokens count together."""
    for batch in batches:
        mass = []
        for text in batch.column("text").to_pylist():
            words = Counter(w.lower() for _, piece in slices(text) for w in TOKEN.findall(piece))
            mass.append(min(float(MASS), sum(map(harmonic, words.values()))))
        yield pa.RecordBatch.from_pydict({"fold": batch.column("fold"), "mark": batch.column("mark"), "n": pa.array(mass, pa.float64())})


def out_of_fold(every: list[dict], law: Law | None):
    """Texts scored by the model without their fold: mark, n and the best score, or with a law the surprise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = [Worth(m) for m in every]
        for batch in batches:
            found = [passages(worth[fold], text) for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            value = [law.surprise(n, [p[0] for p in got]) if law else max((p[0] for p in got), default=0.0) for n, got in found]
            yield pa.RecordBatch.from_pydict({"mark": batch.column("mark"), "n": pa.array([n for n, _ in found], pa.int64()), "value": pa.array(value, pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[dict[str, tuple[float, float]], Law]:
    """The stems that stand out, and the law. With one class only every score is 0.999 or 0.001, without labels 0.5."""
    rows, shares = chosen(docs, labels, most)
    if len(shares) < 2:
        return {}, Law(offset={0: -6.9, 1: 6.9}[next(iter(shares))] if shares else 0.0)
    rows = written(rows, shared_folder(docs.sparkSession), "toxicity-sample")
    every = models(rows)
    schema = "mark int, n bigint, value double"
    told = lambda law: np.array([tuple(r) for r in rows.mapInArrow(out_of_fold(every, law), schema).collect()] or np.zeros((0, 3)), float)  # noqa: E731  at most 2 * most rows
    got = told(None)
    clean = got[got[:, 0] == 0]
    law = fitted_law(np.maximum(clean[:, 1], 1.0), clean[:, 2])
    got = told(law)
    held = {m: max(1, int((got[:, 0] == m).sum())) for m in (0, 1)}
    weight = np.array([shares[int(m)] / held[int(m)] for m in got[:, 0]])
    return every[FOLDS], fitted_curve(law, got[:, 2], got[:, 0], weight / max(weight.sum(), 1.0) * len(weight))


def located(text: str, spans: list[tuple[int, int, float]]) -> list[dict]:
    """Spans of tokens as spans of code points."""
    starts, ends = {a for a, _, _ in spans}, {b - 1 for _, b, _ in spans}
    at, k = {}, 0
    for begin, piece in slices(text):
        for m in TOKEN.finditer(piece):
            if k in starts or k in ends:
                at[k] = begin + m.start(), begin + m.end()
            k += 1
    return [{"start": at[a][0], "end": at[b - 1][1], "chance": e} for a, b, e in sorted(spans)]


PASSAGES = "array<struct<start:bigint,end:bigint,chance:double>>"


def scorer(model: dict[str, tuple[float, float]], law: Law):
    """Adds score and passages to rows with text, and drops text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = Worth(model)
        for batch in batches:
            score, found = [], []
            for text in batch.column("text").to_pylist():
                n, got = passages(worth, text or "")
                score.append(law.probability(law.surprise(n, [p[0] for p in got])))
                rare = [(a, b, math.exp(-z)) for s, a, b in got if (z := law.normalised(s, n)) >= -math.log(CHANCE)]
                found.append(located(text, rare) if rare else [])
            rest = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(rest | {"score": pa.array(score, pa.float64()), "passages": pa.array(found, kind)})

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The probability of toxicity of every document, and its toxic passages.

    docs: doc_id, text and any further columns, whatever their names; they come back in the struct row. passages: start and
    end in code points and how many such are expected by chance in a clean text of this length, in order of place; they
    don't overlap. A null text is empty; empty texts and texts without letters have no passage and the score of that.
    Repeated rows and ids get equal scores; a stem of one document only leaves its token to the next shorter one. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    model, law = train(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return rows.mapInArrow(scorer(model, law), f"row {rows.schema['row'].dataType.simpleString()}, score double, passages {PASSAGES}")


def query(spark, sf_dir) -> DataFrame:
    """Query op11: the toxicity of every document."""
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    toxic = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    out = out.select(F.col("row.doc_id"), "score", toxic.alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
    return out.withColumn("held_out", id_crc("doc_id", 4) == 2)
