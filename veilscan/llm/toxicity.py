"""Toxicity: maximum-scoring segments over token log-odds.

Training reads a bounded sample of labelled documents. The log-odds of a word between toxic and other
documents come with a Dirichlet prior whose shape is the corpus: counts over all documents. Words whose
log-odds aren't significant score as the background, which falls a little with each word. A linear scan
finds all maximal segments of a text (Ruzzo and Tompa); their scores are calibrated as extreme values: by
Karlin and Altschul's statistics a text of n words has K n exp(-lambda s) segments of score s by chance.
A logistic curve over the summed significance of a text's segments, fitted on the sample, gives its score.

What reaches the driver: at most SAMPLE labelled ids, their words that occur in MIN_DOCS of them, one
count a word, and a few numbers for each document of the sample. The same words are broadcast.

Defined results: null and empty texts score as texts without significant segments; labels that are null
or for unknown documents are ignored; a document with several labels counts as toxic if one of them is 1;
without labels of both kinds, or with an empty table, nothing is significant and all score 0; rows with
equal or null doc_id are scored each for itself. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import blobs, pick, plain_words, slices

#: Labelled rows that are used for training, chosen by a hash of their id.
SAMPLE = 20_000
#: A word must occur in so many documents of the sample.
MIN_DOCS = 5
#: Weight of the prior in documents, and the z value from which log-odds are significant.
PRIOR, SIGNIFICANT = 200.0, 3.0
#: Least log-odds, up or down, that a word scores with: weaker words tell a text's topic or language.
EFFECT = 1.0
#: What every word costs; the expected score of a word is then below zero.
DRIFT = 0.1
#: Segments with a smaller expected number of chance occurrences count.
CHANCE = 0.001


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    lambda_: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -20.0


def segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a text where the words at `positions` have
    `scores` and all others cost `drift`. Linear in the number of positions."""
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    total, at = 0.0, 0
    for p, s in zip(positions, scores):
        total -= drift * (p - at)
        before, total, at = total, total + s, p + 1
        if s <= 0:
            continue
        low, high, first, end = before, total, p, p + 1
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= low:
                k -= 1
            if k < 0 or stack[k][1] >= high:
                stack.append((low, high, first, end))
                break
            low, first = stack[k][0], stack[k][2]
            del stack[k:]
    return [(first, end, high - low) for low, high, first, end in stack]


def toxic_passages(text: bytes, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and the significant segments with their significance (-ln of expected chance)."""
    words = plain_words(text)
    get = model.scores.get
    found = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    out = []
    if found:
        base = log(max(model.k * len(words), 1e-12))
        for first, end, s in segments([i for i, _ in found], [s for _, s in found], DRIFT):
            significance = model.lambda_ * s - base
            if significance > -log(CHANCE):
                out.append((first, end, significance))
    return len(words), out


def _evidence(passages: list[tuple[int, int, float]]) -> float:
    return log(1.0 + sum(s for _, _, s in passages))


def _probability(model: Model, passages: list) -> float:
    x = model.slope * _evidence(passages) + model.shift
    return 1.0 / (1.0 + exp(-x)) if x > -500 else 0.0


def _lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive solution of sum(share * exp(lambda * value)) = 1, by halving."""
    low, high = 1e-6, 1e-3
    over = lambda t: float((shares * np.exp(np.minimum(t * values, 700))).sum()) > 1
    while not over(high) and high < 100:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with a small ridge."""
    a, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - 1e-3 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled documents that are not held out."""
    spark = docs.sparkSession
    id_, text = pick(docs, "doc_id", "text")
    rows = docs.select(id_.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    key, toxic = pick(labels, "doc_id", "toxic")
    known = labels.select(key.cast("long").alias("doc_id"), toxic.cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most `sample` rows: small enough to send to all
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    training = rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for part in slices(batches):
            for raw, toxic in zip(blobs(part.column(0)), part.column(1).to_pylist()):
                counts[toxic].update({w.decode() for w in plain_words(raw)})
                counts[toxic][None] += 1
        for toxic, c in enumerate(counts):
            items = list(c.items())
            for i in range(0, len(items), 50_000):
                some = items[i : i + 50_000]
                n = pa.array([v for _, v in some], pa.int64())
                zero = pa.array([0] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), *((zero, n) if toxic else (n, zero))], names=["word", "other", "toxic"])

    counted = training.mapInArrow(words_of, "word string, other long, toxic long").groupBy("word").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    table = counted.where((F.col("other") + F.col("toxic") >= MIN_DOCS) | F.col("word").isNull()).collect()  # bounded by the sample
    totals = next((r for r in table if r["word"] is None), None)
    words = sorted((r["word"].encode(), r["toxic"], r["other"]) for r in table if r["word"] is not None)
    if not totals or not totals["other"] or not totals["toxic"] or not words:
        return Model()

    places = spark.sparkContext.broadcast({w: i for i, (w, _, _) in enumerate(words)})

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, count, n_docs, n_words = places.value.get, np.zeros(len(places.value) + 2, np.int64), 0, 0
        for part in slices(batches):
            for raw in blobs(part.column(0)):
                text = plain_words(raw)
                count[list({i for i in map(get, text) if i is not None})] += 1
                n_docs, n_words = n_docs + 1, n_words + len(text)
        count[-2], count[-1] = n_docs, n_words
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["place", "n"])

    corpus = np.zeros(len(words) + 2)
    for r in rows.select("text").mapInArrow(background, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        corpus[r["place"]] = r["n"]
    n_docs, n_words = max(corpus[-2], 1), max(corpus[-1], 1)
    prior = PRIOR * corpus[:-2] / n_docs + 1e-3
    pos, neg = (np.array([w[k] for w in words], float) for k in (1, 2))
    n_pos, n_neg = totals["toxic"], totals["other"]
    odds = lambda c, n: np.log((c + prior) / (n + PRIOR - c - prior + 1))
    delta = odds(pos, n_pos) - odds(neg, n_neg)
    z = delta / np.sqrt(1 / (pos + prior) + 1 / (neg + prior))
    use = (np.abs(z) >= SIGNIFICANT) & (np.abs(delta) >= EFFECT)
    values = np.where(use, delta, 0.0) - DRIFT
    model = Model({w[0]: float(v) for w, v, u in zip(words, values, use) if u})
    # chance is what other documents do: shares of the words there, each counted once per document
    shares = (neg[use] + prior[use] / PRIOR) / n_neg * (n_docs / n_words)
    if not (values[use] > 0).any():
        return Model()
    model.lambda_ = _lambda(np.append(values[use], -DRIFT), np.append(shares, max(0.0, 1 - shares.sum())))

    sent = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            best, size = [], []
            for raw in blobs(part.column(0)):
                text = plain_words(raw)
                found = [(i, s) for i, s in enumerate(map(sent.value.scores.get, text)) if s is not None]
                best.append([s for _, _, s in segments([i for i, _ in found], [s for _, s in found], DRIFT)])
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.list_(pa.float64())), pa.array(size, pa.int64()), part.column(1)], names=["scores", "size", "toxic"])

    seen = training.mapInArrow(evidence, "scores array<double>, size long, toxic int").collect()  # at most `sample` rows
    # K by the mean of the extreme-value law over the other documents: E[max] = (ln(K n) + 0.5772) / lambda
    tops = [model.lambda_ * max(r["scores"]) - log(r["size"]) - 0.5772 for r in seen if not r["toxic"] and r["scores"]]
    none = sum(1 for r in seen if not r["toxic"] and not r["scores"] and r["size"])
    # documents without any segment are below: they pull the mean down to the least seen
    model.k = float(np.exp(np.mean(tops + [min(tops)] * none))) if tops else 1e-3
    x = []
    for r in seen:
        base = log(max(model.k * r["size"], 1e-12)) if r["size"] else 0.0
        x.append(_evidence([(0, 0, s) for s in (model.lambda_ * v - base for v in r["scores"]) if s > -log(CHANCE)]))
    model.slope, model.shift = _logistic(np.array(x), np.array([r["toxic"] for r in seen], float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and passages (first word, end, significance)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_, text = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("significance", pa.float64())]))
        for part in slices(batches):
            passages = [toxic_passages(raw, sent.value)[1] for raw in blobs(part.column(2))]
            p = [_probability(sent.value, x) for x in passages]
            found = [[{"first": a, "end": b, "significance": s} for a, b, s in x] for x in passages]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(found, kind)],
                names=["doc_id", "held_out", "score", "predicted", "passages"],
            )

    chosen = docs.select(id_.cast("long").alias("doc_id"), F.coalesce(held_out(id_), F.lit(False)).alias("held_out"), text.cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first:long,end:long,significance:double>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([_probability(sent.value, toxic_passages(raw, sent.value)[1]) < 0.5 for raw in blobs(part.column(at))]))

    return docs.mapInArrow(run, docs.schema)
