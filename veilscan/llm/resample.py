"""Target-distribution importance resampling over hashed n-grams, read by an overlapped regex scan.

A text is lower-cased, every run of separators collapses to one space, and a pattern with boundary lookarounds is run
over it with overlapping matches: its spans are the n-grams of each length, straight from the text. A span's bytes go
into a bucket by their CRC-32. Buckets are counted over all documents (the raw corpus) and all target texts; a bucket's
gain is the logarithm of how much likelier the target makes it, with one count more for each bucket. A document's weight
is the sum of the gains of its n-grams, and adding Gumbel noise keyed by its id makes the highest scores a draw
without replacement in proportion to the weights.

Corpus counts are two arrays of `buckets` numbers, summed inside tasks before they are shuffled by bucket; the gains,
as many numbers, are all that is broadcast. Scores are ranked by ranges, so a rank needs no single task.

Defined results: null and empty texts, and texts without words, have no n-grams and weight 0; words of any length
and texts of any length are read whole; a null doc_id draws its noise as an empty id and ranks last among equal
scores; rows with equal score and doc_id are ranked by weight, then number of n-grams; repeated rows are documents
of their own; without target texts every gain still follows from the counts; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import islice
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import MEMO_KEY, MEMO_WORDS, WORD_TABLE, blobs, pick, ranked, slices, stored

#: N-grams that are looked at in one step.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Plan:
    """n-grams of 1 to `longest` words in `buckets` buckets; `percent` of the documents with `least` words are drawn."""

    longest: int = 1
    buckets: int = 10_000
    least: int = 20
    percent: int = 10
    seed: int = 2024


@lru_cache(maxsize=16)
def gram_pattern(longest: int) -> tuple[regex.Pattern, ...]:
    """One pattern for each number of words; a match begins and ends at a space or an end of the text."""
    return tuple(regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % k) for k in range(longest))


def collapsed(text: bytes) -> bytes:
    """Lower-cased, with one space for each run of separators and none at the ends."""
    return b" ".join(text.translate(WORD_TABLE).split())


def grams(text: bytes, longest: int) -> Iterator[bytes]:
    """The n-grams of a collapsed text, from the spans of overlapping matches."""
    if longest == 1:
        return (m[0] for m in gram_pattern(1)[0].finditer(text, overlapped=True))
    return (m[0] for p in gram_pattern(longest) for m in p.finditer(text, overlapped=True))


class Known(dict):
    """What a function gives for an n-gram, kept for those met before; long n-grams are worked out each time."""

    def __init__(self, work_out: Callable[[bytes], int]):
        super().__init__()
        self.work_out = work_out

    def __missing__(self, gram: bytes) -> int:
        value = self.work_out(gram)
        if len(gram) <= MEMO_KEY:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[gram] = value
        return value


def bucket_counts(texts: DataFrame, plan: Plan, column: str = "text") -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, total = Counter(), np.zeros(plan.buckets, np.int64)

        def settle() -> None:
            buckets = np.fromiter((crc32(g) % plan.buckets for g in met), np.int64, len(met))
            np.add.at(total, buckets, np.fromiter(met.values(), np.int64, len(met)))
            met.clear()

        for part in slices(batches):
            for text in blobs(part.column(0)):
                found = grams(collapsed(text), plan.longest)
                while some := list(islice(found, CHUNK)):
                    met.update(some)
                    if len(met) >= MEMO_WORDS:
                        settle()
        settle()
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    (text,) = pick(texts, column)
    rows = texts.select(text.cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found, out = rows.toArrow(), np.zeros(plan.buckets, np.int64)  # at most `buckets` rows
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which each bucket is likelier in the target, rounded down."""
    s_all, t_all, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    above = [float((t + 1) * (s_all + buckets)) for t in target.tolist()]
    below = [float((s + 1) * (t_all + buckets)) for s in corpus.tolist()]
    return np.array([floor(1000 * log(a / b)) for a, b in zip(above, below)], np.int64)


def noise(key: str, seed: int) -> int:
    """Thousandths of a Gumbel number that the key fixes."""
    h = int(sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, plan: Plan) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = sent.value.tolist()
        gain_of = Known(lambda gram: values[crc32(gram) % plan.buckets]).__getitem__
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), blobs(part.column(1))):
                clean = collapsed(text)
                found, n, weight = grams(clean, plan.longest), 0, 0
                while some := list(islice(found, CHUNK)):
                    n, weight = n + len(some), weight + sum(map(gain_of, some))
                words = clean.count(b" ") + 1 if clean else 0
                rows.append((doc, words, n, weight, weight + noise("" if doc is None else str(doc), plan.seed)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    id_, text = pick(docs, "doc_id", "text")
    return docs.select(id_.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(score, SCORED)


def drawn(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds `rank` to scored rows: 1, 2, 3 ... for the documents drawn, null for the others."""
    keyed = rows.select("*", (F.col("n_words") < plan.least).alias("short"), (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("nameless"), (-F.col("weight")).alias("lighter"))
    placed = ranked(keyed, ["short"], ["down", "nameless", "doc_id", "lighter", "n_features"], "scores")
    top = ~F.col("short") & F.expr(f"rank < size * {plan.percent} div 100")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(top, F.col("rank") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    gain = gains(bucket_counts(docs, plan), bucket_counts(target, plan))
    # ranking looks at its input twice, first for the ranges that it deals rows out by
    return drawn(stored(scored(docs, gain, plan), "scored"), plan)


def selected(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of docs whose doc_id is drawn; columns stay."""
    ids = resampled(docs, target, plan).where("rank is not null").select(F.col("doc_id").alias("id__")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id__")), "left_semi")
