"""Benchmark decontamination: windows of test words looked up in training texts.

Benchmark items are normalised to words; each run of `window` words of an item (a shorter item is one
window of its own length) goes into a broadcast hash set. Documents are scanned by a rolling hash over
their words' numbers, hits are verified word by word, and hit words are reported, removed, or cost the
document its place.

The broadcast holds at most MAX_WORDS item words; a larger benchmark is split into so many scans, each
adding to the hits of the one before, with no shuffle.

Defined results: null texts have no words, in documents and items alike; items with a null item_id and
items without words take no part; repeated item_ids count once; repeated documents are scanned each for
itself; with an empty benchmark nothing is hit. Columns of documents other than text are kept untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import blobs, fresh, mixed, pick, plain_words, slices

#: Item words in one broadcast (about 100 bytes each in a worker).
MAX_WORDS = 1_000_000
#: The words of plain_words() in a lower-cased text in UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Windows:
    """Hash set of the items' windows, and the scan for them."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[bytes, set] = {}
        for item, words in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.uint64)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                self.items.setdefault(ids[i : i + size].tobytes(), set()).add(item)
        self.hashes: dict[int, np.ndarray] = {}
        for size in sorted({len(k) // 8 for k in self.items}):
            all_ids = np.array([np.frombuffer(k, np.uint64) for k in self.items if len(k) == 8 * size])
            self.hashes[size] = np.unique(self._hash(all_ids.T))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(c)
        return total

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        numbers = self.numbers
        ids = np.fromiter((numbers.get(w, 0) for w in words), np.uint64, len(words))
        hit, found = np.zeros(len(words), bool), set()
        missing = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, hashes in self.hashes.items():
            starts = np.flatnonzero(missing[size:] == missing[:-size])
            if not len(starts):
                continue
            h = self._hash([ids[starts + k] for k in range(size)])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in starts[hashes[at] == h].tolist():
                items = self.items.get(ids[i : i + size].tobytes())
                if items:
                    found |= items
                    hit[i : i + size] = True
        return hit, found


def item_batches(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their words, in lists of at most MAX_WORDS words (but at least one item)."""
    id_, text = pick(benchmark, id_column, text_column)
    batch, size = [], 0
    for item, content in benchmark.select(id_, text).where(id_.isNotNull() & text.isNotNull()).distinct().toLocalIterator():
        words = plain_words(content.encode())
        if not words:
            continue
        if batch and size + len(words) > MAX_WORDS:
            yield batch
            batch, size = [], 0
        batch.append((item, words))
        size += len(words)
    yield batch


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id"
) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned too): n_words, hits (runs of hit words: first, end),
    items (ids as strings of the items with occurring windows, sorted)."""
    spark, name = docs.sparkSession, fresh(docs, "contamination")
    kind = "struct<n_words:bigint,hits:array<struct<first:bigint,end:bigint>>,items:array<string>>"
    out = docs.withColumn(name, F.lit(None).cast(kind))
    at, place = docs.columns.index(text_column), len(docs.columns)
    for batch in item_batches(benchmark, item_column, "text"):
        sent = spark.sparkContext.broadcast((batch, window))
        built: list[Windows] = []

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, built=built) -> Iterator[pa.RecordBatch]:
            if not built:
                built.append(Windows(*sent.value))
            for part in slices(batches):
                rows = []
                for text, before in zip(blobs(part.column(at)), part.column(place).to_pylist()):
                    words = plain_words(text)
                    hit, items = built[0].scan(words)
                    items = {str(i) for i in items}
                    if before:
                        for run in before["hits"]:
                            hit[run["first"] : run["end"]] = True
                        items |= set(before["items"])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
                    runs = [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]
                    rows.append({"n_words": len(words), "hits": runs, "items": sorted(items)})
                yield pa.RecordBatch.from_arrays([*part.columns[:place], pa.array(rows, part.column(place).type)], schema=part.schema)

        out = out.mapInArrow(scan, out.schema)
    return out, name


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    id_, text = pick(docs, id_column, "text")
    found, c = contamination(docs.select(id_.alias("doc_id"), text.alias("text")), benchmark, window)
    n_hit = F.aggregate(f"{c}.hits", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"])
    return found.select(
        "doc_id",
        F.col(f"{c}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> str:
    """The text without runs of its words (first, end), signs between removed words included."""
    spans = [m.span() for m in WORD.finditer(text.lower())]
    parts, at = [], 0
    for first, end in runs:
        parts.append(text[at : spans[first][0]])
        at = spans[end - 1][1]
    return b"".join([*parts, text[at:]]).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 10, drop_share: float = 0.5) -> DataFrame:
    """docs without hit words; documents of which at least drop_share of the words are hit go whole.

    The columns stay; n_chars, where there is one, follows the new text.
    """
    found, c = contamination(docs, benchmark, window)
    at, place, columns = docs.columns.index("text"), len(docs.columns), docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep, texts, sizes = [], [], []
            n_chars = part.column(columns.index("n_chars")).to_pylist() if "n_chars" in columns else [None] * part.num_rows
            for raw, text, n, what in zip(blobs(part.column(at)), part.column(at).to_pylist(), n_chars, part.column(place).to_pylist()):
                runs = [(r["first"], r["end"]) for r in what["hits"]]
                hit = sum(b - a for a, b in runs)
                keep.append(not hit or hit < drop_share * what["n_words"])
                if runs:
                    text = without_runs(raw, runs)
                    n = len(text)
                texts.append(text)
                sizes.append(n)
            arrays = list(part.columns[:place])
            arrays[at] = pa.array(texts, arrays[at].type)
            if "n_chars" in columns:
                k = columns.index("n_chars")
                arrays[k] = pa.array(sizes, arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

    return found.mapInArrow(clean, docs.schema)


