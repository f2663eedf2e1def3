"""Approximate nearest chunks: buckets by random projections, the likeliest of them looked into.

A vector's bucket is the signs of a few orthonormal random projections, each taken from the sample's median.  A question
looks into the buckets of its document in order of the squared distance to the boundaries that part it from them, which
is a lower bound of the distance to any chunk there.  How many buckets that takes for a wanted recall is measured on a
bounded sample; every chunk is in the index, and what is found is ranked by its exact distance.

A few neighbouring buckets of a document make a cell; chunks and questions of a cell are dealt into blocks of bounded
size, and every block of chunks meets every block of questions in a task of its own.  There, each bucket is compared with
the questions that look into it by one matrix product, and what may be among the nearest is measured exactly.  So pairs
never become rows: a task gives back k rows for each question, and a document with very many chunks is spread over tasks.

Vectors that are null, hold null or non-finite components, or have another length than the index take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.operators.retrieval import squared_l2
from veilscan.settings import DEFAULT_OPTIONS

#: Vectors, about, that boundaries and the number of buckets to look into are fitted on; questions of the sample that are tried.
SAMPLE, TRIED = 8192, 300
#: Recall aimed at within the sample.
TARGET = 0.94
#: Buckets of one cell; chunks, and questions, of one task, about.
CELL_BUCKETS, BLOCK = 32, 16384


@dataclass(frozen=True)
class VectorIndex:
    """Projections (one a row), their medians, and the buckets that a question looks into."""

    directions: np.ndarray
    medians: np.ndarray
    probes: int

    @property
    def buckets(self) -> int:
        return 1 << len(self.medians)


def _whole(vector: str) -> Column:
    """True for a vector of finite components."""
    return F.expr(f"{vector} is not null and forall({vector}, x -> x is not null and abs(cast(x as double)) < cast('infinity' as double))")


def _usable(vector: str, index: VectorIndex) -> Column:
    return _whole(vector) & (F.size(vector) == (index.directions.shape[1] if len(index.medians) else -1))


def _bits(n: int) -> np.ndarray:
    return (np.arange(1 << n)[:, None] >> np.arange(n)) & 1


def fit_index(
    chunks: DataFrame, bits: int = 8, k: int = DEFAULT_OPTIONS.retriever_k, key: str = "doc_id", target: float = TARGET, seed: int = 11
) -> VectorIndex:
    """Fit an index to ``chunks(key, chunk_no, vector)``; about ``SAMPLE`` of them are read to the driver."""
    total = chunks.count()
    share = min(1.0, SAMPLE / max(total, 1))
    chosen = chunks.where(F.pmod(F.xxhash64(key, "chunk_no"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = [r for r in chosen.where(_whole("vector")).select(key, "vector").limit(2 * SAMPLE).collect() if len(r["vector"])]
    if not rows:
        return VectorIndex(np.zeros((0, 0)), np.zeros(0), 1)
    # the most frequent length of the sample
    sizes = np.bincount([len(r["vector"]) for r in rows])
    rows = [r for r in rows if len(r["vector"]) == sizes.argmax()]
    points = np.array([r["vector"] for r in rows], float)
    bits = min(bits, points.shape[1])
    random = np.random.default_rng(seed)
    directions = np.linalg.qr(random.normal(size=(points.shape[1], bits)))[0].T
    projected = points @ directions.T
    medians = np.median(projected, 0)
    margins = projected - medians
    codes = ((margins > 0) << np.arange(bits)).sum(1)
    # within each document of the sample: where in the order of buckets do a point's nearest ones lie
    groups: dict[object, list[int]] = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[key], []).append(i)
    flips, needed = _bits(bits), []
    for i in random.permutation(len(rows))[:TRIED]:
        others = np.array([j for j in groups[rows[i][key]] if j != i], int)
        near = others[np.argsort(((points[others] - points[i]) ** 2).sum(1))[:k]]
        place = np.empty(1 << bits, int)
        place[np.argsort(flips @ margins[i] ** 2, kind="stable")] = np.arange(1 << bits)
        needed += place[codes[near] ^ codes[i]].tolist()
    probes = int(np.ceil(np.quantile(needed, target))) + 1 if needed else 1
    return VectorIndex(directions, medians, probes)


def _numbers(rows) -> str:
    return f"array({', '.join(f'{x!r}D' for x in map(float, rows))})"


def _margins(vector: str, index: VectorIndex) -> Column:
    directions = f"array({', '.join(_numbers(d) for d in index.directions)})" if len(index.medians) else "cast(array() as array<array<double>>)"
    dots = f"transform({directions}, d -> aggregate(zip_with({vector}, d, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x))"
    medians = _numbers(index.medians) if len(index.medians) else "cast(array() as array<double>)"
    return F.expr(f"zip_with({dots}, {medians}, (x, m) -> x - m)")


CODE = "aggregate(transform(_margins, (m, i) -> if(m > 0, shiftleft(1, i), 0)), 0, (s, x) -> s + x)"


def indexed_chunks(chunks: DataFrame, index: VectorIndex, key: str = "doc_id") -> DataFrame:
    """``(key, bucket, chunk_no, vector)``: every chunk in its bucket; may be stored and used for many questions."""
    return chunks.select(key, "chunk_no", "vector", _margins("vector", index).alias("_margins")).select(
        key, F.expr(CODE).alias("bucket"), "chunk_no", "vector"
    )


def probed_buckets(questions: DataFrame, index: VectorIndex, key: str = "doc_id") -> DataFrame:
    """``(q_id, key, q_vector, _buckets)``: the array of buckets that each question looks into."""
    costs = "aggregate(transform(_margins, (m, i) -> if(shiftright(flip, i) & 1 = 1, m * m, 0D)), 0D, (s, x) -> s + x)"
    order = f"array_sort(transform(sequence(0, {index.buckets - 1}), flip -> named_struct('cost', {costs}, 'bucket', flip ^ _code)))"
    coded = questions.select("q_id", key, "q_vector", _margins("q_vector", index).alias("_margins")).withColumn("_code", F.expr(CODE))
    return coded.select("q_id", key, "q_vector", F.expr(f"transform(slice({order}, 1, {index.probes}), p -> p.bucket)").alias("_buckets"))


def probed(questions: DataFrame, index: VectorIndex, key: str = "doc_id") -> DataFrame:
    """``(q_id, key, bucket, q_vector)``: the same as rows."""
    return probed_buckets(questions, index, key).select("q_id", key, F.explode("_buckets").alias("bucket"), "q_vector")


def compared_chunks(questions: DataFrame, indexed: DataFrame, index: VectorIndex, key: str = "doc_id") -> DataFrame:
    """``(q_id, key, chunk_no, distance)`` of the chunks that the questions look at."""
    return indexed.join(probed(questions, index, key), [key, "bucket"]).select(
        "q_id", key, "chunk_no", squared_l2("vector", "q_vector").alias("distance")
    )


def nearest_in_block(key: str, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of chunks and one of questions, the k nearest that the questions find, with their exact distances."""

    def components(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten(), float).reshape(rows, -1)

    def run(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        keys, ids = chunks[key].type, chunks["chunk_no"].type
        schema = pa.schema([("q_id", questions["q_id"].type), (key, keys), ("chunk_no", ids), ("distance", pa.float64())])
        if not chunks.num_rows or not questions.num_rows:
            return schema.empty_table()
        # by bucket and number; of equal vectors in a bucket, only the k first can be among the nearest
        chunks = chunks.take(pc.sort_indices(chunks, [("bucket", "ascending"), ("chunk_no", "ascending")], null_placement="at_start"))
        points, buckets = components(chunks["vector"], chunks.num_rows), np.asarray(chunks["bucket"])
        alike = np.unique(points + 0.0, axis=0, return_inverse=True)[1].ravel()
        place = np.lexsort((np.arange(len(alike)), alike, buckets))
        fresh = np.r_[True, (np.diff(alike[place]) != 0) | (np.diff(buckets[place]) != 0)]
        nth = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        kept = np.sort(place[nth < k])
        points, buckets, rows = points[kept], buckets[kept], kept
        asked = components(questions["q_vector"], questions.num_rows)
        probes = questions["probes"].combine_chunks()
        at = np.repeat(np.arange(questions.num_rows), np.asarray(probes.value_lengths()))
        into = np.asarray(probes.flatten())
        order = np.argsort(into, kind="stable")
        at, into = at[order], into[order]
        lengths, sizes = (points**2).sum(1), (asked**2).sum(1)
        # what rounding in the products can amount to
        slack = 1e-12 * (lengths.max() + sizes) * points.shape[1]
        best = np.full((len(asked), k), np.inf)
        found_q, found_c, found_d = [], [], []
        for bucket in np.unique(buckets):
            own = slice(*np.searchsorted(buckets, [bucket, bucket + 1]))
            who = at[slice(*np.searchsorted(into, [bucket, bucket + 1]))]
            for part, c in product(range(0, len(who), 1024), range(own.start, own.stop, 4096)):
                q, some = who[part : part + 1024], slice(c, min(c + 4096, own.stop))
                near = sizes[q, None] + lengths[some] - 2 * (asked[q] @ points[some].T)
                limit = best[q, -1]
                if near.shape[1] > k and np.isinf(limit).any():
                    limit = np.minimum(limit, np.partition(near, k - 1, 1)[:, k - 1])
                i, j = np.nonzero(near <= (limit + 2 * slack[q])[:, None])
                if not len(i):
                    continue
                found_q.append(q[i]), found_c.append(c + j), found_d.append(near[i, j])
                some = np.unique(i)
                best[q[some]] = np.sort(np.partition(np.concatenate([best[q[some]], near[some]], 1), k - 1, 1)[:, :k], 1)
        if not found_q:
            return schema.empty_table()
        q, c, d = map(np.concatenate, (found_q, found_c, found_d))
        close = d <= best[q, -1] + 2 * slack[q]
        q, c = q[close], c[close]
        exact = np.zeros(len(q))
        for x in range(points.shape[1]):  # component by component, as the expression sums
            exact += (points[c, x] - asked[q, x]) ** 2
        numbers = np.empty(chunks.num_rows, int)
        numbers[np.asarray(pc.sort_indices(chunks["chunk_no"], null_placement="at_start"))] = np.arange(chunks.num_rows)
        order = np.lexsort((numbers[rows[c]], exact, q))
        q, c, exact = q[order], c[order], exact[order]
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(q) != 0], np.arange(len(q)), 0))
        top = np.arange(len(q)) - first < k
        q, c, exact = q[top], c[top], exact[top]
        return pa.Table.from_arrays([questions["q_id"].take(q), questions["_key"].take(q), chunks["chunk_no"].take(rows[c]), pa.array(exact)], schema=schema)

    return run


def nearest_indexed(
    questions: DataFrame, indexed: DataFrame, index: VectorIndex, k: int = DEFAULT_OPTIONS.retriever_k, key: str = "doc_id", block: int = BLOCK
) -> DataFrame:
    """The k nearest found chunks of each question within its document, as ``nearest_chunks`` gives them.

    ``questions`` and ``indexed`` are read twice each: to count their blocks, and to compare them.
    """
    cell = F.expr(f"bucket div {CELL_BUCKETS}").alias("_cell")
    chunks = indexed.where(_usable("vector", index) & F.col(key).isNotNull()).select(key, cell, "bucket", "chunk_no", "vector")
    asked = questions.where(_usable("q_vector", index) & F.col(key).isNotNull()).select("q_id", key, "q_vector")

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / block).cast("int")

    cells = chunks.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("n")).select(key, "_cell", blocks("n").alias("_parts"))
    asks = asked.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, blocks("n").alias("_asks"))
    grid = cells.join(asks, key)
    dealt = chunks.join(grid, [key, "_cell"]).select(
        key, "_cell", F.expr("pmod(xxhash64(chunk_no, vector), _parts)").cast("int").alias("_part"),
        F.explode(F.expr("sequence(0, _asks - 1)")).alias("_ask"), "bucket", "chunk_no", "vector",
    )
    looked = probed_buckets(asked, index, key).select(
        "q_id", key, "q_vector",
        F.explode(F.expr(
            f"filter(transform(sequence(0, {(index.buckets - 1) // CELL_BUCKETS}), c -> named_struct('cell', c, 'probes', "
            f"filter(_buckets, b -> b div {CELL_BUCKETS} = c))), x -> size(x.probes) > 0)"
        )).alias("_c"),
    ).select("q_id", key, "q_vector", F.col("_c.cell").cast("long").alias("_cell"), F.col("_c.probes").alias("probes"))
    # other names than ``dealt`` has: both sides come from the same grid
    met = looked.join(grid, [key, "_cell"]).select(
        key, "_cell", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part"),
        F.expr("pmod(xxhash64(q_id, q_vector), _asks)").cast("int").alias("_ask"), "q_id", "q_vector", "probes",
    ).toDF("_key", "_group", "_block", "_set", "q_id", "q_vector", "probes")
    types = {f.name: f.dataType.simpleString() for f in [*indexed.schema, *questions.schema]}
    found = dealt.groupBy(key, "_cell", "_part", "_ask").cogroup(met.groupBy("_key", "_group", "_block", "_set")).applyInArrow(
        nearest_in_block(key, k), f"q_id {types['q_id']}, {key} {types[key]}, chunk_no {types['chunk_no']}, distance double"
    )
    order = Window.partitionBy("q_id").orderBy("distance", "chunk_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
