"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue.

Equal vectors are one vector with its few smallest ids, so copies never meet each other. The trees are
fitted on a bounded sample (random directions, split at the median of the sample) and sent to all tasks;
how many leaves a query visits is what its neighbours within the sample need;
every vector is put into one leaf of each tree. A query walks all trees through one queue, ordered by how
far it is from the boundaries it has crossed, and visits the nearest leaves. Leaves are blocks of bounded
size; a block compares its queries with its vectors exactly and passes on each query's best, from which the
final ones are chosen by the cosine in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without vec_id or with a length other than the most common one (ties: the longer). Repeated rows with
the same id count once. Ties go to smaller ids. With no queries or no candidates there are no rows for them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import pick, stored

#: Vectors that the trees are fitted on, chosen by a hash of their id.
SAMPLE = 16_384
TREES = 6
#: Share of true neighbours that must lie in the leaves visited, measured within the sample on PROBES queries.
TARGET, PROBES = 0.96, 200
#: Vectors that a leaf holds on average: so many at least, and this multiple of the square root of all, since a
#: query's answers from all its leaves are gathered. Sample points that a leaf needs.
LEAF, ROOTS, LEAF_SAMPLE = 384, 10, 6
#: Vectors that a block of a leaf holds at most, on average.
BLOCK = 4096


@dataclass
class Forest:
    """Nodes of all trees in flat arrays; child >= 0 is a node, child < 0 is leaf -child - 1 of the tree."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    roots: list[int]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            todo = np.arange(len(vectors)) if root >= 0 else np.empty(0, int)
            while len(todo):
                node = at[todo]
                right = np.einsum("ij,ij->i", vectors[todo], self.directions[node]) > self.thresholds[node]
                at[todo] = self.children[node, right.astype(int)]
                todo = todo[at[todo] >= 0]
            out[:, t] = -at - 1
        return out

    def search(self, vector: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves visited, best first, through one queue over all trees."""
        margins = self.directions @ vector - self.thresholds if len(self.thresholds) else np.empty(0)
        queue = [(-np.inf, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(queue)
        out: list[tuple[int, int]] = []
        while queue and len(out) < visits:
            least, t, at = heapq.heappop(queue)
            while at >= 0:
                m = margins[at]
                near = int(m > 0)
                heapq.heappush(queue, (max(least, abs(m)), t, int(self.children[at, 1 - near])))
                at = int(self.children[at, near])
            out.append((t, -at - 1))
        return out


def leaf_size(count: int) -> int:
    return max(LEAF, int(ROOTS * count**0.5))


def fit(sample: np.ndarray, count: int, trees: int = TREES, seed: int = 7) -> Forest:
    """Trees over unit vectors of the sample, for `count` vectors in all."""
    random = np.random.default_rng(seed)
    size = max(LEAF_SAMPLE, int(len(sample) * leaf_size(count) / max(count, 1)))
    directions, thresholds, children, roots = [], [], [], []
    for _ in range(trees):
        leaf = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal leaf
            if len(rows) > size:
                # random direction between two points of the node: separates what is there
                a, b = sample[random.choice(rows, 2, replace=False)]
                d = (a - b) + random.normal(size=sample.shape[1]) * 0.1 / np.sqrt(sample.shape[1])
                d = d / (np.linalg.norm(d) or 1.0)
                p = sample[rows] @ d
                cut = float(np.median(p))
                right = p > cut
                if right.any() and not right.all():
                    at = len(thresholds)
                    directions.append(d)
                    thresholds.append(cut)
                    children.append([0, 0])
                    children[at][0] = grow(rows[~right])
                    children[at][1] = grow(rows[right])
                    return at
            leaf += 1
            return -leaf

        roots.append(grow(np.arange(len(sample))))
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, int).reshape(-1, 2), roots)


def needed_visits(forest: Forest, sample: np.ndarray, k: int) -> int:
    """Leaves to visit so that TARGET of the k nearest of sample vectors (within the sample) are met."""
    probes = sample[:PROBES]
    near = probes @ sample.T
    near[np.arange(len(probes)), np.arange(len(probes))] = -2
    near = np.argsort(-near, 1)[:, : min(k, len(sample) - 1)]
    if not near.size:
        return len(forest.roots)
    margins = probes @ forest.directions.T - forest.thresholds if len(forest.thresholds) else np.empty((len(probes), 0))
    # the place in the queue of each node and leaf; parents come before their children
    order, tree = np.zeros((len(probes), len(forest.thresholds))), np.zeros(len(forest.thresholds), int)
    at_leaf: list[dict[int, np.ndarray]] = [{0: np.zeros(len(probes))} if root < 0 else {} for root in forest.roots]
    for t, root in enumerate(forest.roots):
        if root >= 0:
            tree[root] = t
    for i in range(len(forest.thresholds)):
        right = margins[:, i] > 0
        far = np.maximum(order[:, i], np.abs(margins[:, i]))
        for side, value in ((0, np.where(right, far, order[:, i])), (1, np.where(right, order[:, i], far))):
            child = forest.children[i, side]
            if child >= 0:
                order[:, child], tree[child] = value, tree[i]
            else:
                at_leaf[tree[i]][-child - 1] = value
    by_tree = [np.stack([leaves[k] for k in range(len(leaves))], 1) for leaves in at_leaf]
    everything = np.sort(np.concatenate(by_tree, 1), 1)
    where = forest.leaves(sample)
    need = []
    for i, others in enumerate(near):
        for j in others:
            first = min(values[i, where[j, t]] for t, values in enumerate(by_tree))
            need.append(np.searchsorted(everything[i], first, "right"))
    return int(np.ceil(np.quantile(need, TARGET)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.empty((0, 0))


def vectors_of(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector): the rows that take part, the vector as doubles."""
    id_, vector = pick(table, id_column, vector_column)
    rows = table.select(id_.cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & usable)
    lengths = rows.groupBy(F.size("vector").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1)
    width = lengths.first()
    return rows.where(F.size("vector") == (width["k"] if width else 0))


def nearest(table: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    spark = table.sparkSession
    rows = vectors_of(table, id_column, vector_column)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(v, "<f8").tobytes() for v in data.to_pylist()], pa.binary())], names=["vec_id", "vector"])

    packed = rows.mapInArrow(pack, "vec_id long, vector binary")
    # of a vector's copies, the k + 1 smallest ids are enough for any query; each task passes on so many at most
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    few = packed.withColumn("nth", F.dense_rank().over(by_id)).where(F.col("nth") <= k + 1)
    points = few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    points = stored(points.select(F.col("ids")[0].alias("point"), "vector", "ids"), "points")
    count = points.count()
    queries = packed.where(F.col("vec_id") % every == 0).distinct()
    asked = stored(queries.join(points.select("point", "vector"), "vector").select("vec_id", "point", "vector"), "asked")

    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("vector").toArrow()  # at most SAMPLE rows
    units = _unit(_matrix(sample.column("vector").combine_chunks())) if sample.num_rows else np.empty((0, 0))
    forest = fit(units, count)
    visits = needed_visits(forest, units, k) if sample.num_rows else TREES
    sent = spark.sparkContext.broadcast(forest)
    leaves = max(1, min(count // leaf_size(count), SAMPLE // LEAF_SAMPLE))
    split = max(1, -(-count // (leaves * BLOCK)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = sent.value.leaves(_unit(_matrix(part.column(1))))
                n, trees = found.shape
                index = pa.array(np.repeat(np.arange(n), trees))
                point = part.column(0).take(index)
                block = pa.array((np.asarray(point) * 2654435761 % 2**32 % split).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(found.reshape(-1)), block, pa.array(np.zeros(n * trees, bool)), point, part.column(1).take(index)],
                    names=["tree", "leaf", "block", "asks", "point", "vector"],
                )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                index, trees, found = [], [], []
                for i, v in enumerate(_unit(_matrix(part.column(1)))):
                    for t, leaf in sent.value.search(v, visits):
                        index.append(i)
                        trees.append(t)
                        found.append(leaf)
                index, trees, found = (np.repeat(np.array(x), split) for x in (index, trees, found))
                block = np.tile(np.arange(split, dtype=np.int32), len(index) // split)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees.astype(np.int32)), pa.array(found.astype(np.int32)), pa.array(block), pa.array(np.ones(len(index), bool)), part.column(0).take(pa.array(index)), part.column(1).take(pa.array(index))],
                    names=["tree", "leaf", "block", "asks", "point", "vector"],
                )

    schema = "tree int, leaf int, block int, asks boolean, point long, vector binary"
    held = points.select("point", "vector").mapInArrow(place, schema)
    asking = asked.select("point", "vector").distinct().mapInArrow(visit, schema)

    def rerank(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        point = np.asarray(table.column("point"))
        out: list[list] = [[], [], []]
        if asks.any() and not asks.all():
            all_rows = _matrix(table.column("vector").combine_chunks())
            ours, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
            theirs = theirs[np.argsort(point[theirs], kind="stable")]
            right, right_size = all_rows[theirs], np.sqrt((all_rows[theirs] ** 2).sum(1))
            for q in ours:
                v = all_rows[q]
                # elementwise products and a sum along the row: the same number wherever the row lies
                score = (right * v).sum(1) / (right_size * np.sqrt((v * v).sum()))
                best = np.argsort(-score, kind="stable")[: k + 1]
                out[0].append(np.full(len(best), point[q]))
                out[1].append(point[theirs[best]])
                out[2].append(score[best])
        joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({"query": pa.array(joined[0]), "found": pa.array(joined[1]), "score": pa.array(joined[2])})

    close = held.unionByName(asking).groupBy("tree", "leaf", "block").applyInArrow(rerank, "query long, found long, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    best = close.groupBy("query", "found").agg(F.max("score").alias("score"))
    best = best.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1)
    answers = best.join(points.select(F.col("point").alias("found"), "ids"), "found").select("query", F.explode("ids").alias("found_id"), "score")
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "found_id")
    return (
        mine.join(answers, "query").where("found_id != query_id")
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("found_id").alias("vec_id"), "score")
    )
