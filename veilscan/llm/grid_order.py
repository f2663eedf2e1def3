"""Embedding near-duplicates by an epsilon grid order join.

Vectors of equal length under one label (a group) are cut into unit length, so that a cosine of at least c is a distance
of at most eps = sqrt(2 - 2c). Their leading principal coordinates fall into grid cells of side eps; the lexicographic
order of cells is one sequence for each group, cut into blocks of bounded size. Intervals of the sequence are joined
recursively, from whole groups down to blocks as Spark joins of one row for each interval, and inside two blocks in
one task. A pair of intervals ends
 - when it is provably distant: the boxes of its grid coordinates, or its balls, are further than eps apart;
 - when it is provably near: its balls lie within eps of each other, so all its pairs link and are counted, not made;
 - at small intervals, whose cosines are computed in double precision.
So links of a dense group are counted by intervals, and every link is counted.

The principal axes come from a bounded sample of vectors (their mean under each label taken off); they decide the order
only, never a result. Equal vectors of a group are one point with a number of copies. Points that link inside a block
are one vertex, and components run over edges between vertices, of which a dense group has few.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without label or
vec_id, link with nothing; vectors of different length are not compared; repeated rows are vectors of their own, linked
with each other; component_id is the smallest vec_id reachable, its own for a vector without links (null only for a row
without vec_id); an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import pick, ranked, stored
from veilscan.llm.jaccard import components

#: Vectors, about, that the axes are fitted on, chosen by a hash of the vector.
SAMPLE = 16_384
#: Distances closer to eps than this are decided by the cosine itself.
SLACK = 1e-9


@dataclass(frozen=True)
class Grid:
    """Links have a cosine of at least `least`; leading axes, points of a block, of a small interval, children of an interval."""

    least: float = 0.93
    axes: int = 8
    block: int = 2048
    leaf: int = 128
    fan: int = 16

    @property
    def eps(self) -> float:
        return max(2.0 - 2.0 * self.least, 1e-8) ** 0.5


def matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The measure that a pair close to the bound is decided by."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_of(table: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """vec_id, and for vectors that take part: label, width, key (digest of label and vector), vector (bytes of doubles)."""
    id_, vector, label = pick(table, id_column, vector_column, label_column)
    chosen = table.select(id_.cast("long").alias("vec_id"), label.cast("string").alias("label"), vector.cast("array<double>").alias("vector"))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    chosen = chosen.withColumn("vector", F.when(part, F.col("vector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if v is None else (np.array(v, "<f8") + 0.0).tobytes() for v in b.column(2).to_pylist()]
            keys = [None if v is None else blake2b(l.encode() + b"\0" + v, digest_size=16).digest() for l, v in zip(b.column(1).to_pylist(), raw)]
            width = [None if v is None else len(v) // 8 for v in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(width, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "width", "key", "vector"]
            )

    return chosen.mapInArrow(run, "vec_id long, label string, width int, key binary, vector binary")


def fitted_axes(points: DataFrame, axes: int, count: int) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample, its leading principal axes as columns."""
    share = min(1.0, SAMPLE / max(count, 1))
    chosen = points.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = chosen.select("width", "label", "vector").limit(2 * SAMPLE).toArrow()  # about SAMPLE rows, never more than twice as many
    by_width: dict[int, dict[str, list[bytes]]] = {}
    for w, l, v in zip(*(rows.column(c).to_pylist() for c in ("width", "label", "vector"))):
        by_width.setdefault(w, {}).setdefault(l, []).append(v)
    out = {}
    for w, labels in by_width.items():
        spread = [u - u.mean(0) for u in map(unit, map(matrix, labels.values()))]
        every = np.concatenate(spread)
        out[w] = np.linalg.eigh(every.T @ every)[1][:, ::-1][:, :axes]
    return out


def in_grid_order(points: DataFrame, grid: Grid, axes: dict[int, np.ndarray]) -> DataFrame:
    """points with `cells` (grid cells of side eps, then of an eighth of it, as bytes that sort like the cells) and `place`
    (the leading coordinates)."""
    sent = points.sparkSession.sparkContext.broadcast(axes)
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, raw = b.column(names.index("width")).to_pylist(), b.column(names.index("vector")).to_pylist()
            cells, place = [b""] * len(raw), [b""] * len(raw)
            for w in set(width):
                at = [i for i, x in enumerate(width) if x == w]
                # a length that the sample has missed is ordered by its first coordinates
                p = unit(matrix([raw[i] for i in at])) @ sent.value.get(w, np.eye(w, min(w, grid.axes)))
                steps = np.concatenate([np.floor((p + 1.01) / grid.eps), np.floor((p + 1.01) / grid.eps * 8)], 1).astype(">u2")
                for i, c, q in zip(at, steps, p):
                    cells[i], place[i] = c.tobytes(), q.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.binary()), pa.array(place, pa.binary())], names=[*names, "cells", "place"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, cells binary, place binary")


class Interval:
    """Points first..end of a block in grid order, with their box of leading coordinates and their ball."""

    __slots__ = ("first", "end", "low", "high", "centre", "radius", "weight", "parts")

    def __init__(self, block: Block, first: int, end: int, leaf: int):
        u, p = block.units[first:end], block.place[first:end]
        self.first, self.end, self.low, self.high = first, end, p.min(0), p.max(0)
        self.centre = u.mean(0)
        self.radius = float(np.sqrt(((u - self.centre) ** 2).sum(1).max()))
        self.weight = int(block.copies[first:end].sum())
        middle = (first + end) // 2
        self.parts = (Interval(block, first, middle, leaf), Interval(block, middle, end, leaf)) if end - first > leaf else ()


class Block:
    """A run of points of one group: keys, copies, unit vectors, leading coordinates, and the vertex of each point."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray, place: np.ndarray, vertices: np.ndarray, leaf: int):
        self.vectors, self.units, self.copies, self.place, self.vertices = vectors, unit(vectors), copies, place, vertices
        self.links = np.zeros(len(copies), np.int64)
        self.tree = Interval(self, 0, len(copies), leaf)


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[b] = a
            self.edges.append((x, y))


def joined_intervals(a: Block, b: Block, grid: Grid, union: Union, shift: int) -> None:
    """Counts the links between all points of a and b (twice the same block: inside it, each pair once, no point with
    itself) and unites their vertices, those of b numbered from `shift`."""
    same, eps = a is b, grid.eps
    todo = [(a.tree, b.tree)]
    while todo:
        x, y = todo.pop()
        itself = same and x is y
        gap = np.maximum(0.0, np.maximum(x.low - y.high, y.low - x.high))
        apart = float(np.sqrt(((x.centre - y.centre) ** 2).sum()))
        if gap @ gap > (eps + SLACK) ** 2 or apart - x.radius - y.radius > eps + SLACK:
            continue
        if apart + x.radius + y.radius < eps - SLACK:
            # twice the radius bounds the distance inside an interval
            a.links[x.first : x.end] += y.weight
            if itself:
                a.links[x.first : x.end] -= a.copies[x.first : x.end]
            else:
                b.links[y.first : y.end] += x.weight
            va, vb = np.unique(a.vertices[x.first : x.end]).tolist(), np.unique(b.vertices[y.first : y.end]).tolist()
            for v in va:
                union.join(v, vb[0] + shift)
            for v in vb:
                union.join(va[0], v + shift)
            continue
        if x.parts or y.parts:
            if itself:
                left, right = x.parts
                todo += [(left, left), (left, right), (right, right)]
            else:
                todo += [(p, q) for p in x.parts or (x,) for q in y.parts or (y,)]
            continue
        score = a.units[x.first : x.end] @ b.units[y.first : y.end].T
        hit = score >= grid.least
        for i, k in np.argwhere(np.abs(score - grid.least) < SLACK).tolist():
            hit[i, k] = cosine(a.vectors[x.first + i], b.vectors[y.first + k]) >= grid.least
        if itself:
            hit |= hit.T
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        a.links[x.first : x.end] += hit @ b.copies[y.first : y.end]
        if not itself:
            b.links[y.first : y.end] += hit.T @ a.copies[x.first : x.end]
        i, k = np.nonzero(hit)
        pairs = np.unique(np.stack([a.vertices[x.first + i], b.vertices[y.first + k]], 1), axis=0)
        for v, w in pairs.tolist():
            union.join(v, w + shift)


BLOCK = (
    "label string, width int, block long, points long, weight long, centre array<double>, radius double, low array<double>, high array<double>, "
    "keys binary, copies binary, vectors binary, place binary, vertices binary, links binary, ids binary"
)


def packed_blocks(sequence: DataFrame, grid: Grid) -> DataFrame:
    """One row for each block, its points joined among themselves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        keys, raw, place = (table.column(c).to_pylist() for c in ("key", "vector", "place"))
        copies = np.asarray(table.column("copies"), np.int64)
        n = len(keys)
        block = Block(matrix(raw), copies, matrix(place), np.arange(n), grid.leaf)
        union = Union(n)
        joined_intervals(block, block, grid, union, 0)
        roots = np.array([union.find(i) for i in range(n)])
        tree = block.tree
        row = {
            "label": table.column("label")[0].as_py(), "width": table.column("width")[0].as_py(), "block": table.column("block")[0].as_py(), "points": n, "weight": tree.weight,
            "centre": tree.centre.tolist(), "radius": tree.radius, "low": tree.low.tolist(), "high": tree.high.tolist(),
            "keys": b"".join(keys), "copies": copies.tobytes(), "vectors": b"".join(raw), "place": b"".join(place),
            "vertices": roots.astype("<i4").tobytes(), "links": block.links.tobytes(), "ids": np.asarray(table.column("first_id"), np.int64).tobytes(),
        }
        return pa.Table.from_pylist([row], kinds)

    doubles = pa.list_(pa.float64())
    kinds = pa.schema(
        [("label", pa.string()), ("width", pa.int32()), ("block", pa.int64()), ("points", pa.int64()), ("weight", pa.int64()), ("centre", doubles), ("radius", pa.float64()), ("low", doubles), ("high", doubles)]
        + [(c, pa.binary()) for c in ("keys", "copies", "vectors", "place", "vertices", "links", "ids")]
    )
    return sequence.groupBy("label", "width", "block").applyInArrow(run, BLOCK)


def wider_intervals(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level of intervals: each holds `fan` neighbours, their box and a ball around theirs."""

    def run(table: pa.Table) -> pa.Table:
        weight, points = (np.asarray(table.column(c), float) for c in ("weight", "points"))
        centres = np.array(table.column("centre").to_pylist())
        centre = (centres * points[:, None]).sum(0) / points.sum()
        radius = np.sqrt(((centres - centre) ** 2).sum(1)) + np.asarray(table.column("radius"))
        row = {
            "label": table.column("label")[0].as_py(), "width": table.column("width")[0].as_py(), "node": table.column("over")[0].as_py(), "points": int(points.sum()), "weight": int(weight.sum()),
            "centre": centre.tolist(), "radius": float(radius.max()), "low": np.array(table.column("low").to_pylist()).min(0).tolist(), "high": np.array(table.column("high").to_pylist()).max(0).tolist(),
        }
        return pa.Table.from_pylist([row], kinds)

    doubles = pa.list_(pa.float64())
    kinds = pa.schema([("label", pa.string()), ("width", pa.int32()), ("node", pa.int64()), ("points", pa.int64()), ("weight", pa.int64()), ("centre", doubles), ("radius", pa.float64()), ("low", doubles), ("high", doubles)])
    over = nodes.withColumn("over", F.expr(f"node div {fan}"))
    return over.groupBy("label", "width", "over").applyInArrow(run, "label string, width int, node long, points long, weight long, centre array<double>, radius double, low array<double>, high array<double>")


def judged(pairs: DataFrame, nodes: DataFrame, eps: float) -> DataFrame:
    """Pairs (label, width, a, b) of one level that aren't distant, with `near` and the weights of both sides."""
    measured = ("weight", "centre", "radius", "low", "high")
    one = nodes.select("label", "width", F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in measured))
    two = nodes.select("label", "width", F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in measured))
    both = pairs.join(one, ["label", "width", "a"]).join(two, ["label", "width", "b"])
    apart = "sqrt(aggregate(zip_with(centre_a, centre_b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"
    gaps = "zip_with(zip_with(low_a, high_b, (x, y) -> greatest(x - y, 0D)), zip_with(low_b, high_a, (x, y) -> greatest(x - y, 0D)), (x, y) -> greatest(x, y))"
    both = both.selectExpr("label", "width", "a", "b", "weight_a", "weight_b", "radius_a + radius_b as radii", f"{apart} as apart", f"sqrt(aggregate({gaps}, 0D, (s, x) -> s + x * x)) as gap")
    far = (F.col("gap") > eps + SLACK) | (F.col("apart") - F.col("radii") > eps + SLACK)
    return both.where(~far).select("label", "width", "a", "b", "weight_a", "weight_b", (F.col("apart") + F.col("radii") < eps - SLACK).alias("near"))


def interval_pairs(blocks: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame, int]:
    """From whole groups down: the pairs of blocks to be joined, the pairs of intervals that are near, with their level, and
    the number of levels above blocks."""
    most = blocks.agg(F.max("block")).first()[0] or 0
    names = ("label", "width", "points", "weight", "centre", "radius", "low", "high")
    levels = [blocks.select(F.col("block").alias("node"), *names)]
    while most:
        levels.append(stored(wider_intervals(levels[-1], grid.fan), "intervals"))
        most //= grid.fan
    pairs, near = levels[-1].select("label", "width", F.col("node").alias("a"), F.col("node").alias("b")), None
    for level in range(len(levels) - 1, 0, -1):
        found = stored(judged(pairs, levels[level], grid.eps).withColumn("level", F.lit(level)), "pairs")
        near = found.where("near") if near is None else near.unionByName(found.where("near"))
        below = levels[level - 1].selectExpr("label", "width", "node", f"node div {grid.fan} as over")
        left = below.select("label", "width", F.col("over").alias("a"), F.col("node").alias("a_"))
        right = below.select("label", "width", F.col("over").alias("b"), F.col("node").alias("b_"))
        pairs = found.where("not near").join(left, ["label", "width", "a"]).join(right, ["label", "width", "b"])
        pairs = pairs.where("a_ <= b_").selectExpr("label", "width", "a_ as a", "b_ as b")
    # a block has been joined with itself
    found = stored(judged(pairs.where("a != b"), levels[0], grid.eps).withColumn("level", F.lit(0)), "pairs")
    return found.where("not near"), found.where("near") if near is None else near.unionByName(found.where("near")), len(levels) - 1


def linked_blocks(pairs: DataFrame, blocks: DataFrame, grid: Grid) -> DataFrame:
    """Rows of pairs of blocks: key and number of links of a point (b null), or an edge between two vertices' keys."""
    content = ("keys", "copies", "vectors", "place", "vertices")
    one = blocks.select("label", "width", F.col("block").alias("a"), *(F.col(c).alias(f"{c}_a") for c in content))
    two = blocks.select("label", "width", F.col("block").alias("b"), *(F.col(c).alias(f"{c}_b") for c in content))
    both = pairs.select("label", "width", "a", "b").join(one, ["label", "width", "a"]).join(two, ["label", "width", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                sides, keys = [], []
                for s in ("a", "b"):
                    keys.append(row[f"keys_{s}"])
                    copies, vertices = np.frombuffer(row[f"copies_{s}"], np.int64), np.frombuffer(row[f"vertices_{s}"], "<i4")
                    sides.append(Block(*(np.frombuffer(row[f"{c}_{s}"], "<f8").reshape(len(copies), -1) if c else copies for c in ("vectors", "", "place")), vertices, grid.leaf))
                n = len(sides[0].copies)
                union = Union(n + len(sides[1].copies))
                joined_intervals(*sides, grid, union, n)
                names, others, counts = [], [], []
                for block, raw in zip(sides, keys):
                    for i in np.flatnonzero(block.links).tolist():
                        names.append(raw[16 * i : 16 * i + 16])
                        others.append(None)
                        counts.append(int(block.links[i]))
                raw = keys[0] + keys[1]
                for v, w in union.edges:
                    names.append(raw[16 * v : 16 * v + 16])
                    others.append(raw[16 * w : 16 * w + 16])
                    counts.append(0)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(others, pa.binary()), pa.array(counts, pa.int64())], names=["a", "b", "n"])

    return both.select(*(f"{c}_{s}" for c in content for s in "ab")).mapInArrow(run, "a binary, b binary, n long")


def points_of(blocks: DataFrame) -> DataFrame:
    """The points again: label, width, block, key, vertex (key of the first point of its component in the block), n (links
    inside the block, its own copies included), first_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = [row["keys"][i : i + 16] for i in range(0, len(row["keys"]), 16)]
                vertices, copies = np.frombuffer(row["vertices"], "<i4").tolist(), np.frombuffer(row["copies"], np.int64)
                n, size = np.frombuffer(row["links"], np.int64) + copies - 1, len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["label"]] * size), pa.array([row["width"]] * size, pa.int32()), pa.array([row["block"]] * size, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([keys[v] for v in vertices], pa.binary()), pa.array(n), pa.array(copies), pa.array(np.frombuffer(row["ids"], np.int64))],
                    names=["label", "width", "block", "key", "vertex", "n", "copies", "first_id"],
                )

    columns = ("label", "width", "block", "keys", "vertices", "copies", "links", "ids")
    return blocks.select(*columns).mapInArrow(run, "label string, width int, block long, key binary, vertex binary, n long, copies long, first_id long")


def inherited(near: DataFrame, blocks: DataFrame, grid: Grid, levels: int) -> DataFrame:
    """For each block and each interval around it that is near another one (or to itself): add, the links that every
    point of the block gets, and name, the interval's vertex."""
    sides = near.selectExpr("label", "width", "level", "a as node", "weight_b as add", "cast(a = b as long) as itself")
    sides = sides.unionByName(near.where("a != b").selectExpr("label", "width", "level", "b as node", "weight_a as add", "0L as itself"))
    sides = sides.groupBy("label", "width", "level", "node").agg(F.sum("add").alias("add"), F.sum("itself").alias("itself"))
    around = F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"block div {grid.fan**k}").alias("node")) for k in range(levels + 1)))
    spans = blocks.select("label", "width", "block", "weight", F.explode(around).alias("at")).select("label", "width", "block", "weight", "at.*")
    met = spans.join(sides, ["label", "width", "level", "node"])
    # links inside the block are counted there already
    return met.select("label", "width", "block", (F.col("add") - F.col("itself") * F.col("weight")).alias("add"), interval_name("node").alias("name"))


def interval_name(node: str) -> Column:
    """A vertex for an interval; longer than the keys of points."""
    return F.concat_ws("/", F.lit("interval of points"), "label", "width", "level", node).cast("binary")


def near_duplicates(table: DataFrame, grid: Grid = Grid(), id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = stored(rows_of(table, id_column, vector_column, label_column), "vectors")
    some = rows.where("key is not null")
    points = some.groupBy("label", "width", "key").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    points = stored(points, "points")
    axes = fitted_axes(points, grid.axes, points.count())
    sequence = ranked(in_grid_order(points, grid, axes), ["label", "width"], ["cells", "key"], "sequence")
    blocks = stored(packed_blocks(sequence.withColumn("block", F.expr(f"rank div {grid.block}")), grid), "blocks")
    pairs, near, levels = interval_pairs(blocks, grid)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(linked_blocks(pairs.repartition(tasks, "label", "width", "a", "b"), blocks, grid), "links")
    each = stored(points_of(blocks), "each")
    given = stored(inherited(near, blocks, grid, levels), "given")

    edges = found.where("b is not null").select("a", "b")
    edges = edges.unionByName(near.where("a != b").select(interval_name("a").alias("a"), interval_name("b").alias("b")))
    vertices = each.groupBy("label", "width", "block", "vertex").agg(F.min("first_id").alias("first_id"))
    edges = edges.unionByName(vertices.join(given, ["label", "width", "block"]).select(F.col("vertex").alias("a"), F.col("name").alias("b")))
    of_vertex = _components(vertices, edges)

    within = each.select("label", "width", "block", "key", "vertex", "n")
    across = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more"))
    adds = given.groupBy("label", "width", "block").agg(F.sum("add").alias("add"))
    total = F.col("n") + F.coalesce("more", F.lit(0)) + F.coalesce("add", F.lit(0))
    within = within.join(adds, ["label", "width", "block"], "left").join(across, "key", "left").join(of_vertex, "vertex")
    answers = within.select("key", total.alias("n_links"), "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = some.join(answers, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, component_id): the smallest id that each vertex reaches."""
    labels = components(edges).select(F.col("node").alias("vertex"), F.col("label").alias("component"))
    marked = stored(vertices.join(labels, "vertex", "left").select("vertex", "first_id", F.coalesce("component", "vertex").alias("component")), "marked")
    least = marked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return marked.join(least, "component").select("vertex", "component_id")
