"""N-gram Jaccard join: which documents share at least a given part of their word n-grams.

Sets of n-grams are kept as 64-bit hashes in one global order (the hash). The join has three steps.

1. Blocking. Sets with Jaccard similarity t or more differ in at most d elements, d following from their
   sizes. The hash range is cut into m > d parts, so m - d parts of both hold the same elements. Digests of a set's
   d + 1 largest parts are its blocking keys: the largest part that two linked sets share is among them in both.
   Keys are dealt out as packed arrays, with short names of their sets; each key's first set is its hub, and every
   later set of the key yields an edge (hub, set). A key that a third of all sets have is one entry and a stream of edges.
2. Prefix trees. The sets of a hub's star meet in blocks of bounded size. A block stores its sets in a trie,
   equal beginnings once. Each set walks down the trie with the overlap so far shared by all sets below;
   a subtree is left when the elements that remain can't bring the overlap up to what is needed, or when all
   its sets are known to be in the same component.
   At first each set meets only its largest star. Before sets move, those of a block are held against each other by
   their parities: one bit for some places that elements fall into, which differ in no more bits than the sets in
   elements. Only sets that may link by these meet in prefix trees.
3. Components. Links of all blocks are joined to components (large and small stars). In stars whose sets are still in
   several components, sets of other components than the hub's meet all sets of the star, in the same two steps.

Documents with equal sets are one set from the start. No pairs of a group are listed.

Defined results: null and empty texts have no set and link with nothing; texts with fewer words than n are one
n-gram; repeated rows are documents of their own; component_id is the smallest doc_id of a component, null only
if all its rows have a null doc_id; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StructField, StructType

from veilscan.llm.common import Memo, blobs, bucketed, few, fresh, give_back, kept, mixed, pick, slices, stored

#: A block of a star holds about so many sets and so many elements.
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 2_000_000
#: Sets and elements that are compared by their parities in one block.
PARITY_SETS, PARITY_ELEMENTS = 16_384, 32_000_000
#: Words of parities looked at in one step of a block.
PARITY_STEP = 1 << 21
#: Bits of the filter that says which documents may be needed again (2 MB, whatever the input).
FILTER_BITS = 1 << 24
#: Bytes of a blocking key that are dealt out, and of the name that a set has there, whatever the number of partitions.
KEY_BYTES, NAME_BYTES = 5, 6
#: Keys of a partition that are sorted at once.
CHUNK = 1 << 18
#: Elements compared between two looks at the bound.
STRIDE = 64
U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Sets link when den * intersection >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100

    def needed(self, total: int) -> int:
        """Least intersection of linked sets whose sizes sum to total."""
        return -(-self.num * total // (self.num + self.den))

    def differing(self, total: int) -> int:
        """Most elements that only one of two linked sets has, their sizes summing to total or less."""
        return total * (self.den - self.num) // (self.num + self.den)


def word_set(text: bytes, memo: Memo, n: int) -> np.ndarray:
    """Sorted hashes of the text's distinct word n-grams; A-Z count as a-z, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U)
    ids = memo.array(words)
    size = min(n, len(ids))
    h = np.full(len(ids) - size + 1, size, U)
    for k in range(size):
        h = mixed(h * U(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k])
    return np.unique(h)


def node_of(values: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    if not len(values):
        return b""
    a, b = mixed(values ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U), mixed(values + U(len(values) * 0xD1342543DE82EF95 % 2**64)).sum(dtype=U)
    return np.array([a, b], U).tobytes()


@lru_cache(maxsize=64)
def _classes(rule: Rule) -> list[tuple[int, int]]:
    """Ranges of sizes; linked sets are in the same range or in neighbours."""
    out, low = [], 1
    while low < 1 << 40:
        high = rule.den * low // rule.num
        out.append((low, high))
        low = high + 1
    return out


@lru_cache(maxsize=64)
def _lows(rule: Rule) -> np.ndarray:
    return np.array([low for low, _ in _classes(rule)])


def blocking_keys(values: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of which linked sets share one, for the set's own range of sizes and the next.

    Two sets that differ in at most `most` elements agree in m - most parts or more. Ordered by size and place, the last of
    these has m - most - 1 others before it in either set, so that many parts, the smallest, need no key.
    """
    n = len(values)
    own = int(np.searchsorted(_lows(rule), n, "right")) - 1
    sums = np.concatenate([[U(0)], np.cumsum(mixed(values ^ U(0x5851F42D4C957F2D)), dtype=U)])
    keys = []
    for c in (own, own + 1):
        high = _classes(rule)[c][1]
        d = rule.differing(2 * high)
        m = d + 1 + d // 2
        # no linked set that has keys of this range is larger
        most = rule.differing(n + min(high, rule.den * n // rule.num))
        bounds = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(U)
        cuts = np.concatenate([[0], np.searchsorted(values, bounds), [n]])
        sizes = np.diff(cuts)
        without = m - 1 - most
        part = np.argpartition(sizes * m + np.arange(m), without)[without:]
        name = part.astype(U) * U(0x9E3779B97F4A7C15) + U(c * 0xC2B2AE3D27D4EB4F % 2**64) + sizes[part].astype(U)
        keys.append(mixed(sums[cuts[part + 1]] - sums[cuts[part]] + name))
    return np.concatenate(keys)


def document_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: doc_id, n (size of its set), node (digest of the set), bits (its parities)."""
    id_, text = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("words", Memo)
        for part in slices(batches):
            sets = [word_set(t, memo, rule.words) for t in blobs(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.binary()), pa.array([parities(s) for s in sets], pa.binary())],
                names=["doc_id", "n", "node", "bits"],
            )

    return docs.select(id_.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, node binary, bits binary")


def dealt_keys(docs: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Blocking keys of all sets, packed by the partition they go to: part, keys, index (of a key's set), names (of these sets)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = kept("words", Memo), set()
        for part in slices(batches):
            keys, nodes, owner = [], [], []
            for text in blobs(part.column(0)):
                values = word_set(text, memo, rule.words)
                node = node_of(values)
                # a set met before in this task has given its keys already
                if not node or node in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                own = blocking_keys(values, rule)
                keys.append(own)
                owner.append(np.full(len(own), len(nodes), np.uint8))
                nodes.append(node)
            if not nodes:
                continue
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            table = np.frombuffer(b"".join(node[:NAME_BYTES] for node in nodes), np.uint8).reshape(-1, NAME_BYTES)
            place = (keys >> U(40)) % U(parts)
            # so many bits tell keys of one part apart well enough; a chance meeting costs a comparison
            short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(parts + 1, dtype=U))
            rows = []
            for p in range(parts):
                at = order[ends[p] : ends[p + 1]]
                if len(at):
                    used, index = np.unique(owner[at], return_inverse=True)
                    rows.append((p, short[at].tobytes(), index.astype(np.uint8).tobytes(), table[used].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["part", "keys", "index", "names"]
            )

    (text,) = pick(docs, "text")
    return docs.select(text.cast("string").alias("text")).mapInArrow(deal, "part int, keys binary, index binary, names binary")


def candidate_pairs(docs: DataFrame, rule: Rule) -> DataFrame:
    """Edges (hub, name) between names of sets that share a blocking key; every such set has an edge to the key's hub."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hubs = np.empty(0, U), np.empty(0, U)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> pa.RecordBatch:
            nonlocal known, hubs
            keys, names = np.concatenate([k for k, _ in waiting]), np.concatenate([n for _, n in waiting])
            waiting.clear()
            order = np.lexsort((names, keys))
            keys, names = keys[order], names[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            start = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            heads, hub = keys[start], names[start]
            at = np.minimum(np.searchsorted(known, heads), max(len(known) - 1, 0))
            old = known[at] == heads if len(known) else np.zeros(len(heads), bool)
            hub = np.where(old, hubs[at], hub) if len(known) else hub
            mine = hub[group]
            edge = mine != names
            pairs = np.unique(np.stack([mine[edge], names[edge]], 1), axis=0)
            new = ~old
            known, hubs = np.concatenate([known, heads[new]]), np.concatenate([hubs, hub[new]])
            order = np.argsort(known, kind="stable")
            known, hubs = known[order], hubs[order]
            raw = np.ascontiguousarray(pairs).astype("<u8")
            return pa.RecordBatch.from_arrays([pa.array([r.tobytes()[:NAME_BYTES] for r in raw[:, k]], pa.binary()) for k in (0, 1)], names=["hub", "name"])

        held = 0
        give_back()
        for batch in batches:
            for keys, index, names in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                keys = unpacked(keys, KEY_BYTES)
                waiting.append((keys, unpacked(names, NAME_BYTES)[np.frombuffer(index, np.uint8)]))
                held += len(keys)
                if held >= CHUNK:
                    yield settle()
                    held = 0
        if waiting:
            yield settle()

    return dealt_keys(docs, rule, parts).repartitionById(parts, F.col("part")).mapInArrow(meet, "hub binary, name binary").distinct()


def candidate_edges(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Edges (hub, node) between sets that share a blocking key or a name; every such set has an edge to the hub."""
    # a name is the beginning of a digest: hardly any two sets have the same
    name = F.substring("node", 1, NAME_BYTES)
    named = classes.where("n > 0").groupBy(name.alias("name")).agg(F.collect_set("node").alias("nodes"))
    heads = named.select(F.col("name").alias("hub"), F.array_min("nodes").alias("head"))
    met = candidate_pairs(docs, rule).join(heads, "hub").join(named, "name").select(F.col("head").alias("hub"), F.explode("nodes").alias("node"))
    same = named.where(F.size("nodes") > 1).select(F.array_min("nodes").alias("hub"), F.explode("nodes").alias("node")).where("hub != node")
    return met.unionByName(same)


def packed(values: np.ndarray) -> bytes:
    """The leading 48 bits of each hash, which keep the order; two sets of a thousand elements then agree in
    an element by mistake once in some hundred million pairs."""
    return (values >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes, width: int = 6) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").reshape(-1)


def parities(values: np.ndarray) -> bytes:
    """A bit for each place of a table of two to four times as many places as the set has elements: whether an odd
    number of them falls there. Two sets differ in at least as many elements as their parities differ in bits."""
    places = 64 << max(0, int(len(values) - 1) // 32).bit_length()
    odd = np.bincount((mixed(values ^ U(0x7F4A7C15F39CC060)) & U(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Parities in a table of fewer places, a power of two as before."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def possible_partners(sizes: np.ndarray, bits: list[bytes], labels: np.ndarray, asks: np.ndarray, rule: Rule) -> np.ndarray:
    """Which sets of a block may link with another one under another label, one of the two asking: no set that does is missed."""
    width = np.fromiter((len(b) // 8 for b in bits), int, len(bits))
    found = np.zeros(len(bits), bool)
    tables = {w: np.frombuffer(b"".join(b for b in bits if len(b) == 8 * w), U).reshape(-1, w) for w in np.unique(width).tolist()}
    index = {w: np.flatnonzero(width == w) for w in tables}
    for w, mine in tables.items():
        some = np.flatnonzero(asks[index[w]])
        for v, theirs in tables.items():
            # tables have two to four places an element, and sizes of linked sets are close
            if not len(some) or max(v, w) * rule.num > 2 * min(v, w) * rule.den:
                continue
            words = min(v, w)
            left, right, there = folded(mine[some], words), folded(theirs, words), index[v]
            step = max(1, PARITY_STEP // (words * len(right)))
            for at in range(0, len(left), step):
                here = index[w][some[at : at + step]]
                differ = np.bitwise_count(left[at : at + step, None, :] ^ right[None, :, :]).sum(2, dtype=np.int64)
                most = (sizes[here][:, None] + sizes[there][None, :]) * (rule.den - rule.num) // (rule.num + rule.den)
                hit = (differ <= most) & (labels[here][:, None] != labels[there][None, :])
                found[here] |= hit.any(1)
                found[there] |= hit.any(0)
    return found


class PrefixTree:
    """Sets in global order; equal beginnings are stored once."""

    class Branch:
        __slots__ = ("values", "depth", "children", "ends", "least", "most", "tag")

        def __init__(self, values: np.ndarray, depth: int):
            self.values, self.depth = values, depth  # depth: elements before these
            self.children: dict[int, PrefixTree.Branch] = {}
            self.ends: list[int] = []
            self.least, self.most, self.tag = 1 << 60, 0, -1

    def __init__(self, rule: Rule, find):
        self.rule, self.find = rule, find
        self.root = self.Branch(np.empty(0, U), 0)

    def add(self, values: np.ndarray, name: int) -> None:
        branch, at = self.root, 0
        while True:
            # the tag is a member, if all members were in one component when the last came
            alone = branch.most == 0
            branch.least, branch.most = min(branch.least, len(values)), max(branch.most, len(values))
            if alone:
                branch.tag = name
            elif branch.tag >= 0 and self.find(branch.tag) != self.find(name):
                branch.tag = -1
            if at == len(values):
                branch.ends.append(name)
                return
            child = branch.children.get(int(values[at]))
            if child is None:
                child = self.Branch(values[at:], at)
                child.least = child.most = len(values)
                child.tag = name
                child.ends.append(name)
                branch.children[int(values[at])] = child
                return
            n = min(len(child.values), len(values) - at)
            differ = np.flatnonzero(child.values[:n] != values[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.values):
                lower = self.Branch(child.values[same:], at + same)
                lower.children, lower.ends, lower.least, lower.most, lower.tag = child.children, child.ends, child.least, child.most, child.tag
                child.values, child.children, child.ends = child.values[:same], {int(lower.values[0]): lower}, []
            branch, at = child, at + same

    def linked(self, values: np.ndarray, name: int) -> Iterator[int]:
        """Names of stored sets that link with the given one, but for those in its component already."""
        size, rule = len(values), self.rule
        stack = [(self.root, 0, 0)]
        while stack:
            branch, overlap, at = stack.pop()
            if branch.tag >= 0 and self.find(branch.tag) == self.find(name):
                continue
            cut = False
            for i in range(0, len(branch.values), STRIDE):
                some = branch.values[i : i + STRIDE]
                left = values[at:]
                where = np.searchsorted(left, some)
                overlap += int((left[np.minimum(where, len(left) - 1)] == some).sum()) if len(left) else 0
                at += int(np.searchsorted(left, some[-1], "right"))
                depth, rest = branch.depth + i + len(some), size - at
                best = max(branch.least, min(branch.most, depth + rest))
                if overlap + min(best - depth, rest) < rule.needed(best + size):
                    cut = True
                    break
            if cut:
                continue
            depth = branch.depth + len(branch.values)
            if branch.ends and rule.den * overlap >= rule.num * (depth + size - overlap):
                yield from branch.ends
            stack.extend((child, overlap, at) for child in branch.children.values())


def block_links(nodes: list[bytes], labels: list[bytes | None], sets: list[bytes], rule: Rule) -> list[tuple[bytes, bytes]]:
    """Links that connect what the block's sets connect; sets with equal labels count as connected before."""
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_label: dict[bytes, int] = {}
    for k, label in enumerate(labels):
        if label is not None:
            parent[find(k)] = find(by_label.setdefault(label, k))
    tree, links = PrefixTree(rule, find), []
    for k, raw in enumerate(sets):
        values = unpacked(raw)
        for other in tree.linked(values, k):
            if find(other) != find(k):
                parent[find(k)] = find(other)
                links.append((nodes[other], nodes[k]))
        tree.add(values, k)
    return links


def tree_join(blocks: DataFrame, rule: Rule, *keys: str) -> DataFrame:
    """Links (a, b) within each block; blocks has the key columns, node, label and values (the set)."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        first: dict[bytes, int] = {}
        for k, node in enumerate(table.column("node").to_pylist()):
            first.setdefault(node, k)
        table = table.take(pa.array(sorted(first.values())))
        links = block_links(*(table.column(c).to_pylist() for c in ("node", "label", "values")), rule)
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return blocks.groupBy(*keys).applyInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b); label is the component's smallest node. Large and small stars in turn."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    rows = edges.count()
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        changed = small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = stored(few(changed.where("u != v").distinct(), rows), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark, rows = now, now[0]
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def with_field(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with a bit for each id; of fixed size, so it may be sent to all."""
    bit = f"pmod(xxhash64({column}), {FILTER_BITS})"
    words = ids.selectExpr(f"cast({bit} div 64 as int) as word", f"shiftleft(1L, cast({bit} % 64 as int)) as bits")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return out


def bit_of(column: Column) -> Column:
    """The bit of an id in such a bitmap."""
    return F.pmod(F.xxhash64(column.cast("long")), F.lit(FILTER_BITS))


def maybe_in(bits: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """True for the bits of all ids of the filter (and of few others)."""
    bits = np.asarray(bits)
    return ((bitmap[bits // 64] >> (bits % 64)) & 1).astype(bool)


def wanted_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, n, values) of the given nodes, computed again from one document each."""
    one = classes.where("n > 0").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    id_, text = pick(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(one, "doc_id"))

    # one function filters and makes sets: two in a row would take two Python processes a task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("words", Memo)
        for part in slices(batches):
            part = part.filter(pa.array(maybe_in(part.column(1), sent.value)))
            sets = [word_set(t, memo, rule.words) for t in blobs(part.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([packed(s) for s in sets], pa.binary())],
                names=["node", "n", "values"],
            )

    sets = docs.select(text.cast("string").alias("text"), bit_of(id_).alias("bit")).mapInArrow(run, "node binary, n long, values binary")
    one_each = Window.partitionBy("node").orderBy("n")
    return sets.join(nodes, "node", "left_semi").withColumn("nth", F.row_number().over(one_each)).where("nth = 1").drop("nth")


def _blocks(sets, elements, most_sets: int, most_elements: int):
    return (F.ceil(sets / most_sets) + F.floor(elements / most_elements)).cast("int")


def crossed(split: DataFrame, most_sets: int, most_elements: int) -> DataFrame:
    """Rows of a star's sets (hub, node, n, label, apart) dealt into blocks a x b so that every set apart meets every
    set of the star in some block, as one that asks."""
    measures = split.groupBy("hub").agg(
        _blocks(F.count("*"), F.sum("n"), most_sets, most_elements).alias("blocks"),
        _blocks(F.count(F.when(F.col("apart"), 1)), F.coalesce(F.sum(F.when(F.col("apart"), F.col("n"))), F.lit(0)), most_sets, most_elements).alias("others"),
    )
    split = split.join(measures.where("others > 0"), "hub")
    split = split.withColumn("a", F.pmod(F.xxhash64("node"), "others").cast("int")).withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("block")
    stored_rows = split.select("hub", "node", "label", "apart", "a", "b", every).select("hub", "node", "label", F.col("block").alias("a"), "b", (F.col("apart") & (F.col("a") == F.col("block"))).alias("asks"))
    asked = split.where("apart").select("hub", "node", "label", "a", F.col("b").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    return stored_rows.unionByName(asked.where("b != own").select("hub", "node", "label", "a", "b", F.lit(True).alias("asks")))


def partners(rows: DataFrame, marks: DataFrame, rule: Rule, *keys: str) -> DataFrame:
    """The rows (with hub, node, label, asks) of blocks, named by keys, whose set may link with another of its block, judged by
    parities: a small part of a set's bytes moves."""
    rows = rows.join(marks.select("node", "n", "bits"), "node")

    def run(table: pa.Table) -> pa.Table:
        give_back()
        names: dict[bytes, int] = {}
        labels = np.fromiter((names.setdefault(x, len(names)) for x in table.column("label").to_pylist()), np.int64, table.num_rows)
        found = possible_partners(np.asarray(table.column("n")), table.column("bits").to_pylist(), labels, np.asarray(table.column("asks")), rule)
        return table.select([*keys, "node"]).filter(pa.array(found))

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(run, f"{kinds}, node binary")


def set_links(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame | None:
    """(node, label) of the sets that link with another one, or None if there are no candidates."""
    edges = stored(candidate_edges(docs, classes, rule), "candidates")
    if not (met := edges.count()):
        return None
    nodes = edges.select("node").unionByName(edges.select(F.col("hub").alias("node"))).distinct()
    one_each = classes.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    marks = bucketed(one_each.join(nodes, "node", "left_semi"), "marks", "node")
    sizes = marks.select("node", "n")
    # a star holds its hub too
    members = edges.unionByName(edges.select("hub", F.col("hub").alias("node")).distinct()).join(sizes, "node")
    counts = members.groupBy("hub").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    stars = stored(few(counts.select("hub", "sets", _blocks(F.col("sets"), F.col("elements"), BLOCK_SETS, BLOCK_ELEMENTS).alias("blocks")), met), "stars")
    members = stored(few(members.join(stars, "hub"), met), "members")

    # first each set meets its largest star only, in one block of it, with the hub
    home = members.groupBy("node").agg(F.max_by(F.struct("hub", "blocks"), F.struct("sets", "hub")).alias("home")).select("node", "home.*")
    placed = home.select("hub", "node", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    hubs = placed.select("hub", F.col("hub").alias("node"), "block").distinct()
    filled = placed.unionByName(hubs).distinct().select("*", F.col("node").alias("label"), F.lit(True).alias("asks"))
    filled = stored(partners(filled, marks, rule, "hub", "block"), "filled")
    sets = bucketed(wanted_sets(docs, classes, filled.select("node").distinct(), rule), "sets", "node").select("node", "values")
    links = stored(tree_join(filled.join(sets, "node").withColumn("label", F.lit(None).cast("binary")), rule, "hub", "block"), "links")
    labels = stored(few(components(links), met), "labels")

    # then stars whose sets aren't all connected: what isn't with the hub meets all blocks of the star
    split = members.join(labels, "node", "left").select("hub", "node", "n", F.coalesce("label", "node").alias("label"))
    main = split.where("hub = node").select("hub", F.col("label").alias("main"))
    split = split.join(main, "hub").select("hub", "node", "n", "label", (F.col("label") != F.col("main")).alias("apart"))
    split = stored(few(split, met), "split")
    possible = partners(crossed(split, PARITY_SETS, PARITY_ELEMENTS), marks, rule, "hub", "a", "b").select("hub", "node").distinct()
    split = stored(few(split.join(possible, ["hub", "node"], "left_semi"), met), "partnered")
    if split.where("apart").isEmpty():
        return labels
    more = wanted_sets(docs, classes, split.select("node").distinct(), rule).select("node", "values")
    blocks = crossed(split, BLOCK_SETS, BLOCK_ELEMENTS).drop("asks").join(more, "node")
    return stored(few(components(links.unionByName(tree_join(blocks, rule, "hub", "a", "b"))), met), "labels")


def labelled(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: doc_id, n, node, label (equal for documents of one component)."""
    classes = stored(document_sets(docs, rule), "classes")
    labels = set_links(docs, classes, rule)
    if labels is None:
        return classes.withColumn("label", F.col("node"))
    rows = classes.join(labels, "node", "left").select("doc_id", "n", "node", F.coalesce("label", "node").alias("label"))
    return stored(few(rows, classes.count()), "labelled")


def joined(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    rows = labelled(docs, rule)
    some = rows.where("n > 0")
    groups = some.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = some.join(groups, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of docs without all but the first (by doc_id) of each component; columns stay.

    Only rows that may go, by a filter of their doc_id, are shuffled; the others pass as they are.
    """
    rows = labelled(docs, rule).where("n > 0")
    groups = rows.groupBy("label").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")).where("rows > 1")
    several = stored(few(rows.join(groups, "label").select("doc_id", "node", "label", "first"), rows.count()), "several")
    stays = F.col("doc_id").eqNullSafe(F.col("first"))
    again = several.where(stays).groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    bitmap = id_filter(several.where(~stays).select("doc_id").unionByName(again.select("doc_id")), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    decisions = several.select("node", "label", "first").distinct()
    node, bit, at, names = fresh(docs, "node"), fresh(docs, "bit"), docs.columns.index("text"), docs.columns
    id_ = pick(docs, "doc_id")[0]
    flagged = docs.withColumn(bit, bit_of(id_))

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names).filter(pa.array(~maybe_in(part.column(len(names)), sent.value)))

    def add_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("words", Memo)
        for part in slices(batches):
            part = part.filter(pa.array(maybe_in(part.column(len(names)), sent.value)))
            nodes = [node_of(word_set(t, memo, rule.words)) for t in blobs(part.column(at))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(nodes, pa.binary())], names=[*names, node])

    sure = flagged.mapInArrow(pass_on, docs.schema)
    known = flagged.mapInArrow(add_node, with_field(docs, node, BinaryType()))
    label, first, nth = fresh(docs, "label"), fresh(docs, "first"), fresh(docs, "nth")
    known = known.join(decisions.toDF(node, label, first), node, "left")
    unlinked = known.where(F.col(label).isNull())
    heads = known.where(F.col(label).isNotNull() & id_.eqNullSafe(F.col(first)))
    heads = heads.withColumn(nth, F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("text")))).where(F.col(nth) == 1)
    columns = pick(docs, *docs.columns)
    return sure.select(*columns).unionByName(unlinked.select(*columns)).unionByName(heads.select(*columns))
