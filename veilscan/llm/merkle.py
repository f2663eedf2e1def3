"""Merkle manifest of documents with incremental witnesses.

A leaf is the digest of a document's fields. Leaves of a source, in ascending order of doc_id, are appended to
runs of `ARITY`; a full run (the last one may be short) becomes one node of the next level, and so on to the
source's subroot. Subroots, in order of their sources, are appended in the same way and give the root.

An open subtree keeps, with each finished node that waits for siblings, the leaves below it. When the run closes,
the witness of each of these leaves grows by the digests of the other nodes of the run. Leaves are appended in
blocks of ARITY ** POWER, aligned to the source's first leaf, each in one task; a block's root is then one more
append, in blocks again, and its witness is that of all leaves of the block from there on. A source of any size is
so spread over tasks, and nothing but one node for each block moves on to the next round.

A leaf's place in its runs follows from its rank and the number of leaves, so a witness is digests only, and anyone
who has it can fold a leaf up to the root.

Defined results: null fields are a mark of their own, so null and empty texts differ; documents without a source are
a source that comes first; rows with equal doc_id follow each other by digest, rows without doc_id come first and are
not tampered with; repeated rows are leaves of their own; an empty table gives no rows. Columns other than the five
fields are not looked at. Texts of any length are digested whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import pick, ranked, stored

#: Nodes of a run, and levels that one task appends: blocks of 3 ** 8 = 6561 nodes.
ARITY, POWER = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
SEQUENCE = "source string, rank long, size long, node binary, witness binary, root binary"


def digest(nodes: list[bytes]) -> bytes:
    """The parent of nodes: their digests go in as hex text, one after the other."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


class Append:
    """Appends nodes one by one and extends the witnesses of those below each run that closes."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        #: For each level the finished nodes of its open run, each with the numbers of the leaves below it.
        self.open: list[list[tuple[bytes, range]]] = [[]]
        self.witnesses: list[bytearray] = []

    def append(self, node: bytes) -> None:
        self.witnesses.append(bytearray())
        self._put(0, node, range(len(self.witnesses) - 1, len(self.witnesses)))

    def _put(self, level: int, node: bytes, below: range) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for i, (_, below) in enumerate(run):
            others = b"".join(n for k, (n, _) in enumerate(run) if k != i)
            if others:
                for leaf in below:
                    self.witnesses[leaf] += others
        self._put(level + 1, digest([n for n, _ in run]), range(run[0][1].start, run[-1][1].stop))

    def finish(self, levels: int) -> bytes:
        """Closes what is open up to a level, short runs included, and returns the one node there."""
        for level in range(levels):
            if self.open[level]:
                self._close(level)
        ((root, _),) = self.open[levels]
        return root


def levels_of(size: int, arity: int = ARITY) -> int:
    """Levels above `size` nodes until one remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


def folded(node: bytes, rank: int, size: int, witness: bytes, at: int = 0, arity: int = ARITY) -> tuple[bytes, int]:
    """The top node that a node of that rank among `size` gives with its witness from place `at`, and the place after."""
    while size > 1:
        first = rank // arity * arity
        n = min(arity, size - first)
        others = [witness[at + k * DIGEST : at + (k + 1) * DIGEST] for k in range(n - 1)]
        at += (n - 1) * DIGEST
        others.insert(rank - first, node)
        node, rank, size = digest(others), rank // arity, -(-size // arity)
    return node, at


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column, others: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in others), field(text)), 256))


def leaves(docs: DataFrame, tampered: Column | None = None, text_of: Column | None = None) -> DataFrame:
    """doc_id, source, node, forged: each document's digest, and where `tampered` holds, that of another text."""
    chosen = docs.select(*pick(docs, *FIELDS))
    *others, text = [F.col(f"`{c}`") for c in FIELDS]
    forged = F.when(tampered, leaf(text_of, others)) if tampered is not None else F.lit(None).cast("binary")
    return chosen.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(text, others).alias("node"), forged.alias("forged")
    )


def appended(nodes: DataFrame, name: str, power: int = POWER, *extra: str) -> DataFrame:
    """Rows of nodes (source, rank, size, node) with their witness inside the block of ARITY ** power that they are in.

    The last node of a block also has the block's `root`; size and rank of the roots follow from those of the nodes.
    """
    block = ARITY**power
    kept = [nodes.schema[c] for c in extra]
    schema = f"{SEQUENCE}{''.join(f', {f.name} {f.dataType.simpleString()}' for f in kept)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        tree, upto = Append(), 0

        def close() -> pa.RecordBatch:
            # a sequence of several blocks has all of them as nodes of one level, a short last one too
            size = held[0]["size"]
            held[-1]["root"] = tree.finish(power if size > block else levels_of(size))
            for row, witness in zip(held, tree.witnesses):
                row["witness"] = bytes(witness)
            return pa.RecordBatch.from_pylist(held, kinds)

        kinds = pa.schema(
            [("source", pa.string()), ("rank", pa.int64()), ("size", pa.int64()), ("node", pa.binary()), ("witness", pa.binary()), ("root", pa.binary())]
            + [(f.name, pa.binary() if f.dataType.typeName() == "binary" else pa.int64()) for f in kept]
        )
        for batch in batches:
            for row in batch.to_pylist():
                if not held:
                    upto = min(row["size"], (row["rank"] // block + 1) * block)
                row["root"] = None
                held.append(row)
                tree.append(row["node"])
                if row["rank"] + 1 == upto:
                    yield close()
                    held, tree = [], Append()

    place = F.expr(f"rank div {block}")
    dealt = nodes.select("source", "rank", "size", "node", *extra).repartition(F.col("source"), place).sortWithinPartitions("source", "rank")
    return stored(dealt.mapInArrow(run, schema), name)


def climbed(nodes: DataFrame, name: str, power: int = POWER) -> tuple[list[DataFrame], DataFrame]:
    """Appends nodes in as many rounds as the largest source takes: the rounds' rows, and (source, root) of each source."""
    rounds = []
    while True:
        rounds.append(appended(nodes, f"{name}-{len(rounds)}", power))
        block = ARITY**power
        nodes = rounds[-1].where("root is not null").selectExpr("source", f"rank div {block} as rank", f"(size + {block - 1}) div {block} as size", "root as node")
        if not nodes.agg(F.max("size") > 1).first()[0]:
            return rounds, nodes.selectExpr("source", "node as root")


def witnesses(leaf_rows: DataFrame, power: int = POWER) -> DataFrame:
    """Each leaf with its whole witness: the columns of leaves(), rank and size in its source, place and sources (rank of the
    source and number of sources), witness, subroot, root."""
    block = ARITY**power
    within = appended(ranked(leaf_rows, ["source"], ["doc_id", "node"], "leaves"), "witnesses", power, "doc_id", "forged")
    roots = within.where("root is not null").selectExpr("source", f"rank div {block} as rank", f"(size + {block - 1}) div {block} as size", "root as node")
    rounds, subroots = climbed(roots, "blocks", power)
    # subroots are one more sequence; its "source" is none
    order = ranked(subroots.selectExpr("source as name", "root as node"), [], ["name"], "sources")
    order = stored(order, "order")
    above, tops = climbed(order.selectExpr("cast(null as string) as source", "rank", "size", "node"), "top", power)
    # from the top down, so that only rows of blocks are joined, never leaves with a source's one row
    upper = order.select("name", F.col("node").alias("subroot"), F.col("rank").alias("place"), F.col("size").alias("sources"), F.col("rank").alias("k"))
    upper = upper.withColumn("upper", F.lit(b"").cast("binary"))
    for rows in above:
        step = rows.selectExpr("rank as k", "witness as w")
        upper = upper.join(step, "k").withColumn("upper", F.concat("upper", "w")).withColumn("k", F.expr(f"k div {block}")).drop("w")
    root = tops.first()
    upper = upper.drop("k").withColumn("root", F.lit(bytes(root["root"]) if root else None).cast("binary"))
    down = rounds[-1].selectExpr("source", "rank", "witness")
    down = _with(down, upper, "name").selectExpr("source", "rank", "concat(witness, upper) as upper", "subroot", "place", "sources", "root")
    for rows in reversed(rounds[:-1]):
        lower = rows.selectExpr("source", "rank", "witness", f"rank div {block} as over")
        down = _with(lower, down.withColumnsRenamed({"source": "name", "rank": "k"}), "name", ("over", "k"))
        down = down.selectExpr("source", "rank", "concat(witness, upper) as upper", "subroot", "place", "sources", "root")
    down = stored(down, "upper")
    full = within.drop("root").withColumn("over", F.expr(f"rank div {block}"))
    full = _with(full, down.withColumnsRenamed({"source": "name", "rank": "k"}), "name", ("over", "k"))
    return full.selectExpr("doc_id", "source", "node", "forged", "rank", "size", "place", "sources", "concat(witness, upper) as witness", "subroot", "root")


def _with(rows: DataFrame, other: DataFrame, name: str, *pairs: tuple[str, str]) -> DataFrame:
    """Join on the source, null being a source, and on further columns."""
    on = F.col("source").eqNullSafe(F.col(name))
    for a, b in pairs:
        on &= F.col(a) == F.col(b)
    return rows.join(other, on)


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def checked(rows: DataFrame) -> DataFrame:
    """Per leaf: the digests as hex text, the digest of its witness, the root that it (or its forged form) folds to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                node, at = folded(r["forged"] or r["node"], r["rank"], r["size"], r["witness"])
                node, at = folded(node, r["place"], r["sources"], r["witness"], at)
                out.append({
                    "doc_id": r["doc_id"], "leaf": r["node"].hex(), "subroot": r["subroot"].hex(), "root": r["root"].hex(),
                    "proof_sha256": sha256(r["witness"].hex().encode()).hexdigest(), "folded_root": node.hex(), "verified": node == r["root"] and at == len(r["witness"]),
                })
            yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    return rows.mapInArrow(run, MANIFEST)


def manifest(docs: DataFrame, power: int = POWER) -> DataFrame:
    """One row per document: its leaf, subroot, root and proof, and whether the proof holds after tampering with every
    document whose id has an even CRC-32: its line ends are deleted."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return checked(witnesses(leaves(docs, even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))), power))
