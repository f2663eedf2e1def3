"""Best-fit packing of documents into sequences: a configuration linear program over the lengths.

The histogram of piece lengths (at most `capacity` rows) is all that leaves the cluster. A configuration
says how many pieces of each length share a sequence. The linear program (fewest configurations that
hold all pieces) is solved by multiplicative weights, in phases: the value of a length is its size, times a
weight that falls exponentially with the share of it that is held already; an unbounded-knapsack dynamic
program prices capacities under these values, and its table gives for every length the best full sequence with
it. A phase takes these sequences, dearest first, for a share of what is left of their lengths, in whole numbers:
the solution is rounded as it grows, so that the next phase sees what rounding left over. When no full sequence
can be put together any more, the few pieces that remain are packed best fit, longest first.

Pieces get their sequence by rank among those of their length. A rank is a task's base (prefix sums over
counts by task and length) plus a running number, so no task sees all pieces of a length.

Defined results: a null text is empty and still gets its end id, so each document has a piece; rows with
equal or null doc_id are packed like others; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import pick, slices, stored, strings
from veilscan.llm.tokens import encoder_for

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Share of what is left of its lengths that a phase gives to a configuration, and phases at most.
STEP, PHASES = 0.5, 400
#: Natural logarithm by which a length's weight falls when all of it is held.
RATE = 4.0


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every document's ids and end id, cut after each `capacity` ids; keep_ids adds them as binary `ids`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(tokenizer), np.array([end_id], "<u4").tobytes()
        block, seen = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(strings(batch.column(1)))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    for column, value in zip(out, (doc, k, at // 4, n, zlib.crc32(piece), block, seen[n], piece)):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: 7 + keep_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth", "ids"][: 7 + keep_ids])

    id_, text = pick(docs, id_column, text_column)
    chosen = docs.select(id_.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    return chosen.mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def priced(values: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For each capacity up to the given one the largest sum of values of lengths that fit, and a length of that
    solution (0: the same as for one less). Lengths of negative value take no part."""
    best, took = np.zeros(capacity + 1), [0] * (capacity + 1)
    for c in range(1, capacity + 1):
        sums = values[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(sums.argmax())
        if sums[k] > best[c - 1]:
            best[c], took[c] = sums[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, took


def full_sequence(length: int, took: list[int], capacity: int) -> Counter | None:
    """The priced solution for the room beside a length, if it fills the sequence."""
    config, room = Counter({length: 1}), capacity - length
    while room and took[room]:
        config[took[room]] += 1
        room -= took[room]
    return None if room else config


def configurations(left: Counter, capacity: int) -> list[tuple[int, Counter]]:
    """Full sequences, each so many times; takes their pieces out of `left`."""
    demand = np.array([left[l] for l in range(capacity + 1)], float)
    sizes, found = np.arange(capacity + 1), Counter()
    for _ in range(PHASES):
        rest = np.array([left[l] for l in range(capacity + 1)], float)
        held = np.divide(demand - rest, demand, out=np.zeros(capacity + 1), where=demand > 0)
        values = np.where(rest > 0, sizes * np.exp(-RATE * held), -1.0)
        best, took = priced(values, capacity)
        before = len(found), left.total()
        for length in (np.argsort(-(values[1:] + best[capacity - 1 :: -1]), kind="stable") + 1).tolist():
            config = full_sequence(length, took, capacity) if left[length] else None
            times = min(left[l] // n for l, n in config.items()) if config else 0
            if times:
                times = max(1, int(times * STEP))
                for l, n in config.items():
                    left[l] -= n * times
                found[tuple(sorted(config.items()))] += times
        if before == (len(found), left.total()):
            break
    return [(times, Counter(dict(config))) for config, times in found.items()]


def best_fit(rest: dict[int, int], gaps: Counter, capacity: int) -> list[tuple[int, int, list[int]]]:
    """Packs pieces longest first into the smallest gap that holds them: (gap, number, lengths) of the sequences.

    Works on counts: as many equal pieces as there are equal gaps go at once.
    """
    filled: Counter = Counter({(g, ()): n for g, n in gaps.items() if n})
    rooms: dict[int, Counter] = {}
    for (g, inside), n in filled.items():
        rooms.setdefault(g, Counter())[g, inside] += n
    order = sorted(rooms)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                new, room = left * length // capacity + 1, capacity
                if capacity not in rooms:
                    rooms[capacity] = Counter()
                    insort(order, capacity)
                rooms[capacity][capacity, ()] += max(1, min(left, new))
                continue
            room = order[at]
            kinds = rooms[room]
            kind = next(iter(kinds))
            n = min(left, kinds[kind])
            kinds[kind] -= n
            if not kinds[kind]:
                del kinds[kind]
            if not kinds:
                del rooms[room]
                order.pop(at)
            start, inside = kind
            less = room - length
            if less not in rooms:
                rooms[less] = Counter()
                insort(order, less)
            rooms[less][start, (*inside, length)] += n
            left -= n
    return [(start, n, list(inside)) for kinds in rooms.values() for (start, inside), n in kinds.items() if inside or start != capacity]


def packing_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequences' first number, pieces of the length in each, first offset, ranks).

    Rank r of a length, q = r - first rank, lies in sequence first + q // n at offset + (q % n) * length.
    """
    left = Counter({l: n for l, n in histogram.items() if n})
    chosen: list[tuple[int, Counter]] = []
    if full := left.pop(capacity, 0):
        chosen.append((full, Counter({capacity: 1})))
    chosen += configurations(left, capacity)
    gaps: Counter = Counter()
    by_gap: dict[int, list[tuple[int, Counter]]] = {}
    for times, config in chosen:
        gap = capacity - sum(l * n for l, n in config.items())
        gaps[gap] += times
        by_gap.setdefault(gap, []).append((times, config))
    final: list[tuple[int, Counter]] = []
    for gap, times, lengths in best_fit({l: n for l, n in left.items() if n}, gaps, capacity):
        stack = by_gap.get(gap, [])
        while times:
            if stack:
                have, config = stack.pop()
                n = min(have, times)
                if have > n:
                    stack.append((have - n, config))
            else:
                n, config = times, Counter()
            final.append((n, config + Counter(lengths)))
            times -= n
    rows, rank, sequence = [], Counter(), 0
    for times, config in final:
        offset = 0
        for l, n in sorted(config.items(), reverse=True):
            rows.append((l, rank[l], sequence, n, offset, times * n))
            rank[l] += times * n
            offset += l * n
        sequence += times
    assert all(rank[l] == n for l, n in histogram.items() if n), "pieces without a place"
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to the rows of token_pieces(); other columns of it stay."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    counts = stored(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # up to `capacity` rows
    plan = spark.sparkContext.broadcast(packing_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["block", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = [f.name for f in pieces.schema if f.name not in ("block", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        span = int(rows[:, 1].max()) + 1 if len(rows) else 1
        keys = rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            row = rows[np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1]
            q = rank - row[:, 1]
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            out += [pa.array(row[:, 2] + q // row[:, 3]), pa.array(row[:, 4] + q % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, PACKED if "ids" not in names else PACKED.replace("ids_crc32 long", "ids_crc32 long, ids binary"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, end_id, capacity, keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (rows of keep_ids=True): sequence_id, n_tokens, ids (binary).

    A sequence holds at most `capacity` ids, so a group is small by construction.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
