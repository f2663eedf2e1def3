"""Small helpers that several operators share: tables in the shared folder, texts from Arrow, word ids."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries that a worker's memo of words may hold before it is emptied, and the longest key in bytes (characters
#: for texts) that it keeps: together a bound in bytes, about 30 MB. Longer words are worked out each time.
MEMO_WORDS, MEMO_KEY = 150_000, 64

#: Documents handled at once inside a task.
SLICE = 256


#: Bytes of an Arrow batch that a Python task gets at once; by default only rows are counted, and texts can be long.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, below the session's warehouse.

    Both are folders that all executors of a cluster share.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: later steps don't compute them again,
    and a lost executor costs only a read."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    # Spark removes shuffle files when the driver's JVM finds their plan gone, which may take it half an hour;
    # what the write has shuffled is not needed any more
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small table's file, and files of it at least.
FILE_ROWS, LEAST_FILES = 100_000, 8


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as about so many short rows need. Where a table is written, each file costs a request or,
    on local disks without Hadoop's native library, a process that the executor starts. Only for steps that end in
    light work behind a shuffle: they run in no more tasks than this."""
    return df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """Like stored(), in buckets of a column: later joins on that column don't move these rows."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, by).option("path", path).saveAsTable(table)
    spark.sparkContext._jvm.System.gc()
    opened = spark.table(table)
    # the files stay, and with them what has been read from the catalog
    spark.sql(f"drop table {table}")
    return opened


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with two more columns: rank (from 0, by `order` within equal values of `groups`) and size (rows of the group).

    Rows are dealt by ranges of groups and order together, so a group of any size is spread over tasks. A row's rank is
    its place in its task's part of the group plus the rows of the group in earlier tasks. Both come from a table of one
    row for each task and group. Nulls are a group like others and come first in the order.
    """
    keys = [*groups, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # an id that Spark numbers a task's rows with: the task in the upper bits, the row's place in the lower 33
    placed = stored(dealt.withColumn("nth_", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("nth_", 33).alias("part_"), F.expr("nth_ & 8589934591")
    counts = placed.groupBy(part, *groups).agg(F.count("*").alias("n_"), F.min(place).alias("first_"))
    counts = stored(counts, f"{name}-counts")
    before = Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("part_").alias("part__"), *(F.col(g).alias(f"{g}__") for g in groups),
        (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("base_"),
        F.sum("n_").over(Window.partitionBy(*groups)).alias("size"),
    )
    same = F.shiftright("nth_", 33) == F.col("part__")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"{g}__"))
    return placed.join(bases, same).select(*df.columns, (F.col("base_") + place).alias("rank"), "size")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names differ in more than letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pick(df: DataFrame, *names: str) -> list[Column]:
    """The named columns, quoted, so that odd names can't be taken for paths."""
    return [F.col(f"`{n}`") for n in names]


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Values of a string column; null is empty."""
    return [t or "" for t in column.to_pylist()]


@lru_cache(maxsize=1)
def give_back() -> None:
    """Makes the process return large arrays to the system as soon as they are freed: workers live long, and several
    of them share an executor's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it; -3 stands for the size from which on
        ctypes.CDLL(None).mallopt(-3, LARGE)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


#: Bytes from which on an array is large.
LARGE = 1 << 22

_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """The worker process's one object of that name. Another operator's object goes, and its memory back to the
    system, when a task of this one comes to the same process: long-lived workers hold one operator's tables only."""
    if name not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)
        _kept[name] = make()
    return _kept[name]


class Memo(dict):
    """Word to number, computed once per worker: a 64-bit hash of the word's bytes."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_KEY:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves about half of the bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Lower-cases A-Z and turns each ASCII character that is no letter or digit into a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return text.translate(WORD_TABLE).split()
