"""Token ids as flat unsigned files with 64-bit document offsets, read back by memory mapping.

A token table is a folder with, per part, three flat little-endian files: `.ids` (unsigned token ids of 16
bits if the vocabulary has at most 65,536 entries, else of 32, documents one after the other), `.offsets` (unsigned 64-bit, one per document and one for the end,
counted from the part's start) and `.docs` (signed 64-bit document ids), and a Parquet manifest with one
row per part. Parts hold ascending ranges of doc_id; the ids before a part are a prefix sum over the
manifest.

Defined results: a null text is empty and still gets the end id; rows with equal doc_id follow each other
by text; rows with a null doc_id come first (their id in the file is the least 64-bit number) and are read
back as null; an empty table gives no parts. Columns other than the two named are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import pick, shared_dir, slices, strings
from veilscan.llm.tokens import encoder_for

NULL_ID = -(2**63)
MANIFEST = "part string, first_id long, n_docs long, n_tokens long, width int, place int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Documents whose ids are looked at in one step while reading.
READ_DOCS = 1024


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Writes the folder `path` (shared by all executors) and returns its manifest.

    The texts are shuffled once, by ranges of the id, so each task writes one part. A part's name is new
    in every attempt; only parts of attempts that Spark accepted are in the manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(tokenizer), np.array([end_id], "<u4").tobytes()
        files = None
        docs_seen = tokens = 0
        first = place = None
        for batch in slices(batches):
            if batch.num_rows == 0:
                continue
            if files is None:
                store, folder = fs.FileSystem.from_uri(path)
                name = f"part-{uuid.uuid4().hex}"
                store.create_dir(folder, recursive=True)
                files = {k: store.open_output_stream(f"{folder}/{name}.{k}") for k in ("ids", "offsets", "docs")}
                files["offsets"].write(np.zeros(1, "<u8").tobytes())
                first, place = batch.column(0)[0].as_py(), batch.column(2)[0].as_py()
            encoded = [ids + end for ids in encoder.encode(strings(batch.column(1)))]
            lengths = np.fromiter(map(len, encoded), np.uint64, len(encoded)) // 4
            files["ids"].write(np.frombuffer(b"".join(encoded), "<u4").astype(f"<u{encoder.width}").tobytes())
            files["offsets"].write((np.uint64(tokens) + np.cumsum(lengths)).astype("<u8").tobytes())
            ids = [NULL_ID if i is None else i for i in batch.column(0).to_pylist()]
            files["docs"].write(np.array(ids, "<i8").tobytes())
            docs_seen, tokens = docs_seen + batch.num_rows, tokens + int(lengths.sum())
        if files is not None:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [name], "first_id": pa.array([first], pa.int64()), "n_docs": [docs_seen], "n_tokens": [tokens], "width": pa.array([encoder.width], pa.int32()), "place": pa.array([place], pa.int32())}
            )

    id_, text = pick(docs, id_column, text_column)
    ordered = (
        docs.select(id_.cast("long").alias("id"), text.cast("string").alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .withColumn("place", F.spark_partition_id())
    )
    manifest = f"{path.rstrip('/')}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the folder: doc_id, start, n_tokens, ids_crc32; ids are mapped, not loaded."""
    # one short row per part: as many as the writing job had tasks
    parts = sorted(spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest").collect(), key=lambda r: r["place"])
    bases = [0, *accumulate(p["n_tokens"] for p in parts)]
    rows = [(p["part"], base, p["n_docs"], p["width"]) for p, base in zip(parts, bases)]
    located = spark.createDataFrame(rows, "part string, base long, n_docs long, width int")

    def mapped(store: fs.FileSystem, file: str, kind: str) -> np.ndarray:
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(file, kind, "r")
        with store.open_input_file(file) as f:
            return np.frombuffer(f.read(), kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for part, base, n, width in zip(*(c.to_pylist() for c in batch.columns)):
                file = f"{folder}/{part}"
                ids, offsets, docs = mapped(store, f"{file}.ids", f"<u{width}"), mapped(store, f"{file}.offsets", "<u8"), mapped(store, f"{file}.docs", "<i8")
                for i in range(0, n, READ_DOCS):
                    cuts = offsets[i : min(n, i + READ_DOCS) + 1].astype(np.int64)
                    some = np.asarray(docs[i : i + READ_DOCS])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=some == NULL_ID), pa.array(cuts[:-1] + base), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return located.repartition(max(1, min(len(rows), 10_000)), "part").mapInArrow(read, ROWS)


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the documents' ids below spark.checkpoint.dir and reads them back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
