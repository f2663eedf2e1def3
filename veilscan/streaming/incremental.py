"""Incremental scan: new documents or files, each content once, results appended.

A streaming aggregation keeps, for each content hash ever met, the batch that met it first and where it lies.  Only keys
and hashes reach the state store, combined inside tasks before they are moved, and a batch touches the state of its own
contents only, however long the history.  (With very many contents, set Spark's RocksDB state store provider, which keeps
the state on disk.)

Contents that are new in a batch are read again from the batch's own files and analysed; every batch writes into its own
``batch_id`` folder of each output table with overwrite.  A batch that is retried after a lost executor or driver thus
replaces its own rows and nothing else, so each document counts once.
"""

from __future__ import annotations

import time
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan.functions.text import content_hash, upload_error
from veilscan.operators.detect import explode_findings
from veilscan.plans.analysis import analyze
from veilscan.settings import DEFAULT_OPTIONS, RULES, Options, Rule
from veilscan.sources.audit import audit_rows
from veilscan.sources.uploads import UPLOAD_SCHEMA, extract_uploads, read_uploads, rejected_uploads

#: The file that a streamed row is from.
SOURCE_FILE = "source_file"


def stream_documents(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", max_files: int = 1000
) -> DataFrame:
    """Stream of document rows, with their ``source_file``, from parquet files that keep arriving in a folder."""
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )
    return rows.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


def stream_uploads(spark: SparkSession, folder: str, max_files: int = 10000) -> DataFrame:
    """Stream of uploaded files."""
    return (
        spark.readStream.format("binaryFile")
        .schema(UPLOAD_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )


def _batch_path(out: str, table: str, batch_id: int) -> str:
    return f"{out}/{table}/batch_id={batch_id}"


def _write(df: DataFrame, out: str, table: str, batch_id: int) -> DataFrame:
    path = _batch_path(out, table, batch_id)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_met(rows: DataFrame, content: Column, place: Column) -> DataFrame:
    """``(content_hash, first, last)`` per content of a stream: the batch time and the smallest ``place`` (a struct) of
    the batch that met it first, and the time of the batch that met it last.

    All rows of a micro-batch have the same time, which a retry keeps.
    """
    timed = rows.select(content.alias("content_hash"), F.struct(F.current_timestamp().alias("met"), place.alias("place")).alias("_at"))
    return timed.groupBy("content_hash").agg(F.min("_at").alias("first"), F.max("_at.met").alias("last"))


def _fresh(batch: DataFrame, out: str, batch_id: int) -> DataFrame:
    """Of the contents that a batch has met, those that no earlier batch has, as ``(content_hash, place columns)``."""
    fresh = batch.where(F.col("first.met") == F.col("last")).select("content_hash", "first.place.*")
    return _write(fresh, out, "seen", batch_id)


def _files(fresh: DataFrame, column: str) -> list[str]:
    """The files of a batch that hold new contents; a batch has at most ``maxFilesPerTrigger`` of them."""
    return [r[0] for r in fresh.select(column).distinct().collect()]


def scan_batch(
    docs: DataFrame, key: str, out: str, batch_id: int, rules: tuple[Rule, ...], options: Options
) -> None:
    """Analyse the documents of one batch and write results, findings and audit rows."""
    started = time.perf_counter()
    results = _write(analyze(docs, rules, options).drop("text"), out, "results", batch_id)
    n = max(1, results.count())
    per_document = (time.perf_counter() - started) / n
    _write(explode_findings(results, key), out, "findings", batch_id)
    _write(audit_rows(results, processing_time=F.lit(per_document)), out, "audit", batch_id)


def _start(met: DataFrame, out: str, work) -> StreamingQuery:
    return (
        met.writeStream
        .outputMode("update")
        .option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(work)
        .start()
    )


def scan_documents(
    stream: DataFrame, out: str, key: str = "doc_id",
    rules: tuple[Rule, ...] = RULES, options: Options = DEFAULT_OPTIONS,
) -> StreamingQuery:
    """Scan rows with ``key`` and ``text`` (and optionally ``filename``) from ``stream_documents``."""
    place = F.struct(F.col(key).alias("key"), F.col(SOURCE_FILE).alias("file"))
    columns = [f for f in stream.schema.fields if f.name != SOURCE_FILE]

    def work(batch: DataFrame, batch_id: int) -> None:
        fresh = _fresh(batch, out, batch_id)
        files = [unquote(f) for f in _files(fresh, "file")]
        spark, schema = batch.sparkSession, type(stream.schema)(columns)
        if not files:
            nothing = spark.createDataFrame([], schema)
            return scan_batch(nothing.withColumn("filename", F.col(key).cast("string")), key, out, batch_id, rules, options)
        rows = spark.read.schema(schema).parquet(*files)
        places = fresh.select(F.col("key").alias(key), F.col("file").alias(SOURCE_FILE), F.col("content_hash"))
        named = rows.withColumn(SOURCE_FILE, F.col("_metadata.file_path")).withColumn("content_hash", content_hash(F.col("text")))
        docs = named.join(places, [key, SOURCE_FILE, "content_hash"], "left_semi").drop(SOURCE_FILE, "content_hash")
        if "filename" not in docs.columns:
            docs = docs.withColumn("filename", F.col(key).cast("string"))
        scan_batch(docs, key, out, batch_id, rules, options)

    return _start(first_met(stream, content_hash(F.col("text")), place), out, work)


def scan_uploads(
    stream: DataFrame, out: str, rules: tuple[Rule, ...] = RULES, options: Options = DEFAULT_OPTIONS
) -> StreamingQuery:
    """Scan a stream of files; rejected files go to their own table, without audit row.

    The contents of rejected files are not read, those of copies once, for their hash.
    """
    error = upload_error(F.col("path"), F.col("length"), options)
    good = stream.where(error.isNull()).select(content_hash(F.col("content")).alias("hash"), "path", "length")
    bad = stream.where(error.isNotNull()).select(F.concat(F.lit("path "), F.col("path")).alias("hash"), "path", "length")

    def work(batch: DataFrame, batch_id: int) -> None:
        fresh = _fresh(batch, out, batch_id)
        _write(rejected_uploads(fresh, options), out, "rejected", batch_id)
        files = _files(fresh.where(upload_error(F.col("path"), F.col("length"), options).isNull()), "path")
        spark = batch.sparkSession
        uploads = read_uploads(spark, *files) if files else spark.createDataFrame([], UPLOAD_SCHEMA)
        scan_batch(extract_uploads(uploads, options), "path", out, batch_id, rules, options)

    place = F.struct("path", "length")
    return _start(first_met(good.unionByName(bad), F.col("hash"), place), out, work)


def read_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    """One output table of a scan, over all batches."""
    return spark.read.parquet(f"{out}/{table}").drop("batch_id")
