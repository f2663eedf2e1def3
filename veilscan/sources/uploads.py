"""Files as a source: validation, text extraction, rejected files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.csv import with_csv_text
from veilscan.functions.text import (
    content_hash,
    decode_text,
    file_extension,
    file_name,
    upload_error,
)
from veilscan.settings import DEFAULT_OPTIONS, Options
from veilscan.sources.pages import assemble_pages

UPLOAD_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PDF_MESSAGE = "The PDF has no page table; supply its pages as text rows."


def read_uploads(spark: SparkSession, *folders: str) -> DataFrame:
    """Files, or those below folders, one row each: path, modificationTime, length, content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(folders))
    )


def rejected_uploads(uploads: DataFrame, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """``(path, filename, length, error)`` of files that fail validation.

    File contents are not read: only path and length are selected.
    """
    error = upload_error(F.col("path"), F.col("length"), options)
    return uploads.select("path", file_name(F.col("path")).alias("filename"), "length", error.alias("error")).where(
        F.col("error").isNotNull()
    )


def extract_uploads(
    uploads: DataFrame, options: Options = DEFAULT_OPTIONS, pages: DataFrame | None = None
) -> DataFrame:
    """``(path, filename, content_hash, text, error)`` of the valid files, one row each, read once.

    Each format has its branch, all of column expressions: TXT files are decoded, CSV files brought to a normal form
    (see ``functions.csv``).  The text of a PDF file is that of its rows in ``pages(path, page_no, text)``, assembled in page
    order; one without rows there carries an error.  Only keys and assembled texts of PDF files are joined, the
    other formats pass without a shuffle.
    """
    if pages is not None:
        is_pdf = file_extension(F.col("path")) == ".pdf"
        texts = assemble_pages(pages, "path").select("path", F.col("text").alias("_assembled"))
        joined = extract_uploads(uploads.where(is_pdf), options).drop("text", "error").join(texts, "path", "left")
        error = F.when(F.col("_assembled").isNull(), F.lit(PDF_MESSAGE)).alias("error")
        paged = joined.select("path", "filename", "content_hash", F.col("_assembled").alias("text"), error)
        return extract_uploads(uploads.where(~is_pdf), options).unionByName(paged)
    extension, content = F.col("_ext"), F.col("content")
    valid = uploads.withColumn("_ext", file_extension(F.col("path"))).where(
        (F.col("length") <= options.max_upload_mb * 1024 * 1024) & extension.isin(*options.allowed_extensions)
    )
    parsed = with_csv_text(valid, F.when(extension == ".csv", content))
    return parsed.select(
        "path",
        file_name(F.col("path")).alias("filename"),
        content_hash(content).alias("content_hash"),
        F.when(extension == ".csv", F.col("csv_text"))
        .when(extension != ".pdf", decode_text(content))
        .alias("text"),
        F.when(extension == ".csv", F.col("csv_error"))
        .when(extension == ".pdf", F.lit(PDF_MESSAGE))
        .alias("error"),
    )
