"""Documents assembled from page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import strip

SEPARATOR = "\n\n"


def assemble_pages(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """``(key, text, pages)``: stripped, non-blank pages joined in page order.

    The texts are moved once: pages are dealt out by document and sorted by page number inside the tasks (on disk where
    they don't fit), so that the aggregation meets a document's pages in order and in one place.  A document
    without a readable page keeps its row, with ''.  The result is one string, so a document must fit into one.
    """
    cleaned = pages.select(key, F.col(page).alias("_page"), F.coalesce(strip(text), F.lit("")).alias("_text"))
    ordered = cleaned.repartition(key).sortWithinPartitions(key, "_page", "_text")
    readable = F.when(F.col("_text") != "", F.struct("_page", "_text"))
    # collect_list keeps the order of its rows; sorting the short structs again costs nothing and doesn't rely on it
    found = ordered.groupBy(key).agg(F.array_sort(F.collect_list(readable)).alias("_in"))
    return found.select(
        key,
        F.array_join(F.transform("_in", lambda p: p["_text"]), SEPARATOR).alias("text"),
        F.size("_in").alias("pages"),
    )
