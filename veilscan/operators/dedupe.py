"""Skip documents whose content was already seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import content_hash


def copies(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """One row per distinct content: hash, smallest key, number of copies.

    Only key and hash reach the aggregation, and it is combined before the shuffle, so
    one content that fills a third of the corpus costs one row per task.
    """
    return (
        docs.select(key, content_hash(F.col(content)).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    )


def first_keys(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Keys of the documents that are the first of their content; no text is moved.

    Join what is needed of the documents (lengths, paths) to these; ``first_copies`` gives
    whole rows.
    """
    return copies(docs, key, content).select(key)


def later_keys(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Keys of the documents whose content a document with a smaller key has; no text is moved.

    Contents with one document leave before the join, which is on the hash: keys of a content that a third of the
    corpus shares are short rows on one side, and one row on the other.
    """
    hashed = docs.select(key, content_hash(F.col(content)).alias("content_hash"))
    several = copies(docs, key, content).where("copies > 1").select(F.col("content_hash").alias("_hash"), F.col(key).alias("_first"))
    same = F.col("content_hash").eqNullSafe(F.col("_hash"))
    return hashed.join(several, same).where(F.col(key) != F.col("_first")).select(key)


def first_copies(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Documents that are the first of their content (smallest key).

    What leaves are the later copies, by an anti join on the key: usually few rows, which Spark then broadcasts, so that
    the texts stay where they are; never a join of the texts on the possibly hot hash.
    """
    return docs.join(later_keys(docs, key, content), key, "left_anti")
