"""Corpora derived from the given tables, each built by Spark over the whole table.

The plain documents trigger only two of the nine rules, so two further corpora append a
text to every document: ``augmented`` adds one value of each remaining category, and
``mixed`` adds, depending on the document, one of eight sets that together reach every
step of the risk ladder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``(doc_id, text)`` and further columns; only these reach the scan."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", *extra)


def phone_number(doc_id: str = "doc_id", shift: int = 0) -> str:
    return f"cast(6000000000 + ({doc_id} * 7919 + {shift}) % 3999999999 as string)"


def padded(doc_id: str, width: int) -> str:
    return f"lpad(cast({doc_id} % {10 ** min(width, 18)} as string), {width}, '0')"


def full_suffix(doc_id: str = "doc_id") -> str:
    """SQL text with one phone, PAN, Aadhaar, account, API key, password, employee."""
    return (
        f"concat('\\n', 'contact +91 ', {phone_number(doc_id)}, ' pan ABCDE', {padded(doc_id, 4)}, "
        f"'F aadhaar 1234 5678 ', {padded(doc_id, 4)}, '\\n', 'account no: ', 'x', '\\n', "
        f"'account: ', cast(100000000 + {doc_id} as string), ' api_key=\"k', {padded(doc_id, 22)}, "
        f"'\" password: pw', {padded(doc_id, 8)}, ' EMP-', {padded(doc_id, 5)})"
    )


def mixed_suffix(doc_id: str = "doc_id") -> str:
    passwords = f"' password: pw', {padded(doc_id, 8)}, ' pwd=zz', {padded(doc_id, 8)}"
    phones = ", ".join(f"' , ', {phone_number(doc_id, 1000003 * i)}" for i in range(6))
    return (
        f"case {doc_id} % 8 "
        f"when 0 then '' "
        f"when 1 then concat(' pan ABCDE', {padded(doc_id, 4)}, 'F') "
        f"when 2 then concat(' aadhaar 1234 5678 ', {padded(doc_id, 4)}) "
        f"when 3 then concat({passwords}) "
        f"when 4 then concat({passwords}, ' contact +91 ', {phone_number(doc_id)}) "
        f"when 5 then concat({phones}) "
        f"when 6 then concat(' api_key=\"k', {padded(doc_id, 22)}, '\"') "
        f"else concat(' account: ', cast(100000000 + {doc_id} as string), ' EMP-', {padded(doc_id, 5)}) end"
    )


def overlap_suffix(doc_id: str = "doc_id") -> str:
    """A spaced card number, valid for a tenth of the documents, whose first twelve digits are an identifier too."""
    return f"concat(' card 4111 1111 1111 ', {padded(doc_id, 4)}, ' or so, mail user', {doc_id}, '@mail.example')"


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which findings of different length begin at the same place."""
    return documents(spark, sf_dir).withColumn("text", F.expr(f"concat(text, {overlap_suffix()})"))


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", F.expr(f"concat(text, {full_suffix()})"))


def mixed(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return documents(spark, sf_dir, *extra).withColumn("text", F.expr(f"concat(text, {mixed_suffix()})"))


def with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents plus one whitespace-only document per row of ``labels``."""
    blanks = table(spark, sf_dir, "labels").select(
        (-F.col("doc_id") - 1).alias("doc_id"),
        F.expr("case quality when 0 then concat(' ', '\\n', '\\t') else concat(' ', chr(160), ' ') end").alias("text"),
        F.lit("none").alias("lang"),
    )
    return documents(spark, sf_dir, "lang").unionByName(blanks)


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages of their conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )


# Question openings that reach each route; the user turn follows.
OPENINGS = (
    "What compliance risks are present? ",
    "Which company is named? ",
    "What is this about? ",
    "How do I fix it? ",
    "",
    "xyzzy quux? ",
)


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question about the document of its conversation."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"),
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("turn"),
        F.col("text").alias("question"),
    )


def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with openings; some blank, some about a document that is not there."""
    pick = (F.col("doc_id") + F.col("turn")) % 9
    opening: Callable[..., Column] = F.when(pick == 0, F.lit(OPENINGS[0]))
    for i, words in enumerate(OPENINGS[1:], start=1):
        opening = opening.when(pick == i, F.lit(words))
    turns = user_turns(spark, sf_dir)
    return turns.select(
        "q_id",
        F.when(pick == 8, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(pick == 6, F.lit(" \n "))
        .when(pick == 5, F.lit(OPENINGS[5]))
        .otherwise(F.concat(opening.otherwise(F.lit("")), "question"))
        .alias("question"),
    )


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: the label is the document, the vector id the chunk."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_no"), F.col("embedding").alias("vector")
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per document: the mean of its chunk vectors."""
    parts = vector_rows(spark, sf_dir).select("doc_id", F.posexplode("vector").alias("dim", "x"))
    means = parts.groupBy("doc_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_dims")
    ).select(
        F.col("doc_id").cast("long").alias("q_id"),
        "doc_id",
        F.transform("_dims", lambda d: d["m"]).alias("q_vector"),
    )
