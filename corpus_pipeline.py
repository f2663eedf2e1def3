"""From documents to packed training sequences: five stages, each over all rows that the one before kept.

run() writes each stage's rows to the folder in spark.checkpoint.dir and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import decontaminate, jaccard, packing, secrets, toxicity
from veilscan.llm.common import bounded, stored
from veilscan.llm.queries import CAPACITY, PACK_END, table
from veilscan.llm.tokens import default_tokenizer

#: Near duplicates: five words, similarity of 0.8 or more.
NEAR = jaccard.Rule(words=5, num=80, den=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels that are not held out, takes for toxic go."""
    return toxicity.without_toxic(bounded(docs), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal word n-grams, directly or through others, the smallest doc_id stays."""
    return jaccard.one_of_each(bounded(docs), NEAR)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of benchmark items go; documents of which half the words are hit go whole."""
    return decontaminate.cleaned(bounded(docs), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET]."""
    return secrets.redacted(bounded(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of CAPACITY tokens."""
    return packing.pack_documents(bounded(docs), default_tokenizer(), PACK_END, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: A tokenizer and a fitted classifier are not SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
