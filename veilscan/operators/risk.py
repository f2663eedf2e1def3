"""Aggregations over the long findings table and over results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.risk import risk_from
from veilscan.settings import (
    DEFAULT_OPTIONS,
    RULES,
    Options,
    Rule,
    category_dim,
    critical_categories,
    risk_level_dim,
)


def category_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per key and category; partial aggregation runs before the shuffle."""
    return findings.groupBy(*keys, "category").agg(F.count(F.lit(1)).cast("int").alias("n"))


def counts_long(results: DataFrame, *keys: str) -> DataFrame:
    """Same table from result rows, by exploding their counts (no shuffle)."""
    return results.select(*keys, F.explode("counts").alias("category", "n"))


def label_categories(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Join labels, weight and severity; unknown categories keep defaults."""
    dim = category_dim(df.sparkSession, rules)
    return df.join(F.broadcast(dim), "category", "left").withColumns({
        "weight": F.coalesce("weight", F.lit(1)),
        "critical": F.coalesce("critical", F.lit(False)),
        "label": F.coalesce("label", "category"),
        "severity": F.coalesce("severity", F.lit("Standard")),
    })


def category_breakdown(counts: DataFrame, *keys: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Label, occurrences and severity per category; corpus-wide without keys.

    Takes ``(keys, category, n)``; zero counts are dropped.  Rows have no order, see
    ``ordered_breakdown``.
    """
    summed = counts.groupBy(*keys, "category").agg(F.sum("n").alias("occurrences")).where("occurrences > 0")
    named = label_categories(summed, rules)
    return named.select(*keys, "category", "label", "occurrences", "severity")


def ordered_breakdown(breakdown: DataFrame, *keys: str) -> DataFrame:
    """The breakdown for display: per key most frequent first, ties by category."""
    return breakdown.orderBy(*keys, F.desc("occurrences"), "category")


def counts_table(counts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, place, category, n)``: the counts in the order in which they are shown, by category, numbered from 1.

    Zero counts are dropped.  A key has at most as many rows as there are categories.
    """
    summed = counts.groupBy(*keys, "category").agg(F.sum("n").alias("n")).where("n > 0")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("category"))
    return summed.select(*keys, place.alias("place"), "category", "n")


def risk_from_counts(
    counts: DataFrame, *keys: str, rules: tuple[Rule, ...] = RULES, options: Options = DEFAULT_OPTIONS
) -> DataFrame:
    """Risk per key from the long counts table ``(keys, category, n)``.

    For stored findings; documents without any row here are Low with score 0, which the
    caller adds by a left join from its document list.
    """
    critical = critical_categories(rules)
    named = label_categories(counts, rules)
    summed = named.groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("weight")).cast("int").alias("_score"),
        F.sum("n").cast("int").alias("total_findings"),
        *[F.max(F.col("category") == c).alias(f"_critical_{i}") for i, c in enumerate(critical)],
    )
    hits = F.filter(
        F.array(*[F.when(F.col(f"_critical_{i}"), F.lit(c)) for i, c in enumerate(critical)])
        .cast("array<string>"),
        lambda c: c.isNotNull(),
    )
    return summed.select(
        *keys,
        "total_findings",
        risk_from(F.col("_score"), F.col("total_findings"), hits, options).alias("_risk"),
    ).select(*keys, "total_findings", "_risk.*")


def risk_level_mix(results: DataFrame, *keys: str) -> DataFrame:
    """Documents, findings and score per risk level."""
    return results.groupBy(*keys, "risk_level").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("risk_score").alias("total_score"),
        F.max("risk_score").alias("max_score"),
    )


def with_theme(results: DataFrame) -> DataFrame:
    """Add the label and tone of the risk level; unknown levels use 'Unknown'."""
    dim = risk_level_dim(results.sparkSession)
    level = F.when(F.col("risk_level").isin("Low", "Medium", "High"), F.col("risk_level")).otherwise("Unknown")
    return (
        results.withColumn("_level", level)
        .join(F.broadcast(dim.withColumnRenamed("risk_level", "_level")), "_level", "left")
        .drop("_level")
    )
