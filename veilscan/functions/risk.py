"""Risk of one document from its category counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.counts import total
from veilscan.functions.text import sql_text
from veilscan.settings import DEFAULT_OPTIONS, RULES, Options, Rule, critical_categories

# Wording of the five risk reasons.
REASON_CRITICAL = "Critical sensitive category detected: %s."
REASON_SCORE = "Weighted risk score %d exceeds %d."
REASON_ITEMS = "Detected %d sensitive items, above the threshold of %d."
REASON_MEDIUM = "Weighted risk score %d is in the medium range."
REASON_LOW = "Few or no sensitive identifiers were detected."


def risk_score(counts: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Sum of weight times count; a category without a rule weighs 1."""
    arms = " ".join(f"when {sql_text(r.category)} then {r.weight}" for r in rules)
    weight = f"case e.key {arms} else 1 end" if arms else "1"
    return F.expr(f"aggregate(map_entries({counts}), 0, (acc, e) -> acc + e.value * {weight})")


def critical_hits(counts: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Critical categories present, in naming order."""
    names = ", ".join(sql_text(c) for c in critical_categories(rules))
    return F.expr(f"filter(cast(array({names}) as array<string>), c -> map_contains_key({counts}, c))")


def risk_from(
    score: Column, items: Column, critical: Column, options: Options = DEFAULT_OPTIONS
) -> Column:
    """``struct<risk_level, risk_score, risk_reason>``; the first true rule wins."""
    level = (
        F.when(F.size(critical) > 0, "High")
        .when(score > options.high_threshold, "High")
        .when(items > options.sensitive_count_threshold, "High")
        .when(score.between(options.medium_min, options.high_threshold), "Medium")
        .otherwise("Low")
    )
    reason = (
        F.when(F.size(critical) > 0, F.format_string(REASON_CRITICAL, F.array_join(critical, ", ")))
        .when(score > options.high_threshold, F.format_string(REASON_SCORE, score, F.lit(options.high_threshold)))
        .when(
            items > options.sensitive_count_threshold,
            F.format_string(REASON_ITEMS, items, F.lit(options.sensitive_count_threshold)),
        )
        .when(
            score.between(options.medium_min, options.high_threshold),
            F.format_string(REASON_MEDIUM, score),
        )
        .otherwise(F.lit(REASON_LOW))
    )
    return F.struct(
        level.alias("risk_level"), score.cast("int").alias("risk_score"), reason.alias("risk_reason")
    )


def risk_of(counts: str, rules: tuple[Rule, ...] = RULES, options: Options = DEFAULT_OPTIONS) -> Column:
    """Risk struct straight from a counts map column."""
    return risk_from(risk_score(counts, rules), total(counts), critical_hits(counts, rules), options)
