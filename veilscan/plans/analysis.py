"""The document analysis plan: detection, masking, counts, risk, texts, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import narrative
from veilscan.functions.counts import counts_map, total
from veilscan.functions.masking import mask_text
from veilscan.functions.risk import risk_of
from veilscan.functions.text import BLANK_MESSAGE, is_blank
from veilscan.operators.detect import detect, detect_counts
from veilscan.operators.pin import pinned
from veilscan.settings import DEFAULT_OPTIONS, RULES, Options, Rule

SUCCESS = "Success"
FAILURE = "Failure: "


def analyze(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, options: Options = DEFAULT_OPTIONS
) -> DataFrame:
    """One result row per document, without a shuffle.

    Input: key columns and ``text``; an optional ``error`` column marks documents whose
    extraction failed.  Output keeps the input columns (except ``error``) and adds
    ``findings, counts, masked_text, risk_level, risk_score, risk_reason, status``.
    A blank or failed document is a row with status Failure, level Unknown and score 0.
    """
    keep, error = _readable(docs)
    found = detect(docs.select(*keep, error), rules)
    counted = pinned(found, counts=counts_map("findings"))
    masked = mask_text("text", "findings").alias("masked_text")
    return _rated(counted, [*keep, "findings"], [masked], rules, options)


def _readable(docs: DataFrame) -> tuple[list[str], Column]:
    """Columns kept, and why a document can't be analysed (``_error``, null if it can)."""
    failed = F.when(is_blank(F.col("text")), F.lit(BLANK_MESSAGE))
    if "error" in docs.columns:
        failed = F.coalesce(F.col("error"), failed)
    return [c for c in docs.columns if c != "error"], failed.alias("_error")


def _rated(
    counted: DataFrame, keep: list[str], extra: list[Column], rules: tuple[Rule, ...], options: Options
) -> DataFrame:
    scored = pinned(counted, _risk=risk_of("counts", rules, options))
    good = F.col("_error").isNull()
    return scored.select(
        *keep,
        "counts",
        *extra,
        F.when(good, F.col("_risk.risk_level")).otherwise("Unknown").alias("risk_level"),
        F.when(good, F.col("_risk.risk_score")).otherwise(0).alias("risk_score"),
        F.when(good, F.col("_risk.risk_reason")).alias("risk_reason"),
        F.when(good, F.lit(SUCCESS)).otherwise(F.concat(F.lit(FAILURE), "_error")).alias("status"),
    )


def assess(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, options: Options = DEFAULT_OPTIONS
) -> DataFrame:
    """``analyze`` without ``findings`` and ``masked_text``, for reports on counts and risk only."""
    keep, error = _readable(docs)
    return _rated(detect_counts(docs.select(*keep, error), rules), keep, [], rules, options)


def succeeded(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == SUCCESS)


def failed(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") != SUCCESS)


def with_playbook(results: DataFrame, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """Add ``summary, context, playbook``.

    A ``summary`` or ``context`` column already present (say, written by a model) is
    used where it is not NULL; otherwise the deterministic texts are.
    """
    cols = [*map(F.col, ("risk_level", "risk_score", "risk_reason")), "counts"]
    summary = narrative.fallback_summary(*cols)
    context = F.lit(narrative.NO_CONTEXT)
    if "summary" in results.columns:
        summary = F.coalesce("summary", summary)
    if "context" in results.columns:
        context = F.coalesce("context", context)
    texts = results.withColumns({"summary": summary, "context": context})
    return texts.withColumn("playbook", narrative.playbook(*cols, F.col("summary"), F.col("context"), options))


def with_report(books: DataFrame, timed: bool = False) -> DataFrame:
    """Add ``report``; needs ``filename`` and the columns of ``with_playbook``."""
    return books.withColumn(
        "report",
        narrative.report(
            F.col("filename"), F.col("risk_level"), F.col("risk_score"), F.col("risk_reason"),
            "counts", F.col("playbook"), F.col("processing_time") if timed else None,
        ),
    )


def model_requests(results: DataFrame, key: str = "doc_id", options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """``(key, kind, prompt)`` rows for a batch inference job, from masked text only."""
    prompts = F.array(
        F.struct(
            F.lit("summary").alias("kind"),
            narrative.summary_prompt(
                F.col("risk_level"), F.col("risk_score"), F.col("risk_reason"), "counts",
                F.col("masked_text"), options,
            ).alias("prompt"),
        ),
        F.struct(
            F.lit("context").alias("kind"),
            narrative.context_prompt(F.col("masked_text"), options).alias("prompt"),
        ),
    )
    return succeeded(results).select(key, F.explode(prompts).alias("_p")).select(key, "_p.kind", "_p.prompt")


def totals(results: DataFrame) -> DataFrame:
    """Add ``total_findings``."""
    return results.withColumn("total_findings", total("counts"))
