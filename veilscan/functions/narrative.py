"""Texts written about one document: summary, playbook, report, model requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.counts import category_list, counts_text, total
from veilscan.functions.text import compact, truncate
from veilscan.settings import DEFAULT_OPTIONS, Options

# Wording of the summary used when no model wrote one.
SUMMARY_TEMPLATE = (
    "Executive Summary:\n"
    "The document was classified as %s risk with a score of %d.\n\n"
    "Compliance Observations:\n"
    "%s\n\n"
    "Security Risks:\n"
    "%s\n\n"
    "Suggested Remediation:\n"
    "Mask sensitive values, restrict access, rotate exposed secrets, and retain only necessary personal data."
)

# Fixed value: context review used when no model wrote one.
NO_CONTEXT = (
    "Confidential Business Information:\nNone identified\n\n"
    "Trade Secret:\nNone identified\n\n"
    "Internal Sensitive Context:\nNone identified"
)

# Playbook sentences.
OBSERVATION_LEVEL = (
    "The document is classified as %s risk with a score of %d, using weighted scoring and "
    "critical-category override rules."
)
OBSERVATION_TOTAL = (
    "The scanner detected %d sensitive item(s) across %s. Coverage includes PAN numbers, emails, "
    "phones, credit cards, bank accounts, API keys, passwords, employee IDs, and semantic "
    "corporate-secret indicators."
)
OBSERVATION_COUNTS = "Audit-ready detection counts: %s. %s"
NO_CATEGORIES = "no structured sensitive identifiers"
RISK_DRIVER = (
    "Primary risk driver: %s This may create privacy, credential, financial, or internal "
    "confidentiality exposure depending on document distribution."
)
RISK_UNMASKED = (
    "Unmasked identifiers can increase regulatory exposure if the document is shared outside "
    "controlled workflows or retained longer than business necessity requires."
)
REMEDIATION = (
    "Use the masked preview as the approved sharing artifact and limit original-document access to "
    "least-privilege reviewers only.",
    "Rotate exposed API keys, passwords, access tokens, or secret material immediately, then verify "
    "downstream systems no longer accept old credentials.",
    "Attach this playbook to the audit trail, assign remediation ownership, and re-scan the sanitized "
    "document before external or cross-team release.",
)
CONTEXT_NONE = "No strong semantic corporate-secret indicators were identified."
CONTEXT_NOTED = "Semantic context review noted: %s."
ADVISORY = (
    "The AI compliance narrative is advisory; deterministic findings and risk score remain the "
    "operational source of truth."
)

# Section headings of the report; the title line is our own.
REPORT_TITLE = "Document Risk Playbook"
HEAD_COUNTS = "Detection Counts:"
HEAD_OBSERVATIONS = "1. Compliance Observations:"
HEAD_RISKS = "2. Security Risks:"
HEAD_REMEDIATION = "3. Suggested Remediation Steps:"

# Model request templates (our own wording).
SUMMARY_PROMPT = (
    "Write a compliance report on the document below for a security reviewer. Use only the evidence "
    "given; add no findings. Use four sections titled Executive Summary, Compliance Observations, "
    "Security Risks and Suggested Remediation.\n\n"
    "Level: %s\nScore: %d\nReason: %s\n\nCounts:\n%s\n\nText:\n%s"
)
CONTEXT_PROMPT = (
    "List business context in the text below that is sensitive although it is no identifier. Use the "
    "headings Confidential Business Information, Trade Secret and Internal Sensitive Context, with "
    "short bullets that the text supports, or 'None identified'.\n\nText:\n%s"
)
QUESTION_PROMPT = (
    "Answer the question from the passages below only, and say so when they do not suffice. Name "
    "categories, counts and masked forms; do not repeat secrets in full.\n\n"
    "Passages:\n%s\n\nQuestion:\n%s"
)


def fallback_summary(level: Column, score: Column, reason: Column, counts: str) -> Column:
    """Four-section summary without a model."""
    return F.format_string(SUMMARY_TEMPLATE, level, score, counts_text(counts), reason)


def context_sentence(context: Column, options: Options = DEFAULT_OPTIONS) -> Column:
    """One sentence about the context review."""
    flat = compact(context)
    nothing = (F.length(flat) == 0) | (F.contains(flat, F.lit("None identified")) & (F.length(flat) < options.context_short))
    return F.when(F.coalesce(nothing, F.lit(True)), F.lit(CONTEXT_NONE)).otherwise(
        F.format_string(CONTEXT_NOTED, F.substring(flat, 1, options.context_chars))
    )


# Fixed value: where the risk section of a summary lies.
RISK_SECTION = r"(?iu)Security Risks:\s*(.+?)(?:Suggested Remediation:|$)"


def summary_risk(summary: Column, options: Options = DEFAULT_OPTIONS) -> Column:
    """The risk section of a summary, clipped, or a fixed sentence."""
    section = F.trim(F.regexp_extract(compact(summary), RISK_SECTION, 1))
    return F.when(F.length(section) > 0, F.substring(section, 1, options.risk_chars)).otherwise(F.lit(ADVISORY))


def playbook(
    level: Column, score: Column, reason: Column, counts: str, summary: Column, context: Column,
    options: Options = DEFAULT_OPTIONS,
) -> Column:
    """``struct<observations, risks, remediation>``, three sentences each."""
    return F.struct(
        F.array(
            F.format_string(OBSERVATION_LEVEL, level, score),
            F.format_string(OBSERVATION_TOTAL, total(counts), category_list(counts, NO_CATEGORIES)),
            F.format_string(OBSERVATION_COUNTS, counts_text(counts), context_sentence(context, options)),
        ).alias("observations"),
        F.array(
            F.format_string(RISK_DRIVER, reason), F.lit(RISK_UNMASKED), summary_risk(summary, options)
        ).alias("risks"),
        F.array(*[F.lit(s) for s in REMEDIATION]).alias("remediation"),
    )


def bullets(items: Column) -> Column:
    """One '- item' line per element."""
    return F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")


def report(
    filename: Column,
    level: Column,
    score: Column,
    reason: Column,
    counts: str,
    book: Column,
    processing_time: Column | None = None,
) -> Column:
    """Downloadable report; the time line appears when a time is given."""
    lines = [
        F.lit(REPORT_TITLE),
        F.lit(""),
        F.concat(F.lit("Filename: "), filename),
        F.concat(F.lit("Risk Level: "), level),
        F.concat(F.lit("Score: "), score.cast("string")),
    ]
    if processing_time is not None:
        lines.append(F.format_string("Processing Time: %.2fs", processing_time))
    lines += [
        F.concat(F.lit("Total Findings: "), total(counts).cast("string")),
        F.concat(F.lit("Risk Reason: "), reason),
        F.lit(""),
        F.lit(HEAD_COUNTS),
        counts_text(counts),
        F.lit(""),
        F.lit(HEAD_OBSERVATIONS),
        bullets(book["observations"]),
        F.lit(""),
        F.lit(HEAD_RISKS),
        bullets(book["risks"]),
        F.lit(""),
        F.lit(HEAD_REMEDIATION),
        bullets(book["remediation"]),
    ]
    return F.concat_ws("\n", *lines)


def summary_prompt(
    level: Column, score: Column, reason: Column, counts: str, masked: Column,
    options: Options = DEFAULT_OPTIONS,
) -> Column:
    excerpt = truncate(masked, options.max_input_chars)
    return F.format_string(SUMMARY_PROMPT, level, score, reason, counts_text(counts), excerpt)


def context_prompt(masked: Column, options: Options = DEFAULT_OPTIONS) -> Column:
    return F.format_string(CONTEXT_PROMPT, truncate(masked, options.max_input_chars))


def question_prompt(context: Column, question: Column) -> Column:
    return F.format_string(QUESTION_PROMPT, context, question)
