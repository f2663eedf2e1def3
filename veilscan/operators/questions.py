"""Deterministic answers to questions about analysed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.counts import category_list, counts_text, total
from veilscan.functions.narrative import bullets
from veilscan.functions.text import compact, compact_sql, is_blank, search_terms_sql, sentences_sql
from veilscan.functions.arrays import let
from veilscan.operators.pin import pinned
from veilscan.settings import DEFAULT_OPTIONS, Options

# Substrings that route a question, tried in this order.
ROUTES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("risk", ("risk", "compliance", "issue", "problem", "exposure")),
    (
        "findings",
        (
            "sensitive", "pii", "data", "findings", "identifier", "email", "phone", "pan",
            "password", "api", "credit", "bank", "employee",
        ),
    ),
    ("summary", ("summary", "summarize", "about", "overview")),
    ("remediation", ("remediate", "remediation", "fix", "action", "recommend", "step", "priority")),
)

# Wording of the answers.
ANSWER_BLANK = "Please enter a question about the uploaded document."
ANSWER_NO_DOCUMENT = "No document is currently loaded. Upload a document first, then ask your question."
ANSWER_RISK = (
    "The document is classified as %s risk with a score of %d. Total sensitive findings: %d.\n\n"
    "Compliance risks found:\n%s"
)
ANSWER_FINDINGS = (
    "I found %d sensitive item(s) in the document.\n\nDetection counts:\n%s\n\n"
    "The findings table on the Compliance Panel contains the detected values and masked equivalents."
)
ANSWER_SUMMARY = (
    "Document overview: this file was processed as %s risk with %d sensitive finding(s). "
    "Key detected categories: %s.\n\nMasked excerpt: %s"
)
ANSWER_REMEDIATION = "Recommended remediation steps:\n%s"
ANSWER_SENTENCES = "Relevant document context:\n%s"
ANSWER_DEFAULT = (
    "I can answer from the uploaded document scan. The document has %d sensitive finding(s), a %s "
    "risk level, and a score of %d. Ask about risks, sensitive data, summary, findings, or "
    "remediation for more detail."
)


def route_by_words(question: Column) -> Column:
    """Route by keyword substrings; NULL when none fits."""
    lowered = F.lower(question)
    route = F
    for name, words in ROUTES:
        found = F.contains(lowered, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(lowered, F.lit(word))
        route = route.when(found, F.lit(name))
    return route


def with_sentences(docs: DataFrame, text: str = "masked_text", options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """Add ``sentences``: the non-blank sentences of each text, clipped, and lower-cased; worked out once per document."""
    clipped = f"named_struct('sentence', left(flat_, {options.sentence_chars}), 'lowered', lower(flat_))"
    prepared = (
        f"filter(transform({sentences_sql(text)}, raw -> {let('flat_', compact_sql('raw'), clipped)}), p -> length(p.lowered) > 0)"
    )
    return pinned(docs, sentences=F.expr(prepared))


def relevant_sentences(question: str, sentences: str = "sentences", options: Options = DEFAULT_OPTIONS) -> Column:
    """Best sentences (of ``with_sentences``) for a question: ``array<struct<score,pos,sentence>>``.

    The score is the number of question terms contained in the lower-cased sentence.
    Ranking happens inside the row of the question: nothing is exploded or shuffled.
    """
    scored = (
        f"transform({sentences}, (p, i) -> named_struct("
        "'back', -size(filter(terms_, t -> contains(p.lowered, t))), 'pos', i, 'sentence', p.sentence))"
    )
    best = (
        f"transform(slice(array_sort(filter({scored}, r -> r.back < 0)), 1, {options.sentence_limit}), "
        "r -> named_struct('score', -r.back, 'pos', r.pos, 'sentence', r.sentence))"
    )
    return F.expr(let("terms_", search_terms_sql(question), best))


def answer_questions(
    questions: DataFrame,
    results: DataFrame,
    key: str = "doc_id",
    options: Options = DEFAULT_OPTIONS,
    loaded: DataFrame | None = None,
) -> DataFrame:
    """``(q_id, key, route, answer, sources)`` for ``questions(q_id, key, question)``.

    ``results`` are successful results with their playbook.  Questions without a
    document get the fixed answer through an anti join on the key column alone, so that
    the wide result rows only take part in an inner join, in which Spark may broadcast
    the question side when it is small.  ``loaded`` may name the keys of the analysed
    documents when ``results`` is not a stored table, so that asking for the keys does
    not run the analysis again.
    """
    asked = questions.where(~is_blank(F.col("question")))
    empty = questions.where(is_blank(F.col("question")))
    joined = asked.join(with_sentences(results, options=options), key).withColumn("_route", route_by_words(F.col("question")))
    matched = joined.withColumn(
        "_best",
        F.when(
            F.col("_route").isNull(),
            relevant_sentences("question", options=options),
        ),
    ).withColumn(
        "route",
        F.coalesce("_route", F.when(F.size("_best") > 0, F.lit("sentences")), F.lit("default")),
    )
    counts, score, level = "counts", F.col("risk_score"), F.col("risk_level")
    found = F.col("_best.sentence")
    answer = (
        F.when(
            F.col("route") == "risk",
            F.format_string(
                ANSWER_RISK, level, score, total(counts),
                bullets(F.coalesce(F.col("playbook.risks"), F.array("risk_reason"))),
            ),
        )
        .when(F.col("route") == "findings", F.format_string(ANSWER_FINDINGS, total(counts), counts_text(counts)))
        .when(
            F.col("route") == "summary",
            F.format_string(
                ANSWER_SUMMARY, level, total(counts), category_list(counts, "none"),
                F.substring(compact(F.col("masked_text")), 1, options.excerpt_chars),
            ),
        )
        .when(F.col("route") == "remediation", F.format_string(ANSWER_REMEDIATION, bullets(F.col("playbook.remediation"))))
        .when(F.col("route") == "sentences", F.format_string(ANSWER_SENTENCES, bullets(found)))
        .otherwise(F.format_string(ANSWER_DEFAULT, total(counts), level, score))
    )
    sources = F.when(F.col("route") == "sentences", found).otherwise(
        F.array(F.substring("masked_text", 1, options.source_chars))
    )
    answered = matched.select("q_id", key, "route", answer.alias("answer"), sources.alias("sources"))
    nothing = F.expr("cast(array() as array<string>)").alias("sources")
    keys = (results if loaded is None else loaded).select(key)
    orphaned = asked.join(keys, key, "left_anti").select(
        "q_id", key, F.lit("no_document").alias("route"), F.lit(ANSWER_NO_DOCUMENT).alias("answer"), nothing
    )
    unasked = empty.select("q_id", key, F.lit("blank").alias("route"), F.lit(ANSWER_BLANK).alias("answer"), nothing)
    return answered.unionByName(orphaned).unionByName(unasked)


def answers_with_fallback(
    questions: DataFrame,
    retrieved: DataFrame,
    results: DataFrame,
    key: str = "doc_id",
    options: Options = DEFAULT_OPTIONS,
    loaded: DataFrame | None = None,
) -> DataFrame:
    """``(q_id, key, provenance, route, answer, sources)``, one row per question.

    ``retrieved(q_id, answer, sources)`` holds what a model made of the retrieved chunks.  Where it has an answer, that
    counts (provenance ``retrieval``); questions that are blank, were not retrieved for, or whose model call gave
    nothing get the deterministic answer (``fallback``), which is worked out for these only.
    """
    good = retrieved.where(~is_blank(F.col("answer"))).select("q_id", "answer", "sources")
    from_chunks = questions.where(~is_blank(F.col("question"))).select("q_id", key).join(good, "q_id").select(
        "q_id", key, F.lit("retrieval").alias("provenance"), F.lit("chunks").alias("route"), "answer", "sources"
    )
    rest = questions.join(from_chunks.select("q_id"), "q_id", "left_anti")
    fallback = answer_questions(rest, results, key, options, loaded)
    return from_chunks.unionByName(fallback.withColumn("provenance", F.lit("fallback")))
