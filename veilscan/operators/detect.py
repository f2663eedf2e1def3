"""Detection over a corpus: one map-side pass that adds a findings array per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.patterns import MARK, gate_sql, number_sql, parts_sql, rule_hits, rule_marks, spans_sql
from veilscan.functions.text import sql_text
from veilscan.operators.pin import pinned
from veilscan.settings import RULES, Gate, Rule

FINDING_FIELDS = ("category", "value", "masked_value", "start", "end", "confidence")
SPAN_TYPE = "array<struct<start:int,category:string,end:int,value:string,masked_value:string>>"
# Fixed value: pattern findings always carry this confidence.
CONFIDENCE = "High"


def scan_hits(
    docs: DataFrame, rules: tuple[Rule, ...], text: str, prefilter: bool, scan: Callable[..., Column] = rule_hits
) -> tuple[DataFrame, dict[Rule, str]]:
    """docs with one column of matches (or of what ``scan`` makes) per rule, and the names of these columns."""
    hit = {r: f"_hits_{i}" for i, r in enumerate(rules)}
    gates: dict[str, list[Gate]] = {}
    for r in rules:
        if prefilter and r.gate:
            gates.setdefault(f"_gate_{r.gate.group}", []).append(r.gate)
    gate_of = {r: f"_gate_{r.gate.group}" for r in rules if prefilter and r.gate}
    opened = docs.select("*", *[F.expr(gate_sql(text, g)).alias(name) for name, g in gates.items()])
    scanned = opened.select(
        *docs.columns, *[scan(text, r, prefilter, gate_of.get(r)).alias(hit[r]) for r in rules]
    )
    return scanned, hit


def detect_counts(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", prefilter: bool = True
) -> DataFrame:
    """Add ``counts``: ``map<category,count>`` without zero entries, keys sorted.

    Counts come from the matches themselves: no spans, masks or sorting are computed.
    """
    scanned, hit = scan_hits(docs, rules, text, prefilter)
    numbers: dict[str, list[str]] = {}
    for r in rules:
        numbers.setdefault(r.category, []).append(number_sql(text, r, hit[r]))
    entries = ", ".join(
        f"named_struct('key', {sql_text(c)}, 'value', {' + '.join(n)})" for c, n in sorted(numbers.items())
    )
    counts = f"map_from_entries(filter(array({entries}), e -> e.value > 0))" if numbers else "cast(map() as map<string,int>)"
    return pinned(scanned, counts=F.expr(counts)).select(*docs.columns, "counts")


def detect(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    prefilter: bool = True,
) -> DataFrame:
    """Add ``findings``: array of structs ordered by ``(start, category)``.

    No shuffle: each rule contributes one column of marked texts, then (only for texts that hit)
    its spans, and the arrays are merged within the row.  The steps are separate
    projections because Catalyst keeps an expensive column that is used more than
    once, so every pattern runs once per text.  Overlaps between categories are kept.
    """
    scanned, marked = scan_hits(docs, rules, text, prefilter, rule_marks)
    unmarked = f"contains({text}, {sql_text(MARK)})"
    matched = ", ".join(parts_sql(text, r, marked[r], unmarked) for r in rules)
    parted = scanned.select(
        *docs.columns, F.expr(f"filter(array({matched}), p -> size(p.parts) > 0)").alias("_matched")
    )
    public = ", ".join(f"'{name}', s.{name}" for name in FINDING_FIELDS[:-1])
    findings = (
        f"transform(array_sort(if(size(_matched) > 0, {spans_sql('_matched', rules)}, cast(array() as {SPAN_TYPE}))), "
        f"s -> named_struct({public}, 'confidence', '{CONFIDENCE}'))"
    )
    return pinned(parted, findings=F.expr(findings)).select(*docs.columns, "findings")


def explode_findings(found: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per finding, with the key columns of its document."""
    return found.select(*keys, F.explode("findings").alias("_f")).select(
        *keys, *[F.col("_f")[name].alias(name) for name in FINDING_FIELDS]
    )


def findings_sheet(findings: DataFrame, *keys: str) -> DataFrame:
    """Display form of the long findings table; the columns exist even when empty."""
    return findings.select(
        *keys,
        F.col("category").alias("Category"),
        F.col("value").alias("Value"),
        F.col("masked_value").alias("Masked Value"),
        F.col("start").alias("Start"),
        F.col("end").alias("End"),
        F.coalesce("confidence", F.lit(CONFIDENCE)).alias("Confidence"),
    )


def filter_categories(findings: DataFrame, selected: list[str]) -> DataFrame:
    """Findings of the selected categories; an empty selection keeps everything."""
    return findings.where(F.col("category").isin(*selected)) if selected else findings


def filter_categories_by(
    findings: DataFrame, selection: DataFrame, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Same with the selection as a table, in one plan; an empty selection keeps everything.

    Of the selection, only categories of ``rules`` are sent to the tasks, so the broadcast
    is never larger than the rule set; ``rules`` are those that made the findings.
    """
    names = [r.category for r in rules]
    chosen = selection.where(F.col("category").isin(*names)).select("category").distinct()
    nothing = selection.agg(F.count(F.lit(1)) == 0).scalar()
    marked = findings.join(F.broadcast(chosen.withColumn("_chosen", F.lit(True))), "category", "left")
    return marked.where(F.col("_chosen").isNotNull() | nothing).select(*findings.columns)


def distinct_categories(findings: DataFrame) -> DataFrame:
    """Sorted distinct categories."""
    return findings.select("category").distinct().orderBy("category")
