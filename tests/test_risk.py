from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from veilscan.functions.counts import counts_json, counts_map, counts_text, total
from veilscan.functions.narrative import context_sentence, summary_risk
from veilscan.functions.risk import risk_of
from veilscan.operators.risk import (
    category_breakdown,
    category_counts,
    label_categories,
    ordered_breakdown,
    risk_from_counts,
    with_theme,
)
from veilscan.plans.analysis import analyze, model_requests, with_playbook, with_report

GOLDEN_RISKS = [
    ({}, 0, "Low", "Few or no sensitive identifiers were detected."),
    ({"PAN": 1}, 3, "Low", "Few or no sensitive identifiers were detected."),
    ({"Aadhaar": 1}, 4, "Medium", "Weighted risk score 4 is in the medium range."),
    ({"Password": 2}, 10, "Medium", "Weighted risk score 10 is in the medium range."),
    ({"Password": 2, "Email": 1}, 11, "High", "Weighted risk score 11 exceeds 10."),
    ({"Email": 5}, 5, "Medium", "Weighted risk score 5 is in the medium range."),
    ({"Email": 6}, 6, "High", "Detected 6 sensitive items, above the threshold of 5."),
    ({"API Key": 1}, 5, "High", "Critical sensitive category detected: API Key."),
    ({"Credit Card": 1, "API Key": 1}, 10, "High", "Critical sensitive category detected: API Key, Credit Card."),
    ({"Email": 1, "Phone": 1}, 2, "Low", "Few or no sensitive identifiers were detected."),
    ({"Something new": 4}, 4, "Medium", "Weighted risk score 4 is in the medium range."),
]


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(i, c) for i, (c, *_) in enumerate(GOLDEN_RISKS)]
    return spark.createDataFrame(rows, "doc_id long, counts map<string,int>")


def test_golden_risks(counted):
    got = counted.select("doc_id", risk_of("counts").alias("r")).orderBy("doc_id").collect()
    assert [(r.r.risk_score, r.r.risk_level, r.r.risk_reason) for r in got] == [g[1:] for g in GOLDEN_RISKS]


def test_long_form_gives_the_same_risk(counted):
    long = counted.select("doc_id", F.explode("counts").alias("category", "n"))
    got = {r.doc_id: (r.risk_score, r.risk_level, r.risk_reason) for r in risk_from_counts(long, "doc_id").collect()}
    assert got == {i: g[1:] for i, g in enumerate(GOLDEN_RISKS) if g[0]}


def test_count_formats(spark):
    rows = spark.createDataFrame(
        [(1, ["Phone", "Email", "Phone"]), (2, []), (3, ['Odd "name"'])], "doc_id long, names array<string>"
    ).withColumn("f", F.expr("transform(names, n -> named_struct('category', n))")).withColumn("c", counts_map("f"))
    got = rows.select("c", counts_text("c").alias("t"), counts_json("c").alias("j"), total("c").alias("n")).collect()
    assert got[0].c == {"Email": 1, "Phone": 2}
    assert [r.t for r in got] == ["- Email: 1\n- Phone: 2", "None", '- Odd "name": 1']
    assert [r.j for r in got] == ['{"Email": 1, "Phone": 2}', "{}", '{"Odd \\"name\\"": 1}']
    assert [r.n for r in got] == [3, 0, 1]


def test_breakdown_orders_and_drops_zero(spark):
    rows = spark.createDataFrame([(1, "PAN", 2), (1, "Email", 2), (2, "Phone", 0), (2, "Mine", 3)], "doc_id long, category string, n int")
    got = [(r.category, r.label, r.occurrences, r.severity) for r in ordered_breakdown(category_breakdown(rows)).collect()]
    assert got == [
        ("Mine", "Mine", 3, "Standard"), ("Email", "Emails", 2, "Standard"), ("PAN", "PAN Numbers", 2, "Elevated"),
    ]


def test_labels_are_broadcast(spark):
    rows = spark.createDataFrame([(1, "PAN", 2)], "doc_id long, category string, n int")
    plan = plan_of(label_categories(rows))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_counting_combines_before_the_shuffle(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("category"))
    plan = plan_of(category_counts(rows))
    assert plan.count("HashAggregate") == 2


def test_failures_are_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a@x.co", None), (2, "  \n\x1f", None), (3, None, None), (4, None, "The CSV could not be parsed.")],
        "doc_id long, text string, error string",
    )
    got = {r.doc_id: r for r in analyze(docs).collect()}
    assert (got[1].status, got[1].risk_level, got[1].risk_score) == ("Success", "Low", 1)
    blank = "Failure: The uploaded document does not contain readable text."
    assert got[2].status == got[3].status == blank
    assert got[4].status == "Failure: The CSV could not be parsed."
    assert all((got[i].risk_level, got[i].risk_score, got[i].counts) == ("Unknown", 0, {}) for i in (2, 3, 4))


def test_themes(spark):
    rows = spark.createDataFrame([("High",), ("Unknown",), ("Strange",)], "risk_level string")
    got = {r.risk_level: (r.level_label, r.tone) for r in with_theme(rows).collect()}
    assert got == {
        "High": ("High Threat", "Crimson"), "Unknown": ("Unclassified", "Slate"), "Strange": ("Unclassified", "Slate"),
    }


def test_analysis_does_not_shuffle_and_scans_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = plan_of(analyze(docs).where("risk_level = 'High' and risk_score > 5"))
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all") == 15


def test_context_and_summary_sentences(spark):
    rows = spark.createDataFrame(
        [("",), (None,), ("Trade Secret:\n None   identified",), ("None identified " + "x" * 200,), ("We plan a merger",)],
        "c string",
    )
    none = "No strong semantic corporate-secret indicators were identified."
    got = [r[0] for r in rows.select(context_sentence(F.col("c"))).collect()]
    assert got[:3] == [none] * 3
    assert got[3] == "Semantic context review noted: None identified " + "x" * 200 + "."
    assert got[4] == "Semantic context review noted: We plan a merger."
    rows = spark.createDataFrame(
        [("a\nsecurity risks:  leak \n of keys Suggested Remediation: x",), ("Security Risks: " + "y" * 500,), ("none",), ("Security Risks: Suggested Remediation: x",)],
        "s string",
    )
    got = [r[0] for r in rows.select(summary_risk(F.col("s"))).collect()]
    assert got[0] == "leak of keys" and got[1] == "y" * 360
    assert got[2].startswith("The AI compliance narrative is advisory")
    assert got[3] == "Suggested Remediation: x"


def test_report_and_requests(spark):
    docs = spark.createDataFrame([(1, "mail a@x.co", "a b.txt", 0.126)], "doc_id long, text string, filename string, processing_time double")
    results = analyze(docs)
    row = with_report(with_playbook(results), timed=True).first()
    assert "Processing Time: 0.13s\nTotal Findings: 1" in row.report
    assert row.report.count("\n- ") == 10
    prompts = {r.kind: r.prompt for r in model_requests(results).collect()}
    assert set(prompts) == {"summary", "context"}
    assert all("a@x.co" not in p and "a****@x.co" in p for p in prompts.values())
