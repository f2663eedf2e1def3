from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from veilscan.functions.masking import mask_text, mask_value
from veilscan.operators.detect import detect, detect_counts, explode_findings, filter_categories, filter_categories_by, findings_sheet
from veilscan.settings import RULES, Rule, rule_from_row, rules_from_table, with_rules

GOLDEN_TEXTS = [
    ("Account number: 987654321012 and acct no. 123456789 end", "Account number: XXXXXXXX1012 and acct no. XXXXX6789 end"),
    (
        "api_key = 'abcdefghijklmnopqrstuvwxyz123' bearer: ABCDEFGHIJKLMNOPQRSTUV",
        "api_key = 'abc***********************123' bearer: ABC****************TUV",
    ),
    ('password: "hunter22x", pwd=abc123zz. passwd: short', 'password: "hun******22x", pwd=abc******zz. passwd: short'),
    ("The employee and Employee ID: E1234 EMP-007X EMPLOYEE", "The em****ee and Em****ee ID: E1234 EM****7X EM****EE"),
    ("card 4111 1111 1111 1111 or 4111-1111-1111-1112", "card XXXXXXXXXXXX1111r XXXXXXXX1111-1112"),
    ("phone +91 9876543210, 9876543210, 919876543210", "phone XXXXXXXX3210, XXXXXX3210, XXXXXXXX3210"),
    (
        "\U0001f600 PAN ABCDE1234F éfoo.bar@x.com \U0001f600 pwd: sécrét99 x",
        "\U0001f600 PAN ABC****34F éfoo.b****@x.com \U0001f600 pwd: ******** x",
    ),
    ("1234 5678 9012 3456 7890 1234", "XXXXXXXX9012 XXXXXXXX1234"),
    ("paſsword: hunter222", "paſsword: hun******222"),
]

GOLDEN_MASKS = [
    ("Email", "ab@x.co", "a****@x.co"),
    ("Email", "alice@x.co", "al****@x.co"),
    ("Email", "longlocal@x.co", "lo*******@x.co"),
    ("Email", "@x.co", "****@x.co"),
    ("PAN", "ABCDE1234F", "ABC****34F"),
    ("PAN", "ABC", "***"),
    ("Aadhaar", "1234 5678 9012", "XXXXXXXX9012"),
    ("Phone", "+91 9876543210", "XXXXXXXX3210"),
    ("Phone", "9876543210", "XXXXXX3210"),
    ("Credit Card", "4111-1111-1111-1111", "XXXXXXXXXXXX1111"),
    ("Bank Account", "123456789", "XXXXX6789"),
    ("Bank Account", "12a", "***"),
    ("Password", "hunter22", "********"),
    ("Password", "hunter222", "hun******222"),
    ("API Key", "abcdefghijklmnopqrstuvwx", "abc******************vwx"),
    ("Employee ID", "EMP-007X", "EM****7X"),
    ("Employee ID", "EMP123", "EM***23"),
    ("Other", "abcd", "****"),
    ("Other", "  ", ""),
]

ATOMS = (
    "            |pwd          |account|acct|acct no.|ACCOUNT NUMBER|paſsword|password|pwd|passwd|api_key|api-key|APİ_KEY|apı_key|"
    "secretkey|acceſſ_token|bearer|toKen|EMP|emp|Employee ID|employeeid|ABCDE1234F|XYZAB0000Z|foo|bar.|@|"
    "x.com|mail.co.in|user+tag|4111111111111111|4111-1111-1111-1111|4111 1111 1111 1111|5500000000000004|"
    "1234 5678 9012|987654321012|919876543210|+91-9876543210|6123456789|123456789|hunter22|'|\"|:|=|#|-| |  |\n|\t|"
    "\x1c|\x1f|\xa0| |,|.|é|é|\xb2|\xbd|Ⅷ|\U0001d400|\U0001d7d7|٣|٤٥٦٧|"
    "\U0001f600|_|‿|‍|\xdf|K|ı|İ|abcdefghijklmnopqrstuv|0|7|9|12|00000|\r\n| |\x85|᠎"
).split("|")


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [
        "".join(rng.choice(ATOMS) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 60))) for _ in range(n)
    ]


def scan(spark, texts, **kwargs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = detect(docs, **kwargs).select("doc_id", "findings", mask_text("text", "findings").alias("masked"))
    return {
        r.doc_id: ([(f.start, f.category, f.end, f.value, f.masked_value) for f in r.findings], r.masked)
        for r in found.collect()
    }


def check_spans(text, found):
    """Values are what stands at their offsets, and findings come in order."""
    assert all(text[start:end].strip() == value for start, _, end, value, _ in found)
    assert [f[:2] for f in found] == sorted(f[:2] for f in found)


def test_golden_texts(spark):
    got = scan(spark, [t for t, _ in GOLDEN_TEXTS])
    for i, (text, masked) in enumerate(GOLDEN_TEXTS):
        assert got[i][1] == masked
        check_spans(text, got[i][0])
    spans = [f[:3] for f in got[4][0]]
    assert spans == [(5, "Aadhaar", 19), (5, "Credit Card", 24), (28, "Aadhaar", 42)]


def test_golden_masks(spark):
    rows = spark.createDataFrame(GOLDEN_MASKS, "category string, value string, want string")
    got = rows.select("category", "value", "want", mask_value("category", "value").alias("got")).collect()
    assert [(r.category, r.value, r.got) for r in got] == [(r.category, r.value, r.want) for r in got]


def test_joint_patterns_change_no_result(spark):
    texts = random_texts(11, 1500) + ["", "   ", "a"]
    got = scan(spark, texts, prefilter=True)
    assert got == scan(spark, texts, prefilter=False)
    for i, text in enumerate(texts):
        check_spans(text, got[i][0])


def test_long_text_with_many_overlapping_findings(spark):
    line = "4111 1111 1111 1111 or a{0}@x.co pwd=abc{0}zz. 919876543210\n"
    text = "".join(line.format(i) for i in range(3000))
    got = scan(spark, [text])
    assert len(got[0][0]) > 10000
    check_spans(text, got[0][0])
    assert "4111 1111" not in got[0][1] and "pwd=abc0zz" not in got[0][1]


def test_finding_invariants(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = explode_findings(detect(docs), "doc_id", "text")
    bad = rows.where(F.expr("substring(text, start + 1, end - start) <> value"))
    assert bad.count() == 0
    assert rows.groupBy("doc_id", "category", "start", "end").count().where("count > 1").count() == 0


def test_null_text_has_no_findings(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert detect(docs).first().findings == []


def test_user_rules(spark):
    extra = rule_from_row({"category": "Ticket", "before": "ticket ", "body": "[0-9]+", "ignore_case": True, "weight": 7})
    docs = spark.createDataFrame([(1, "see TICKET 4711, EMP-12345")], "doc_id long, text string")
    got = [(f.category, f.value, f.start) for f in detect(docs, with_rules(extra)).first().findings]
    assert got == [("Ticket", "4711", 11), ("Employee ID", "EMP-12345", 17)]
    strict = with_rules(Rule("Employee ID", before="Employee ID: ", body="E[0-9]+"))
    assert len(strict) == len(RULES)
    docs = spark.createDataFrame([(1, "employee Employee ID: E1234")], "doc_id long, text string")
    assert [f.value for f in detect(docs, strict).first().findings] == ["E1234"]


def test_category_filters(spark):
    docs = spark.createDataFrame([(1, "a@x.co ABCDE1234F EMP-12345")], "doc_id long, text string")
    rows = explode_findings(detect(docs), "doc_id")
    chosen = spark.createDataFrame([("PAN",)], "category string")
    assert filter_categories(rows, ["PAN", "Email"]).count() == 2
    assert filter_categories(rows, []).count() == 3
    assert filter_categories_by(rows, chosen).count() == 1
    assert filter_categories_by(rows, chosen.where("false")).count() == 3


def test_sheet_keeps_columns_when_empty(spark):
    docs = spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")
    sheet = findings_sheet(explode_findings(detect(docs), "doc_id"))
    assert sheet.columns == ["Category", "Value", "Masked Value", "Start", "End", "Confidence"]
    assert sheet.count() == 0


def test_scan_is_one_map_side_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_of(explode_findings(detect(docs.select("doc_id", "text")), "doc_id").where("category = 'PAN'"))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    for rule in RULES:
        assert plan.count("regexp_extract_all") == len(RULES) + 2 * sum(r.grouped for r in RULES)
        assert rule.pattern in plan


def test_filters_on_other_columns_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_of(detect(docs.select("doc_id", "text", "lang")).where("lang = 'en'"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [("Ticket", "T-[0-9]+", 3, True, None), ("Badge", "B[0-9]{4}", 1, False, "edges")],
        "category string, body string, weight int, critical boolean, mask string",
    )
    rules = rules_from_table(table)
    assert [(r.category, r.weight, r.critical) for r in rules] == [("Badge", 1, False), ("Ticket", 3, True)]
    docs = spark.createDataFrame([(1, "T-42 and B1234")], "doc_id long, text string")
    assert [f.value for f in detect(docs, rules).first().findings] == ["T-42", "B1234"]


def test_counts_equal_those_of_findings(spark):
    texts = [*(t for t, _ in GOLDEN_TEXTS), "4111 1111 1111 1111 and 4111 1111 1111 1112, a@b.example", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = {r.doc_id: r.counts for r in detect_counts(docs).collect()}
    for row in detect(docs).collect():
        want = {}
        for f in row.findings:
            want[f.category] = want.get(f.category, 0) + 1
        assert counted[row.doc_id] == want
    plan = detect_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "masked_value" not in plan and "array_sort" not in plan


def test_a_pattern_walks_a_text_once(spark):
    """One replacement marks matches and groups; extraction and splitting are left for texts that hold the mark."""
    docs = spark.createDataFrame([(1, "pwd: hunter22x"), (2, None), (3, "")], "doc_id long, text string")
    assert plan_of(detect(docs)).count("regexp_replace(text#") == len(RULES)


def test_texts_that_hold_the_mark(spark):
    odd = [t.replace(" ", "\ue000 ", 2) for t in random_texts(5, 200)] + ["\ue000", "\ue000pwd: hunter22x\ue000 a@x.co"]
    plain = [t.replace("\ue000", "\ue001") for t in odd]
    found, same = scan(spark, odd), scan(spark, plain)
    assert {i: ([(s, c, e, v.replace("\ue000", "\ue001"), m.replace("\ue000", "\ue001")) for s, c, e, v, m in f], t.replace("\ue000", "\ue001")) for i, (f, t) in found.items()} == same
