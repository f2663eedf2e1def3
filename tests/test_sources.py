from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tests.conftest import plan_of
from veilscan.functions import text as T
from veilscan.operators.dedupe import copies, first_copies
from veilscan.plans.analysis import analyze, with_playbook, with_report
from veilscan.session import work_dir
from veilscan.sources.audit import append_audit, audit_csv, audit_rollup, audit_rows, export_csv, read_audit, read_audit_csv, write_reports
from veilscan.sources.pages import assemble_pages
from veilscan.sources.tables import read_csv_table, rows_as_text
from veilscan.sources.uploads import extract_uploads, read_uploads, rejected_uploads
from veilscan.streaming.incremental import read_table, scan_documents, scan_uploads, stream_documents, stream_uploads


def write_files(folder, files):
    for name, data in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


FILES = {
    "a.txt": "Grüße von bob@x.co".encode(),
    "sub/b.TXT": "café 9876543210".encode("latin-1"),
    "c.csv": b'name,card\r\n"Ann",4111111111111111\r\n"B, C",0012\r\n\r\n',
    "ragged.csv": b"a,b\n1,2\n3,4,5,6\n",
    "empty.csv": b"a,b\n",
    "d.docx": b"PK",
    "e.pdf": b"%PDF",
    "blank.txt": b" \n\t ",
    "copy.txt": "Grüße von bob@x.co".encode(),
}


def test_file_names(spark):
    names = [
        ("a.pdf", ".pdf"), ("x/y.TXT", ".txt"), (".pdf", ""), ("a.tar.gz", ".gz"), ("dot.", ""), ("none", ""),
        ("dir.d/none", ""), ("a.b/", ".b"),
    ]
    rows = spark.createDataFrame(names, "p string, want string")
    assert all(r.want == r.got for r in rows.withColumn("got", T.file_extension(F.col("p"))).collect())
    rows = spark.createDataFrame([("a b/c.txt", "a_b_c.txt"), ("__x  y__", "x_y"), ("é", ""), ("", "")], "p string, want string")
    assert all(r.want == r.got for r in rows.withColumn("got", T.safe_filename(F.col("p"))).collect())


def test_validation_order(spark):
    rows = spark.createDataFrame([("a.exe", 1 << 40), ("a.txt", (20 << 20) + 1), ("a.txt", 20 << 20)], "p string, n long")
    got = [r[0] for r in rows.select(T.upload_error(F.col("p"), F.col("n"))).collect()]
    assert got == ["Unsupported file type. Allowed types: .pdf, .txt, .csv.", "File is too large. Maximum size is 20 MB.", None]


def test_truncate(spark):
    row = spark.createDataFrame([("abcdef",)], "t string").select(T.truncate(F.col("t"), 3), T.truncate(F.col("t"), 6)).first()
    assert tuple(row) == ("abc\n\n[Content truncated for model context limit.]", "abcdef")


def test_luhn_of_any_script(spark):
    rows = spark.createDataFrame(
        [("4111 1111-1111 1111", True), ("4111111111111112", False), ("٤" + "١" * 15, True), ("0000", False), ("\U0001d7d2" + "1" * 15, True)],
        "v string, want boolean",
    )
    assert all(r.want == r.got for r in rows.withColumn("got", T.passes_luhn("v")).collect())


def test_uploads(spark, tmp_path):
    write_files(tmp_path, FILES)
    uploads = read_uploads(spark, str(tmp_path))
    rejected = {r.filename: r.error for r in rejected_uploads(uploads).collect()}
    assert list(rejected) == ["d.docx"]
    got = {r.filename: r for r in extract_uploads(uploads).collect()}
    assert got["a.txt"].text == "Grüße von bob@x.co" and got["b.TXT"].text == "café 9876543210"
    assert got["c.csv"].text == 'name,card\nAnn,4111111111111111\n"B, C",0012\n'
    assert got["ragged.csv"].error == "The CSV could not be parsed."
    assert got["empty.csv"].text == "" and got["e.pdf"].error is not None
    status = {r.filename: (r.status, r.counts) for r in analyze(extract_uploads(uploads)).collect()}
    assert status["c.csv"] == ("Success", {"Credit Card": 1})
    assert status["blank.txt"][0] == status["empty.csv"][0]


def test_pdf_files_take_their_pages(spark, tmp_path):
    write_files(tmp_path, FILES)
    uploads = read_uploads(spark, str(tmp_path))
    path = uploads.where("path like '%/e.pdf'").first().path
    pages = spark.createDataFrame([(path, 2, "mail bob@x.co"), (path, 1, " first "), (path, 3, None)], "path string, page_no int, text string")
    got = {r.filename: r for r in extract_uploads(uploads, pages=pages).collect()}
    assert sorted(got) == sorted(r.filename for r in extract_uploads(uploads).collect())
    assert got["e.pdf"].text == "first\n\nmail bob@x.co" and got["e.pdf"].error is None
    assert {r.filename: r.status for r in analyze(extract_uploads(uploads, pages=pages)).collect()}["e.pdf"] == "Success"
    without = extract_uploads(uploads, pages=pages.where("false")).where("filename = 'e.pdf'").first()
    assert without.text is None and without.error is not None


def test_page_texts_are_moved_once(spark):
    rows = spark.createDataFrame([(1, 1, "a")], "doc_id long, page_no int, text string")
    plan = plan_of(assemble_pages(rows))
    assert plan.count("Exchange ") == 1, plan


def test_rejected_files_are_not_read(spark, tmp_path):
    write_files(tmp_path, {"x.bin": b"1"})
    plan = plan_of(rejected_uploads(read_uploads(spark, str(tmp_path))))
    assert "content" not in plan.split("ReadSchema")[1]


def test_page_assembly_keeps_order_across_pieces(spark):
    pages = [(1, i, f"  p{i}\n") for i in range(700)] + [(1, 700, " \t"), (2, 0, "\xa0"), (3, 5, "b"), (3, -1, "a"), (3, 2, None)]
    rows = spark.createDataFrame(pages, "doc_id long, page_no int, text string").repartition(5)
    got = {r.doc_id: (r.text, r.pages) for r in assemble_pages(rows).collect()}
    assert got == {1: ("\n\n".join(f"p{i}" for i in range(700)), 700), 2: ("", 0), 3: ("a\n\nb", 2)}


def test_table_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note\n007,"call 9876543210, now"\n8,\n')
    table = read_csv_table(spark, str(tmp_path / "t.csv"))
    got = {r.id: r.text for r in rows_as_text(table, "id").collect()}
    assert got == {"007": '007,"call 9876543210, now"', "8": "8,"} or got["8"] in ("8,", '8,""')


def test_dedupe(spark):
    rows = [(i, "same") for i in range(1000)] + [(i, f"t{i}") for i in range(1000, 1010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id for r in first_copies(docs).collect()} == {0, *range(1000, 1010)}
    plan = plan_of(first_copies(docs))
    assert "LeftAnti" in plan and "NestedLoop" not in plan
    odd = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x"), (5, "")], "doc_id long, text string")
    assert {r.doc_id for r in first_copies(odd).collect()} == {1, 3, 5}
    assert copies(docs).agg(F.max("copies")).first()[0] == 1000
    assert plan_of(copies(docs)).count("HashAggregate") == 2


def test_audit_log(spark, tmp_path):
    docs = spark.createDataFrame([("x,1.txt", 'a@x.co'), ("blank.txt", " ")], "filename string, text string")
    ts = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9))
    audit = audit_rows(analyze(docs), ts=ts, processing_time=F.lit(0.4194))
    got = {r.Filename: tuple(r) for r in audit_csv(audit).collect()}
    stamp = got["x,1.txt"][0]
    assert len(stamp) == 20 and stamp.endswith("Z")
    assert got["x,1.txt"][1:] == ("x,1.txt", "Low", "1", '{"Email": 1}', "0.419", "Success")
    assert got["blank.txt"][2:5] == ("Unknown", "0", "{}")
    for run in ("a", "b", "a"):  # a run that is tried again replaces its rows
        export_csv(audit, str(tmp_path / "csv"), run)
    back = read_audit_csv(spark, str(tmp_path / "csv"))
    assert back.count() == 4
    row = back.where("filename = 'x,1.txt'").first()
    assert row.detection_counts == {"Email": 1} and row.ts == audit.first().ts and row.processing_time == 0.419
    for run in ("a", "b", "a"):
        append_audit(audit, str(tmp_path / "table"), run)
    roll = audit_rollup(read_audit(spark, str(tmp_path / "table"))).first()
    assert (roll.scans, roll.failures, roll.low, roll.high, roll.median_time) == (4, 2, 2, 0, 0.4194)


def test_rollup_has_exact_times(spark):
    import statistics

    times = {"a": [0.1, 0.5, 0.2, 0.9, None], "b": [0.3] * 7 + [0.1] * 3 + [2.0], "c": [None], None: [0.25, 0.5]}
    rows = [(k, "Low", 1, t, "Success" if t else "Failure: x") for k, some in times.items() for t in some]
    audit = spark.createDataFrame(rows, "who string, risk_level string, risk_score int, processing_time double, status string")
    for r in audit_rollup(audit, "who").collect():
        known = [t for t in times[r.who] if t is not None]
        assert (r.scans, r.failures) == (len(times[r.who]), len(times[r.who]) - len(known))
        assert r.median_time == (statistics.median(known) if known else None)
        assert r.mean_time is None if not known else abs(r.mean_time - statistics.mean(known)) < 1e-12
    assert audit_rollup(audit).first().median_time == statistics.median([t for some in times.values() for t in some if t])


def test_report_table(spark, tmp_path):
    docs = spark.createDataFrame([("my file.txt", "a@x.co")], "filename string, text string")
    for _ in range(2):
        write_reports(with_report(with_playbook(analyze(docs))), str(tmp_path / "r"), "one")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    assert spark.read.parquet(str(tmp_path / "r")).first().report_file == "compliance_playbook_my_file.txt.txt"


def test_upload_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write_files(source, FILES)
    scan_uploads(stream_uploads(spark, str(source)), out).awaitTermination()
    results = read_table(spark, out, "results")
    names = sorted(r.filename for r in results.collect())
    assert "d.docx" not in names and len([n for n in names if n in ("a.txt", "copy.txt")]) == 1
    batch = analyze(extract_uploads(read_uploads(spark, str(source)))).where(F.col("filename").isin(*names))
    cols = ["path", "status", "risk_level", "risk_score"]
    assert sorted(map(tuple, results.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert read_table(spark, out, "rejected").count() == 1
    assert read_table(spark, out, "audit").count() == len(names)
    write_files(source, {"new.txt": b"EMP-12345", "again.txt": FILES["a.txt"]})
    scan_uploads(stream_uploads(spark, str(source)), out).awaitTermination()
    after = sorted(r.filename for r in read_table(spark, out, "results").collect())
    assert after == sorted([*names, "new.txt"])
    assert read_table(spark, out, "findings").where("value = 'EMP-12345'").count() == 1


def test_document_stream_in_small_batches(spark, sf_dir, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(source)
    stream = stream_documents(spark, source, "doc_id long, text string", max_files=1)
    scan_documents(stream, out).awaitTermination()
    results = read_table(spark, out, "results")
    assert results.count() == docs.select("text").distinct().count()
    assert results.join(docs, "doc_id").select("text").distinct().count() == results.count()


def test_each_batch_touches_its_own_contents_only(spark, tmp_path):
    """Copies in later batches add no rows anywhere, and nothing but the state knows earlier batches."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    for k in range(4):
        rows = [(10 * k + i, f"text {i if i < 3 else 100 * k + i} bob{i}@x.co") for i in range(5)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = stream_documents(spark, str(source), "doc_id long, text string", max_files=1)
    query = scan_documents(stream, out)
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    state = [p["stateOperators"][0] for p in progress]
    assert len(progress) == 4 and [s["numRowsTotal"] for s in state] == [5, 7, 9, 11]
    sizes = {r.batch_id: r.n for r in spark.read.parquet(f"{out}/seen").groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 5, 1: 2, 2: 2, 3: 2}
    assert read_table(spark, out, "results").count() == read_table(spark, out, "findings").count() == 11
    # nothing new: the same stream again does no batch, and a folder of copies only yields no rows
    spark.createDataFrame([(99, "text 0 bob0@x.co")], "doc_id long, text string").write.mode("append").parquet(str(source))
    scan_documents(stream_documents(spark, str(source), "doc_id long, text string", max_files=1), out).awaitTermination()
    assert read_table(spark, out, "results").count() == 11


def test_retried_batch_replaces_its_rows(spark, sf_dir, tmp_path):
    from veilscan.settings import DEFAULT_OPTIONS, RULES
    from veilscan.streaming.incremental import scan_batch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("filename", F.lit("f"))
    for _ in range(2):
        scan_batch(docs, "doc_id", str(tmp_path), 0, RULES, DEFAULT_OPTIONS)
    assert read_table(spark, str(tmp_path), "results").count() == docs.count()


def test_work_dir_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_dir(spark), work_dir(spark)
    assert first != second
    if shared is not None:
        assert first.startswith(shared.rstrip("/") + "/")
