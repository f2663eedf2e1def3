"""The registered queries: one or more per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions import text as T
from veilscan.functions.counts import counts_json, counts_text, total
from veilscan.functions.masking import mask_value
from veilscan.functions.patterns import rule_hits
from veilscan.operators.dedupe import copies, first_copies, first_keys
from veilscan.operators.detect import (
    detect,
    detect_counts,
    distinct_categories,
    explode_findings,
    filter_categories,
    filter_categories_by,
    findings_sheet,
)
from veilscan.operators.corpus_search import build_sentence_index
from veilscan.operators.corpus_search import corpus_sentences as best_of_corpus
from veilscan.operators.questions import answer_questions, relevant_sentences, route_by_words, with_sentences
from veilscan.operators.questions import answers_with_fallback as coalesced_answers
from veilscan.operators.retrieval import (
    chunk_text,
    nearest_chunks,
    pack_text,
    question_context,
    question_requests,
)
from veilscan.operators.risk import (
    category_breakdown,
    category_counts,
    counts_long,
    label_categories,
    risk_from_counts,
    risk_level_mix,
    with_theme,
)
from veilscan.operators.risk import counts_table as shown_counts
from veilscan.operators.vector_index import fit_index, indexed_chunks, nearest_indexed
from veilscan.plans import corpora as C
from veilscan.plans.analysis import (
    analyze,
    assess,
    failed,
    model_requests,
    succeeded,
    totals,
    with_playbook,
    with_report,
)
from veilscan.session import work_dir
from veilscan.settings import RULES, Options, Rule, category_dim, rules_from_table, with_rules
from veilscan.sources.audit import append_audit, audit_csv, audit_rollup, audit_rows, read_audit, read_audit_csv, write_reports
from veilscan.sources.pages import assemble_pages
from veilscan.sources.tables import rows_as_text
from veilscan.sources.uploads import extract_uploads, read_uploads, rejected_uploads
from veilscan.streaming.incremental import (
    read_table,
    scan_documents,
    scan_uploads,
    stream_documents,
    stream_uploads,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rules_named(*names: str) -> tuple[Rule, ...]:
    return tuple(r for r in RULES if r.category in names)


def found_in(docs: DataFrame, *rules: Rule) -> DataFrame:
    return explode_findings(detect(docs, rules or RULES), "doc_id")


# --- detection ---------------------------------------------------------------------


@query
def findings_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in(C.documents(spark, sf_dir), *rules_named("Email"))


@query
def findings_credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in(C.documents(spark, sf_dir), *rules_named("Credit Card"))


@query
def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in(C.augmented(spark, sf_dir))


@query
def findings_sheet_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_sheet(found_in(C.mixed(spark, sf_dir)), "doc_id")


@query
def findings_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as documents."""
    pages = C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return found_in(pages)


@query
def luhn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card-shaped run with the outcome of its check."""
    card = rules_named("Credit Card")[0]
    runs = C.documents(spark, sf_dir).select(
        "doc_id", F.explode(rule_hits("text", card)).alias("value")
    )
    return runs.select("doc_id", "value", T.passes_luhn("value").alias("is_card"))


@query
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rules next to the built-in ones: counts per category."""
    extra = (
        Rule("US Phone", body=r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", needs=("+1",), mask="digits", weight=2),
        Rule("Quoted Token", before='token = "', body="[^\"]+", after='"', needs=("token",), mask="secret", weight=5),
    )
    rules = with_rules(*extra)
    counts = counts_long(detect_counts(C.documents(spark, sf_dir), rules), "doc_id")
    return category_breakdown(counts, rules=rules)


@query
def custom_rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same user rules, loaded from a rule table."""
    table = spark.createDataFrame(
        [
            ("US Phone", None, r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", None, ["+1"], "digits", 2),
            ("Quoted Token", 'token = "', "[^\"]+", '"', ["token"], "secret", 5),
        ],
        "category string, before string, body string, after string, needs array<string>, mask string, weight int",
    )
    rules = with_rules(*rules_from_table(table))
    counts = counts_long(detect_counts(C.documents(spark, sf_dir), rules), "doc_id")
    return category_breakdown(counts, rules=rules)


@query
def findings_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filter_categories(found_in(C.augmented(spark, sf_dir)), ["PAN", "Password"])
    return kept.select("doc_id", "category", "masked_value")


@query
def findings_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection as a table: the categories rated Critical."""
    findings = found_in(C.mixed(spark, sf_dir))
    kept = filter_categories_by(findings, category_dim(spark).where("severity = 'Critical'"))
    return kept.select("doc_id", "category", "value")


@query
def findings_none_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty selection keeps everything."""
    findings = found_in(C.mixed(spark, sf_dir))
    kept = filter_categories_by(findings, category_dim(spark).where("severity = 'Unheard of'"))
    return kept.select("doc_id", "category", "value")


@query
def distinct_category_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_categories(found_in(C.augmented(spark, sf_dir)))


# --- masking -----------------------------------------------------------------------


@query
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks by a category column: each customer name masked in every style."""
    names = [r.category for r in RULES] + ["Other"]
    people = C.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.explode(F.array(*[F.lit(n) for n in names])).alias("category"),
        F.expr("concat(c_mktsegment, '.', c_custkey, '@mail', c_nationkey, '.example')").alias("value"),
    )
    return people.select(
        "c_custkey", "category", mask_value("category", "value").alias("masked_value")
    )


def _masked(docs: DataFrame) -> DataFrame:
    return analyze(docs).select(
        "doc_id", F.md5("masked_text").alias("masked_md5"), F.length("masked_text").alias("masked_length")
    )


@query
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(C.documents(spark, sf_dir))


@query
def masked_text_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(C.augmented(spark, sf_dir))


@query
def masked_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of different overlapping findings, replaced from the right one after the other."""
    return _masked(C.overlapping(spark, sf_dir))


# --- counts and risk ---------------------------------------------------------------


@query
def doc_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_long(detect_counts(C.mixed(spark, sf_dir)), "doc_id")


@query
def corpus_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus-wide breakdown."""
    return category_breakdown(counts_long(detect_counts(C.augmented(spark, sf_dir)), "doc_id"))


@query
def doc_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_breakdown(counts_long(detect_counts(C.mixed(spark, sf_dir)), "doc_id"), "doc_id")


@query
def breakdown_zero_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counts table with a row for every rule; those that count nothing are left out."""
    names = F.array(*[F.lit(r.category) for r in RULES])
    every = detect_counts(C.mixed(spark, sf_dir)).select("doc_id", "counts", F.explode(names).alias("category"))
    counts = every.select("doc_id", "category", F.expr("coalesce(counts[category], 0)").alias("n"))
    return category_breakdown(counts, "doc_id")


@query
def lang_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = detect_counts(C.mixed(spark, sf_dir, "lang"))
    return category_breakdown(counts_long(results, "lang"), "lang")


@query
def doc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(assess(C.documents(spark, sf_dir))).select(
        "doc_id", "total_findings", "risk_level", "risk_score", "risk_reason"
    )


@query
def doc_risk_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(assess(C.mixed(spark, sf_dir))).select(
        "doc_id", "total_findings", "risk_level", "risk_score", "risk_reason"
    )


@query
def risk_from_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk from the stored long findings table instead of the nested array."""
    docs = C.mixed(spark, sf_dir)
    counts = category_counts(found_in(docs), "doc_id")
    # documents without findings are Low with score 0
    every = docs.select("doc_id").join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return risk_from_counts(every, "doc_id")


@query
def risk_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_level_mix(assess(C.documents(spark, sf_dir)))


@query
def risk_mix_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_level_mix(assess(C.mixed(spark, sf_dir, "lang")), "lang")


@query
def severity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = found_in(C.augmented(spark, sf_dir)).select("doc_id", "category", "start")
    return label_categories(findings).select("doc_id", "category", "start", "label", "severity", "weight", "critical")


@query
def risk_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = assess(C.with_blanks(spark, sf_dir))
    return with_theme(results).select("doc_id", "risk_level", "level_label", "tone")


# --- texts -------------------------------------------------------------------------


@query
def counts_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = "counts"
    return detect_counts(C.mixed(spark, sf_dir)).select(
        "doc_id", counts_text(counts).alias("counts_text"), counts_json(counts).alias("counts_json")
    )


@query
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_playbook(analyze(C.mixed(spark, sf_dir))).select("doc_id", "summary")


@query
def constant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_playbook(assess(C.mixed(spark, sf_dir))).select("doc_id", "context")


@query
def playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.col("playbook")
    return with_playbook(analyze(C.mixed(spark, sf_dir))).select(
        "doc_id",
        F.array_join(book["observations"], "\n").alias("observations"),
        F.array_join(book["risks"], "\n").alias("risks"),
        F.array_join(book["remediation"], "\n").alias("remediation"),
    )


@query
def playbook_with_model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and context supplied as columns, here taken from the documents themselves."""
    results = analyze(C.mixed(spark, sf_dir)).withColumns({
        "summary": F.expr(
            "case when doc_id % 3 = 0 then concat('Intro. SECURITY  RISKS: ', text) "
            "when doc_id % 3 = 1 then concat('Intro. Security\\nRisks: ', text, ' suggested remediation: none') "
            "else text end"
        ),
        "context": F.expr(
            "case when doc_id % 2 = 0 then text else concat('Trade Secret:\\n None  identified ', doc_id) end"
        ),
    })
    book = F.col("playbook")
    return with_playbook(results).select(
        "doc_id", book["risks"][2].alias("summary_risk"), F.md5(book["observations"][2]).alias("context_md5")
    )


@query
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = analyze(C.mixed(spark, sf_dir)).withColumn("filename", F.expr("concat('doc ', doc_id, '.txt')"))
    return with_report(with_playbook(named)).select(
        "doc_id", F.concat(F.lit("compliance_playbook_"), T.safe_filename(F.col("filename")), F.lit(".txt")).alias("report_file"), "report"
    )


@query
def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = model_requests(analyze(C.documents(spark, sf_dir)))
    return requests.select("doc_id", "kind", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_length"))


@query
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = T.compact(F.col("text"))
    return C.documents(spark, sf_dir).select(
        "doc_id", F.md5(flat).alias("compact_md5"), F.length(T.truncate(F.col("text"), 1000)).alias("clipped_length")
    )


# --- files, tables, audit ----------------------------------------------------------


@query
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("safe_name"))


@query
def extension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = C.table(spark, sf_dir, "pages").select(
        "page_id",
        F.expr(
            "concat(url, case page_id % 7 when 0 then '/a.pdf' when 1 then '/B.TXT' when 2 then '/c.csv' "
            "when 3 then '/d.docx' when 4 then '/.pdf' when 5 then '/e.tar.gz' else '' end)"
        ).alias("name"),
        F.expr("length(html) * 8000").alias("size"),
    )
    return named.select(
        "page_id",
        T.file_extension(F.col("name")).alias("extension"),
        T.upload_error(F.col("name"), F.col("size")).alias("error"),
    )


@query
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents as UTF-8 bytes, half as Latin-1 bytes."""
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    )
    return C.documents(spark, sf_dir).select("doc_id", content.alias("content")).select(
        "doc_id", F.md5(T.decode_text(F.col("content"))).alias("text_md5")
    )


@query
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(C.documents(spark, sf_dir))


@query
def first_copy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return docs.select("doc_id", F.length("text").alias("chars")).join(first_keys(docs), "doc_id", "left_semi")


@query
def first_copy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows of the first documents of each content."""
    return first_copies(C.documents(spark, sf_dir, "lang")).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query
def blank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed(assess(C.with_blanks(spark, sf_dir))).select("doc_id", "status", "risk_level", "risk_score")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = C.with_blanks(spark, sf_dir).withColumn("filename", F.expr("concat('doc-', doc_id, '.txt')"))
    return audit_rows(assess(named), "lang")


@query
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_csv(_audit(spark, sf_dir))
    return log.select(
        F.col("Filename").alias("filename"),
        F.col("Risk Level").alias("risk_level"),
        F.col("Risk Score").alias("risk_score"),
        F.col("Detection Counts").alias("detection_counts"),
        F.col("Status").alias("status"),
    )


@query
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rollup(_audit(spark, sf_dir), "lang").select(
        "lang", "scans", "failures", "high", "medium", "low", F.round("mean_score", 6).alias("mean_score")
    )


@query
def audit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as CSV files and read back into a typed table."""
    folder = f"{work_dir(spark)}/audit"
    audit_csv(_audit(spark, sf_dir)).write.csv(folder, header=True, escape='"')
    back = read_audit_csv(spark, folder)
    return back.groupBy("risk_level", "status").agg(
        F.count(F.lit(1)).alias("scans"),
        F.sum("risk_score").alias("total_score"),
        F.sum(total("detection_counts")).alias("findings"),
    )


@query
def audit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact mean and median of given times, by language."""
    docs = C.documents(spark, sf_dir, "lang", "n_chars")
    rows = docs.select(
        "lang", F.lit("Low").alias("risk_level"), F.lit(1).alias("risk_score"), F.lit("Success").alias("status"),
        F.expr("case when doc_id % 10 < 9 then n_chars * 0.001D end").alias("processing_time"),
    )
    return audit_rollup(rows, "lang").select(
        "lang", "scans", F.round("mean_time", 6).alias("mean_time"), F.round("median_time", 6).alias("median_time")
    )


@query
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to the audit table, one of them tried again: each leaves its rows once."""
    folder = f"{work_dir(spark)}/audit"
    rows = _audit(spark, sf_dir).drop("lang")
    for run, some in (("first", "risk_score = 0"), ("second", "risk_score > 0"), ("first", "risk_score = 0")):
        append_audit(rows.where(some), folder, run)
    return read_audit(spark, folder).groupBy("run", "risk_level").agg(
        F.count(F.lit(1)).alias("scans"), F.sum("risk_score").alias("total_score"), F.sum(total("detection_counts")).alias("findings")
    )


@query
def pages_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, conversations as PDF files with a page table; every ninth PDF file has no pages."""
    texts = C.mixed(spark, sf_dir).select(F.expr("concat('/in/doc-', doc_id, '.txt')").alias("path"), F.encode("text", "UTF-8").alias("content"))
    pages = C.conversation_pages(spark, sf_dir).select(F.expr("concat('/in/scan ', doc_id, '.pdf')").alias("path"), "doc_id", "page_no", "text")
    scans = pages.select("path").distinct().select("path", F.encode(F.lit("%PDF"), "UTF-8").alias("content"))
    uploads = texts.unionByName(scans).withColumn("length", F.length("content").cast("long"))
    files = extract_uploads(uploads, pages=pages.where("doc_id % 9 != 0").drop("doc_id"))
    return totals(assess(files)).select("filename", "total_findings", "risk_level", "risk_score", "status")


@query
def counts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of each document as they are shown, by category."""
    return shown_counts(counts_long(detect_counts(C.mixed(spark, sf_dir)), "doc_id"), "doc_id")


#: Other limits and thresholds than the defaults.
STRICT = Options(
    high_threshold=7, medium_min=2, sensitive_count_threshold=2, chunk_size=300, chunk_overlap=40, max_input_chars=200,
)


@query
def options_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk under other thresholds."""
    return totals(assess(C.mixed(spark, sf_dir), options=STRICT)).select(
        "doc_id", "total_findings", "risk_level", "risk_score", "risk_reason"
    )


@query
def options_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of another size."""
    return chunk_text(C.documents(spark, sf_dir), options=STRICT).select(
        "doc_id", "chunk_no", "start", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5")
    )


@query
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_pages(C.conversation_pages(spark, sf_dir)).select(
        "doc_id", "pages", F.md5("text").alias("text_md5"), F.length("text").alias("text_length")
    )


@query
def table_row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with contact columns, scanned row by row."""
    people = C.table(spark, sf_dir, "customer").withColumns({
        "phone": F.expr(f"concat('+91 ', {C.phone_number('c_custkey')})"),
        "pan": F.expr(f"concat('ABCDE', {C.padded('c_custkey', 4)}, 'F')"),
        "mail": F.expr("concat('user', c_custkey, '@mail.example')"),
    })
    return explode_findings(detect(rows_as_text(people, "c_custkey")), "c_custkey").drop("confidence")


@query
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as a table of files and read back."""
    folder = f"{work_dir(spark)}/reports"
    named = analyze(C.mixed(spark, sf_dir)).withColumn("filename", F.expr("concat('doc ', doc_id, '.txt')"))
    write_reports(with_report(with_playbook(named)), folder, "one")
    return spark.read.parquet(folder).select("report_file", F.md5("report").alias("report_md5"))


def _derived_files(spark: SparkSession, sf_dir: str, csv_folders: tuple[str, ...] = ("csv",)) -> str:
    """A folder of CSV, TXT and JSON files that Spark writes from three tables."""
    folder = work_dir(spark)
    people = C.table(spark, sf_dir, "customer").select(
        "*", F.expr(f"concat('call +91 ', {C.phone_number('c_custkey')}, ', please')").alias("note")
    )
    for name in csv_folders:
        people.write.option("maxRecordsPerFile", 20000).csv(f"{folder}/{name}", header=True)
    C.mixed(spark, sf_dir).select("text").write.option("maxRecordsPerFile", 500).text(f"{folder}/txt")
    C.table(spark, sf_dir, "nation").write.json(f"{folder}/json")
    return folder


@query
def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived files as a stream; the CSV files exist twice and count once."""
    folder = _derived_files(spark, sf_dir, ("csv", "again"))
    out = work_dir(spark)
    scan_uploads(stream_uploads(spark, folder), out).awaitTermination()
    results = read_table(spark, out, "results").withColumn("extension", T.file_extension(F.col("path")))
    return counts_long(results, "extension").groupBy("extension", "category").agg(F.sum("n").alias("n"))


@query
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files derived from tables, scanned as uploads: findings per file type."""
    uploads = read_uploads(spark, _derived_files(spark, sf_dir))
    good = extract_uploads(uploads).withColumn("extension", T.file_extension(F.col("path")))
    counts = counts_long(analyze(good), "extension")
    scanned = counts.groupBy("extension", "category").agg(F.sum("n").alias("n"))
    refused = rejected_uploads(uploads).select(
        T.file_extension(F.col("path")).alias("extension"), F.col("error").alias("category"), F.lit(0).alias("n")
    ).distinct()
    return scanned.unionByName(refused)


@query
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, each content once, read back from the result table."""
    out = work_dir(spark)
    # a glob: the table may be one file or a folder of them
    stream = stream_documents(spark, f"{sf_dir}/document[s].parquet", "doc_id long, text string")
    scan_documents(stream, out).awaitTermination()
    return read_table(spark, out, "results").select("doc_id", "risk_level", "risk_score", "status")


@query
def incremental_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents twice, under other ids, as a stream of several batches: each content counts once."""
    folder, out = work_dir(spark), work_dir(spark)
    docs = C.mixed(spark, sf_dir)
    twice = docs.unionByName(docs.withColumn("doc_id", -F.col("doc_id") - 1))
    twice.repartition(8, "doc_id").write.parquet(folder)
    stream = stream_documents(spark, folder, "doc_id long, text string", max_files=3)
    scan_documents(stream, out).awaitTermination()
    return totals(read_table(spark, out, "results")).groupBy("total_findings", "risk_level", "risk_score").agg(
        F.count(F.lit(1)).alias("contents")
    )


# --- questions and retrieval -------------------------------------------------------


@query
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = analyze(C.documents(spark, sf_dir))
    return chunk_text(masked, text="masked_text").select(
        "doc_id", "chunk_no", "start", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5")
    )


@query
def chunks_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole paragraphs, sentences or words of the masked texts."""
    return pack_text(analyze(C.documents(spark, sf_dir)), text="masked_text").select(
        "doc_id", "start", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5")
    )


@query
def chunks_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank documents have no chunk."""
    return chunk_text(C.with_blanks(spark, sf_dir)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk")).alias("chars")
    )


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_chunks(C.vector_questions(spark, sf_dir), C.vector_rows(spark, sf_dir))
    return near.select("q_id", "rank", F.col("chunk_no").alias("vec_id"), F.round("distance", 5).alias("distance"))


@query
def vector_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every chunk the nearest chunks of its document (itself first), found through the bucket index."""
    chunks = C.vector_rows(spark, sf_dir)
    index = fit_index(chunks)
    asked = chunks.select(F.col("chunk_no").alias("q_id"), "doc_id", F.col("vector").alias("q_vector"))
    near = nearest_indexed(asked, indexed_chunks(chunks, index), index, k=5)
    return near.select("q_id", "rank", F.col("chunk_no").alias("vec_id"), F.round("distance", 5).alias("distance"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_chunks(C.vector_questions(spark, sf_dir), C.vector_rows(spark, sf_dir))
    wanted = C.table(spark, sf_dir, "documents").select("doc_id", "text").join(
        near.select(F.col("chunk_no").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    texts = analyze(wanted).select(F.col("doc_id").alias("chunk_no"), F.col("masked_text").alias("chunk"))
    passages = C.vector_rows(spark, sf_dir).select("doc_id", "chunk_no").join(texts, "chunk_no")
    return question_context(near, passages)


@query
def vector_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select(
        "q_id", F.md5("context").alias("context_md5"), F.size("sources").alias("n_sources")
    )


@query
def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model request of every vector question."""
    asked = C.vector_questions(spark, sf_dir).select(
        "q_id", F.expr("concat(' Which topics does collection ', q_id, ' cover? ')").alias("question")
    )
    requests = question_requests(_contexts(spark, sf_dir), asked)
    return requests.select("q_id", "kind", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_length"))


@query
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.user_turns(spark, sf_dir).select(
        "q_id", F.array_join(F.array_sort(T.search_terms("question")), " ").alias("terms")
    )


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.sentences("text")
    return C.documents(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("pos", "sentence")).where(
        ~T.is_blank(F.col("sentence"))
    ).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(T.compact(F.col("sentence")))).alias("chars")
    )


@query
def question_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.routed_questions(spark, sf_dir).select(
        "q_id", F.coalesce(route_by_words(F.col("question")), F.lit("text")).alias("route")
    )


def _asked(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Results of the documents that have a question; others are not analysed."""
    return succeeded(analyze(docs.join(questions.select("doc_id"), "doc_id", "left_semi")))


@query
def relevant_sentence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = C.user_turns(spark, sf_dir)
    results = with_sentences(_asked(questions, C.documents(spark, sf_dir)))
    best = relevant_sentences("question")
    return questions.join(results, "doc_id").select("q_id", F.posexplode(best).alias("pos", "_b")).select(
        "q_id", (F.col("pos") + 1).alias("rank"), "_b.score", "_b.sentence"
    )


@query
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = C.routed_questions(spark, sf_dir)
    docs = C.mixed(spark, sf_dir)
    results = with_playbook(_asked(questions, docs))
    return answer_questions(questions, results, loaded=docs.where(~T.is_blank(F.col("text")))).select(
        "q_id", "route", "answer", F.size("sources").alias("n_sources"),
        F.md5(F.array_join("sources", "\n")).alias("sources_md5"),
    )


@query
def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question about the whole corpus."""
    index = build_sentence_index(analyze(C.documents(spark, sf_dir)), work_dir(spark))
    return best_of_corpus(C.user_turns(spark, sf_dir), index).select("q_id", "rank", "score", "doc_id", "sentence")


@query
def answers_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with an answer from retrieved chunks where there is one: the assistant's turn, for documents with vectors."""
    questions, docs = C.routed_questions(spark, sf_dir), C.mixed(spark, sf_dir)
    replies = C.table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("q_id"), F.col("text").alias("answer")
    )
    contexts = _contexts(spark, sf_dir).select(F.col("q_id").alias("doc_id"), "sources")
    retrieved = questions.select("q_id", "doc_id").join(contexts, "doc_id").join(replies, "q_id", "left").select("q_id", "answer", "sources")
    results = with_playbook(_asked(questions, docs))
    answers = coalesced_answers(questions, retrieved, results, loaded=docs.where(~T.is_blank(F.col("text"))))
    return answers.select("q_id", "provenance", "route", F.md5("answer").alias("answer_md5"), F.size("sources").alias("n_sources"))
