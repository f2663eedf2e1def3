"""The audit log: rows for analysed documents, its table, its CSV form, a roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.functions.counts import counts_json

AUDIT_SCHEMA = (
    "ts timestamp, filename string, risk_level string, risk_score int, "
    "detection_counts map<string,int>, processing_time double, status string"
)
# Column names and formats of the CSV log.
CSV_COLUMNS = (
    "Timestamp", "Filename", "Risk Level", "Risk Score", "Detection Counts", "Processing Time", "Status",
)
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def audit_rows(
    results: DataFrame, *keys: str, ts: Column | None = None, processing_time: Column | None = None
) -> DataFrame:
    """One audit row per result; failures carry level Unknown, score 0 and no counts.

    ``processing_time`` is NULL unless the caller has measured it.
    """
    return results.select(
        *keys,
        (F.current_timestamp() if ts is None else ts).alias("ts"),
        "filename",
        "risk_level",
        "risk_score",
        F.col("counts").alias("detection_counts"),
        (F.lit(None) if processing_time is None else processing_time).cast("double").alias("processing_time"),
        "status",
    )


def append_audit(audit: DataFrame, path: str, run: str) -> None:
    """Append the rows of a run to the audit table, partitioned by run and day.

    A run owns its folder and replaces it, so that a run that is tried again after a failure leaves its rows once.
    """
    audit.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/run={run}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit table over all runs, with its ``run``."""
    return spark.read.schema(f"{AUDIT_SCHEMA}, run string, day date").parquet(path).drop("day")


def audit_csv(audit: DataFrame) -> DataFrame:
    """The log in its text form, all columns strings."""
    utc = F.to_utc_timestamp("ts", F.current_timezone())
    values = (
        F.date_format(utc, TIMESTAMP_FORMAT),
        F.col("filename"),
        F.col("risk_level"),
        F.col("risk_score").cast("string"),
        counts_json("detection_counts"),
        F.when(F.col("processing_time").isNotNull(), F.format_string("%.3f", F.col("processing_time"))),
        F.col("status"),
    )
    return audit.select(*[v.alias(name) for v, name in zip(values, CSV_COLUMNS)])


def export_csv(audit: DataFrame, path: str, run: str) -> None:
    """Append the rows of a run as CSV files with a header, in the run's own folder; trying again replaces them."""
    audit_csv(audit).write.mode("overwrite").csv(f"{path}/run={run}", header=True, escape='"')


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed audit table from CSV logs."""
    log = spark.read.csv(path, header=True, escape='"', schema=", ".join(f"`{c}` string" for c in CSV_COLUMNS))
    local = F.from_utc_timestamp(F.to_timestamp("Timestamp", TIMESTAMP_FORMAT), F.current_timezone())
    return log.select(
        local.alias("ts"),
        F.col("Filename").alias("filename"),
        F.col("Risk Level").alias("risk_level"),
        F.col("Risk Score").cast("int").alias("risk_score"),
        F.from_json("Detection Counts", "map<string,int>").alias("detection_counts"),
        F.col("Processing Time").cast("double").alias("processing_time"),
        F.col("Status").alias("status"),
    )


def audit_rollup(audit: DataFrame, *keys: str) -> DataFrame:
    """Scans, failures, level mix, score and time per key (over everything without keys); all exact.

    Rows shrink to a histogram (one row for each key and time) inside the tasks; everything else is summed from it, and
    the median is where the running number of timed rows passes the middle.  What one task sorts is the distinct
    times of a key, in the log's milliseconds a bounded number.
    """
    level, time = F.col("risk_level"), F.col("processing_time")
    histogram = audit.groupBy(*keys, "processing_time").agg(
        F.count(F.lit(1)).alias("scans"),
        F.count_if(F.col("status") != "Success").alias("failures"),
        *[F.count_if(level == name).alias(name.lower()) for name in ("High", "Medium", "Low")],
        F.sum("risk_score").alias("_score"),
    ).withColumn("_n", F.when(time.isNotNull(), F.col("scans")))
    whole = Window.partitionBy(*keys)
    placed = histogram.withColumns({"_upto": F.sum("_n").over(whole.orderBy("processing_time")), "timed": F.sum("_n").over(whole)})
    # the two in the middle, which are one in an odd number of rows
    low, high = (F.min(F.when(F.col("_upto") >= F.expr(f"(timed + {k}) div 2"), time)) for k in (1, 2))
    return placed.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("scans", "failures", "high", "medium", "low")],
        (F.sum("_score") / F.sum("scans")).alias("mean_score"),
        (F.sum(time * F.col("_n")) / F.sum("_n")).alias("mean_time"),
        ((low + high) / 2).alias("median_time"),
    )


def write_reports(books: DataFrame, path: str, run: str) -> None:
    """Append the reports of a run as a table ``(report_file, report)``, one row per document; trying again replaces them."""
    from veilscan.functions.text import safe_filename

    name = F.concat(F.lit("compliance_playbook_"), safe_filename(F.coalesce("filename", F.lit("document"))), F.lit(".txt"))
    books.select(name.alias("report_file"), "report").write.mode("overwrite").parquet(f"{path}/run={run}")
