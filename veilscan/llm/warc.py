"""Content-addressed WARC archive: payloads once by digest, record headers apart, records by a join.

An archive is a folder with two Parquet tables. `payloads` has each distinct payload once, under its
SHA-256 (with the SHA-1 that WARC headers name, and the size); `headers` has every record's exact header
bytes and the SHA-256 of its payload. A response is header, payload and two line ends, a revisit the same without
payload; the original response of a revisit comes back from its header and the payload that it refers to. Both
come from a join on the digest. Reading computes the digests of the stored bytes again and compares them with header and key.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is a response and
the others revisit it; smaller payloads are all responses (their bytes are stored once all the same).

Hot payloads: which row of a digest is kept is decided by a ranking of which each task passes on one
row per digest, so a payload that a third of the pages share is moved once per task.

Defined results: a null html is an empty payload, a null url is written as an empty one; rows with the same
page_id and payload are all responses if that page_id is the largest; rows with a null page_id are responses
only if no other row has their payload (or it is small); an empty table gives empty tables.
Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm.common import pick, shared_dir

LEAST = 1000


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri(key: Column) -> Column:
    """A record id of the form urn:uuid, from a digest of what the record is."""
    h = F.sha2(key, 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archive of `pages` into the folder `path`, which all executors share."""
    id_, url, html = pick(pages, "page_id", "url", "html")
    rows = pages.select(
        id_.cast("long").alias("page_id"),
        # a line end would end the header line
        F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " ").alias("url"),
        F.coalesce(html, F.lit("")).cast("binary").alias("payload"),
    ).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")
    )
    first = Window.partitionBy("sha256", "sha1", "size").orderBy(F.desc_nulls_last("page_id"))
    payloads = rows.drop("url").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    payloads.select("sha256", "sha1", "size", F.col("page_id").alias("owner"), "payload").write.parquet(f"{path}/payloads")

    owners = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "owner")
    known = rows.drop("payload").join(owners, "sha256")
    is_response = (F.col("size") < least) | F.col("page_id").eqNullSafe(F.col("owner"))
    known = known.withColumn("kind", F.when(is_response, "response").otherwise("revisit"))
    name = lambda page: _uri(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), "sha256"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        F.when(F.col("page_id").isNotNull(), _line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(
            F.col("kind") == "revisit",
            F.concat(
                _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                _line("WARC-Refers-To", name(F.col("owner"))),
                _line("WARC-Refers-To-Page-ID", F.col("owner").cast("string")),
            ),
        ).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("kind") == "revisit", "0").otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    known.select(header.cast("binary").alias("header"), "sha256").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: header and payload bytes, the header's fields, and what the stored payload says.

    A payload whose bytes don't have the digest they are stored under, or that the header names, fails the job.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.col("sha256").alias("key"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), F.sha2("payload", 256).alias("again"),
    ).where(F.when(F.col("again") == F.col("key"), True).otherwise(F.raise_error(F.lit("a stored payload has changed"))))
    headers = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, f"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    parsed = headers.select(
        "header", F.col("sha256").alias("key"), field("WARC-Page-ID").cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"), field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest").alias("named"), field("Content-Length").cast("long").alias("length"),
    )
    sized = F.col("length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    same = (F.col("named") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & sized
    return parsed.join(stored.drop("again"), "key").where(F.when(same, True).otherwise(F.raise_error(F.lit("header and payload differ")))).select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "header", "payload"
    )


END = b"\r\n\r\n"


def records(archive: DataFrame) -> DataFrame:
    """page_id and the record bytes of read_archive(), as a WARC file holds them: revisits have no body."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", body, F.lit(END)).alias("record"))


def originals(archive: DataFrame) -> DataFrame:
    """page_id and every page's response record, also of revisits: what there was before payloads were shared."""
    text = F.decode("header", "UTF-8")
    own = F.regexp_replace(text, "\r\n(?:WARC-Profile|WARC-Refers-To|WARC-Refers-To-Page-ID): [^\r\n]*(?=\r\n)", "")
    own = F.regexp_replace(own, "\r\nWARC-Type: revisit\r\n", "\r\nWARC-Type: response\r\n")
    sized = F.regexp_replace(own, F.lit("\r\nContent-Length: 0(?=\r\n)"), F.concat(F.lit("\r\nContent-Length: "), F.col("payload_bytes").cast("string")))
    header = F.when(F.col("record_type") == "revisit", sized.cast("binary")).otherwise(F.col("header"))
    return archive.select("page_id", F.concat(header, "payload", F.lit(END)).alias("record"))


def archived(pages: DataFrame) -> DataFrame:
    """Writes `pages` below spark.checkpoint.dir and reads the archive back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
