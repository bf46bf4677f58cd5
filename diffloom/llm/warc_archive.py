"""Content-addressed WARC archive.

Payload bytes are stored once in a table keyed by their SHA-256 and length; record headers are stored apart, byte
for byte; a record (header, body, two line ends; a revisit has no body) is put together again by a join on the digest. Each stored
payload is checked once against its digest and length before the join; what a record says is read from its bytes alone.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm.common import shared_dir

MIN_DEDUP_BYTES = 100


def _header(kind: Column, date: str) -> Column:
    """The header block of a WARC 1.1 record, up to and with the empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]", "%0A")
    is_revisit = kind == "revisit"
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:none>"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("owner"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("WARC-Payload-Bytes", F.col("bytes").cast("string")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> tuple[str, str]:
    """Write one record per row, dated `date` (now, if none is given; UTC, as `2020-01-01T00:00:00Z`); returns the names of the table of payloads (bucketed by digest, each payload once) and
    the folder of headers.

    Null html is an empty payload, a null url an empty target, line ends in urls become %0A. Payloads under
    MIN_DEDUP_BYTES are always responses. Repeated rows of the page that owns a payload are responses too. Rows of
    a null page_id own a payload only if all rows with it have none; extra columns are ignored; no row in gives an
    empty archive. Very long payloads are single values. Equal payloads meet in partial aggregates on the map side, so a hot
    payload moves once per task.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    store = keyed.groupBy("digest", "bytes").agg(F.min("page_id").alias("owner"), F.max("payload").alias("payload"))
    name = f"warc_payloads_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store.write.bucketBy(buckets, "digest").option("compression", "zstd").saveAsTable(name)
    owners = spark.table(name).select("digest", "owner")
    kind = F.when((F.col("bytes") < MIN_DEDUP_BYTES) | F.col("owner").isNull() | F.col("page_id").eqNullSafe(F.col("owner")), "response").otherwise("revisit")
    heads = keyed.drop("payload").join(owners, "digest").select("digest", _header(kind, date or f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}").cast("binary").alias("header"))
    path = f"{shared_dir(spark)}/warc-headers-{uuid.uuid4().hex}"
    heads.write.option("compression", "zstd").parquet(path)
    return name, path


def read_records(spark: SparkSession, payloads: str, headers: str) -> DataFrame:
    """record: the bytes of every record, as they stand in a WARC file; raises if a stored payload doesn't have its digest, or is not there.

    One row per header, repeated ones too; empty payloads give records with an empty body.
    """
    store = spark.table(payloads)
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("bytes"))
    store = store.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("bad payload "), F.col("digest"))).cast("binary")).alias("payload"))
    revisit = F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    # a revisit's payload has to be there too
    lost = F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("binary")
    body = F.when(F.col("payload").isNull(), lost).otherwise(body)
    return spark.read.parquet(headers).join(store, "digest", "left").select(F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def describe(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the records' bytes: a response's from its body, a
    revisit's from its header. id_type: the type of the page ids (a string id may hold anything but `>` and line ends).
    """
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    field = lambda name, pattern: F.regexp_extract("head", f"\\r\\n{name}: {pattern}(?:\\r\\n|\\z)", 1)
    page = lambda name: F.when(F.col("head").rlike(f"\\r\\n{name}: <urn:page:"), field(name, "<urn:page:([^>]*)>")).cast(id_type)
    parts = records.select("record", head.alias("head"))
    parts = parts.withColumn("length", field("Content-Length", "(\\d+)").cast("int")).withColumn("record_type", field("WARC-Type", "(\\w+)"))
    parts = parts.withColumn("body", F.substring(F.col("record"), F.octet_length("head") + 5, F.col("length")))
    revisit = F.col("record_type") == "revisit"
    return parts.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(revisit, field("WARC-Payload-Bytes", "(\\d+)").cast("long")).otherwise(F.octet_length("body").cast("long")).alias("payload_bytes"),
        F.when(revisit, field("WARC-Payload-Digest", "sha256:(\\w+)")).otherwise(F.sha2("body", 256)).alias("payload_digest"),
        "record_type",
        page("WARC-Refers-To").alias("refers_to"),
    )


def drop_archive(spark: SparkSession, payloads: str, headers: str) -> None:
    """Delete an archive's table and folder."""
    spark.sql(f"DROP TABLE IF EXISTS {payloads}")
    at = spark._jvm.org.apache.hadoop.fs.Path(headers)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN owner END AS refers_to FROM o
"""
