"""Content-addressed web archive: headers of WARC records in one table, payload bytes once by digest in another.

`write_archive` makes one WARC 1.1 record for each page. Among records with equal payloads of at least
REVISIT_BYTES the one with the smallest page_id is a response and the others are revisits of it; smaller payloads are
always responses. The exact header bytes of every record are kept; its payload is kept once, under its SHA-256.
`read_archive` takes type and reference out of those headers, computes every stored payload's digest anew and checks
it against the header's; `records` joins headers and payloads to the original bytes.

Defined cases: a null html is an empty payload; a null url leaves out the target header; rows of one page_id make one
record each, and all rows of the smallest page_id are responses; a null page_id counts as larger than any other and
is written as `none`; a very long html is a payload like any other; an empty table gives an empty archive; other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm.common import join_by, new_path

REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NL = "\r\n"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def _header() -> Column:
    revisit, size = F.col("record_type") == "revisit", F.col("_size").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), size, F.lit(NL * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_size"))
    return F.concat(
        F.lit(f"WARC/1.1{NL}WARC-Type: "), F.col("record_type"),
        F.lit(f"{NL}WARC-Record-ID: <"), _record_id(F.col("page_id")), F.lit(">"),
        F.coalesce(F.concat(F.lit(f"{NL}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        F.lit(f"{NL}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{NL}WARC-Profile: {PROFILE}{NL}WARC-Refers-To: <"), _record_id(F.col("_first")), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{NL}Content-Type: application/http; msgtype=response{NL}Content-Length: "), length.cast("string"), F.lit(NL * 2), http,
    )


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes <path>/headers (page_id, digest, header) and <path>/payloads (digest, payload); returns path."""
    path = path or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("_size"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    revisit = (F.col("_size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    headers = join_by(rows, first, "digest", "_n").withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    headers.select("page_id", "digest", _header().cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    payloads = pages.select(F.sha2(html, 256).alias("digest"), html.alias("payload")).dropDuplicates(["digest"])
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/headers")
    return headers, spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload_digest, payload_bytes, verified, refers_to: the types and references as the headers say, sizes and digests as the stored payloads have them; `verified` where the header says the same digest."""
    headers, payloads = _tables(spark, path)
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    rows = headers.select(
        "page_id",
        "digest",
        field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("_said"),
        F.regexp_extract(text, r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
    )
    kept = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    times = headers.groupBy("digest").agg(F.count("*").alias("_n"))
    found = join_by(rows, times.join(kept, "digest", "left"), "digest", "_n")
    verified = F.coalesce(F.col("payload_digest") == F.col("_said"), F.lit(False))
    return found.select("page_id", "record_type", "payload_digest", "payload_bytes", verified.alias("verified"), "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the bytes of every WARC record, with its payload unless it is a revisit."""
    headers, payloads = _tables(spark, path)
    revisit = F.decode("header", "UTF-8").startswith(f"WARC/1.1{NL}WARC-Type: revisit{NL}")
    whole = F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit((NL * 2).encode()))
    return headers.join(payloads, "digest").select("page_id", whole.alias("record"))
