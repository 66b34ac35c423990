"""Content-addressed WARC archive: payload bytes once by verified strong digest, exact record headers apart.

The archive is two Parquet tables: ``payloads`` (address, payload) with one row a distinct
payload, addressed by SHA-256 and length, and ``records`` (page_id, header, address, ...)
with the exact header block of every record. A record is the header, an empty line, the
payload for responses, and two line ends; it is rebuilt by joining the tables. Reading
computes both digests afresh from the stored bytes, and a damaged payload is an error.

Defined cases: a null html is an empty payload; a null url is an empty target; rows that
repeat a page_id and payload are each a record, the first-ranked one is the response; rows with a
null page_id are records; a revisit's refers_to is null if no record of its payload has a page_id;
an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, eight letters each."""
    hexed = F.sha1(payload)
    letters = []
    for g in range(4):
        bits = F.conv(F.substring(hexed, 10 * g + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(_BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def address(payload: Column) -> Column:
    """SHA-256 and length: the name under which the payload is stored."""
    return F.concat(F.sha2(payload, 256), F.lit("-"), F.octet_length(payload).cast("string"))


def _header(url: Column, page_id: Column, digest: Column, size: Column, revisit: Column, refers: Column) -> Column:
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))
    uri = lambda p: F.concat(F.lit("<urn:page:"), F.coalesce(p.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(page_id)),
        line("WARC-Date", F.lit(RECORD_DATE)),
        # a line end inside an address would break the header block
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", uri(refers)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
    )


def write(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the archive of ``pages`` (page_id, url, html) under ``path``: payloads/ and records/."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # one narrow row a page: digests are computed once, in the scan
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", address(payload).alias("address"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"), F.monotonically_increasing_id().alias("_tie")
    )
    slim = common.written(slim, "warc-slim")
    # the response of each address: the largest page_id; repeated rows are told apart by their place in the written table
    lead = slim.groupBy("address").agg(F.max(F.struct("page_id", "_tie")).alias("lead"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    lead = lead.select("address", F.col("lead.page_id").alias("lead_id"), F.col("lead._tie").alias("lead_tie"), F.when(F.col("d0") == F.col("d1"), F.lit(True)).otherwise(F.raise_error(F.lit("one address for two payloads")).cast("boolean")).alias("one"))
    all_ = slim.join(lead, "address").where("one")
    revisit = (F.col("_tie") != F.col("lead_tie")) & (F.col("size") >= min_revisit_bytes)
    records = all_.select(
        "page_id", F.encode(_header(F.col("url"), F.col("page_id"), F.col("digest"), F.col("size"), revisit, F.col("lead_id")), "UTF-8").alias("header"), "address", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("lead_id")).alias("refers_to")
    )
    records.write.mode("overwrite").parquet(f"{path}/records")
    # payload bytes cross the network once, and only the chosen row of an address stays
    keep = slim.join(lead.select("lead_tie"), slim["_tie"] == F.col("lead_tie"), "left_semi").select(F.col("page_id").alias("_id"), F.col("address").alias("_address"))
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload")).withColumn("address", address(F.col("payload")))
    stored = chosen.join(keep, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("address") == F.col("_address"))).select("address", "payload")
    if slim.groupBy("page_id", "address").count().where("count > 1").limit(1).count():
        stored = stored.dropDuplicates(["address"])  # a page_id and its payload are repeated
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Every record rebuilt: page_id, record_type, refers_to, header, payload, payload_bytes, payload_digest, verified.

    The digests are those of the stored bytes, computed beside the payload and before the join.
    A payload that is not what its address and its record's header say is an error; with
    ``strict`` False it comes out with ``verified`` false.
    """
    stored = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads").select(
        "address", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), (address(F.col("payload")) == F.col("address")).alias("intact")
    )
    records = spark.read.schema("page_id long, header binary, address string, record_type string, refers_to long").parquet(f"{path}/records")
    head = F.decode("header", "UTF-8")
    said = F.regexp_extract(head, r"WARC-Payload-Digest: sha1:(\w+)", 1)
    kind = F.regexp_extract(head, r"WARC-Type: (\w+)", 1)
    refers = F.regexp_extract(head, r"WARC-Refers-To: <urn:page:(-?\d+)>", 1)
    out = records.select("page_id", "header", "address", kind.alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"), said.alias("said"))
    verified = F.col("intact") & (F.col("said") == F.col("payload_digest"))
    if strict:
        verified = F.when(verified, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("boolean"))
    out = out.join(stored, "address").withColumn("verified", verified)
    return out.where("verified") if strict else out


def records(archive: DataFrame) -> DataFrame:
    """page_id and the exact bytes of each WARC record."""
    end = F.lit("\r\n").cast("binary")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return archive.select("page_id", F.concat("header", end, body, end, end).alias("record"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


QUERIES = {"op2_warc_archive": op2_warc_archive}
#: Base32 has no SQL function in DuckDB: eight letters a group of ten hex digits.
_DIGEST = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(h, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * k}) & 31)::INT + 1, 1)" for g in range(4) for k in range(8))
ORACLE_SQL = {
    "op2_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to, TRUE AS verified FROM q"""
}
