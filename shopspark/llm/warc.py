"""Content-addressed web archive.

Payload bytes are stored once, keyed by their SHA-256. Record headers are stored
apart, byte for byte as they stand in the record, with the key of their payload.
A join of the two gives back the original records. Both parts are Parquet in a
shared folder; :func:`write_warc_files` lays the same records out as plain WARC
files, :func:`read_warc_files` parses such files.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with
the largest identifier is the response, the others are revisits of it.

Defined cases: a null payload is empty, a null address is an empty address. A
null identifier is smaller than any other. Of repeated rows (equal identifier and
payload) one is the response and the others revisit it. An empty table gives an
empty archive. Other columns are not looked at.
"""

from __future__ import annotations

import gzip
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopspark.storage import materialize, scratch_path

END = "\r\n\r\n"
#: The digits Spark's base conversion writes, and those of base32 (RFC 4648).
CONVERSION_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits, ten at a time, make 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONVERSION_DIGITS, BASE32_DIGITS)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _header(record_id: Column, url: Column, kind: Column, digest: Column, size: Column, refers: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(refers.isNotNull(), line("WARC-Refers-To", refers)).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 0,
    date: str = WARC_DATE,
) -> None:
    """Write ``path/payloads`` (one row per distinct payload) and ``path/headers`` (one row per record)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    source = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", "").alias("url"), payload.alias("payload")
    )
    facts = {
        "address": F.unhex(F.sha2("payload", 256)),
        "digest": base32_sha1(F.col("payload")),
        "bytes": F.octet_length("payload").cast("long"),
    }
    slim = source.select("id", "url", F.struct(*[c.alias(n) for n, c in facts.items()]).alias("f"))
    slim = slim.select("id", "url", "f.*", F.monotonically_increasing_id().alias("row"))
    records = materialize(slim, "warc-records")
    # Equal addresses fold before the shuffle; the second digest and the length verify the strong one.
    groups = records.groupBy("address", "digest", "bytes").agg(F.max(F.struct("id", "row")).alias("keeper"))
    groups = materialize(groups, "warc-groups")
    linked = records.join(groups, ["address", "digest", "bytes"])
    shared = (F.col("bytes") >= revisit_bytes) & (F.col("row") != F.col("keeper.row"))
    record_id = _uuid(F.col("id").cast("string"), F.col("row").cast("string"))
    refers_id = F.when(shared, _uuid(F.col("keeper.id").cast("string"), F.col("keeper.row").cast("string")))
    kind = F.when(shared, "revisit").otherwise("response")
    headers = linked.select(
        "id",
        "address",
        kind.alias("record_type"),
        F.when(shared, F.col("keeper.id")).alias("refers_to"),
        _header(record_id, F.col("url"), kind, F.col("digest"), F.col("bytes"), refers_id, date).alias("header"),
    )
    headers.write.parquet(f"{path}/headers")
    # The payload comes from the row that was kept, so no two rows with texts meet in a group.
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.hex("address"))
    wanted = groups.select(F.coalesce(F.col("keeper.id").cast("string"), F.lit("-")).alias("id"), "address").select(key.alias("key"))
    bodies = source.withColumn("address", facts["address"]).withColumn("key", key)
    bodies = bodies.join(wanted, "key", "left_semi").dropDuplicates(["key"])
    bodies.select("address", F.col("payload").cast("binary").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt from an archive: id, header, payload, record_type, refers_to.

    A payload whose bytes do not hash to its address fails the job.
    """
    bodies = spark.read.parquet(f"{path}/payloads")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("address")
    bodies = bodies.withColumn("payload", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary")))
    return spark.read.parquet(f"{path}/headers").join(bodies, "address")


def header_field(header: Column, name: str) -> Column:
    """A field of a header block, null where it is absent."""
    value = F.regexp_extract(header, f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(F.contains(header, F.lit(f"\r\n{name}: ")), value)


def page_records(pages: DataFrame, id_col: str = "page_id", revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write an archive of ``pages`` and report what reading it back gives for each."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc-archive")
    write_archive(pages, path, id_col=id_col, revisit_bytes=revisit_bytes)
    records = read_archive(spark, path)
    return records.select(
        F.col("id").alias(id_col),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        "refers_to",
    )


def write_warc_files(records: DataFrame, path: str) -> None:
    """Lay rebuilt records out as gzip WARC files; revisit records carry no body."""
    revisit = F.col("record_type") == "revisit"
    header = F.when(revisit, F.regexp_replace("header", "\\r\\nContent-Length: \\d+", "\r\nContent-Length: 0")).otherwise(F.col("header"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    lines = records.select(F.concat(header, body).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_warc(content: bytes) -> list[dict]:
    """The records of one file, cut by their Content-Length."""
    stream, found = io.BytesIO(content), []
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            fields[name.decode().lower()] = value.decode()
        fields["payload"] = stream.read(int(fields.get("content-length", 0)))
        found.append(fields)
    return found


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Parse WARC files; a file is read by one task, so writers should bound file sizes."""

    def parse(batches):
        for files in batches:
            for content in files["content"]:
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                yield pd.DataFrame(
                    [
                        {"record_id": r.get("warc-record-id"), "record_type": r.get("warc-type"), "url": r.get("warc-target-uri"),
                         "payload_digest": r.get("warc-payload-digest"), "refers_to": r.get("warc-refers-to"), "payload": r["payload"]}
                        for r in parse_warc(raw)
                    ],
                    columns=["record_id", "record_type", "url", "payload_digest", "refers_to", "payload"],
                )

    schema = "record_id string, record_type string, url string, payload_digest string, refers_to string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)
