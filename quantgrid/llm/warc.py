"""WARC archives: write transactions, read records back, assemble one nested row per capture.

Writing is a text sink whose line separator is the record terminator, so the files are WARC/1.1 (gzip).  Reading
takes whole files (kept short by ``records_per_file``) and slices records by Content-Length.  Assembly follows the
concurrent-to identifiers over any number of hops: a record belongs to every response that it names, that names it, or that
a record it names belongs to; one that comes to none so belongs where the records that name it belong.

Defined cases: a null payload is empty; a null page id is written empty and sorts last; repeated rows are captures of
their own, and those with equal page id and payload all are responses or all revisit the same; line breaks in a URL are percent-encoded; records that lead to no response form a capture
with a null record_type under the identifier they name; a capture with more than ``MEMBERS_PER_ROW`` members of one
kind continues in further rows (``part`` 1, 2, ...), so no row holds an unbounded group.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.core import scratch, store

CRLF = "\r\n"
MEMBERS_PER_ROW = 1_000
RECORDS_PER_FILE = 3_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ANCHORS = ("response", "revisit")


def base32_sha1(data: Column) -> Column:
    """Base32 of the SHA-1, five hex digits (20 bits) to four letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plan_transactions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, first_id, nth: first_id is the smallest page id with the same payload.

    Payloads below ``min_bytes`` are never shared.  Only digests are grouped; the payload itself crosses one shuffle.
    ``nth`` tells rows of one page id and payload apart: 0 for one of them, and for all others.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"),
                        (F.monotonically_increasing_id() + 1).alias("_row"))
    repeats = (rows.groupBy("page_id", "digest").agg(F.min("_row").alias("_main"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
               .select(F.col("page_id").alias("_q"), F.col("digest").alias("_e"), "_main"))
    rows = (rows.join(repeats, F.expr("page_id <=> _q and digest = _e"), "left")
            .withColumn("nth", F.when(F.col("_main").isNull() | (F.col("_main") == F.col("_row")), 0).otherwise(F.col("_row"))))
    light = rows.where(F.length("payload") >= min_bytes).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = (light.join(first, "digest").where("page_id is null or page_id > first_id")
                .groupBy("page_id", "digest").agg(F.min("first_id").alias("first_id")))
    again = revisits.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first_id")
    return (rows.join(again, F.expr("page_id <=> _p and digest = _d"), "left")
            .select("page_id", "url", "payload", "digest", "first_id", "nth"))


def write_warc(transactions: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A request, a response or revisit, and a metadata record per row of :func:`plan_transactions`."""
    t = transactions
    row = [F.col("page_id"), F.col("digest"), F.nullif(F.col("nth"), F.lit(0))]
    own = record_uuid(F.lit("response"), *row)
    origin = record_uuid(F.lit("response"), F.col("first_id"), F.col("digest"), F.lit(None))
    revisit = F.col("first_id").isNotNull()
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    text = F.col("payload").cast("string")

    def record(kind: Column, ident: Column, mime: str, extra: list[Column], body: Column) -> Column:
        head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident),
                F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), *extra,
                F.lit(f"Content-Type: {mime}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
        return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), body)

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.length("payload").cast("string"), F.lit(CRLF * 2))
    answer = record(
        F.when(revisit, F.lit("revisit")).otherwise("response"), own, "application/http; msgtype=response",
        [F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
         F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                                        f"{CRLF}WARC-Refers-To: "), origin))],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(text)))
    linked = [F.concat(F.lit("WARC-Concurrent-To: "), own)]
    request = record(F.lit("request"), record_uuid(F.lit("request"), *row),
                     "application/http; msgtype=request", linked, F.lit(f"GET / HTTP/1.1{CRLF}{CRLF}"))
    metadata = record(F.lit("metadata"), record_uuid(F.lit("metadata"), *row),
                      "application/warc-fields", linked,
                      F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    (t.select(F.explode(F.array(request, answer, metadata)).alias("value"))
     .write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


RECORD_SCHEMA = ("record_id string, record_type string, uri string, concurrent_to array<string>, refers_to string, "
                 "payload_digest string, content_type string, http_head string, payload binary")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*(?:\r\n[ \t]+[^\r\n]*)*)")


def unzip(data: bytes) -> bytes:
    """The members of a gzip file one after another; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


def parse_records(data: bytes):
    """Records of one archive file, sliced by Content-Length."""
    at, n = 0, len(data)
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields: dict[str, list[str]] = {}
        for name, value in _FIELD.findall(data, data.find(b"\r\n", at) + 2, end):
            fields.setdefault(name.decode("latin-1").lower(), []).append(value.decode("utf-8", "replace").strip())
        one = {k: v[0] for k, v in fields.items()}
        size = int(one.get("content-length", "0"))
        block = data[end + 4:min(end + 4 + size, n)]
        head, payload = None, block
        if one.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            head, payload = (block[:cut], block[cut + 4:]) if cut >= 0 else (block, b"")
            head = head.decode("utf-8", "replace")
        digest = one.get("warc-payload-digest")
        yield (one.get("warc-record-id"), one.get("warc-type"), one.get("warc-target-uri"), fields.get("warc-concurrent-to", []),
               one.get("warc-refers-to"), digest.removeprefix("sha1:") if digest else None, one.get("content-type"), head, payload)
        at = end + 4 + size


def _parse_files(batches):
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    for pdf in batches:
        for data in pdf["content"]:
            data, rows, size = unzip(data), [], 0
            for r in parse_records(data):
                rows.append(r)
                size += len(r[-1])
                if size > 4 << 20 or len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record, with the payload's length and SHA-1 as read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = files.mapInPandas(_parse_files, RECORD_SCHEMA)
    return records.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("sha1", base32_sha1(F.col("payload")))


def resolve_captures(records: DataFrame) -> DataFrame | None:
    """(record_id, capture_id) of every record that is not a response: follows concurrent-to until nothing is added.

    None where every such record names responses only and no response names others: then the names are the answer.
    """
    anchor = F.col("record_type").isin(*ANCHORS)
    ids = records.select("record_id", "record_type", "concurrent_to")
    named = ids.where(~anchor).select("record_id", F.explode_outer("concurrent_to").alias("target"))
    anchors = ids.where(anchor)
    anchor_ids = anchors.select(F.col("record_id").alias("target"))
    if anchors.where(F.size("concurrent_to") > 0).isEmpty() and named.join(anchor_ids, "target", "left_anti").isEmpty():
        return None

    ids = store(ids.distinct())
    anchors = ids.where(anchor)
    others = ids.where(~anchor).select("record_id")
    links = store(ids.where(~anchor).select("record_id", F.explode("concurrent_to").alias("target")).distinct())
    reverse = anchors.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id"))
    direct = links.join(anchors.select(F.col("record_id").alias("target")), "target").select("record_id", F.col("target").alias("capture_id"))
    found = store(direct.unionByName(reverse.join(others, "record_id").select("record_id", "capture_id")).distinct())
    latest = found
    while not latest.isEmpty():
        # each round adds the pairs that one more named record gives
        latest = store(links.join(latest.withColumnRenamed("record_id", "target"), "target").select("record_id", "capture_id")
                       .distinct().join(found, ["record_id", "capture_id"], "left_anti"))
        found = found.unionByName(latest)
        if latest.isEmpty():
            loose = others.join(found.select("record_id").distinct(), "record_id", "left_anti")
            latest = store(links.join(found, "record_id").select(F.col("target").alias("record_id"), "capture_id")
                           .join(loose, "record_id").select("record_id", "capture_id").distinct())
            found = found.unionByName(latest)
    orphans = (ids.where(~anchor).join(found.select("record_id").distinct(), "record_id", "left_anti")
               .select("record_id", F.coalesce(F.try_element_at("concurrent_to", F.lit(1)), "record_id").alias("capture_id")))
    return found.unionByName(orphans)


def assemble_captures(records: DataFrame) -> DataFrame:
    """capture_id, part, record_type, uri, refers_to, payload_bytes, payload_digest, response, requests, metadata.

    Equal records count once.  Pass stored records: links and members are read apart.
    """
    anchor = F.col("record_type").isin(*ANCHORS)
    of = resolve_captures(records)
    inner = F.struct("record_id", F.col("record_type").alias("kind"), F.col("http_head").alias("head"), F.col("payload").cast("string").alias("body"))
    members = records.where(~anchor)
    if of is None:
        members = members.withColumn("capture_id", F.explode("concurrent_to"))
    else:
        members = members.join(of, "record_id")
    members = members.select("record_id", "record_type", "capture_id", inner.alias("member"), F.lit(0).cast("long").alias("part"))
    sizes = members.groupBy("capture_id").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_ROW).alias("parts")).where("parts > 1")
    if not sizes.isEmpty():
        members = (members.drop("part").join(sizes, "capture_id", "left")
                   .withColumn("part", F.coalesce(F.pmod(F.xxhash64("record_id"), F.col("parts")), F.lit(0))))
    request = F.col("record_type") == "request"
    nested = members.groupBy("capture_id", "part").agg(
        F.collect_set(F.when(request, F.col("member"))).alias("requests"), F.collect_set(F.when(~request, F.col("member"))).alias("metadata"))
    heads = records.where(anchor)
    heads = heads.dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("capture_id"), "record_type", "uri", "refers_to", "payload_digest", "payload_bytes", "sha1", "http_head", "payload")
    none = F.array().cast("array<struct<record_id:string,kind:string,head:string,body:string>>")
    return (heads.join(nested, "capture_id", "full_outer")
            .select("capture_id", F.coalesce("part", F.lit(0)).alias("part"), "record_type", "uri", "refers_to", "payload_bytes",
                    F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("sha1")).alias("payload_digest"),
                    F.struct("http_head", "payload").alias("response"),
                    F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata")))


def follow_revisits(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page id): revisits take the full payload's figures."""
    page = F.get(F.transform("metadata", lambda m: F.nullif(F.regexp_extract(m["body"], r"page-id: (-?\d+)", 1), F.lit(""))), 0).cast("long")
    rows = captures.where("record_type is not null and part = 0").select(
        "capture_id", page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("origin"))
    again = rows.where("record_type = 'revisit'").select("page_id", "payload_digest", "origin")
    full = rows.where("record_type = 'response'").select(
        F.col("capture_id").alias("origin"), F.col("page_id").alias("refers_to"), "payload_bytes")
    revisits = again.join(full, "origin", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return rows.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC into the shared folder, read the archive, assemble its captures."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(plan_transactions(pages), path)
    # Lengths and digests are taken from the payloads as read; the archive is parsed once and responses' bytes go no further.
    keep = F.when(~F.col("record_type").isin(*ANCHORS), F.col("payload"))
    records = store(read_warc(spark, path).withColumn("payload", keep))
    light = store(assemble_captures(records)
                  .select("capture_id", "part", "record_type", "refers_to", "payload_bytes", "payload_digest", "metadata"))
    return follow_revisits(light)
