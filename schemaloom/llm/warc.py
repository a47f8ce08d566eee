"""Web archive records: reading, and resolution of not-modified revisits.

A revisit that says the server answered 304 holds no payload. It is resolved by an as-of join on the canonical
URL to the latest earlier full response; the validators are checked, and the headers that a 304 may carry
replace those of the stored response (RFC 9111, section 3.2).

The as-of join never brings the captures of a URL together in one task: time is cut into bins, each bin's last
full response is aggregated map-side, the carry-in of a bin comes from the bins before (one row a bin), and
only captures of one URL and bin are ordered together. A hot URL is so spread over its bins, whose width follows the
times in the table.

Defined results: a null URL is never resolved ("no_url"), an empty one is a URL; very long URLs and headers are taken
whole; records at the same time are ordered by record id, and a record is no earlier than itself; repeated revisits give
repeated results, repeated responses count once (of different headers under one id the least text counts); null headers
are no headers; a record without a time is never matched ("no_response"); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

import xxhash

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, read, stored

# Headers that describe the stored payload, so a 304 may not replace them.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
# Query parameters that only track where a visitor came from.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid", "sessionid")


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without www. and default port, no fragment, no tracking parameters, no last slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i)[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{'|'.join(TRACKING)})(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


#: Over so many bins the time of a hot URL's captures is spread.
BINS = 4096


def resolve_revisits(records: DataFrame, bin_width: int | None = None) -> DataFrame:
    """One row per revisit. ``records``: record_id long, url string, t long, kind "response" or "revisit", headers map<string, string> (lower-case names).

    Result: revisit_id, url_key, t, response_id, status ("resolved", "no_response", "validator_mismatch", "no_url"), headers (merged where resolved).
    A validator agrees if the entity tags are equal (weak ones too), or, where one side has none, the dates of last modification are; with neither on the revisit it agrees.
    """
    if bin_width is None:
        first, last = records.agg(F.min("t"), F.max("t")).first()
        bin_width = max(1, -(-((last or 0) - (first or 0)) // BINS))
    headers = F.coalesce("headers", F.create_map().cast(records.schema["headers"].dataType)).alias("headers")
    r = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "t", "kind", headers, canonical_url(F.col("url")).alias("url_key"))
    r = r.withColumn("bin", F.floor(F.col("t") / bin_width))
    full = F.col("kind") == "response"
    keyed = r.where(F.col("url_key").isNotNull())
    last = keyed.where(full).groupBy("url_key", "bin").agg(F.max(F.struct("t", F.col("record_id").alias("id"))).alias("last")).where("bin IS NOT NULL")
    wanted = keyed.where(~full).select("url_key", "bin").distinct()
    bins = last.withColumn("wanted", F.lit(False)).unionByName(wanted.select("url_key", "bin", F.lit(None).cast(last.schema["last"].dataType).alias("last"), F.lit(True).alias("wanted")))
    before = Window.partitionBy("url_key").orderBy("bin").rangeBetween(Window.unboundedPreceding, -1)
    carry = bins.withColumn("carry", F.max("last").over(before)).where("wanted").select("url_key", "bin", "carry")
    inside = Window.partitionBy("url_key", "bin").orderBy("t", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("own", F.last(F.when(full, F.struct("t", F.col("record_id").alias("id"))), ignorenulls=True).over(inside)).where(~full)
    matched = local.join(carry, ["url_key", "bin"], "left").withColumn("response_id", F.coalesce(F.col("own.id"), F.col("carry.id"))).drop("own", "carry", "bin")
    responses = r.where(full).select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    if not responses.groupBy("response_id").count().where("count > 1").isEmpty():
        # written first, so that the join below has no aggregate on a side, and a response of very many revisits can be split
        responses = stored(responses.groupBy("response_id").agg(F.min_by("stored", F.to_json("stored")).alias("stored")))
    matched = matched.join(responses, "response_id", "left")
    lost = r.where(~full & F.col("url_key").isNull()).select("record_id", "t", "kind", "headers", "url_key", F.lit(None).cast("long").alias("response_id"), F.lit(None).cast(r.schema["headers"].dataType).alias("stored"))
    tag = lambda c: F.regexp_replace(F.element_at(c, "etag"), r"^W/", "")
    date = lambda c: F.element_at(c, "last-modified")
    both = tag(F.col("headers")).isNotNull() & tag(F.col("stored")).isNotNull()
    agrees = F.when(both, tag(F.col("headers")) == tag(F.col("stored"))).when(date(F.col("headers")).isNotNull(), F.coalesce(date(F.col("headers")) == date(F.col("stored")), F.lit(False))).otherwise(tag(F.col("headers")).isNull())
    status = F.when(F.col("url_key").isNull(), "no_url").when(F.col("response_id").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    permitted = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    out = matched.unionByName(lost).withColumn("status", status)
    return out.select(F.col("record_id").alias("revisit_id"), "url_key", "t", "response_id", "status", F.when(F.col("status") == "resolved", merged).alias("headers"))


def resolve_identical(records: DataFrame) -> DataFrame:
    """revisit_id, response_id: revisits of identical payload name the record that they repeat; null where that isn't there."""
    again = records.where(F.col("kind") == "identical").select(F.col("record_id").alias("revisit_id"), "refers_to")
    there = records.where(F.col("kind") == "response").select(F.col("record_id").alias("response_id")).distinct()
    return again.join(there, F.col("refers_to") == F.col("response_id"), "left").select("revisit_id", "response_id")


class Record(NamedTuple):
    """A parsed record; ``error`` says what is wrong with it, and the others are then as far as it could be read. ``rest`` is what follows its block."""

    warc: dict[str, str]
    status: int | None
    http: dict[str, str]
    body: bytes
    error: str | None
    rest: bytes


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def parse_record(data: bytes) -> Record:
    """One record from its version on, without the empty lines after it."""
    head, gap, block = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    warc = _headers(lines)
    size, error = warc.get("content-length", ""), None
    if not version.startswith(b"WARC/"):
        error = "no WARC version"
    elif not (size.isascii() and size.isdigit()):
        error = "no content length"
    elif not gap and int(size) or len(block) < int(size):
        error = "truncated"
    rest = b""
    if size.isascii() and size.isdigit():
        block, rest = block[: int(size)], block[int(size) :].strip()
    status, http, body = None, {}, block
    if warc.get("content-type", "").startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        first, *lines = top.split(b"\r\n")
        words = first.split()
        status = int(words[1]) if len(words) > 1 and first.startswith(b"HTTP/") and words[1].isdigit() else None
        http = _headers(lines)
    return Record(warc, status, http, body, error, rest)


def record_key(name: str | None) -> int | None:
    return None if name is None else xxhash.xxh3_64_intdigest(name) >> 1


def kind_of(r: Record) -> str:
    """response; revisit (the server answered 304); identical (another kind of revisit, that of an identical payload); or the record's own type."""
    kind = r.warc.get("warc-type", "")
    if kind == "revisit" and r.status != 304 and "not-modified" not in r.warc.get("warc-profile", "not-modified" if r.status is None else ""):
        return "identical"
    return kind


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of WARC files, plain or compressed: record_id, url, t, kind, headers, body, refers_to, file, error.

    Spark's text reader cuts files at records, so a file is never held as a whole and a plain one is read in splits.
    A broken record, or one whose block holds what looks like the start of another, is a row with an error, and the next
    one is read again from its own start. What follows a break in a compressed stream can't be read; Spark logs it.
    """

    def each(columns):
        rows = []
        for file, data in zip(*columns, strict=True):
            data = data.lstrip(b"\r\n")
            if not data:
                continue
            r = parse_record(data if data.startswith(b"WARC/") else b"WARC/1." + data)
            error, when = r.error, None
            try:
                when = int(datetime.fromisoformat(r.warc.get("warc-date", "").replace("Z", "+00:00")).timestamp())
            except ValueError:
                error = error or "no date"
            name = r.warc.get("warc-record-id")
            key = record_key(name if name is not None else f"{file}:{xxhash.xxh3_128_hexdigest(data)}")
            rows.append((key, r.warc.get("warc-target-uri"), when, kind_of(r), list(r.http.items()), r.body, record_key(r.warc.get("warc-refers-to")), file, error))
            if r.rest:
                rows.append((None, None, None, "", [], r.rest, None, file, "bytes between records"))
        return [list(c) for c in zip(*rows, strict=True)]

    text = spark.read.option("lineSep", "\r\n\r\nWARC/1.").option("ignoreCorruptFiles", "true").text(path)
    records = text.select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
    return map_rows(records, each, "record_id long, url string, t long, kind string, headers map<string,string>, body binary, refers_to long, file string, error string", rows=64)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The captures among them that are whole, in the shape that ``resolve_revisits`` takes, with the body beside."""
    return read_records(spark, path).where("error IS NULL AND kind IN ('response', 'revisit', 'identical')").drop("error", "file")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """The record stream that ``pages`` stands for: a full response for each page, at time 2 * page_id, whose tag is the digest of its
    HTML, and a later conditional request of the same URL, answered "not modified" with the tag of the page it was made with.
    Pages of one canonical URL are so captures of it in turn, and a tag fails to match once another capture lies between.
    Of each ten pages, one is asked for before its own response, one with an outdated tag, and one record lost its URL."""
    tag = F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"'))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (2 * F.col("page_id")).alias("t"), F.lit("response").alias("kind"),
        F.map_filter(F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("cache-control"), F.lit("max-age=60")), lambda k, v: v.isNotNull()).alias("headers"),
    )
    case = F.pmod(F.col("page_id"), F.lit(10))
    later = 2 * F.col("page_id") + F.when(case == 7, F.lit(-1)).otherwise(2 * F.length(F.coalesce("url", F.lit(""))) + 1)
    asked = F.when(case == 8, F.concat(F.lit('"old-'), F.md5(F.col("html")), F.lit('"'))).otherwise(tag)
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.when(case != 9, F.col("url")).alias("url"), later.alias("t"), F.lit("revisit").alias("kind"),
        F.map_filter(F.create_map(F.lit("etag"), asked, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120")), lambda k, v: v.isNotNull()).alias("headers"),
    )
    return full.unionByName(again)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of_pages(read(spark, sf_dir, "pages")))
    h = F.col("headers")
    return out.select("revisit_id", "url_key", "t", "response_id", "status", F.element_at(h, "etag").alias("etag"), F.element_at(h, "content-length").alias("content_length"), F.element_at(h, "cache-control").alias("cache_control"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', '') AS u FROM pages
), k AS (
  SELECT page_id, url, html,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS q
  FROM p
), c AS (
  SELECT page_id, html, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key,
    2 * page_id AS id, 2 * page_id + CASE WHEN page_id % 10 = 7 THEN -1 ELSE 2 * length(coalesce(url, '')) + 1 END AS later
  FROM k
), v AS (
  SELECT 2 * page_id + 1 AS revisit_id, CASE WHEN page_id % 10 <> 9 THEN url_key END AS url_key, later AS t,
    CASE WHEN page_id % 10 = 8 THEN '"old-' ELSE '"' END || md5(html) || '"' AS tag FROM c
), m AS (
  SELECT v.*, f.id AS response_id, '"' || md5(f.html) || '"' AS stored, strlen(f.html) AS size
  FROM v ASOF LEFT JOIN c f ON v.url_key = f.url_key AND v.t >= f.id
), s AS (
  SELECT *, CASE WHEN url_key IS NULL THEN 'no_url' WHEN response_id IS NULL THEN 'no_response'
    WHEN tag IS NULL OR tag = stored THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM m
)
SELECT revisit_id, url_key, t, response_id, status,
  CASE WHEN status = 'resolved' THEN tag END AS etag,
  CASE WHEN status = 'resolved' THEN CAST(size AS VARCHAR) END AS content_length,
  CASE WHEN status = 'resolved' THEN 'max-age=120' END AS cache_control
FROM s
"""
