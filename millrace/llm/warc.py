"""Revisit resolution of archived captures: as-of join of not-modified records to the latest earlier full response.

Method. Captures are keyed by canonical url. A 304 revisit is matched with the latest full response of its key that is earlier (by time, then record id). If the revisit has an ETag it must equal the response's in weak
comparison; else its Last-Modified must equal the response's; else there is nothing to check. A match takes the response's
payload and headers, updated by the headers that a 304 may change.

The as-of join runs inside (key, time bucket) and carries the last response of earlier buckets over, so a key with very many captures is
spread over its buckets, of which only one row each meets in one place.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare

#: Query parameters that do not change a resource.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: Headers of the stored response that a 304 must not change.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade",
)
BUCKET_SECONDS = 3600


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment, tracking parameters or closing slash; other parameters sorted. Null stays null."""
    bare = F.regexp_replace(url, r"(?s)#.*\z", "")
    front = F.lower(F.regexp_extract(bare, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    front = F.regexp_replace(F.regexp_replace(front, r"\A(http://[^/]*):80\z", "$1"), r"\A(https://[^/]*):443\z", "$1")
    rest = F.regexp_replace(bare, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)\A[^?]*", 0), r"/\z", "")
    params = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)\z", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(front, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"\AW/", "")


def resolve_revisits(captures: DataFrame, *, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: record_id, url (canonical), outcome, response_id, payload_digest, headers.

    ``captures`` has record_id, uri, time (timestamp), kind ("response" or "revisit"), status, headers (map of lower-case name to value), payload_digest; others are ignored. Full responses are
    kind response with status 200; revisits are kind revisit with status 304; other rows play no part. outcome is ``resolved``, ``unvalidated`` (the revisit has no validator;
    also resolved), ``changed`` (a validator differs or is missing in the response) or ``missing`` (no earlier response, or a null url or time). Only the first two have a response_id, payload_digest and headers.
    Of responses at one time the largest record id counts; a response at a revisit's own time counts if its id is smaller. Null ids sort first. Repeated rows give repeated results; an empty table gives an empty
    result. Null headers are none.
    """
    prepare(captures.sparkSession)
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    again = (F.col("kind") == "revisit") & (F.col("status") == 304)
    rows = captures.select(
        canonical(F.col("uri")).alias("url"), F.unix_micros(F.col("time").cast("timestamp")).alias("at"), F.col("record_id").alias("id"),
        F.coalesce(again, F.lit(False)).alias("again"), F.coalesce(full, F.lit(False)).alias("full"), F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("headers"), "payload_digest",
    ).where("again or full")
    rows = rows.withColumn("bucket", F.expr(f"at div {bucket_seconds * 1_000_000}L"))
    response = F.when(F.col("full"), F.struct("id", "headers", "payload_digest"))
    inside = Window.partitionBy("url", "bucket").orderBy("at", F.col("id").asc_nulls_first(), "again").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.where("url is not null and at is not null").withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("again")
    ends = rows.where("url is not null and at is not null").groupBy("url", "bucket").agg(F.max_by(response, F.when(F.col("full"), F.struct("at", "id"))).alias("end"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select("url", "bucket", F.last("end", ignorenulls=True).over(before).alias("far")).where("far is not null")
    met = near.join(far, ["url", "bucket"], "left").withColumn("r", F.coalesce("near", "far"))
    alone = rows.where("again and (url is null or at is null)").select("url", "id", "headers", F.lit(None).cast(met.schema["r"].dataType).alias("r"))
    met = met.select("url", "id", "headers", "r").unionByName(alone)

    own = lambda name: F.col("headers")[name]
    stored = lambda name: F.col("r.headers")[name]
    outcome = (
        F.when(F.col("r").isNull(), "missing")
        .when(own("etag").isNotNull(), F.when(_weak(own("etag")) == _weak(stored("etag")), "resolved").otherwise("changed"))
        .when(own("last-modified").isNotNull(), F.when(own("last-modified") == stored("last-modified"), "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    met = met.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unvalidated")
    allowed = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return met.select(
        F.col("id").alias("record_id"), "url", "outcome", F.when(good, F.col("r.id")).alias("response_id"), F.when(good, F.col("r.payload_digest")).alias("payload_digest"), F.when(good, merged).alias("headers")
    )


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name, and block, of each record of a WARC file, gzipped by record or whole or not at all."""
    view, pending, at = memoryview(content), bytearray(), 0
    while at < len(view) or pending:
        if at < len(view):
            if content[:2] == b"\x1f\x8b":
                member = zlib.decompressobj(31)
                pending += member.decompress(view[at:])
                at = len(view) - len(member.unused_data) if member.eof else len(view)
            else:
                pending += view[at:]
                at = len(view)
        start = 0
        while (found := pending.find(b"WARC/", start)) >= 0 and (end := pending.find(b"\r\n\r\n", found)) >= 0:
            fields = _fields(bytes(pending[found:end]).split(b"\r\n")[1:])
            size = int(fields.get("content-length", "0"))
            if end + 4 + size > len(pending):
                break
            yield fields, bytes(pending[end + 4 : end + 4 + size])
            start = end + 4 + size
        if start == 0 and at >= len(view):
            return
        del pending[:start]


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines as a map of lower-case name to value; values of a repeated name are joined by commas, continued lines by a blank."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        name, colon, value = text.partition(":")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        elif colon:
            last = name.strip().lower()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "uri", "time", "kind", "status", "headers", "payload_digest"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
    for batch in batches:
        rows = []
        for content in batch.column(0).to_pylist():
            for fields, block in _records(content or b""):
                kind = fields.get("warc-type")
                if kind in ("response", "revisit"):
                    head, _, body = block.partition(b"\r\n\r\n")
                    first, *rest = head.split(b"\r\n")
                    code = first.split(b" ")[1:2]
                    status = int(code[0]) if first.startswith(b"HTTP/") and code and code[0].isdigit() else None
                    given = fields.get("warc-payload-digest") or ("sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else None)
                    rows.append((fields.get("warc-record-id"), (fields.get("warc-target-uri") or "").strip("<>") or None, fields.get("warc-date"), kind, status, list(_fields(rest).items()), given))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the response and revisit records of WARC files (.warc or .warc.gz): record_id, uri, time, kind, status, headers, payload_digest.

    A file is one row of a task, so it must be below 2 GB, as such archives are. A date that is none gives a null time, a record cut off at a file's end is left out, other record types play no part.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(_captures, "record_id string, uri string, time string, kind string, status int, headers map<string,string>, payload_digest string")
    return out.withColumn("time", F.try_to_timestamp("time"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log of a page table: each page is a response at minute page_id and a not-modified revisit, with validators and headers made from the page.

    By page_id modulo 5 the revisit is a week later with the response's etag, or another etag, or its date of change, or no validator, or it is a day before.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    base = pages.select("page_id", "url", digest.alias("digest"), (F.col("page_id") % 5).alias("way"))
    tag, changed = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')), F.concat(F.lit("day "), F.substring("digest", 17, 8))
    at = lambda shift: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + shift)
    first = base.select(
        (F.col("page_id") * 2).alias("record_id"), F.col("url").alias("uri"), at(0).alias("time"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("digest").cast("string"), F.lit("etag"), tag, F.lit("last-modified"), changed, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        F.col("digest").alias("payload_digest"),
    )
    validators = F.create_map(F.lit("etag"), F.when(F.col("way").isin(0, 4), F.concat(F.lit("W/"), tag)).when(F.col("way") == 1, '"other"'), F.lit("last-modified"), F.when(F.col("way") == 2, changed))
    second = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("uri"), at(F.when(F.col("way") == 4, -86_400).otherwise(7 * 86_400)).alias("time"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_concat(F.map_filter(validators, lambda k, v: v.isNotNull()), F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("age"), F.col("page_id").cast("string"))).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return first.unionByName(second)


def digest(resolved: DataFrame) -> DataFrame:
    """Flat columns: the headers as sorted lines, response_id -1 where there is none."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return resolved.select("record_id", "url", "outcome", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "payload_digest", lines.alias("headers"))


def oracle() -> str:
    """The query's rows in DuckDB SQL, with an as-of join."""
    tracked = ", ".join(f"'{t}'" for t in TRACKING)
    return rf"""
with p as (select page_id, regexp_replace(url, '#.*$', '', 's') bare, sha256(coalesce(html, '')) d from pages),
k as (select page_id, d, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) front, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') rest from p),
q as (select page_id, d, regexp_replace(regexp_replace(front, '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1') || regexp_replace(regexp_extract(rest, '^[^?]*'), '/$', '') head,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ({tracked}))) params from k),
u as (select page_id, d, head || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end url from q),
a as (select page_id * 2 id, url, page_id * 60 ts, d from u),
b as (select page_id * 2 + 1 id, url, page_id * 60 + case when page_id % 5 = 4 then -86400 else 604800 end ts, d, page_id, page_id % 5 way from u),
j as (select b.id, b.url, b.d own, b.page_id, way, a.id rid, a.d stored from b asof left join a on b.url = a.url and b.ts >= a.ts),
o as (select *, case when rid is null then 'missing' when way in (0, 4) then case when own[1:16] = stored[1:16] then 'resolved' else 'changed' end when way = 1 then 'changed'
  when way = 2 then case when own[17:24] = stored[17:24] then 'resolved' else 'changed' end else 'unvalidated' end outcome from j)
select id record_id, url, outcome, case when outcome in ('resolved', 'unvalidated') then rid else -1 end response_id, case when outcome in ('resolved', 'unvalidated') then stored end payload_digest,
  case when outcome in ('resolved', 'unvalidated') then 'age: ' || page_id || chr(10) || 'cache-control: max-age=120' || chr(10) || 'content-length: 64' || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || case when way in (0, 4) then 'W/' else '' end || '"' || stored[1:16] || '"' || chr(10) || 'last-modified: day ' || stored[17:24] end headers
from o
"""
