"""WARC: revisit records resolved to the latest earlier full response of their canonical URL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import named
from .scratch import save
from .urls import canonical

#: Header fields of a 304 answer that replace those of the stored response (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Slices of time, each with about as many records: a URL with a third of all records is spread over them.
SLICES = 1024


def _field(headers: str, name: str) -> Column:
    """A field of an array of (name, value); names are lower-case."""
    return F.try_element_at(F.filter(F.col(headers), lambda h: h["name"] == name), F.lit(1))["value"]


def _slice(ts: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` the time has reached, by halving."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda acc, x: F.when(F.get(held, acc + x - 1) <= ts, acc + x).otherwise(acc))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, uri, ts, outcome, source_id, payload_digest, payload_bytes, headers for every record.

    ``records``: record_id long, uri string, ts long, warc_type string, status
    int, headers map<string, string>, payload_digest string, payload_bytes long.
    A full response is a ``response`` record with status 200; it keeps what it
    has (outcome ``full``).  A ``revisit`` is joined with the latest full response
    of the same canonical URL with a smaller ts (of equal ts, the largest
    record_id).  Its validators must agree: the entity tag by weak comparison if
    it has one, else Last-Modified, else the payload digest.  Outcomes:
    ``resolved``, with the source's digest and size and its headers, in which
    the permitted fields of the revisit replace the source's; ``mismatch``,
    ``unvalidated`` (no validator given) and ``missing`` (no earlier response) keep the
    revisit's own.  Other records have outcome ``other``.  Null URIs match
    nothing, null times are never earlier or later than anything.

    As-of by two windows: within (URL, slice of time), and over the last response
    of each slice; so the records of one URL don't meet in one task.  The slices
    are bounded by quantiles of all times, so single times far away from the
    others change nothing.  Repeated records are resolved alike; an empty table
    gives an empty result.
    """
    lower = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    heads = F.array_sort(F.coalesce(lower, F.array().cast("array<struct<name:string,value:string>>")))
    r = records.select("record_id", "uri", canonical(F.col("uri")).alias("site"), "ts", "warc_type", "status", heads.alias("heads"), "payload_digest", "payload_bytes")
    r = save(r, "records")
    cuts = r.agg(F.percentile_approx("ts", [k / SLICES for k in range(1, SLICES)], 10 * SLICES)).first()[0]
    bounds = sorted(set(cuts or []))
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("site").isNotNull() & F.col("ts").isNotNull()
    me = F.when(full, F.struct("ts", "record_id", "heads", "payload_digest", "payload_bytes"))
    r = r.withColumn("slice", F.when(F.col("ts").isNotNull(), _slice(F.col("ts"), bounds))).withColumn("me", me)
    within = Window.partitionBy("site", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    ends = r.groupBy("site", "slice").agg(F.max("me").alias("end"))
    before = Window.partitionBy("site").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carry", F.max("end").over(before)).filter("carry is not null").select("site", "slice", "carry")
    found = r.withColumn("near", F.max("me").over(within)).join(ends, ["site", "slice"], "left").withColumn("src", F.coalesce("near", "carry"))
    src = found.withColumn("src_heads", F.col("src.heads"))
    tag, date = _field("heads", "etag"), _field("heads", "last-modified")
    agrees = (
        F.when(tag.isNotNull(), F.coalesce(_strong(tag) == _strong(_field("src_heads", "etag")), F.lit(False)))
        .when(date.isNotNull(), F.coalesce(date == _field("src_heads", "last-modified"), F.lit(False)))
        .when(F.col("payload_digest").isNotNull(), F.coalesce(F.col("payload_digest") == F.col("src.payload_digest"), F.lit(False)))
    )
    outcome = (
        F.when(F.col("me").isNotNull(), "full")
        .when(F.coalesce(F.col("warc_type") != "revisit", F.lit(True)), "other")
        .when(F.col("src").isNull() | F.col("ts").isNull() | F.col("site").isNull(), "missing")
        .when(agrees.isNull(), "unvalidated")
        .otherwise(F.when(agrees, "resolved").otherwise("mismatch"))
    )
    out = src.withColumn("outcome", outcome)
    new = F.filter("heads", lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    merged = F.array_sort(F.concat(new, F.filter("src_heads", lambda h: ~F.array_contains(names, h["name"]))))
    ok = F.col("outcome") == "resolved"
    text = F.array_join(F.transform(F.when(ok, merged).otherwise(F.col("heads")), lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), "\n")
    return out.select(
        "record_id", "uri", "ts", "outcome",
        F.when(ok, F.col("src.record_id")).when(F.col("outcome") == "full", F.col("record_id")).alias("source_id"),
        F.when(ok, F.col("src.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(ok, F.col("src.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        text.alias("headers"),
    )


def _members(data: bytes) -> Iterator[bytes]:
    """The parts of a file: its gzip members, unpacked, or the file as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(data)
        data = unpack.unused_data


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Fields of a header block; a line that begins with a space goes on with the one before, of repeated names the first counts."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        last = name.strip().decode("latin-1").lower() if colon else None
        if last in out:
            last = None
        if last:
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def parse_warc(data: bytes) -> Iterator[tuple]:
    """(uri, ts, warc_type, status, headers, payload_digest, payload_bytes) of each record of a WARC file, packed or not.

    ts is microseconds of WARC-Date; headers are those of the HTTP block; the
    digest is WARC-Payload-Digest or, without one, sha256 of a response's
    payload.  What follows a record cut short or without a length is left out.
    """
    for part in _members(data):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                break
            own = _fields(part[at:end].split(b"\r\n")[1:])
            size, start = own.get("content-length", ""), end + 4
            if not size.isdigit() or start + int(size) > len(part):
                break
            block, at = part[start : start + int(size)], start + int(size)
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.startswith(b"HTTP/")
            lines = head.split(b"\r\n")
            code = lines[0].split(b" ")[1:2] if http else []
            status = int(code[0]) if code and code[0].isdigit() else None
            try:
                stamp = datetime.fromisoformat(own.get("warc-date", "").replace("Z", "+00:00"))
                ts = round(stamp.timestamp() * 1_000_000)
            except ValueError:
                ts = None
            kind = own.get("warc-type")
            digest = own.get("warc-payload-digest") or (f"sha256:{hashlib.sha256(payload).hexdigest()}" if http and kind == "response" else None)
            yield own.get("warc-target-uri", "").strip("<>") or None, ts, kind, status, _fields(lines[1:]) if http else {}, digest, len(payload) if http else 0


def read_records(files: DataFrame, content: str = "content") -> DataFrame:
    """The records of WARC files (such as ``spark.read.format("binaryFile")`` gives) as :func:`resolve_revisits` takes them.

    A file is read in one task; record_id is the order of files and records.
    Null and empty files have no records.
    """
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]
    names = ["uri", "ts", "warc_type", "status", "headers", "payload_digest", "payload_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                rows = list(parse_warc(x.as_buffer().to_pybytes() if x.is_valid else b""))
                cols = [[list(r[k].items()) if k == 4 else r[k] for r in rows] for k in range(7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)

    got = files.select(named(content).alias("content")).mapInArrow(run, "uri string, ts long, warc_type string, status int, headers map<string,string>, payload_digest string, payload_bytes long")
    return got.select(F.monotonically_increasing_id().alias("record_id"), *names)


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl made of ``pages`` (page_id, url, html), two records a page.

    A full response at time 2 * page_id, and a later revisit of the same URL with
    the entity tag of that response; every seventh page's revisit has another
    tag, every fifth only a Last-Modified.
    """
    at = F.col("page_id") * 2
    digest, size = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    p = pages.select("page_id", "url", digest.alias("d"), size.alias("n"), at.alias("t"))
    tag, day = F.concat(F.lit('"'), F.substring("d", 1, 12), F.lit('"')), F.concat(F.lit("day "), F.floor(F.col("page_id") / 10).cast("string"))
    first = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n").cast("string"), F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.lit("max-age=60"))
    later = F.when(F.col("page_id") % 7 == 3, F.lit('"other"')).when(F.col("page_id") % 5 != 0, F.concat(F.lit("W/"), tag))
    again = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), later, F.lit("Last-Modified"), day, F.lit("Date"), F.concat(F.lit("time "), F.col("t").cast("string")), F.lit("Set-Cookie"), F.lit("x=1"))
    again = F.map_filter(again, lambda _, v: v.isNotNull())
    visit = F.col("t") + 1 + 2 * (F.col("page_id") * 37 % 50)
    records = F.array(
        F.struct(F.col("t").alias("record_id"), F.col("t").alias("ts"), F.lit("response").alias("warc_type"), F.lit(200).alias("status"), first.alias("headers"), F.col("d").alias("payload_digest"), F.col("n").alias("payload_bytes")),
        F.struct((F.col("t") + 1).alias("record_id"), visit.alias("ts"), F.lit("revisit").alias("warc_type"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("payload_digest"), F.lit(0).cast("long").alias("payload_bytes")),
    )
    return p.select(F.col("url").alias("uri"), F.explode(records).alias("r")).select("uri", "r.*")
