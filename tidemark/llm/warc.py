"""WARC archives of pages: records written by Spark, read back, and put together to one nested row a capture.

Writing gives each page a request, a response and a metadata record; request and metadata name the response in
WARC-Concurrent-To. Of equal payloads of at least `LEAST` bytes the page with the
largest id keeps the response, the others become revisits that refer to it and hold no payload. Which pages are
equal is found on digests; payloads are shuffled once, by digest, and a digest of very many pages is a plain
join whose side Spark splits. Records are made by column expressions and go out through Spark's text writer, so
any store that Spark writes to will do; a file holds at most `FILE_RECORDS` records, gzip-compressed.

Reading takes files whole but unpacks and parses them as a stream, record by record, by Content-Length, and
checks each payload against its digest. Assembly joins records to captures by concurrent-to identifiers, in
either direction and over any number of steps: records next to captures first, then those next to these.

Defined cases: a null html counts as empty, a null url is left out, control characters of a url are written as
percent codes; a null page id is below all others. Rows that repeat give the same records; a capture counts its
`copies`. Rows of one id with other urls or payloads are captures of their own. Records that no identifier leads
from to a capture have no row. An empty table gives an archive without records. Other columns are ignored,
whatever their names. A malformed record or a payload that doesn't match its digest raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_path

from . import common

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
FILE_RECORDS = 60_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURES = ["response", "revisit"]
_SCHEMA = "type string, record_id string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def _uuid(*parts: Column) -> Column:
    """<urn:uuid:..> of some values; a null differs from every text."""
    code = F.md5(F.concat(*[F.concat(F.coalesce(F.length(p.cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(code, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, record_id: Column, headers: dict[str, Column], content_type: str, block: Column) -> Column:
    """A record but for its last byte, a newline, which the writer adds. Headers that are null are left out."""
    lines = [F.lit("WARC/1.0"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items()]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def _kinds(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, payload, size, digest, id, top): top is the response's (page_id, url, id) of a payload that
    several pages have."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    # Control characters would end a header.
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%20")
    rows = pages.select("page_id", url.alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("id", _uuid(F.col("page_id"), F.col("url"), F.col("digest")))
    # Payloads are equal if their SHA-256 is; short ones are dealt out by row and meet nothing.
    same = F.when(F.col("size") >= least, F.unhex(F.sha2(F.col("payload").cast("binary"), 256))).otherwise(F.unhex(F.md5(F.col("id").cast("binary"))))
    rows = rows.withColumn("same", same)
    groups = rows.where(F.col("size") >= least).groupBy("same").agg(F.count("*").alias("c"), F.max(F.struct("page_id", "url", "id")).alias("top")).where("c > 1").drop("c")
    return rows.join(groups, "same", "left").drop("same")


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Archives of pages: (page_id, url, html), as gzip-compressed files of WARC records in the folder `path`."""
    rows = _kinds(pages, least)
    # Of rows that repeat, all that are the response's own count as responses.
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    at = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.col("url")}
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    response = _record("response", F.col("id"), at | digest, "application/http; msgtype=response", F.concat(http, F.col("payload")))
    refers = {"WARC-Refers-To": F.col("top.id"), "WARC-Refers-To-Target-URI": F.col("top.url"), "WARC-Profile": F.lit(PROFILE)}
    again = _record("revisit", F.col("id"), at | digest | refers, "application/http; msgtype=response", http)
    to = {"WARC-Concurrent-To": F.col("id")}
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[^:/?#]+://)?([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[^:/?#]+://)?([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _record("request", _uuid(F.lit("request"), F.col("id")), at | to, "application/http; msgtype=request", get)
    about = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", _uuid(F.lit("metadata"), F.col("id")), at | to, "application/warc-fields", about)
    out = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    out.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class _Stream:
    """Bytes of an archive, plain or gzip-compressed in any number of members, unpacked as they are asked for."""

    STEP = 1 << 18

    def __init__(self, data: bytes):
        self.data, self.at, self.ahead = memoryview(data), 0, bytearray()
        self.packed = data[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        if self.at >= len(self.data) and not (self.packed and self.unpack.unconsumed_tail):
            return False
        if not self.packed:
            self.ahead += self.data[self.at : self.at + self.STEP]
            self.at += self.STEP
            return True
        source = self.unpack.unconsumed_tail
        if not source:
            source = self.data[self.at : self.at + self.STEP]
            self.at += self.STEP
        self.ahead += self.unpack.decompress(source, 4 * self.STEP)
        if self.unpack.eof:
            self.at -= len(self.unpack.unused_data) + max(0, self.at - len(self.data))
            self.unpack = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with `mark`; None at the end of the archive."""
        start = 0
        while (k := self.ahead.find(mark, start)) < 0:
            start = max(0, len(self.ahead) - len(mark) + 1)
            if not self._more():
                if bytes(self.ahead).strip():
                    raise ValueError("a WARC file ends inside a record's headers")
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.ahead) < n:
            if not self._more():
                raise ValueError("a WARC file ends inside a record")
        out = bytes(self.ahead[:n])
        del self.ahead[:n]
        return out


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive file in order."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().lstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("a WARC record doesn't start with its version")
        every = _fields(lines)
        named = dict(every)
        block = stream.take(int(named["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is longer than it says")
        kind, payload, fields = named["warc-type"], block, {}
        if named.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif named.get("content-type") == "application/warc-fields":
            fields = dict(_fields(block.decode().split("\r\n")))
        digest = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
        got = hashlib.sha1(payload).hexdigest()
        if kind == "response" and digest and digest != got:
            raise ValueError(f"the payload of {named.get('warc-record-id')} doesn't match its digest")
        yield {
            "type": kind,
            "record_id": named.get("warc-record-id"),
            "concurrent_to": [v for k, v in every if k == "warc-concurrent-to"],
            "refers_to": named.get("warc-refers-to"),
            "uri": named.get("warc-target-uri"),
            "date": named.get("warc-date"),
            "digest": digest,
            "fields": fields,
            "payload_bytes": len(payload),
            "payload_digest": got,
            "payload": payload,
        }


def _parsed(payloads: bool):
    names = ["type", "record_id", "concurrent_to", "refers_to", "uri", "date", "digest", "fields", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        cols = [pa.array([list(r[n].items()) if n == "fields" else r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                rows, size = [], 0
                for record in parse(content.as_py()):
                    if not payloads:
                        record["payload"] = None
                    rows.append(record)
                    size += 500 + (record["payload_bytes"] if payloads else 0)
                    if size > common.SLICE_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    return run


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in the folder `path`; without `payloads` their bytes stay behind, not their
    number and digest."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_parsed(payloads), _SCHEMA)


def captures(found: DataFrame) -> DataFrame:
    """(capture_id, copies, type, uri, date, refers_to, digest, payload_bytes, payload_digest, payload, request,
    metadata, n_requests, n_metadata): one nested row for each response or revisit of `records`.

    request and metadata are the records that concurrent-to identifiers join with the capture, of several the one
    with the least id; the numbers count all of them."""
    own = F.struct("type", "concurrent_to", "refers_to", "uri", "date", "digest", "fields", "payload_bytes", "payload_digest", "payload")
    rows = common.materialize(found.groupBy("record_id").agg(F.first(own).alias("r"), F.count("*").alias("copies")).select("record_id", "copies", "r.*"), "warc-records")
    edges = rows.select(F.col("record_id").alias("u"), F.explode("concurrent_to").alias("v")).where("u <> v")
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    is_capture = F.col("type").isin(CAPTURES)
    # From captures outwards: what the last step reached reaches its neighbours that have no capture yet.
    near = rows.where(is_capture).select("record_id", F.col("record_id").alias("capture_id"))
    reached, attached = near.select("record_id"), None
    others = rows.where(~is_capture).select("record_id")
    while True:
        step = near.select(F.col("record_id").alias("u"), "capture_id").join(edges, "u").select(F.col("v").alias("record_id"), "capture_id")
        near = common.materialize(step.join(others, "record_id", "left_semi").join(reached, "record_id", "left_anti").distinct(), "warc-near")
        if near.isEmpty():
            break
        attached = near if attached is None else attached.unionByName(near)
        reached = reached.unionByName(near.select("record_id"))
    side = F.struct("record_id", "uri", "date", "fields", "payload_bytes", "payload_digest", "payload")
    main = rows.where(is_capture).select(F.col("record_id").alias("capture_id"), "copies", "type", "uri", "date", "refers_to", "digest", "payload_bytes", "payload_digest", "payload")
    if attached is None:
        attached = near
    joined = rows.where(~is_capture).join(attached, "record_id").select("capture_id", "record_id", "type", side.alias("side"))
    of = lambda kind, c: F.when(F.col("type") == kind, c)
    sides = joined.groupBy("capture_id").agg(
        *[F.min_by("side", of(k, F.col("record_id"))).alias(k) for k in ("request", "metadata")],
        F.count(of("request", F.lit(1))).alias("n_requests"),
        F.count(of("metadata", F.lit(1))).alias("n_metadata"),
    )
    return main.join(sides, "capture_id", "left").fillna(0, ["n_requests", "n_metadata"])


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, written to archives and
    read back; bytes and digest are of the full payload, a revisit's those of its response."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least)
    common.owned(spark.read.format("binaryFile").load(path), path)
    kind = pages.schema["page_id"].dataType
    number = F.col("metadata.fields")["page_id"].cast(kind)
    # A row for each copy.
    found = captures(records(spark, path, payloads=False)).select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "capture_id", "type", "refers_to", "digest", "payload_bytes", "payload_digest", number.alias("page_id"))
    found = common.materialize(found, "warc-captures")
    whole = found.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    first = found.where("type = 'response'").groupBy("capture_id").agg(F.first(F.struct(F.col("page_id").alias("id"), "payload_bytes", "payload_digest")).alias("to"))
    again = found.where("type = 'revisit'").select("page_id", "digest", F.col("refers_to").alias("capture_id")).join(first, "capture_id", "left")
    held = F.when(F.col("to.payload_digest") == F.col("digest"), F.col("to.payload_digest")).otherwise(F.raise_error(F.lit("a revisit's digest isn't its response's")))
    again = again.select("page_id", "to.payload_bytes", held.alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("to.id").alias("refers_to"))
    return whole.unionByName(again)
