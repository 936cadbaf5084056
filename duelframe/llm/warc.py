"""WARC archives: write request, response or revisit, and metadata records, read them back, and assemble captures.

Writing.  A capture is three records that share a target and name each other through WARC-Concurrent-To.  Of captures
with equal payloads of at least ``min_bytes``, the one with the largest id is the response and the others are revisits
of it, which hold the HTTP head only.  Records are UTF-8 text and are written by Spark's own writer as gzip files in the
shared folder; a file holds a bounded number of records, so that one task can read it.

Reading.  Files come as binaries through Spark's reader, are inflated as a stream and parsed by Content-Length, never by
searching for a separator.  Digests are recomputed from the payload read.

Assembly.  Requests and metadata join their response or revisit through the concurrent-to identifier, giving one nested
row per capture; a revisit finds its response through WARC-Refers-To.

Defined results: a null payload is an empty one; a null url is an empty target; a null id is written as none and read as
null.  Rows that repeat an id with the same payload are captures of their own, all responses if theirs is the largest
id.  Extra columns are not archived.  An empty table gives no record and no capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import shared_folder, text_of, utf8_bytes

MIN_BYTES = 1000
FILE_BYTES = 32 << 20  # payload bytes that a file holds on average, at most
DATE = "2024-01-01T00:00:00Z"  # of every record, so that reruns agree
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("record_id string, kind string, concurrent_to string, refers_to string, target string, content_type string, "
          "payload_bytes long, payload_digest string, digest_ok boolean, fields map<string,string>, payload binary")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _one_line(text: Column) -> Column:
    """A header value: line breaks would end it."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def _record(kind: str | Column, record_id: Column, target: Column, content_type: str, block: Column, *more: Column) -> Column:
    """One record without its last line break, which the writer adds."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(
        EOL, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), target), *more, F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), utf8_bytes(block).cast("string")), F.lit(""), F.concat(block, F.lit(EOL)))


def plan_captures(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = MIN_BYTES) -> DataFrame:
    """Each capture with its record ids, digest, and the response it revisits (null for a response)."""
    body = text_of(payload)
    rows = pages.select(
        F.col(id_col).alias("_id"), _one_line(F.coalesce(F.col(url), F.lit(""))).alias("_url"), body.alias("_body"),
        F.sha1(body.cast("binary")).alias("_digest"), utf8_bytes(body).alias("_bytes"),
        F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_rid", _uuid(F.lit("r"), F.coalesce(F.col("_id").cast("string"), F.lit("none")), "_row"))
    # Only digests that several captures share go on; a frequent one is combined before the shuffle.
    latest = F.max(F.struct("_id", "_rid"))
    shared = (rows.where(F.col("_bytes") >= min_bytes).groupBy("_digest")
              .agg(latest.alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest", "_kept"))
    joined = rows.join(shared, "_digest", "left")
    revisit = (F.col("_bytes") >= min_bytes) & F.col("_kept").isNotNull() & ~F.col("_kept._id").eqNullSafe(F.col("_id"))
    return joined.withColumn("_refers", F.when(revisit, F.col("_kept._rid"))).drop("_kept")


def record_texts(captures: DataFrame) -> DataFrame:
    """The three records of each capture as text, one row each."""
    target, rid = F.col("_url"), F.col("_rid")
    ident = F.coalesce(F.col("_id").cast("string"), F.lit("none"))
    head = F.concat_ws(EOL, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                       F.concat(F.lit("Content-Length: "), F.col("_bytes").cast("string")), F.lit(""), F.lit(""))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"))
    response = _record("response", rid, target, "application/http; msgtype=response", F.concat(head, F.col("_body")), digest)
    again = _record("revisit", rid, target, "application/http; msgtype=response", head, digest,
                    F.concat(F.lit("WARC-Refers-To: <"), F.col("_refers"), F.lit(">")), F.lit(f"WARC-Profile: {PROFILE}"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <"), rid, F.lit(">"))
    ask = F.concat_ws(EOL, F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1")), F.lit("User-Agent: archiver"), F.lit(""), F.lit(""))
    request = _record("request", _uuid(F.lit("q"), rid), target, "application/http; msgtype=request", ask, concurrent)
    facts = F.concat(F.lit("capture-id: "), ident, F.lit(EOL))
    metadata = _record("metadata", _uuid(F.lit("m"), rid), target, "application/warc-fields", facts, concurrent)
    main = F.when(F.col("_refers").isNull(), response).otherwise(again)
    return captures.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    mean = pages.agg(F.avg(utf8_bytes(text_of(payload)))).first()[0] or 1.0
    records = 3 * max(1, int(file_bytes / max(mean, 1000.0)))
    (record_texts(plan_captures(pages, id_col, url, payload, min_bytes)).write
     .option("lineSep", EOL).option("compression", "gzip").option("maxRecordsPerFile", records).text(path))


class _Stream:
    """Inflates one file bit by bit; several gzip members may follow each other."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step, self.buffer = data, 0, step, bytearray()
        self.inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.inflate is None or not self.inflate.eof:
            chunk = self.data[self.at:self.at + self.step]
            if not chunk:
                return False
            self.at += len(chunk)
            self.buffer += chunk if self.inflate is None else self.inflate.decompress(chunk)
            return True
        rest = self.inflate.unused_data
        self.at -= len(rest)
        if self.at >= len(self.data):
            return False
        self.inflate = zlib.decompressobj(31)
        return self.more()

    def head(self) -> bytes | None:
        """Up to the blank line, without it."""
        start = 0
        while (end := self.buffer.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(self.buffer) - 3)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a record head")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[:end + 4]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("archive ends inside a record block")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _named(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive file, in order; see ``RECORD``."""
    stream = _Stream(data)
    while (raw := stream.head()) is not None:
        lines = raw.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {lines[0][:40]!r}")
        head = _named(lines[1:])
        block = stream.take(int(head["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record's block isn't followed by two line breaks")
        kind, payload, length, digest, ok, fields = head.get("warc-type"), None, None, None, None, {}
        stated = head.get("warc-payload-digest", "").partition(":")[2].lower() or None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            fields = _named(http.split(b"\r\n")[1:])
            if kind == "response":
                length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                ok = stated is None or stated == digest
            else:
                length, digest, payload = int(fields.get("content-length", 0)), stated, None
        elif head.get("content-type") == "application/warc-fields":
            fields = _named(block.split(b"\r\n"))
        bare = lambda key: head[key].strip("<>") if key in head else None
        yield (bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), head.get("warc-target-uri"),
               head.get("content-type"), length, digest, ok, fields, payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records below ``path``; without payloads the digests are still computed from them."""
    names = [part.split()[0] for part in RECORD.split(", ")]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for data in files["content"]:
                rows, held = [], 0
                for record in parse(data, with_payload):
                    rows.append(record)
                    held += len(record[-1] or b"") + 500
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInPandas(parsed, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (response or revisit), ``request``, ``metadata``, ``original``."""
    inner = F.struct("record_id", "kind", "target", "content_type", "payload_bytes", "payload_digest", "digest_ok",
                     "refers_to", "fields", "payload")
    around = F.struct("record_id", "target", "content_type", "fields")
    main = records.where(F.col("kind").isin("response", "revisit")).select("record_id", inner.alias("capture"))
    ask = records.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), around.alias("request"))
    facts = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), around.alias("metadata"))
    whole = main.join(ask, "record_id", "left").join(facts, "record_id", "left")
    # the originals that revisits name; an original may be named by very many
    plain = whole.where("capture.refers_to IS NULL").withColumn("original", F.lit(None).cast("string"))
    original = whole.select(F.col("record_id").alias("_refers"), F.col("metadata.fields")["capture-id"].alias("original"))
    again = whole.where("capture.refers_to IS NOT NULL").withColumn("_refers", F.col("capture.refers_to"))
    again = again.join(original, "_refers", "left").drop("_refers")
    return plain.unionByName(again)


def page_digests(spark: SparkSession, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write all pages, read the archive back, and give each page's digest row."""
    path = shared_folder(spark, "warc")
    write_archive(pages, path, id_col)
    kind = pages.schema[id_col].dataType
    ident = lambda c: F.when(c != "none", c).cast(kind)
    return captures(read_records(spark, path, with_payload=False)).select(
        ident(F.col("metadata.fields")["capture-id"]).alias(id_col), F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.kind").alias("record_type"),
        ident(F.col("original")).alias("refers_to"))
