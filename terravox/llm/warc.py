"""WARC archives: write one transaction per page, read archives back, and assemble transactions.

A capture is three records: the response (or a revisit of an equal payload), its request and its metadata. Request
and metadata name the response in WARC-Concurrent-To; assemble() joins the three through it and gives one nested row
per capture. Archives are written by Spark's own text sink with CR LF as its line end, so any store that Spark can
write to will do and a lost executor's half-written files are never read; each file is a plain (or gzipped) WARC 1.1.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, slices, written

#: Fixed values of WARC 1.1 and HTTP.
VERSION, REVISIT_PROFILE, CRLF = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n"

#: Payload bytes of a file when written (as a number of records of mean size); a reader holds one compressed file and one record.
FILE_BYTES = 64 << 20

_RECORDS = "record_id string, concurrent_to string, refers_to string, kind string, uri string, date string, page_id long, refers_to_page long, payload_bytes long, payload_digest string, block_bytes long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_urn(kind: str, page_id: int | None, digest: str, ordinal: int) -> str:
    """A urn:uuid of what the record holds, so a retried task makes it again and a revisit can name its response; equal rows differ by their ordinal."""
    h = hashlib.md5(f"{kind} {page_id} {digest} {ordinal}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    """Header lines; line breaks inside a value would end it, so they become spaces."""
    return "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in fields if v is not None).encode()


def _record(kind: str, urn: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the last CR LF, which the sink adds."""
    lead = [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", "1970-01-01T00:00:00Z"), *fields, ("Content-Length", len(block))]
    return VERSION.encode() + CRLF + _head(lead) + CRLF + block + CRLF


def transaction(page_id: int | None, url: str | None, payload: bytes, ordinal: int = 0, owner: int | None = None) -> list[bytes]:
    """Response or revisit, request and metadata of one page. owner: page_id of the response with the same payload that it revisits."""
    digest = f"sha1:{sha1_base32(payload)}"
    urn = _record_urn("response", page_id, digest, ordinal)
    target = [("WARC-Target-URI", url)]
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + CRLF
    own = [*target, ("WARC-Payload-Digest", digest), ("X-Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
    if owner is None:
        first = _record("response", urn, own, http + payload)
    else:
        refers = [("WARC-Refers-To", _record_urn("response", owner, digest, 0)), ("X-Refers-To-Page-ID", owner)]
        first = _record("revisit", urn, [*own, ("WARC-Profile", REVISIT_PROFILE), *refers], http)
    joined = [*target, ("WARC-Concurrent-To", urn)]
    asked = f"GET {re.sub(r'\s+', '%20', url or '/')} HTTP/1.1\r\n\r\n".encode()
    request = _record("request", _record_urn("request", page_id, digest, ordinal), [*joined, ("Content-Type", "application/http;msgtype=request")], asked)
    meta = _record("metadata", _record_urn("metadata", page_id, digest, ordinal), [*joined, ("Content-Type", "application/warc-fields")], _head([("payload-bytes", len(payload)), ("page-id", page_id)]))
    return [first, request, meta]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            out = []
            for page_id, url, html, owner, ordinal in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                out += transaction(page_id, url, (html or "").encode(), ordinal, owner)
            yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in out], pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, compress: bool = True) -> str:
    """Write pages(page_id, url, html, ...) as WARC files and return their folder.

    Of pages with equal payloads of at least least_bytes bytes, that with the largest page_id is written as response,
    the others as revisits of it; pages with smaller payloads are all responses. Null html is an empty payload, a null
    url leaves the target out; rows without a page_id are always responses. Repeated rows of one page_id are written
    as often as they stand there, each with its own payload's verdict: rows that agree in page_id and payload are
    numbered, other rows need no number. An empty table leaves an empty folder. Other columns are ignored. A text is
    held whole, about four times its bytes at once.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = own.withColumns({"n": F.octet_length(payload).cast("long"), "sha": F.unhex(F.sha2(payload, 256))})
    keys = written(own.select("page_id", "n", "sha"), "warc-keys")
    size = keys.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    largest = keys.where(F.col("n") >= least_bytes).groupBy("n", "sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("members")).where("members > 1")
    # a page_id may stand there with several payloads, and with one of them several times
    each = written(keys.groupBy("page_id", "n", "sha").agg(F.count("*").alias("copies")), "warc-pages")
    revisits = each.join(largest, ["n", "sha"]).where("page_id < owner").select("page_id", "n", "sha", "owner", "copies")
    repeats = each.where("copies > 1")
    # rows are matched by equal or equally missing page_id: a missing one is text here, so that the join stays an equi-join
    on = lambda df: df.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))).drop("page_id")
    rows = on(own).join(on(revisits).drop("copies"), ["page", "n", "sha"], "left")
    first = lambda df: df.select(F.when(F.col("page") != "-", F.col("page").cast("long")).alias("page_id"), "url", "html", "owner", "ordinal")
    if repeats.isEmpty():
        rows = first(rows.withColumn("ordinal", F.lit(0).cast("long")))
    else:
        again = on(repeats).select("page", "n", "sha")
        number = F.row_number().over(Window.partitionBy("page", "n", "sha").orderBy("url")) - 1
        numbered = rows.join(again, ["page", "n", "sha"], "left_semi").withColumn("ordinal", number.cast("long"))
        rows = first(rows.join(again, ["page", "n", "sha"], "left_anti").withColumn("ordinal", F.lit(0).cast("long"))).union(first(numbered))
    records = rows.mapInArrow(_write, "value string")
    per_file = max(30, min(1_000_000, 3 * FILE_BYTES * (size["rows"] or 1) // max(1, (size["bytes"] or 0) + 600 * (size["rows"] or 1))))
    out = records.write.option("lineSep", "\r\n").option("maxRecordsPerFile", per_file)
    (out.option("compression", "gzip") if compress else out).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, gzipped by file or record, or plain.

    The archive is unpacked as it is read, a record at a time."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()) != CRLF:
            if not line:
                raise ValueError("a WARC record's header has no end")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {head.get('warc-record-id')} ends before its Content-Length")
        yield head, block


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, body


def _read(with_payload: bool):
    names = [x.split()[0] for x in _RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string()] * 6 + [pa.int64()] * 3 + [pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind = head.get("warc-type", "")
        digest, size, body = None, None, None
        page, refers = (int(head[x]) if x in head else None for x in ("x-page-id", "x-refers-to-page-id"))
        if kind == "response":
            body = _http(block)[1]
            digest, size = sha1_base32(body), len(body)  # of what the archive holds, not of what its header says
        elif kind == "revisit":
            size, digest = int(_http(block)[0].get("content-length", 0)), head.get("warc-payload-digest", "").removeprefix("sha1:")
        base = (head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), kind, head.get("warc-target-uri"), head.get("warc-date"), page, refers, size, digest, len(block))
        return (*base, body) if with_payload else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for head, block in parse(batch.column(0)[i].as_py()):
                    rows.append(row(head, block))
                    held += len(block) if with_payload else 0
                    if len(rows) >= 5_000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the WARC files in a folder."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), _RECORDS + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request and metadata structs (null where a record is missing).

    A request or metadata record belongs to the record that its WARC-Concurrent-To names; of several, the one with
    the smallest record id is taken. Records that name none and aren't responses or revisits are left out, and so are
    those whose response isn't there.
    """
    columns = [c for c in records.columns if c not in ("concurrent_to",)]
    whole = F.struct(*columns)
    capture = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    pick = lambda test: F.min_by(F.when(test, whole), F.when(test, F.col("record_id")))
    out = records.withColumn("capture_id", capture).where("capture_id is not null").groupBy("capture_id")
    return out.agg(pick(F.col("kind").isin("response", "revisit")).alias("response"), pick(F.col("kind") == "request").alias("request"), pick(F.col("kind") == "metadata").alias("metadata")).where("response is not null")


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html, ...), read the archives back and give one row per capture: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    Nulls, empty payloads, repeated rows, ties and empty tables are as in write_archives(): n rows give n captures, and
    an empty table gives none. refers_to is null for responses. Columns of other names are ignored.
    """
    r = assemble(read_archives(pages.sparkSession, write_archives(pages, least_bytes=least_bytes)))
    kind = F.col("response.kind")
    return r.select("response.page_id", "response.payload_bytes", "response.payload_digest", kind.alias("record_type"), F.when(kind == "revisit", F.col("response.refers_to_page")).alias("refers_to"))
