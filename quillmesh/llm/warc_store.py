"""Content-addressed WARC archive.

Two tables stand for an archive: `payloads` holds each distinct payload once, compressed, under its SHA-256; `headers` holds the
exact header block of each record (WARC headers and HTTP head) with the digest that it refers to; records come back by a join
of the two and are parsed from their bytes. When an archive is read, each payload's digest is computed again from the rebuilt
record and compared with its header, so a result never rests on an unverified digest. A payload is shuffled compressed, once when
it is stored (copies are combined before that) and once when its record is rebuilt; everything else that moves is narrow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.textscan import small_batches
from quillmesh.storage import written

#: Payloads below this size are stored once too, but each of their records is a full response.
REVISIT_BYTES = 100
#: Without a fetch time in the input every record carries this one.
FETCHED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PACKED = pa.schema([("digest", pa.string()), ("packed", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and compressed payload of the distinct payloads of each batch."""
    codec = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        seen: dict[str, bytes] = {}
        for html in batch.column(0):
            raw = (html.as_py() or "").encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(raw).hexdigest()
            if digest not in seen:
                seen[digest] = codec.compress(raw)
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.binary())], schema=_PACKED)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, digest of the stored bytes, their number)."""
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        found = []
        for packed in batch.column(1):
            raw = codec.decompress(packed.as_py())
            found.append((hashlib.sha256(raw).hexdigest(), len(raw)))
        yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], ["digest", "found", "found_size"])


def write_archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers) of pages (page_id, url, html), written to the shared folder.

    payloads: digest, packed. headers: page_id, digest, header. Of records with equal payloads of at least
    REVISIT_BYTES the one with the smallest page_id is a response, others are revisits that refer to it; smaller payloads are
    always responses. A null html is an empty payload, a null url an empty target. Rows that repeat a page_id with one payload
    are all what that page_id is; null page_ids come last in the order and are named urn:quillmesh:page:null. Line breaks in a url,
    which would end its header line, are written as %0D and %0A. Very long payloads are stored whole; an empty table gives empty
    tables; other columns are not read.
    """
    small_batches(pages.sparkSession)
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url"), F.sha2(raw, 256).alias("digest"), F.length(raw).cast("long").alias("size"))
    distinct = pages.select("html").mapInArrow(_pack, "digest string, packed binary").groupBy("digest").agg(F.max("packed").alias("packed"))
    payloads = written(distinct, "warc-payloads", "uncompressed")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = narrow.join(first.select(F.col("digest").alias("of"), "first"), F.col("digest") == F.col("of"))
    again = (F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:quillmesh:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(FETCHED)),
        line("WARC-Target-URI", F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("first")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return payloads, written(rows.select("page_id", "digest", header.alias("header")), "warc-headers")


def verify(payloads: DataFrame) -> DataFrame:
    """(digest, found, found_size, intact) of every stored payload, from its bytes."""
    read = payloads.select("digest", "packed").mapInArrow(_verified, "digest string, found string, found_size long")
    return read.withColumn("intact", F.col("digest") == F.col("found"))


def parse_record(record: bytes) -> dict:
    """What the bytes of one record say: page_id, record_type, uri, refers_to, declared digest, block length (declared and found)
    and payload (None for revisits). ValueError if it is no record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1" or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:-4]
    page = lambda name: (v := fields.get(name, "<urn:quillmesh:page:null>")[len("<urn:quillmesh:page:") : -1]) and (None if v == "null" else int(v))
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": page("WARC-Record-ID"), "record_type": fields["WARC-Type"], "uri": fields["WARC-Target-URI"], "refers_to": page("WARC-Refers-To"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "declared": int(fields["Content-Length"]), "length": len(block),
        "payload": block.partition(b"\r\n\r\n")[2] if response else None,
    }


def _joined(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """(header, packed) of every record; packed is null for revisits."""
    full = F.when(F.col("header").contains("\r\nWARC-Type: response\r\n"), F.col("digest"))
    return headers.select("header", full.alias("needs")).join(payloads.select("digest", "packed"), F.col("needs") == F.col("digest"), "left").select("header", "packed")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The bytes of the records (header block and, for responses, payload) of rows (header, packed), about 8 MB at a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out, held = [], 0
        for header, packed in zip(batch.column(0), batch.column(1), strict=True):
            out.append(header.as_py().encode("utf-8", "surrogatepass") + (unpack.decompress(packed.as_py()) if packed.is_valid else b"") + b"\r\n\r\n")
            held += len(out[-1])
            if held > 8 << 20:
                yield out
                out, held = [], 0
        yield out


def read_records(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_id, record): the original bytes of every record, by a join on the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _rebuilt(batches):
            yield pa.record_batch([pa.array([parse_record(r)["page_id"] for r in records], pa.int64()), pa.array(records, pa.binary())], ["page_id", "record"])

    return _joined(payloads, headers).mapInArrow(run, "page_id long, record binary")


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("fault", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for records in _rebuilt(batches):
        out = []
        for record in records:
            r = parse_record(record)
            payload, fault = r["payload"], None
            if r["declared"] != r["length"]:
                fault = "length"
            elif payload is not None and hashlib.sha256(payload).hexdigest() != r["digest"]:
                fault = "digest"
            out.append((r["page_id"], r["record_type"], r["refers_to"], r["digest"], None if payload is None else len(payload), fault))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_READ)
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the archive of pages, rebuilds its records by joins, parses their bytes and returns per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit's size is that of the response that it refers to, found by page_id and digest. A
    record whose payload or response is missing or damaged raises an error. Null html: an empty payload, a response; null page_ids and
    repeated rows pass through; an empty table gives no row."""
    payloads, headers = write_archive(pages)
    read = written(_joined(payloads, headers).mapInArrow(_read, "page_id long, record_type string, refers_to long, digest string, payload_bytes long, fault string"), "warc-read")
    # A page_id may be repeated with one payload: one row of it is enough to resolve revisits.
    of = read.where(f"record_type = 'response' and payload_bytes >= {REVISIT_BYTES}").groupBy(F.col("digest").alias("of"), F.col("page_id").alias("at")).agg(F.max("payload_bytes").alias("size"))
    revisits = read.where("record_type = 'revisit'").join(of, (F.col("digest") == F.col("of")) & F.col("refers_to").eqNullSafe(F.col("at")), "left")
    columns = ["page_id", "digest", "record_type", "refers_to", "fault"]
    every = read.where("record_type = 'response'").select(*columns, "payload_bytes").unionByName(revisits.select(*columns, F.col("size").alias("payload_bytes")))
    damage = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("payload_bytes").isNull(), F.lit("no response"))
    checked = F.when(damage.isNull(), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(": "), damage)))
    return every.select("page_id", "payload_bytes", checked.cast("string").alias("payload_digest"), "record_type", "refers_to")
