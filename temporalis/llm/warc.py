"""WARC archives without repeated payloads, and reading them back.

Writing. Narrow headers (page_id, url, digest, size) are stored once and shuffled by payload
digest, with partial sums, to find the original of each digest of ``LEAST`` bytes or more:
the row with the smallest page_id. Pages that repeat an original become revisits (profile
identical-payload-digest), built from their headers alone; all others become responses with
fresh headers. Each record is a gzip member of its own (or several, one a ``MEMBER`` bytes),
compressed before it moves, so payloads move once, compressed, to files of about
``FILE_BYTES`` of records. Files are written by Spark's text writer, whose line separator is
the zero byte that ends every such member (the highest byte of its length). Files are .warc.gz
in content; Spark names them part-*.txt.

Reading inflates each file and walks it by Content-Length, so a payload may hold anything.

A record's id names its page_id and digest. Nulls: a null html is an empty payload; a null
url gives no WARC-Target-URI; a page without page_id is a response and no one's original.
Rows that repeat a page_id and a payload are the same record, and all response if that
page_id is the original's. Columns other than page_id, url and html are ignored; an empty
table gives no records. Line breaks in a url are written as %0A.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, lean, ship, stored

LEAST = 100
FILE_BYTES = 32 << 20
#: Most bytes of a gzip member: its length then ends in a zero byte.
MEMBER = (1 << 24) - 1
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), "[\\r\\n]+", "%0A").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def payload_heads(pages: DataFrame) -> DataFrame:
    """page_id, url, digest and size of each page's payload."""
    return _pages(pages).select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))


def revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to, refers_to_uri) of the pages that repeat an earlier payload; stored."""
    able = heads.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    first = able.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
    first = stored(first.where("first.page_id <> last").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_uri")), "originals")
    return stored(able.select("page_id", "digest").join(first, "digest").where("page_id <> refers_to").distinct(), "revisits")


def _uri(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:16]}>"


def record(date: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes = b"", refers_to: int | None = None, refers_to_uri: str | None = None) -> bytes:
    """A whole WARC record: a revisit if refers_to is given, else a response."""
    again = refers_to is not None
    block = f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: {size}{_EOL * 2}".encode() + (b"" if again else payload)
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", _uri(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if again:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to, digest)), ("WARC-Refers-To-Target-URI", refers_to_uri), ("WARC-Refers-To-Date", date)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join([f"WARC/1.1{_EOL}", *(f"{k}: {v}{_EOL}" for k, v in fields if v is not None), _EOL])
    return b"".join([head.encode(), block, _EOL.encode() * 2])


def members(data: bytes) -> bytes:
    """data as gzip members of at most MEMBER bytes each."""
    out = []
    for at in range(0, len(data), MEMBER):
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += [packer.compress(data[at : at + MEMBER]), packer.flush()]
    return b"".join(out)


def _responses(date: str):
    """page_id, digest, record (its members) of rows (page_id, url, html)."""

    def run(batches):
        for b in batches:
            rows = []
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                payload = html.as_buffer().to_pybytes()
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((page_id, digest, members(record(date, page_id, url, digest, len(payload), payload))))
            ids, digests, packed = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(packed, pa.binary())], names=["page_id", "digest", "record"])

    return run


def _revisits(date: str):
    """record (its member) of rows (page_id, url, digest, size, refers_to, refers_to_uri)."""

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([members(record(date, i, url, digest, size, b"", to, uri)) for i, url, digest, size, to, uri in rows], pa.binary())], names=["record"])

    return run


def write_warc(pages: DataFrame, path: str, date: str, files: int | None = None) -> None:
    """Write a page table as deduplicated archives."""
    spark = pages.sparkSession
    ship(spark)
    heads = stored(payload_heads(pages), "heads")
    again = revisits(heads)
    total = heads.agg(F.sum("size")).first()[0] or 0
    files = files or max(1, -(-total // FILE_BYTES))
    packed = _pages(pages).mapInArrow(lean(_responses(date)), "page_id long, digest string, record binary")
    first = packed.repartition(files, "page_id", "digest").join(again.select("page_id", "digest"), ["page_id", "digest"], "left_anti").select("record")
    # a revisit's record takes about half a kB
    later = heads.join(again, ["page_id", "digest"]).select("page_id", "url", "digest", "size", "refers_to", "refers_to_uri")
    count = again.count()
    more = later.repartition(max(1, -(-count * 512 // FILE_BYTES)), "page_id").mapInArrow(lean(_revisits(date)), "record binary")
    every = first.unionByName(more) if count else first
    # the separator gives each row's last member its last byte back
    every.select(F.substring("record", F.lit(1), F.length("record") - 1).cast("string")).write.option("lineSep", "\0").text(path)
    forget(heads, again)


def inflated(data: memoryview) -> bytes:
    """What the gzip members of a file hold, one after another."""
    out, at = [], 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut short")
            some = data[at : at + 65536]
            out.append(unpacker.decompress(some))
            at += len(some)
        at -= len(unpacker.unused_data)
    return b"".join(out)


def walk(raw: bytes):
    """(headers, block) of each record of an archive's bytes."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split(_EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin, size = end + 4, int(fields["content-length"])
        yield fields, raw[begin : begin + size]
        at = begin + size + 4


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").partition(":")[0]
    return int(number) if number else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest of every record.

    A response's digest and size are those of the payload that was read (and must be those
    of its header); a revisit's are its original's, from its headers.
    """
    ship(spark)

    def parse(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in walk(inflated(memoryview(content.as_buffer()))):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.decode().partition("Content-Length: ")[2].partition(_EOL)[0])
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record {fields['warc-record-id']} doesn't hold its payload")
                    rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page(fields.get("warc-refers-to")), size, digest))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(lean(parse), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string")
