"""Operator 9: Zstandard WARC archives, written and read back.

An archive begins with a skippable frame that holds the dictionary; every record
is a frame of its own, compressed with that dictionary and checksummed.  The
reader finds each frame's end from its block headers, decodes it alone, and
checks the record's version, lengths and payload digest.

Archives travel as rows (archive number, content), so the writer is Spark's own
and the reader takes any table with a ``content`` column, ``binaryFile`` included.

Null html counts as empty; null urls are written without a target; a page
without an id is written with a null id, and never referred to.  Of repeated
rows with the largest id every one is a response.  Other columns are ignored.
Empty tables make no archive.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.storage import materialize, table, write_table

# Fixed values of the formats: Zstandard frame magics, the dictionary's skippable frame, the revisit profile.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this many bytes are always stored whole.
LEAST_BYTES = 1000
#: Up to so many payload groups are joined by broadcast (about 100 bytes each); more by a shuffle.
BROADCAST_GROUPS = 100_000
#: The dictionary is trained on at most so many pages, on at most so many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16_384, 65_536
_NONE = "none"


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample; from a record's usual head where there are too few pages."""
    rows = pages.where(F.col(html).isNotNull()).limit(SAMPLE_PAGES).select(F.substring(F.col(html).cast("binary"), 1, SAMPLE_BYTES).alias("b")).collect()
    samples = [_record(str(i), "https://example.com/", bytes(r.b), "0" * 40, None, len(r.b)) for i, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return _record("0", "https://example.com/", b"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>", "0" * 40, None, 0)


def _record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, size: int) -> bytes:
    """One WARC record; a revisit carries the HTTP head alone, which still states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_targets(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(page, url, payload, digest, size, target): target is the page whose payload stands for this one's."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).alias("url"), payload.alias("payload")).select(
        "page", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("size")
    )
    groups = rows.where((F.col("size") >= LEAST_BYTES) & F.col("page").isNotNull()).groupBy("digest", "size").agg(F.max("page").alias("target"), F.count("*").alias("n"))
    nulls = rows.where((F.col("size") >= LEAST_BYTES) & F.col("page").isNull()).select("digest", "size").distinct()
    # only groups of several pages change anything
    shared = groups.join(nulls.withColumn("too", F.lit(True)), ["digest", "size"], "left").where("n > 1 or too").select("digest", "size", "target")
    shared = materialize(shared, "payload-groups")
    if shared.count() <= BROADCAST_GROUPS:
        shared = F.broadcast(shared)
    return rows.join(shared, ["digest", "size"], "left").select("page", "url", "payload", "digest", "size", "target")


def write_archives(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", archive_bytes: int = 8 << 20, to: str | None = None) -> str:
    """Write every page as a record; archives of about ``archive_bytes``.  Returns the folder."""
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages, html))
    schema = pa.schema([("records", pa.int64()), ("content", pa.binary())])

    def run(batches):
        own = dictionary.value
        start = struct.pack("<II", DICTIONARY_MAGIC, len(own)) + own
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=True, write_content_size=True)
        held, size = [], 0
        for b in batches:
            for page, target_url, payload, digest, n, target in zip(*(c.to_pylist() for c in b.columns)):
                refers = None if target is None or target == page else str(target)
                held.append(pack.compress(_record(_NONE if page is None else str(page), target_url, payload, digest, refers, n)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.record_batch([[len(held)], [start + b"".join(held)]], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.record_batch([[len(held)], [start + b"".join(held)]], schema=schema)

    archives = with_targets(pages, key, html, url).mapInArrow(run, "records bigint, content binary")
    if to is None:
        return write_table(archives, "archives")
    archives.write.parquet(to)
    return to


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and block headers."""
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size_field = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_field
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * checksum


def records(data: bytes):
    """(headers, block) of every record of an archive; raises on anything that doesn't hold together."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with its dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        end = frame_end(data, at)
        if end > len(data):
            raise ValueError("the last frame is cut off")
        record = unpack.decompress(view[at:end])
        at = end
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')}: the block is not as long as stated")
        yield headers, rest[:n]


def export_archives(archives: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """(name, bytes): archives as ``.warc.zst`` files in a folder that all tasks see; a name is the content's digest.

    A file appears under its name once it is whole, so a task that is run again
    leaves the same files.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names, sizes = [], []
            for data in b.column(0).to_pylist():
                names.append(f"{hashlib.sha1(data).hexdigest()}.warc.zst")
                sizes.append(len(data))
                part = os.path.join(folder, f".{names[-1]}.{uuid.uuid4().hex[:8]}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, names[-1]))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return archives.select(content).mapInArrow(run, "name string, bytes bigint")


_PAGE = re.compile(r"<urn:page:(-?\d+|none)>")


def parse_record(headers: dict, block: bytes) -> dict:
    """A record's page, type, target and payload facts; a response's payload is digested anew."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    page = _PAGE.fullmatch(headers["warc-record-id"])[1]
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    refers = None
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"page {page}: the payload is not what its headers state")
    elif kind == "revisit" and headers.get("warc-profile") == PROFILE and not payload:
        refers = int(_PAGE.fullmatch(headers["warc-refers-to"])[1])
    else:
        raise ValueError(f"page {page}: no known record type")
    return {"page_id": None if page == _NONE else int(page), "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload}


def read_archives(archives: DataFrame, with_payload: bool = True, content: str = "content") -> DataFrame:
    """One row per record; ``payload`` is empty for revisits."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)
    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload

    def run(batches):
        for b in batches:
            for data in b.column(0):
                held = []
                for headers, block in records(data.as_py()):
                    held.append(parse_record(headers, block))
                    if not with_payload:
                        del held[-1]["payload"]
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select(content).mapInArrow(run, ddl)


def op9_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    to = write_archives(table(spark, sf_dir, "pages"))
    back = read_archives(spark.read.parquet(to), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), g AS (
  SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN target IS NULL OR target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN target IS NULL OR target = page_id THEN NULL ELSE target END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
