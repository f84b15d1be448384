"""Operator 6: WARC archives with per-record Zstandard frames and a dictionary in a leading skippable frame.

Every task writes one archive: a skippable frame (magic 0x184D2A5D) with a dictionary trained on the archive's own
first records, then one frame per record. The file is written by Spark's text sink, whose commit protocol survives lost
executors and works in any store that Spark writes; its line separator is an empty skippable frame, which every
Zstandard reader skips. Equal payloads are stored once: later ones become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import handover, shared_path, small_batches, table, tidy

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame; all its bytes are ASCII, so it can stand as a line separator.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
FRAME_MAGIC = 0xFD2FB528
LEVEL = 3
#: Bytes of records that a task keeps to train its dictionary, and the dictionary's size at most.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """The URL with white space and controls percent-encoded, so that it stays on its header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


def _id(value: str) -> str:
    """An id as a header has it: percent-encoded, so that no sign of it ends the line."""
    return quote(value, safe=":/@+,;=")


def build_record(page_id: str | None, url: str | None, payload: bytes, first: str | None, date: str = DATE) -> bytes:
    """A WARC/1.1 response record, or a revisit record of page ``first`` (HTTP headers only)."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}"]
    if page_id is not None:
        head.append(f"Page-ID: {_id(page_id)}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{first} {digest}')}>", f"Refers-To-Page-ID: {_id(first)}"]
    block = http if first is not None else http + payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def read_record(record: bytes) -> dict:
    """Fields of a record; a response's payload must match its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page_id, refers_to = (None if fields.get(k) is None else unquote(fields[k]) for k in ("Page-ID", "Refers-To-Page-ID"))
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of page {page_id} does not match its digest")
    return {"type": fields["WARC-Type"], "page_id": page_id, "url": fields["WARC-Target-URI"], "size": size, "digest": digest, "refers_to": refers_to, "payload": payload if fields["WARC-Type"] == "response" else None}


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; with too few to train on, their own bytes serve as one, and without any there is none."""
    total = sum(map(len, samples))
    size = min(DICTIONARY_BYTES, total // 8)
    if size < 256:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT) if total >= 8 else None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's skippable frame, then one frame per record."""
    sample: list[bytes] = []
    kept = 0
    for record in records:
        sample.append(record)
        kept += len(record)
        if kept >= SAMPLE_BYTES:
            break
    if not sample:
        return
    dictionary = train([r[: SAMPLE_BYTES // 8] for r in sample])
    if dictionary is None:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
    else:
        raw = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
        dictionary.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    for record in sample:
        yield compressor.compress(record)
    del sample
    for record in records:
        yield compressor.compress(record)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and block sizes."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * checksum


def read_frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    data = memoryview(content)
    decompressor = zstandard.ZstdDecompressor()
    at = 0
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                raw = bytes(data[at + 8 : at + 8 + size])
                kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield decompressor.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def _write_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            for part in small_batches(batch):
                for page_id, url, payload, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    yield build_record(page_id, url, payload, first)

    frames: list[bytes] = []
    size = 0
    for frame in write_frames(records()):
        frames.append(frame)
        size += len(frame)
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
            frames, size = [], 0
    if frames:
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write all pages as archives under ``path``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is the response and
    the others revisit it. A null html is an empty payload. Ids may hold any signs. Repeated rows of the smallest page_id are responses each;
    pages with a null page_id are responses. Columns besides page_id, url and html are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.when((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull(), F.sha1("payload")))
    copies = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n")).filter("digest IS NOT NULL AND n > 1").select("digest", "first")
    copies = handover(copies, "warc-copies")
    # Rows without a digest would share one key; they take part in no match, so any key of their own will do.
    left = keyed.withColumn("key", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("payload", "url").cast("string"))))
    joined = left.join(copies.withColumnRenamed("digest", "key"), "key", "left")
    first = F.when(F.col("first") != F.col("page_id"), F.col("first").cast("string"))
    records = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", first.alias("first")).hint("rebalance")
    frames = records.mapInArrow(tidy(_write_task), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode()).text(path)


READ_SCHEMA = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _read_task(with_payload: bool):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(READ_SCHEMA))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                rows: list[tuple] = []
                size = 0
                for record in read_frames(content.as_py()):
                    r = read_record(record)
                    rows.append((r["page_id"], r["url"], r["size"], r["digest"], r["type"], r["refers_to"], r["payload"] if with_payload else None))
                    size += 200 + (len(record) if with_payload else 0)
                    if size >= 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record under ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidy(_read_task(with_payload)), READ_SCHEMA)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    back = read_archives(spark, path, with_payload=False)
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


_GROUP = "CAST('0x' || substr(h, {at}, 5) AS BIGINT)"
_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({group} >> {shift}) & 31) + 1 AS BIGINT), 1)"
_BASE32 = " || ".join(_CHAR.format(group=_GROUP.format(at=5 * k + 1), shift=s) for k in range(8) for s in (15, 10, 5, 0))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
