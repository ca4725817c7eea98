"""Operator 12, WARC: a dictionary-compressed archive writer, and its reader.

Every page becomes a WARC/1.1 record.  A Zstandard dictionary is trained on a bounded sample of the payloads
(``SAMPLE`` page_ids, those with the smallest hashes; one payload each, of at most ``SAMPLE_BYTES`` bytes) and stands in a leading skippable frame of
every file (magic 0x184D2A5D, itself compressed where that is shorter); each record is a Zstandard frame of its own, with
content size and checksum, so a reader can start at any record's offset.  Files are written by Spark's text writer, which puts
bytes as they are, through its commit protocol (a lost executor's files never count) and to any file system Spark knows: the line
separator is an empty skippable frame, which decoders pass over.

Equal payloads of at least ``SMALLEST`` bytes are found by their SHA-1 and length: one aggregate gives the largest page_id of
every payload that several rows have; this table of repeated payloads is written to the shared folder and joined (by Spark's size check:
broadcast while small, so that no payload is shuffled; beyond that a shuffled join whose hot payloads AQE splits).  The row with
the largest page_id is the response, the others are revisits of it, without the payload.

Defined results: a null html is an empty payload; a null page_id is below every other; rows that repeat the largest page_id of a payload
are all responses; a null url leaves out the target; characters of a url that cannot stand in a header are percent-encoded; too few records for
a dictionary give files without one; an empty table gives no records.  Columns beyond ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, shared_path, smallest

#: Payloads below so many bytes are always written out.
SMALLEST = 1000
#: The dictionary: its size, the records it is trained on, and the longest of them.
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 1 << 16, 400, 100_000
LEVEL = 3
#: Bytes of frames that a task hands on at a time.
FLUSH = 1 << 20
# Fixed values of the formats: Zstandard's frame magic, the dictionary's skippable frame, an empty skippable frame, the revisit profile.
FRAME_MAGIC, DICTIONARY_MAGIC = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _payloads(pages: DataFrame) -> DataFrame:
    """wz_id, wz_url, wz_payload, wz_digest (SHA-1, hex), wz_bytes of every row."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return (pages.select(F.col("page_id").cast("long").alias("wz_id"), F.col("url").cast("string").alias("wz_url"), body.alias("wz_payload"))
            .withColumns({"wz_digest": F.sha1("wz_payload"), "wz_bytes": F.octet_length("wz_payload").cast("long")}))


def train_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes, or b"" where there are too few records to train one."""
    ids = smallest(pages.select(F.col("page_id").cast("long").alias("wz_id")).where("wz_id IS NOT NULL").distinct(), SAMPLE, F.xxhash64("wz_id"), "wz_id")
    chosen = pages.sparkSession.createDataFrame(ids, "wz_id long")  # at most SAMPLE rows
    rows = _payloads(pages).join(F.broadcast(chosen), "wz_id").where(F.col("wz_bytes").between(1, SAMPLE_BYTES))
    one = rows.groupBy("wz_id").agg(F.min_by("wz_payload", F.struct("wz_digest", "wz_bytes")).alias("payload"))
    some = sorted({bytes(r["payload"]) for r in one.select("payload").collect()})
    try:
        return zstandard.train_dictionary(size, [_record(None, None, x, hashlib.sha1(x).hexdigest(), "response", None, "") for x in some]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # the library refuses a sample that is too small
        return b""


def _named(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    revisit = kind == "revisit"
    block = HTTP if revisit else HTTP + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", _named(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=_PRINTABLE)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(refers_to)), ("X-Payload-Length", str(len(payload)))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_kinds(pages: DataFrame) -> DataFrame:
    """The payload rows with wz_kind (response or revisit) and wz_refers (the response's page_id)."""
    rows = _payloads(pages)
    repeated = (rows.where(F.col("wz_bytes") >= SMALLEST).groupBy("wz_digest", "wz_bytes").agg(F.max("wz_id").alias("wz_largest"), F.count("*").alias("n"))
                .where("n > 1 AND wz_largest IS NOT NULL").drop("n"))
    path = shared_path(pages.sparkSession, "repeated-payloads")
    repeated.write.parquet(path)
    repeated = pages.sparkSession.read.parquet(path)
    later = F.col("wz_largest").isNotNull() & (F.col("wz_id").isNull() | (F.col("wz_id") < F.col("wz_largest")))
    return (rows.join(repeated, ["wz_digest", "wz_bytes"], "left")
            .select("wz_id", "wz_url", "wz_payload", "wz_digest", F.when(later, "revisit").otherwise("response").alias("wz_kind"),
                    F.when(later, F.col("wz_largest")).alias("wz_refers")))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL, dictionary: bytes | None = None) -> None:
    """Write a record for every page to new archive files.  ``dictionary``: None trains one, b"" goes without."""
    dictionary = train_dictionary(pages) if dictionary is None else dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if words:
            words.precompute_compress(level=level)
        coder = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True, write_content_size=True)
        frames, size, begun = [], 0, False
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, kind, refers = (c[i].as_py() for c in b.columns)
                if dictionary and not begun:
                    short = zstandard.ZstdCompressor(level=19).compress(dictionary)
                    short = min(short, dictionary, key=len)
                    frames.append(DICTIONARY_MAGIC + struct.pack("<I", len(short)) + short)
                begun = True
                frames.append(coder.compress(_record(page_id, url, payload, digest, kind, refers, date)))
                size += len(frames[-1])
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                    frames, size = [], 0
        if frames:
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    frames = record_kinds(pages).mapInArrow(giving_back(run), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its block headers."""
    kind = data[at + 4]
    single = kind >> 5 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[kind & 3] + ((1 if single else 0), 2, 4, 8)[kind >> 6]
    last = False
    while not last:
        head = int.from_bytes(data[at:at + 3], "little")
        last = bool(head & 1)
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    return at + (4 if kind >> 2 & 1 else 0)


def _records(data: memoryview) -> Iterator[bytes]:
    """The records of one archive file, decompressed one at a time."""
    at, coder = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = bytes(data[at:at + 4])
        if magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield coder.decompress(data[at:end])
            at = end
            continue
        if magic[1:] != DICTIONARY_MAGIC[1:] or magic[0] >> 4 != 5:
            raise ValueError(f"no frame at byte {at}")
        size = struct.unpack("<I", data[at + 4:at + 8])[0]
        if magic == DICTIONARY_MAGIC:
            words = bytes(data[at + 8:at + 8 + size])
            words = coder.decompress(words) if words[:4] == FRAME_MAGIC else words
            coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
        at += 8 + size


def _number(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def _parsed(record: bytes) -> tuple:
    """page_id, url, payload (None for a revisit), bytes, digest, type, refers_to of a record; its digest is checked."""
    end = record.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in record[:end].decode().split("\r\n")[1:])
    block = record[end + 4:end + 4 + int(head["Content-Length"])]
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
    size = int(head["X-Payload-Length"]) if payload is None else len(payload)
    return _number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), payload, size, digest, head["WARC-Type"], _number(head.get("WARC-Refers-To"))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for record in _records(memoryview(b.column(0)[i].as_buffer())):
                    page_id, url, payload, n, digest, kind, refers = _parsed(record)
                    rows.append((page_id, url, n, digest, kind, refers, payload)[:len(names)])
                    size += len(payload or b"") * payloads + 200
                    if size >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(giving_back(run), _READ + (", payload binary" if payloads else ""))


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to new archives in the shared folder and return the records read back, without payloads."""
    path = shared_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM rows)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN bytes >= {SMALLEST} AND coalesce(page_id < largest, largest IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= {SMALLEST} AND coalesce(page_id < largest, largest IS NOT NULL) THEN largest END AS refers_to
FROM ranked"""
