"""Web archives (WARC/1.1) with a compression dictionary per file, written and read as Spark tables.

Writing:

1. The first record of equal payloads is the response, later ones are revisits without payload. Only payload digests
   and ids are grouped; the join back is split by adaptive execution where one payload is very common.
2. Each task fills archives of bounded size. When one is full, a Zstandard dictionary is built from its records, and
   each record is compressed on its own with it: any record can be read alone, given the head of its file.
3. An archive is a file: the dictionary in a skippable frame, then a frame per record. Spark's own text writer puts the
   frames down (on any file system Spark writes to, with its commit of tasks); its line separator is an empty skippable
   frame, which readers of Zstandard pass over.

Reading goes file by file: dictionary, frames, record headers, payload; digests are checked against payloads.

Null payloads count as empty. Records without an id are written without one; they are the response only if no record
of the same payload has an id. Rows that repeat a page (id and payload) are the same record: each of them is written,
as the response if it is the first. An empty table makes a folder without archives, which reads as an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Payloads of fewer bytes are stored every time.
MIN_SHARED_BYTES = 100
#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: Bytes of a dictionary; it is left out (an empty frame) where the records are too few to build one.
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

# Fixed values of the format: magic numbers of a skippable frame with a dictionary and of an empty one.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)

FRAMES = "archive string, place bigint, frame binary"
RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
          "payload_digest string, payload binary, intact boolean")


def record_bytes(row: dict, date: str) -> bytes:
    """A WARC record of a page: a response with its payload, or a revisit that names the response."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
            % row["payload_bytes"])
    block = http if revisit else http + payload
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{row['payload_digest']}')}>"
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", name(row["page_id"])), ("WARC-Date", date),
            ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
            ("X-Payload-Length", str(row["payload_bytes"])),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if row["url"] is not None:
        head.insert(3, ("WARC-Target-URI", quote(row["url"], safe="!#$&'()*+,/:;=?@[]~%")))
    if row["page_id"] is not None:
        head.append(("X-Page-ID", str(row["page_id"])))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if row["refers_to"] is not None:
            head += [("WARC-Refers-To", name(row["refers_to"])), ("X-Refers-To-Page-ID", str(row["refers_to"]))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary built from all records of an archive, or nothing where they are too few."""
    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 8)
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, f=18, split_point=1.0, accel=4).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_frames(records: list[bytes]) -> list[bytes]:
    """The leading frame with the dictionary, and a frame per record."""
    raw = dictionary_of(records)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    return [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, *map(pack.compress, records)]


def with_record_types(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, its length and digest, and what kind of record it becomes."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"))
    shared = (rows.where(F.col("payload_bytes") >= MIN_SHARED_BYTES).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_id"), F.count("payload_digest").alias("copies")).where("copies > 1")
              .select(F.col("payload_digest").alias("digest"), "first_id"))
    joined = rows.join(shared, F.col("payload_digest") == F.col("digest"), "left")
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first_id")).alias("refers_to"), F.when(~later, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``pages`` (page_id, url, html) as archives below ``path``, one per folder ``archive=...``."""
    arrow = to_arrow_schema(StructType.fromDDL(FRAMES))

    def frames(incoming):
        from pyspark import TaskContext

        task, n, records, size = TaskContext.get().partitionId(), 0, [], 0

        def closed():
            made = archive_frames(records)
            for at in range(0, len(made), 512):
                some = made[at:at + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task:06}-{n:06}"] * len(some)), pa.array(range(at, at + len(some)), pa.int64()),
                     pa.array(some, pa.binary())], schema=arrow)

        for batch in incoming:
            for i in range(batch.num_rows):
                records.append(record_bytes({k: batch.column(k)[i].as_py() for k in batch.schema.names}, date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield from closed()
                    n, records, size = n + 1, [], 0
        if records:
            yield from closed()

    made = with_record_types(pages).mapInArrow(frames, FRAMES)
    # Casting binary to string leaves the bytes as they are; the writer puts them down unchanged.
    (made.sortWithinPartitions("archive", "place").select("archive", F.col("frame").cast("string").alias("value"))
     .write.partitionBy("archive").option("lineSep", SEPARATOR.decode("ascii")).text(path))


HEADER = re.compile(rb"([^:\r\n]+):\x20?([^\r\n]*)\r\n")


def parsed(record: bytes) -> dict:
    """The fields of a record's bytes."""
    end = record.index(b"\r\n\r\n")
    head = {k.decode(): v.decode() for k, v in HEADER.findall(record[record.index(b"\r\n") + 2:end + 2])}
    block = record[end + 4:end + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4:]
    number = lambda name: int(head[name]) if name in head else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    own = hashlib.sha256(payload).hexdigest()
    revisit = head["WARC-Type"] == "revisit"
    return {"page_id": number("X-Page-ID"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
            "refers_to": number("X-Refers-To-Page-ID"),
            "payload_bytes": number("X-Payload-Length") if revisit else len(payload),
            "payload_digest": digest if revisit else own, "payload": None if revisit else payload,
            "intact": revisit or own == digest}


def frames_of(data: bytes):
    """Records of an archive's bytes, one at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive must begin with its dictionary's frame")
    dictionary = zstandard.ZstdCompressionDict(data[8:8 + size]) if size else None
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        if data[at + 1:at + 4] == SEPARATOR[1:4]:  # any skippable frame
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        part = unpack.decompressobj()
        record = part.decompress(view[at:])
        at = len(data) - len(part.unused_data)
        yield record


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``."""
    arrow = to_arrow_schema(StructType.fromDDL(RECORD))

    def batches(incoming):
        for batch in incoming:
            for content in batch.column(0):
                some, size = [], 0
                for record in frames_of(content.as_py()):
                    some.append(parsed(record))
                    size += len(record)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(some, arrow)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, arrow)

    files = (spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path))
    return files.select("content").mapInArrow(batches, RECORD)
