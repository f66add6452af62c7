"""Archives: round trips, and files that a plain reader can read."""

import hashlib
import random

import pytest
import zstandard

from twinsieve.llm import warc

PAGE = "page_id bigint, url string, html string, payload string"


def expected(rows):
    out = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        copies = [r[0] for r in rows if (r[2] or "") == (html or "")]
        first = min((c for c in copies if c is not None), default=None)
        later = len(payload) >= 100 and len(copies) > 1 and first is not None and page != first
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if later else "response",
                    first if later else None))
    return sorted(out, key=str)


def pages(seed):
    rng = random.Random(seed)
    bodies = ["<p>" + " ".join(rng.choices(["tree", "näher", "字", "house"], k=60)) + "</p>" for _ in range(8)]
    rows = [(i, f"http://example.com/{i}", rng.choice(bodies) + "x" * rng.choice([0, 0, i]), "clash") for i in range(150)]
    return rows + [(200, None, None, "c"), (201, "u\r\nX: 1", "", "c"), (None, None, bodies[0], "c"), (3, "again", "short", "c"),
                   (202, "u", "short", "c"), (0, "http://example.com/0", rows[0][2], "c"), (203, "u", "z" * 2_000_000, "c")]


@pytest.mark.parametrize("archive_bytes", [2000, 50_000, 1 << 25])
def test_round_trip(spark, ws, archive_bytes):
    rows, path = pages(1), f"{ws.root}/archives"
    warc.write_archives(spark.createDataFrame(rows, PAGE).repartition(3), path, archive_bytes)
    got = warc.read_archives(spark, path).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == expected(rows)
    assert all(r["intact"] and (r["record_type"] == "revisit") == (r["payload"] is None) for r in got)
    by = {r["page_id"]: r for r in got}
    assert bytes(by[203]["payload"]) == b"z" * 2_000_000 and by[201]["url"] == "u%0D%0AX:%201"


def test_a_file_is_dictionary_and_frames(spark, ws):
    path = f"{ws.root}/archives"
    warc.write_archives(spark.createDataFrame(pages(2), PAGE).coalesce(1), path)
    (data,) = [bytes(r["content"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "part-*").load(path).collect()]
    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == bytes.fromhex("5d2a4d18") and size > 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])).stream_reader(
        data[8 + size:], read_across_frames=True)
    plain = reader.read()
    assert plain.count(b"WARC/1.1\r\n") == len(pages(2))
    # Any frame can be read on its own.
    frames = warc.archive_frames([b"one record " * 50, b"another record " * 50] * 200)
    dictionary = zstandard.ZstdCompressionDict(frames[0][8:])
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frames[7]) == b"one record " * 50
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frames[2]) == b"another record " * 50


def test_the_dictionary_pays():
    rng = random.Random(3)
    head = "<html><head><meta charset=utf-8><style>p{margin:0}</style></head><body><nav>" + "menu " * 20
    records = [(head + " ".join(rng.choices(["tree", "house", "river", "stone"], k=30))).encode() for _ in range(2000)]
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert sum(map(len, warc.archive_frames(records))) < 0.8 * sum(len(plain.compress(r)) for r in records)


def test_no_pages(spark, ws):
    path = f"{ws.root}/archives"
    warc.write_archives(spark.createDataFrame([], PAGE), path)
    assert warc.read_archives(spark, path).count() == 0
