"""Small inputs and plain-Python truths."""

from __future__ import annotations

import struct
import zlib

RECORD = "path string, size bigint, mtime bigint, exact_hash string, phash string, media_type string"


def rec(path, size, exact=None, phash=None, media="image"):
    return (path, size, 0, exact, phash, media)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD).coalesce(1)


def distance(a: int, b: int) -> int:
    return bin((a ^ b) & (2**64 - 1)).count("1")


def frame_distance(a, b) -> int:
    return min(distance(x, y) for x in a for y in b)


def greedy(nodes, near):
    """Owner per node of the serial rule; nodes in order as (rk, value)."""
    owner = {}
    for i, (rk, x) in enumerate(nodes):
        if rk not in owner:
            owner[rk] = rk
            for other, y in nodes[i + 1:]:
                if other not in owner and near(x, y):
                    owner[other] = rk
    return owner


def png(pixels, channels=3) -> bytes:
    """PNG bytes of rows of pixels, each a tuple of channel values (RGB) or a grey value."""
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + b"".join(bytes(p) if channels == 3 else bytes([p]) for p in row) for row in pixels)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def solid(rgb, size=100):
    return png([[rgb] * size for _ in range(size)])


def striped(size=100, band=10):
    return png([[(0,) * 3 if x // band % 2 == 0 else (255,) * 3 for x in range(size)] for _ in range(size)])
