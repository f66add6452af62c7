"""Difference hash of rasters: is a pixel brighter than its right neighbour?

The raster is brought to 9 columns and 8 rows by a triangle filter, in colour,
then to grey; bit ``y * 8 + x`` is set where pixel ``(x, y)`` is brighter than
``(x + 1, y)``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Size of the reduced raster, and ITU-R 709 weights of grey in
# the channel order blue, green, red.
COLUMNS, ROWS = 9, 8
GREY_BGR = np.array([0.0722, 0.7152, 0.2126])


def dhash_luma8(luma: Column | str) -> Column:
    """BIGINT hash of a grey 8 by 8 raster given as ARRAY<INT>, row by row.

    From 8 to 9 columns the triangle filter is linear interpolation, done here
    in whole numbers, halves rounded up; rows stay as they are.
    """
    luma = F.col(luma) if isinstance(luma, str) else luma

    def at(y: Column, x: Column) -> Column:
        return F.element_at(luma, (y * 8 + x + 1).cast("int"))

    def value(y: Column, x: Column) -> Column:
        q = 16 * x - 1
        i, k = F.floor(q / 18), q % 18
        mixed = F.floor((at(y, i) * (18 - k) + at(y, F.least(i + 1, F.lit(7).cast("bigint"))) * k + 9) / 18)
        return F.when(x == 0, at(y, x).cast("bigint")).otherwise(mixed)

    grid = F.transform(F.sequence(F.lit(0), F.lit(ROWS * COLUMNS - 1)),
                       lambda j: value(F.floor(j / COLUMNS), j % COLUMNS))
    bits = F.sequence(F.lit(0), F.lit(63))

    def brighter(v: Column, b: Column) -> Column:
        j = (F.floor(b / 8) * COLUMNS + b % 8 + 1).cast("int")
        return F.element_at(v, j) > F.element_at(v, j + 1)

    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    # Wrapped in a one-element array so that the grid is computed once.
    hashed = F.transform(F.array(grid), lambda v: F.aggregate(bits, none, lambda acc, b: F.when(
        brighter(v, b), acc.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(acc)))
    return hashed[0]


@lru_cache(maxsize=512)
def _triangle(size: int, out: int) -> np.ndarray:
    """Weights (out, size) of a triangle filter, widened when reducing."""
    ratio = size / out
    reach = max(ratio, 1.0)
    centre = (np.arange(out)[:, None] + 0.5) * ratio
    weights = np.clip(1 - np.abs(np.arange(size)[None, :] + 0.5 - centre) / reach, 0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def dhash_raster(pixels: np.ndarray) -> int:
    """Signed 64-bit hash of a (height, width, channels) raster, channels in BGR order."""
    rows = np.tensordot(_triangle(pixels.shape[0], ROWS), pixels.astype(np.float64), axes=(1, 0))
    small = np.einsum("xw,ywc->yxc", _triangle(pixels.shape[1], COLUMNS), rows)
    small = np.floor(np.clip(small, 0, 255) + 0.5)
    grey = small[..., 0] if small.shape[-1] == 1 else np.floor(small[..., :3] @ GREY_BGR + 0.5)
    brighter = (grey[:, :-1] > grey[:, 1:]).reshape(-1)
    return int(np.packbits(brighter, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def dhash_image(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Hash of decoded images; NULL for rows that could not be decoded."""
    out = []
    for h, w, c, raw in zip(height, width, channels, data):
        if not raw or min(h, w, c) < 1 or len(raw) != h * w * c:
            out.append(None)
        else:
            out.append(dhash_raster(np.frombuffer(raw, dtype=np.uint8).reshape(h, w, c)))
    return pd.Series(out, dtype="Int64")
