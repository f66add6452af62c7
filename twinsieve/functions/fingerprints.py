"""Column expressions over 64-bit similarity fingerprints.

A fingerprint is a BIGINT bit pattern; bit 63 is the sign. Text forms (16 hex
digits, or several joined by ``;``) appear only at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text form of a 64-bit hexadecimal number (optional plus
# sign, any leading zeros), and the separator of frame fingerprints.
HEX64 = r"^[+]?0*[0-9a-fA-F]{1,16}$"
FRAME_SEPARATOR = ";"
BITS = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_hex(text: Column | str) -> Column:
    """BIGINT of a hex string, NULL when it is not a 64-bit number."""
    text = _col(text)
    digits = F.conv(F.ltrim(text, F.lit("+")), 16, -10).cast("bigint")
    return F.when(text.rlike(HEX64), digits)


def to_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(_col(fp)), 16, "0"))


def is_multi(text: Column | str) -> Column:
    return F.instr(_col(text), FRAME_SEPARATOR) > 0


def split_frames(text: Column | str) -> Column:
    """ARRAY<BIGINT> of the frames that parse; the others are left out."""
    parts = F.split(_col(text), FRAME_SEPARATOR)
    return F.filter(F.transform(parts, parse_hex), lambda x: x.isNotNull())


def join_frames(fps: Column | str) -> Column:
    return F.concat_ws(FRAME_SEPARATOR, F.transform(_col(fps), to_hex))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two BIGINT fingerprints."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """Distance of two hex fingerprints, NULL when either does not parse."""
    return hamming(parse_hex(a), parse_hex(b))


def min_frame_distance(a: Column | str, b: Column | str) -> Column:
    """Smallest distance over all frame pairs of two ARRAY<BIGINT>, else NULL."""
    a, b = _col(a), _col(b)
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: hamming(x, y)))))


def content_digest(content: Column | str) -> Column:
    """64 hex digits that are equal exactly when the contents are."""
    return F.sha2(_col(content).cast("binary"), 256)


def similarity_pct(distance: Column | str) -> Column:
    """Share of equal bits in percent, rounded half up."""
    return F.floor((BITS - _col(distance)) / F.lit(BITS) * 100 + F.lit(0.5)).cast("int")


def mebibytes(size: Column | str, digits: int = 1) -> Column:
    return F.round(_col(size) / F.lit(1048576), digits)


def kind_label(duplicate_type: Column | str, max_distance: Column | str) -> Column:
    """``exact``, ``filename``, ``identical`` (perceptual, distance 0) or ``similar``."""
    kind = _col(duplicate_type)
    return (F.when(kind != "perceptual", kind)
            .when(_col(max_distance) == 0, "identical").otherwise("similar"))


def pixel_area(width: Column | str, height: Column | str) -> Column:
    """Width times height, 0 when unknown."""
    area = _col(width).cast("bigint") * _col(height).cast("bigint")
    return F.coalesce(F.greatest(area, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def sample_windows(duration: Column | str, count: int) -> Column:
    """ARRAY<STRUCT<idx, start, end>>: where to take ``count`` frames.

    Window ``i`` starts in the middle of the i-th of ``count`` equal parts and
    lasts half a second, inside the video.
    """
    dur = _col(duration).cast("double")

    def window(i: Column) -> Column:
        start = F.least(F.greatest(dur * (i + F.lit(0.5)) / F.lit(float(count)), F.lit(0.0)),
                        dur - F.lit(0.01))
        return F.struct(i.cast("int").alias("idx"), start.alias("start"),
                        F.least(start + F.lit(0.5), dur).alias("end"))

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), window)


def sample_instant(duration: Column | str, position: float) -> Column:
    """Second at which to take a single frame, at a share of the duration."""
    share = min(max(position, 0.0), 0.99)
    return F.greatest(_col(duration).cast("double") * F.lit(share), F.lit(0.0))
