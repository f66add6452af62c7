"""Choice of the key scheme of a Hamming similarity join.

Cut the 64 bits into ``m`` bands. Two fingerprints at most ``t`` bits apart
differ in at most ``t`` bands, so they agree on some ``k = m - t`` of them
(pigeonhole; Norouzi, Punjani and Fleet, CVPR 2012, for ``k = 1``). Every choice of
``k`` bands is a bit mask, and ``fp & mask`` an equi-join key. More bands make
keys longer, buckets smaller, and copies of each row more numerous. Bits are
dealt to bands in turn, so that neighbouring bits that are constant in many
rows (a black border, say) do not make up a band.

When no scheme beats comparing everything (large ``t``), fingerprints are
hashed into tiles and every pair of tiles is an equi-join key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, isqrt

# Relative costs, as measured: moving one row through a shuffle and a sort,
# comparing one pair.
ROW_COST = 300
PAIR_COST = 1
MAX_MASKS = 2000
TILE_ROWS = 20_000
ALL_BITS = tuple(range(64))


def signed(bits: int) -> int:
    """The BIGINT with this 64-bit pattern."""
    return bits - (1 << 64) if bits >> 63 else bits


@dataclass(frozen=True)
class Bands:
    """Keys ``fp & mask`` for each mask; ``bands[i]`` are disjoint bit sets."""

    bands: tuple[int, ...]
    need: int

    @property
    def masks(self) -> list[tuple[int, int]]:
        """(mask, index of its last band), unsigned."""
        return [(sum(self.bands[i] for i in pick), pick[-1])
                for pick in combinations(range(len(self.bands)), self.need)]

    @property
    def copies(self) -> int:
        return comb(len(self.bands), self.need)

    def even_bucket(self, n: int) -> float:
        """Rows of a bucket if ``n`` fingerprints were spread evenly."""
        bits = sum(b.bit_count() for b in self.bands[-self.need:])
        return n / 2**bits


@dataclass(frozen=True)
class Tiles:
    """Every row meets every tile once; ``count`` tiles on either side."""

    count: int

    @property
    def copies(self) -> int:
        return self.count


def band_scheme(threshold: int, need: int, bits: Sequence[int] = ALL_BITS) -> Bands:
    m = threshold + need
    return Bands(tuple(sum(1 << b for b in bits[i::m]) for i in range(m)), need)


def tile_scheme(n: int, parallelism: int) -> Tiles:
    spread = isqrt(parallelism) + 1 if n > 2_000 else 2
    return Tiles(max(ceil(n / TILE_ROWS), spread))


def choose_scheme(n: int, threshold: int, parallelism: int = 8,
                  bits: Sequence[int] = ALL_BITS) -> Bands | Tiles:
    """The cheapest scheme for ``n`` distinct fingerprints that differ in ``bits``."""
    tiles = tile_scheme(n, parallelism)
    best, cost = tiles, 2 * n * tiles.count * ROW_COST + n * n * PAIR_COST
    for need in range(1, len(bits) - threshold + 1):
        copies = comb(threshold + need, need)
        if copies > MAX_MASKS:
            break
        width = need * len(bits) // (threshold + need)
        price = copies * (2 * n * ROW_COST + n * n * PAIR_COST / 2**width)
        if price < cost:
            best, cost = band_scheme(threshold, need, bits), price
    return best
