import random

import pytest

from helpers import distance, frame_distance
from twinsieve.operators import hamming as H
from twinsieve.plans.bands import Bands, Tiles, band_scheme, choose_scheme, signed


def sample(seed, bases=60, copies=2, reach=9):
    rng = random.Random(seed)
    out = {0, 1, 3, 2**64 - 1}
    for _ in range(bases):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(copies):
            x = base
            for _ in range(rng.randint(1, reach)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    values = [signed(v) for v in out]
    rng.shuffle(values)
    return values


def table(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp bigint, val bigint").coalesce(1).cache()


def truth(values, t):
    pairs = {(min(a, b), max(a, b), distance(a, b))
             for i, a in enumerate(values) for b in values[:i] if distance(a, b) <= t}
    lows = {a: min(i for i, b in enumerate(values) if distance(a, b) <= t) for a in values}
    return pairs, lows


def check(ws, df, values, t, scheme):
    pairs, lows = truth(values, t)
    got = [tuple(r) for r in H.similar_pairs(ws, df, len(values), t, scheme).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    found = H.lowest_within(ws, df, df, len(values), len(values), t, scheme).collect()
    assert {r.fp: r.low for r in found} == lows


@pytest.mark.parametrize("t", [0, 1, 4, 8, 13, 20])
def test_every_scheme_is_exact(spark, ws, t):
    values = sample(t)
    df = table(spark, values)
    for scheme in (Tiles(3), band_scheme(t, 1), *([band_scheme(t, 2)] if t < 9 else [])):
        check(ws, df, values, t, scheme)


def test_the_bound_is_inclusive_and_counts_bit_63(spark, ws):
    values = [0, 1, 3, 0xFF, 0x1FF, -1]
    found = H.similar_pairs(ws, table(spark, values), 6, 8, band_scheme(8, 1)).collect()
    assert sorted((r.a, r.b) for r in found if 0 in (r.a, r.b)) == [(0, 1), (0, 3), (0, 0xFF)]


@pytest.mark.parametrize("broadcast,levels", [(400_000, 2), (10, 0)])
def test_hot_buckets_are_taken_apart_exactly(spark, ws, monkeypatch, broadcast, levels):
    monkeypatch.setattr(H, "HOT_ROWS", 4)
    monkeypatch.setattr(H, "LEADERS", 3)
    monkeypatch.setattr(H, "MAX_LEVELS", levels)
    monkeypatch.setattr(H, "BROADCAST_ROWS", broadcast)
    values = sample(7, bases=25, copies=3, reach=6)
    check(ws, table(spark, values), values, 4, band_scheme(4, 1))


def test_different_sides(spark, ws):
    values = sample(11)
    probe, target = values[::2], values[1::2]
    found = H.lowest_within(ws, table(spark, probe), table(spark, target), len(probe), len(target), 6,
                            band_scheme(6, 2)).collect()
    want = {a: min(i for i, b in enumerate(target) if distance(a, b) <= 6)
            for a in probe if any(distance(a, b) <= 6 for b in target)}
    assert {r.fp: r.low for r in found} == want


def test_frame_sets(spark, ws):
    rng = random.Random(3)
    shared = signed(rng.getrandbits(64))
    items = {f"v{i}": [signed(rng.getrandbits(64)) for _ in range(3)] + ([shared] if i % 3 == 0 else [])
             for i in range(25)}
    frames = spark.createDataFrame([(k, f) for k, fs in items.items() for f in fs], "item string, fp bigint")
    for t in (0, 18):
        got = {(r.a, r.b): r.d for r in H.similar_frame_sets(ws, frames, t).collect()}
        want = {(a, b): frame_distance(items[a], items[b]) for a in items for b in items
                if a < b and frame_distance(items[a], items[b]) <= t}
        assert got == want


def test_scheme_follows_size_and_threshold():
    assert isinstance(choose_scheme(500, 20), Tiles)
    assert isinstance(choose_scheme(10**6, 8), Bands)
    assert choose_scheme(10**8, 8).need > choose_scheme(10**6, 8).need
    for scheme in (choose_scheme(10**6, 8), band_scheme(20, 1)):
        bits = 0
        for band in scheme.bands:
            assert bits & band == 0
            bits |= band
        assert bits == 2**64 - 1
