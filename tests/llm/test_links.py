"""Near duplicates and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinsieve.llm import simhash
from twinsieve.llm.components import connected_components

MASK = (1 << 64) - 1


def plain_roots(n, links):
    roots = list(range(n))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(values):
    return [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & MASK).bit_count() <= 3]


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "A b", "É é\x1cx  y\tz"] + [" ".join(rng.choices("abcdE", k=rng.randint(1, 40))) for _ in range(200)]
    assert [simhash.fingerprint(t) & MASK for t in texts] == [plain_fingerprint(t) for t in texts]
    # One shingle's bits are those of the built-in function.
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert simhash.fingerprint("one Two three") == row["h"]


def test_ring_never_loses_a_link():
    rng = np.random.default_rng(2)
    for bits in (0, 1, 2, 3):
        xors = np.array([sum(1 << int(i) for i in rng.choice(64, bits, replace=False)) for _ in range(5000)], np.uint64)
        assert simhash.ring_passes(xors).all()
    far = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert simhash.ring_passes(far).mean() < 0.1


def test_refined_masks_keep_near_values_together():
    rng = random.Random(3)
    masks = [0]
    for level, most in enumerate((20, 400, 8000)):
        mask = rng.choice(masks)
        free = [i for i in range(64) if not mask >> i & 1]
        masks = simhash.refined(mask)
        for _ in range(500):
            x = sum(1 << i for i in rng.sample(free, 3))
            assert any(not x & m for m in masks)
        assert len(masks) <= 20
    assert max(64 - m.bit_count() for m in masks) <= 9 and 2 ** 9 <= simhash.BUCKET_NODES


def cluster(rng, n, flips):
    base = [rng.getrandbits(64) for _ in range(3)]
    out = {rng.choice(base) ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)}
    return list(out | {rng.getrandbits(64) for _ in range(20)} | {0, MASK})


@pytest.mark.parametrize("bucket_nodes, flips", [(512, 3), (4, 2), (8, 6)])
def test_links_connect_what_pairs_connect(spark, ws, bucket_nodes, flips):
    values = cluster(random.Random(flips), 120, flips)
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint")
    links = simhash.near_links(ws, nodes, bucket_nodes).collect()
    place = {simhash.signed(v): i for i, v in enumerate(values)}
    want = near(values)
    got = [(place[r["a"]], place[r["b"]]) for r in links]
    assert plain_roots(len(values), got) == plain_roots(len(values), want)


@pytest.mark.parametrize("links", [
    [], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)],
    [(random.Random(4).randint(0, 0) + i * 7 % 50, i * 13 % 50) for i in range(60)], [(5, 3), (3, 5), (5, 3), (-4, 5)]])
def test_components(spark, ws, links):
    got = {r["node"]: r["root"] for r in connected_components(ws, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    ends = sorted({x for a, b in links if a is not None and a != b for x in (a, b)})
    place = {x: i for i, x in enumerate(ends)}
    roots = plain_roots(len(ends), [(place[a], place[b]) for a, b in links if a in place and b in place])
    assert got == {x: ends[r] for x, r in zip(ends, roots)}


def test_near_duplicates(spark, ws):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(7)
    texts = [None, "", " ", "short one", "short one"]
    for _ in range(12):
        base = rng.choices(words, k=200)
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(200)] = "other"
            texts.append(" ".join(copy))
    rows = [(i * 3 % 59, t, "x", 1) for i, t in enumerate(texts)] + [(None, "short one", "x", 1), (None, "lonely text", "x", 1),
                                                                  (0, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, root int")
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_roots(len(rows), near(prints))
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None)
             for r in set(roots)}
    got = sorted(((r["doc_id"], r["fp"] & MASK, r["component_id"]) for r in simhash.near_duplicates(ws, docs).collect()), key=str)
    assert got == sorted(((rows[i][0], prints[i], least[roots[i]]) for i in range(len(rows))), key=str)
    kept = simhash.one_of_each(ws, docs)
    assert kept.columns == docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted(least.values(), key=str)
    assert simhash.near_duplicates(ws, docs.limit(0)).count() == 0 == simhash.one_of_each(ws, docs.limit(0)).count()
