"""Like texts against all pairs of them."""

import random

import numpy as np
import pytest

import corpus_pipeline
from llm.test_links import plain_roots
from twinsieve.llm import alike, simhash


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " \n", "one", "One", "a b c d", "a b c e"]
    for edits in (1, 2, 4, 8, 12, 30):
        base = rng.choices(vocabulary, k=300)
        out += [" ".join(edited(rng, base, edits)) for _ in range(8)]
    chain = rng.choices(vocabulary, k=200)
    for i in range(12):
        chain[i * 15:i * 15 + 15] = rng.choices(vocabulary, k=15)
        out.append(" ".join(chain))
    return out + [" ".join(rng.choices(vocabulary, k=60)) for _ in range(20)]


def kept_ids(rows):
    sets = [plain_shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    roots = plain_roots(len(rows), links)
    return sorted(min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots))


def test_near_duplicates_stage_equals_all_pairs(spark):
    rows = [(i * 37 % 211, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())
    assert got == kept_ids(rows)


def test_share_is_exact():
    rng = random.Random(12)
    some = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(60)]
    for a in some:
        for b in some:
            want = share(plain_shingles(a), plain_shingles(b)) >= 0.8
            assert alike.are_alike(alike.shingles(a), alike.shingles(b)) == want


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(17)
    for n in (0, 1, 20, 300, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for _ in range(2))
        b = np.union1d(a[: n // 2], b)
        bits = sum(int(x).bit_count() for x in (alike.sketch(a) ^ alike.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and len(alike.sketch(a)) * 64 == alike.SKETCH_BITS


def test_candidates_at_the_threshold():
    rng = np.random.default_rng(13)
    for _ in range(300):
        common, own = rng.integers(0, 1 << 63, 80, np.uint64), rng.integers(0, 1 << 63, 20, np.uint64)
        a, b = np.concatenate([common, own[:10]]), np.concatenate([common, own[10:]])
        assert (alike.band_keys(a) == alike.band_keys(b)).any()


@pytest.mark.parametrize("rows", [[], [(None, None), (None, ""), (1, "a b"), (1, "a b")]])
def test_nulls_and_nothing(spark, ws, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert alike.one_of_each(ws, docs).count() == len(rows) // 2


@pytest.mark.parametrize("drop", [simhash.one_of_each, lambda ws, docs: corpus_pipeline.keep_one_of_each(ws.spark, docs, "")])
def test_near_fingerprints_of_unlike_texts_drop_nothing(spark, ws, drop):
    rng = random.Random(14)
    base = rng.choices([f"w{i}" for i in range(2000)], k=900)
    prints, found = simhash.fingerprint(" ".join(base)), []
    while len(found) < 2:
        other = edited(rng, base, 50)
        if ((simhash.fingerprint(" ".join(other)) ^ prints) & (1 << 64) - 1).bit_count() <= 3:
            found.append(other)
    assert all(share(plain_shingles(" ".join(base)), plain_shingles(" ".join(o))) < 0.8 for o in found)
    rows = [(i, " ".join(t)) for i, t in enumerate([base, *found, base])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in drop(ws, docs).collect()) == [0, 1, 2]


def test_stage_compares_what_fingerprints_link_and_nothing_of_it_again(spark, monkeypatch):
    """Of a long text and versions of it with a word changed: they share three bits and four fifths of their shingles."""
    rng = random.Random(15)
    base = rng.choices([f"w{i}" for i in range(2000)], k=4000)
    near = [base]
    while len(near) < 4:
        other = edited(rng, base, 1)
        if ((simhash.fingerprint(" ".join(other)) ^ simhash.fingerprint(" ".join(base))) & (1 << 64) - 1).bit_count() <= 3:
            near.append(other)
    seen, confirmed = [], alike._confirmed

    def kept(pairs, texts):
        seen.append({(r["a"], r["b"]) for r in pairs.collect()})
        return confirmed(pairs, texts)

    monkeypatch.setattr(alike, "_confirmed", kept)
    rows = [(i, " ".join(t)) for i, t in enumerate([*near, base])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] == [0]
    keys = set(alike.described([t for _, t in rows])["key"])
    assert {k for pair in seen[0] for k in pair} == keys and not any(seen[1:])


def template_group(rng, n, own):
    """Texts of 300 words that share a template, with ``own`` words of their own at a place of their own."""
    base = [f"t{i}" for i in range(300)]
    out = []
    for i in range(n):
        at = rng.randrange(300 - own)
        out.append(" ".join([*base[:at], *(f"o{i}x{k}" for k in range(own)), *base[at + own:]]))
    return out


def links_and_pairs(ws, rows, monkeypatch):
    compared, confirmed = [], alike._confirmed

    def counted(pairs, texts):
        compared.append(pairs.count())
        return confirmed(pairs, texts)

    monkeypatch.setattr(alike, "_confirmed", counted)
    docs = ws.spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in alike.one_of_each(ws, docs).collect())
    return kept, sum(compared)


def test_groups_that_share_much_but_are_not_alike_stay_linear(ws, monkeypatch):
    seen = []
    for n in (200, 400):
        rows = list(enumerate(template_group(random.Random(5), n, 45)))
        sets = [plain_shingles(t) for _, t in rows[:60]]
        assert all(0.5 < share(x, y) < 0.8 for i, x in enumerate(sets) for y in sets[:i])
        kept, pairs = links_and_pairs(ws, rows, monkeypatch)
        assert kept == list(range(n))
        seen.append(pairs)
    assert seen[1] <= 2.6 * seen[0] and seen[1] < 25 * 400


@pytest.mark.parametrize("seed", range(2))
def test_large_groups_equal_all_pairs(ws, monkeypatch, seed):
    """Copies with many and few edits, copies of copies, shortened and lengthened ones, around no text of the table."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(160)]
    texts = [edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 14])) for _ in range(90)]
    texts += [edited(rng, rng.choice(texts), rng.choice([1, 2, 3])) for _ in range(60)]
    for _ in range(40):
        at, words = rng.randrange(100), rng.choice(texts)
        texts.append(words[:at] + words[at + rng.randrange(40):] + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(20))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept, pairs = links_and_pairs(ws, rows, monkeypatch)
    assert kept == kept_ids(rows)
