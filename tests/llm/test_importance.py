"""Resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import importance
from twinsieve.llm.queries import op12_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n", "one", "One TWO", "ÀÉ straße Ω é", "a\x00b{c}", "字 漢 " * 40, "word " * 30_000, "x" * 50_000]


def plain_features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_draw(docs, target):
    s, t = (Counter(b for text in texts for b in plain_features(text)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        words, buckets = plain_features(text)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[:25 * len(fit) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out), key=repr)


def rows(n):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "The", "字"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    return docs + [(n + i, t) for i, t in enumerate(ODD)] + [(None, docs[0][1] + " x" * 25), (7, docs[7][1])] + [(3, "a b " * 15)] * 40


@pytest.mark.parametrize("part", [1, 300, 1 << 20])
def test_features_do_not_cross_texts(monkeypatch, part):
    texts = [t for _, t in rows(40)][:52]
    raw = [(t or "").encode() for t in texts]
    buckets, owner, n_words = importance.features(raw)
    for i, text in enumerate(texts):
        words, want = plain_features(text)
        assert n_words[i] == len(words) and sorted(buckets[owner == i]) == sorted(want)
    ranges = importance.parts_by_bytes(list(map(len, raw)), part)
    assert [k for a, b in ranges for k in range(a, b)] == list(range(len(raw)))
    assert all(sum(map(len, raw[a:b])) <= part or b - a == 1 for a, b in ranges)


def test_crc_goes_on():
    some = np.array([zlib.crc32(w) for w in (b"", b"a", b"word")], np.uint32)
    assert importance.followed_by(some, 32).tolist() == [zlib.crc32(w + b" ") for w in (b"", b"a", b"word")]


@pytest.mark.parametrize("copies", [7, importance.COPIES])
def test_query_equals_the_plain_version(spark, tmp_path, monkeypatch, copies):
    monkeypatch.setattr(importance, "COPIES", copies)
    docs, target = rows(300), ["w1 w2 w3 w1", "w4 the", None, ""]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, op12_importance(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_draw(docs, target)
    assert sum(r[4] is not None for r in got) > 50


@pytest.mark.parametrize("docs, target", [([], []), ([], ["a b"]), ([(1, "a " * 20), (None, None)], [])])
def test_empty_tables(spark, ws, docs, target):
    frames = (spark.createDataFrame(docs, "doc_id bigint, text string"),
              spark.createDataFrame([(t,) for t in target], "text string"))
    got = importance.resample(ws, *frames, percent=100).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: -r["n_words"])] == [1, None][:len(docs)]


def test_other_columns_do_not_matter(spark, ws):
    docs = spark.createDataFrame([(1, "a " * 20, 5, 6)], "doc_id bigint, text string, score int, rank int")
    assert importance.resample(ws, docs, docs, percent=100).first()["rank"] == 1
