"""Quality of texts by ordinal regression on graded ratings.

A cumulative-link model: one weight per hashed feature, shared by all grades, and ordered thresholds between grades,
``P(grade <= k) = logistic(threshold[k] - score)``. A text's score gives its expected grade and the probability of
the best grade. All of them rise or fall with the score, so one limit on ``p_best`` selects texts by every tail alike. The
limit is chosen on rated texts held out from a first fit: the highest that keeps ``KEEP_BEST`` of those of the best grade.
Texts whose ``p_best`` equals the limit are kept.

Features of a whole text are its distinct words, what non-letters words carry, and shares (of repeated words, capitals,
symbols, repeated lines) in steps; each counts once, hashed into ``DIMENSIONS`` buckets.

The model is fitted on at most ``FIT_ROWS`` rated texts, those with the lowest hash of their id; a text that is there
several times under one id counts once. Features of every other text are computed where the text is. Ratings that are null are left out. Null texts count as empty: they have the
features of a text without words and are scored by them. Repeated rows get the same score. Columns of the rows stay
beside the result; only the names of the result's own struct are new. An empty table gives an empty result. With no rated text the model scores all texts
alike, at the prior, and keeps them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.rows import content_key, struct_udf

DIMENSIONS = 1 << 18
#: Rated texts the model is fitted on, at most.
FIT_ROWS = 20_000
#: A feature must occur in so many of the rated texts to get a weight.
MIN_TEXTS = 5
#: One rated text in so many is held out to choose the limit, which keeps this share of the best ones.
HELD_OUT = 5
KEEP_BEST = 0.99
#: Entries of a worker's table of hashed words; it is emptied when full.
CACHE_ENTRIES = 150_000

EDGES = re.compile(rb"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$")
SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>!@^~=_{}[]\\"))


def bucket(feature: bytes) -> int:
    return crc32(feature) % DIMENSIONS


class Words(dict):
    """Buckets of a word: of its letters and of the non-letters at its edges."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        core = EDGES.sub(b"", word)
        edges = b"".join(EDGES.findall(word)).strip(b".,;:!?\"'()-")
        found = tuple([bucket(core.lower())] * bool(core) + [bucket(b"\x01edge " + edges[:4])] * bool(edges))
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


WORDS = Words()


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's features, distinct and ascending."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    distinct = set(words)
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    shares = {b"again": sum(map(eq, words, words[1:])) / n, b"distinct": len(distinct) / n,
              b"capitals": sum(map(bytes.isupper, words)) / n, b"symbols": len(raw.translate(None, SYMBOLS)) / n,
              b"lines": 1 - len(set(lines)) / max(1, len(lines))}
    found = {i for w in distinct for i in WORDS[w]}
    found.update(bucket(b"\x02%s %d" % (k, min(10, int(10 * v + 0.5)))) for k, v in shares.items())
    found.add(bucket(b"\x02words %d" % min(8, len(words).bit_length())))
    return np.array(sorted(found), np.int64)


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Weights per bucket and ascending thresholds between grades."""

    thresholds: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS, np.float32))
    #: The least probability of the best grade that a text is kept with.
    least: float = 0.5

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade <= k)`` for each score and each k but the last grade."""
        return logistic(self.thresholds[None, :] - np.asarray(scores)[:, None])

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, epochs: int = 30, batch: int = 512,
        rate: float = 0.3, decay: float = 3e-4) -> OrdinalModel:
    """The model of rated texts, by gradient steps of adaptive size in a fixed order."""
    counts = np.array([(grades == k).sum() for k in range(n_grades)]) + 0.5
    prior = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(prior / (1 - prior))
    model = OrdinalModel(thresholds.copy())
    if not rows:
        model.thresholds = np.full(n_grades - 1, -8.0) + np.arange(n_grades - 1)
        return model
    # One array for all texts: the memory of many small ones stays with the process when they are gone.
    kept, ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    texts = sum(np.bincount(part, minlength=DIMENSIONS) for part in np.array_split(kept, 16))
    used = np.flatnonzero(texts >= MIN_TEXTS)
    place = np.full(DIMENSIONS, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = place[kept]
    known = kept >= 0
    kept, ends = kept[known], np.cumsum([0, *(np.count_nonzero(known[a:b]) for a, b in zip(ends, ends[1:]))])
    w, seen, seen_t = np.zeros(len(used)), np.full(len(used), 1e-3), np.full(n_grades - 1, 1e-3)
    low = np.concatenate([[-np.inf], thresholds])
    order = np.random.default_rng(0).permutation(len(rows))
    for epoch in range(epochs):
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            sizes = ends[some + 1] - ends[some]
            columns = np.concatenate([kept[ends[i]:ends[i + 1]] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            scores = np.bincount(owner, w[columns], len(some))
            y = grades[some]
            low, high = np.concatenate([[-np.inf], thresholds])[y], np.concatenate([thresholds, [np.inf]])[y]
            p_low, p_high = logistic(low - scores), logistic(high - scores)
            p = np.maximum(p_high - p_low, 1e-9)
            d_low, d_high = p_low * (1 - p_low), p_high * (1 - p_high)
            slope = (d_high - d_low) / p  # of the loss by the score
            g = np.bincount(columns, slope[owner], len(used)) / len(some) + decay * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
            g_t = np.array([(np.where(y == k + 1, d_low / p, 0) - np.where(y == k, d_high / p, 0)).mean()
                            for k in range(n_grades - 1)])
            seen_t += g_t * g_t
            thresholds = np.maximum.accumulate(thresholds - rate * g_t / np.sqrt(seen_t))
    model.thresholds = thresholds
    model.weights[used] = w
    return model


def limit_of(best: np.ndarray, keep: float = KEEP_BEST) -> float:
    """The highest limit from 0.5 to 0.9 that keeps a share ``keep`` of texts with these probabilities, or else 0.5."""
    if not len(best):
        return 0.5
    return float(np.clip(np.sort(best)[int((1 - keep) * len(best))], 0.5, 0.9))


def fit_with_limit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3) -> OrdinalModel:
    """The model of all rated texts, with the limit that a model of most of them gives on the others."""
    model = fit(rows, grades, n_grades)
    held = np.arange(len(rows)) % HELD_OUT == HELD_OUT - 1
    if held.any():
        first = fit([r for r, h in zip(rows, held) if not h], grades[~held], n_grades)
        scores = [first.score(r) for r, h, g in zip(rows, held, grades) if h and g == n_grades - 1]
        model.least = limit_of(1 - first.at_most(np.array(scores))[:, -1])
    return model


def fit_on(docs: DataFrame, ratings: DataFrame, fit_rows: int = FIT_ROWS, n_grades: int = 3) -> OrdinalModel:
    """The model of ``ratings`` (doc_id, grade) over ``docs`` (doc_id, text)."""
    rated = ratings.where("doc_id is not null and grade is not null").select("doc_id", "grade")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(fit_rows)
    found = struct_udf(lambda texts: {"buckets": [features(t) for t in texts]}, "buckets array<int>")
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "grade", content_key("text").alias("key"), found("text").alias("f"))
            .groupBy("doc_id", "grade", "key").agg(F.first("f.buckets").alias("buckets"))
            .orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key", "grade").limit(fit_rows))
    # As arrays all the way: lists of numbers would take many times the memory.
    got = rows.toArrow().combine_chunks()
    order = got.sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("key", "ascending")]).combine_chunks()
    lists = order["buckets"].chunk(0) if order.num_rows else None
    parts = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()) if lists else []
    model = fit_with_limit(parts, order["grade"].to_numpy().astype(int), n_grades)
    del got, order, lists, parts
    pa.default_memory_pool().release_unused()
    return model


def graded(model: OrdinalModel, text: Column | str, least: float | None = None) -> Column:
    """Struct of ``expected_grade``, ``p_best`` (the probability of the best grade) and ``kept``: it is the limit or more."""
    limit = model.least if least is None else least

    def batch(texts):
        below = model.at_most([model.score(features(t)) for t in texts])
        best = 1 - below[:, -1]
        return {"expected_grade": (1 - below).sum(axis=1), "p_best": best, "kept": best >= limit}

    return struct_udf(batch, "expected_grade double, p_best double, kept boolean")(text)


def grade_labels(labels: DataFrame) -> DataFrame:
    """Ratings of labels: toxic texts 0, poor ones 1, good ones 2; null where a label that decides is null."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", F.when(F.col("toxic").isNotNull(), grade).alias("grade"))
