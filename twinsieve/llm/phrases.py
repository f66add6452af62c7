"""Passages of test items in texts, by a positional inverted index.

1. Items are cut into windows of ``WINDOW`` words (a shorter item is one window). They are taken in blocks of bounded
   size; one block is the usual case.
2. The index of a corpus is split by text, as search engines do: a row is a segment of whole texts with the sorted
   positions of each term. Terms that no window of the block has are never looked up and are left out. It is written
   to a shared folder.
3. Collection frequencies of terms come from all segments. They put the terms of each window in order, rarest first.
4. In each segment, the positions of a window's rarest term, moved by its place in the window, are candidates; each
   further term keeps those at which it stands too, in its own place (exact phrase) or within ``slop`` words of it
   (proximity). All windows of a block go through a step at once.

Segments are independent: a term or passage that a third of all texts holds is spread over all segments. Nothing grows
with the corpus but the index.

Null and empty texts have no words and no matches; null and empty items have no windows. Repeated rows each get a row.
Items without an id mark words but are not listed. Repeated items count once. An empty table of items gives no match.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinsieve.llm.rows import content_key, struct_udf
from twinsieve.plans.workspace import Workspace

WINDOW = 13
#: Words of a segment, after which it is closed; a longer text makes a segment of its own.
SEGMENT_WORDS = 1 << 20
#: UTF-8 bytes of items that are looked for at once.
BLOCK_BYTES = 16 << 20

#: Bytes that words are made of stay, A-Z becomes a-z, others become a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))

SEGMENT = ("rows array<bigint>, ids array<bigint>, keys array<bigint>, n_words array<bigint>, "
           "terms array<int>, counts array<bigint>, positions binary")
MATCH = ("row bigint, doc_id bigint, text_key bigint, n_words bigint, "
         "spans array<struct<start: bigint, end: bigint>>, items array<string>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Block:
    """Distinct windows of a block of items; terms are numbered, windows padded with -1."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    #: Items of each window, as (window, item) in ascending order.
    owners: np.ndarray
    items: list[str | None]
    #: Places of each window, rarest term first.
    order: np.ndarray | None = None


def block_of(items: list[tuple], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple, int] = {}
    owners, names = set(), {}
    for name, text in items:
        codes = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        if not codes:
            continue
        item = names.setdefault(name, len(names))
        for i in range(max(1, len(codes) - window + 1)):
            owners.add((windows.setdefault(tuple(codes[i:i + window]), len(windows)), item))
    padded = np.full((len(windows), window), -1, np.int64)
    lengths = np.array([len(w) for w in windows], np.int64)
    for i, w in enumerate(windows):
        padded[i, :len(w)] = w
    return Block(vocabulary, padded, lengths, np.array(sorted(owners), np.int64).reshape(-1, 2), list(names))


def index_segments(rows: DataFrame, vocabulary: dict[bytes, int], segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of ``rows`` (row, doc_id, text_key, text): positions of the vocabulary's terms, by term."""
    arrow = to_arrow_schema(StructType.fromDDL(SEGMENT))
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def segment(ids: list[tuple], sizes: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(parts)
        at = np.flatnonzero(codes >= 0)
        at = at[np.argsort(codes[at], kind="stable")].astype("<i4")
        terms, counts = np.unique(codes[at], return_counts=True)
        return pa.RecordBatch.from_pylist([{
            "rows": [i[0] for i in ids], "ids": [i[1] for i in ids], "keys": [i[2] for i in ids], "n_words": sizes,
            "terms": terms.tolist(), "counts": counts.tolist(), "positions": at.tobytes()}], arrow)

    def batches(incoming):
        get = shared.value.get
        ids, sizes, parts, total = [], [], [], 0
        for batch in incoming:
            for key, text in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), batch.column(3)):
                words = words_of(text.as_py())
                ids.append(key)
                sizes.append(len(words))
                parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                total += len(words)
                if total >= segment_words:
                    yield segment(ids, sizes, parts)
                    ids, sizes, parts, total = [], [], [], 0
        if ids:
            yield segment(ids, sizes, parts)

    return rows.select("row", "doc_id", "text_key", "text").mapInArrow(batches, SEGMENT)


def rarest_first(index: DataFrame, block: Block) -> None:
    """Puts the places of each window in the order of their terms' frequencies in the whole index."""
    counted = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
               .groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect())
    frequency = np.zeros(len(block.vocabulary) + 1, np.int64)
    frequency[-1] = np.iinfo(np.int64).max  # padding comes last
    for row in counted:
        frequency[row["terms"]] = row["n"]
    block.order = np.argsort(frequency[block.windows], axis=1, kind="stable")


def matches(block: Block, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray,
            slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows and the texts and places in the texts, in words, where they start."""
    pad = block.windows.shape[1] + slop
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.searchsorted(first, positions, "right") - 1
    spread = positions + pad * (owner + 1)  # so that no match reaches into the next text
    span = int(first[-1]) + pad * (len(sizes) + 2)
    keys = np.repeat(terms.astype(np.int64), counts) * span + spread
    begins = np.zeros(len(block.vocabulary) + 1, np.int64)
    begins[terms + 1] = counts
    begins = np.cumsum(begins)
    windows = np.arange(len(block.windows))
    rarest = block.windows[windows, block.order[:, 0]]
    n = begins[rarest + 1] - begins[rarest]
    windows = np.repeat(windows, n)
    at = np.arange(len(windows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[rarest], n)
    starts = spread[at] - block.order[windows, 0]
    for k in range(1, block.windows.shape[1]):
        place = block.order[windows, k]
        term = block.windows[windows, place]
        low = term * span + starts + place - slop
        found = np.searchsorted(keys, low)
        near = (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] <= low + 2 * slop)
        keep = near | (term < 0)
        windows, starts = windows[keep], starts[keep]
        if not len(windows):
            break
    spread_first = first + pad * np.arange(1, len(first) + 1)
    text = np.searchsorted(spread_first, starts, "right") - 1
    text = np.clip(text, 0, len(sizes) - 1)
    start = starts - spread_first[text]
    if slop:
        # With slop an aligned start may lie before its text; the text is that of the rarest term.
        anchor = starts + block.order[windows, 0]
        text = np.searchsorted(spread_first, anchor, "right") - 1
        start = starts - spread_first[text]
    return windows, text, start


def union_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, ascending, that cover what the given ones cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]


def match_segments(index: DataFrame, block: Block, slop: int = 0) -> DataFrame:
    """A row per text of the index: where windows match, and the items they are of."""
    arrow = to_arrow_schema(StructType.fromDDL(MATCH))
    shared = index.sparkSession.sparkContext.broadcast(block)

    def batches(incoming):
        block = shared.value
        items_from = np.searchsorted(block.owners[:, 0], np.arange(len(block.windows) + 1))
        for batch in incoming:
            for row in batch.to_pylist():
                sizes = np.array(row["n_words"], np.int64)
                hits = {}
                if len(block.windows) and row["terms"]:
                    windows, text, start = matches(block, sizes, np.array(row["terms"]), np.array(row["counts"]),
                                                   np.frombuffer(row["positions"], "<i4").astype(np.int64), slop)
                    end = np.minimum(start + block.lengths[windows] + slop, sizes[text])
                    start = np.maximum(start - slop, 0)
                    by = np.argsort(text, kind="stable")
                    windows, text, start, end = windows[by], text[by], start[by], end[by]
                    cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
                    for a, b in zip(cuts, cuts[1:]):
                        held = {block.items[i] for w in np.unique(windows[a:b])
                                for i in block.owners[items_from[w]:items_from[w + 1], 1]}
                        hits[int(text[a])] = (*union_spans(start[a:b], end[a:b]), sorted(held - {None}))
                nothing = (np.zeros(0, int), np.zeros(0, int), [])
                found = [hits.get(i, nothing) for i in range(len(sizes))]
                spans = [[{"start": int(a), "end": int(b)} for a, b in zip(s, e)] for s, e, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip((row["rows"], row["ids"], row["keys"], row["n_words"], spans,
                                                         [items for *_, items in found]), arrow)], schema=arrow)

    return index.mapInArrow(batches, MATCH)


def blocks_of(items: DataFrame, window: int, block_bytes: int) -> list[Block]:
    """The items in blocks of about ``block_bytes``, each of which fits the driver and the executors."""
    kept = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [block_of([(r["item_id"], r["text"]) for r in kept.where(part == k).collect()], window) for k in range(n)]


def find_passages(ws: Workspace, docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0,
                  segment_words: int = SEGMENT_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_words``, ``spans`` of matching words and ``items`` found, for every row of ``docs``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", content_key("text").alias("text_key"),
                       "text")
    blocks = blocks_of(items, window, block_bytes)
    if len(blocks) > 1:
        rows = ws.save(rows, "rows")  # numbers of rows must be the same for every block
    found = []
    for block in blocks:
        index = ws.save(index_segments(rows, block.vocabulary, segment_words), "index")
        rarest_first(index, block)
        found.append(match_segments(index, block, slop))
    if len(found) == 1:
        return found[0].drop("row")

    def united(spans):
        out = []
        for row in spans:
            s, e = union_spans(np.array([x["start"] for x in row], int), np.array([x["end"] for x in row], int))
            out.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e)])
        return {"spans": out}

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # One row per block and text; the number of blocks is bounded by the items.
    merged = every.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_key", "n_words")],
                                      F.flatten(F.collect_list("spans")).alias("spans"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = struct_udf(united, "spans array<struct<start: bigint, end: bigint>>")
    return merged.select("doc_id", "text_key", "n_words", spans("spans")["spans"].alias("spans"), "items")


def n_hit(spans: Column | str = "spans") -> Column:
    """Number of words within spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(hits: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are in a passage."""
    return (hits > 0) & (20 * hits >= n_words)


def without_contaminated(ws: Workspace, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; their columns stay."""
    found = find_passages(ws, docs.select("doc_id", "text"), items)
    bad = (found.where(contaminated(n_hit(), F.col("n_words")))
           .select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct())
    bad = ws.save(bad, "contaminated")
    return docs.alias("d").join(
        bad, F.col("d.doc_id").eqNullSafe(F.col("bad_id"))
        & content_key(F.col("d.text")).eqNullSafe(F.col("bad_key")), "left_anti")
