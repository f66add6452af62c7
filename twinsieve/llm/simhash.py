"""Near duplicates by 64-bit similarity fingerprints, with a ring of segments before the full check.

Fingerprints within ``DISTANCE`` bits are linked, and texts linked through others make up a component.

1. Equal fingerprints fold to one node, so copies cost one row from there on.
2. Candidates meet in buckets: the bits are cut in six segments, and two nodes within three bits agree in three of them
   at least. A bucket that is too large is cut again: among its free bits the same rule gives longer keys, until at most
   nine bits are free. No bucket is capped and no pair of a bucket is written out.
3. In a bucket, a pair must first pass the ring: of the eight bytes, some chain of consecutive ones must start with
   differences that stay within the share of the budget at every length. Only then all bits are counted.
4. A bucket gives links that span its linked nodes, at most one per node; components join them over all buckets.

Null and empty texts have the fingerprint zero and are linked like any other. A component's id is the smallest id in
it; rows without an id do not lower it, and a component of such rows only has a null id. Repeated rows each get a row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinsieve.llm import alike
from twinsieve.llm.components import connected_components
from twinsieve.llm.rows import struct_udf
from twinsieve.plans.workspace import Workspace

DISTANCE = 3
SHINGLE_WORDS = 3
#: Segments of the free bits, and how many of them two nodes within DISTANCE must share.
SEGMENTS, SHARED = 6, 3
#: Nodes of a bucket that are compared in one go: as many as can differ in the last free bits.
BUCKET_NODES = 512
LAST_SHARED_BITS = 64 - 9
#: Consecutive bytes of the ring that must stay within their budgets.
CHAIN = 4
BIT_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a whole text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column | str) -> Column:
    """Struct with the fingerprint ``fp`` of a text."""
    return struct_udf(lambda texts: {"fp": [fingerprint(t) for t in texts]}, "fp bigint")(text)


def free_parts(mask: int) -> list[int]:
    """The bits outside ``mask`` in SEGMENTS runs of about equal size."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(i * len(free) / SEGMENTS) for i in range(SEGMENTS + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def refined(mask: int) -> list[int]:
    """Longer masks: two values that agree under ``mask`` and are within DISTANCE agree under one of these."""
    return sorted({mask | sum(some) for some in combinations(free_parts(mask), SHARED)})


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_passes(xors: np.ndarray) -> np.ndarray:
    """Whether some chain of CHAIN consecutive bytes has few enough differing bits at each of its lengths."""
    d = BIT_COUNTS[np.ascontiguousarray(xors).view(np.uint8).reshape(-1, 8)].astype(np.int16)
    ring = np.concatenate([d, d[:, :CHAIN - 1]], axis=1)
    alive, total = np.ones((len(d), 8), bool), np.zeros((len(d), 8), np.int16)
    for length in range(1, CHAIN + 1):
        total += ring[:, length - 1:length + 7]
        alive &= total <= length * DISTANCE // 8
    return alive.any(axis=1)


def spanning_links(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Links that span the linked values of each bucket; ``values`` are those of all buckets in turn."""
    end = np.repeat(np.cumsum(sizes), sizes)
    roots = np.arange(len(values))
    at, lag = np.arange(len(values)), 1
    pairs = []
    while len(at := at[at + lag < end[at]]):
        xors = values[at] ^ values[at + lag]
        close = np.flatnonzero(ring_passes(xors))
        found = BIT_COUNTS[xors[close].view(np.uint8).reshape(-1, 8)].sum(axis=1) <= DISTANCE
        hits = at[close[found]]
        pairs.append(np.stack([hits, hits + lag], axis=1))
        lag += 1
    pairs = np.concatenate([*pairs, np.zeros((0, 2), int)]).astype(int)
    while True:
        least = np.minimum(roots[pairs[:, 0]], roots[pairs[:, 1]])
        new = roots.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        new = new[new]
        if (new == roots).all():
            break
        roots = new
    moved = np.flatnonzero(roots != np.arange(len(values)))
    return np.stack([values[roots[moved]], values[moved]], axis=1)


def _links_of(buckets: DataFrame) -> DataFrame:
    kind = StructType.fromDDL("a bigint, b bigint")
    arrow = to_arrow_schema(kind)

    def batches(incoming):
        for batch in incoming:
            lists = batch.column(0)
            links = spanning_links(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array(links[:, i].astype("<u8").view("<i8")) for i in (0, 1)],
                                             schema=arrow)

    return buckets.select("fps").mapInArrow(batches, kind)


def _scheme(spark: SparkSession, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """Masks and their longer ones; at most SEGMENTS-choose-SHARED of each, so the table is small at every level."""
    longer = [(m, r) for m in masks for r in refined(m)]
    return (spark.createDataFrame([(signed(m), signed(r)) for m, r in longer], "mask bigint, longer bigint"),
            sorted({r for _, r in longer}))


def near_links(ws: Workspace, nodes: DataFrame, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` that chains of near ones connect."""
    spark, links, masks = nodes.sparkSession, None, refined(0)
    longer = nodes.select("fp", F.explode(F.array(*[F.lit(signed(m)).cast("bigint") for m in masks])).alias("mask"))
    while True:
        keyed = longer.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        met = ws.save(keyed.groupBy("mask", "key").agg(F.count("fp").alias("n")).where("n > 1"), "buckets")
        together = ws.save(keyed.join(met, ["mask", "key"]), "together")
        # With so few free bits a bucket has no more than BUCKET_NODES nodes.
        fits = (F.col("n") <= bucket_nodes) | (F.bit_count("mask") >= LAST_SHARED_BITS)
        small = (together.where(fits).groupBy("mask", "key")
                 .agg(F.collect_list("fp").alias("fps")))
        found = ws.save(_links_of(small), "found")
        links = found if links is None else links.unionByName(found)
        left = together.where(~fits).select("fp", "mask")
        if left.isEmpty():
            return links
        scheme, masks = _scheme(spark, masks)
        # The same longer mask can come from several shorter ones.
        longer = left.join(F.broadcast(scheme), "mask").select("fp", F.col("longer").alias("mask")).distinct()


def near_components(ws: Workspace, prints: DataFrame) -> DataFrame:
    """``fp``, ``root`` and ``component_id`` for every distinct fingerprint of ``prints`` (doc_id, fp)."""
    nodes = ws.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    linked = ws.save(connected_components(ws, near_links(ws, nodes)), "linked")
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = ws.save(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(ws: Workspace, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    prints = ws.save(docs.select(F.col(id_column).alias("doc_id"), fingerprints(text_column).alias("f"))
                     .select("doc_id", "f.fp"), "prints")
    return prints.join(near_components(ws, prints), "fp").select("doc_id", "fp", "component_id")


def described(texts: list) -> dict[str, list]:
    return alike.described(texts) | {"fp": [fingerprint(t) for t in texts]}


def described_by(text: Column | str) -> Column:
    """As ``alike.described_by``, with the fingerprint ``fp``."""
    return struct_udf(described, f"{alike.DESCRIBED}, fp bigint")(text)


def near_alike_links(ws: Workspace, packed: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that fingerprints link and whose texts are alike.

    ``packed`` has a row (key, n, sketch, fp, text) per row of the documents. Of the nodes of one fingerprint each is compared with
    the first, and the first ones of two linked fingerprints with each other.
    """
    nodes = ws.save(packed.select("key", "fp").distinct(), "printed")
    first = ws.save(nodes.groupBy("fp").agg(F.min("key").alias("first")), "firsts")
    ends = [first.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")) for end in "ab"]
    pairs = (near_links(ws, first).join(ends[0], "a").join(ends[1], "b").select("first_a", "first_b")
             .unionByName(nodes.join(first, "fp").select(F.col("first").alias("first_a"), F.col("key").alias("first_b"))))
    pairs = ws.save(pairs.where("first_a <> first_b").select(
        F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")).distinct(), "near")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = alike.texts_of(ws, packed, keys)
    return ws.save(alike._confirmed(alike._possible(pairs, texts), texts), "near_links")


def one_of_each(ws: Workspace, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the row of the smallest id of each component of ``alike`` texts.

    What near fingerprints link is compared first: they alone drop no row. Then come the like texts whose fingerprints
    are not near, so that no link of like texts is lost.
    """
    return alike.one_of_each(ws, docs, described_by, near_alike_links)
