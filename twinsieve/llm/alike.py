"""Texts that share most of their five-word shingles: candidates by minima of hashes, links by the exact share.

Two texts are alike if they have at least four fifths of their distinct shingles in common (common by all of both).

1. Texts with equal sets of shingles fold to one node, so copies cost one row from there on.
2. A node has ``BANDS`` keys, each of ``BAND_ROWS`` minima of its shingles' hashes. Nodes that share a key are
   candidates. A pair with 0.8 in common shares none with a chance of (1 - 0.8 ** 4) ** 32, about 5 in 100 million,
   and pairs with more in common with less; the number of keys does not grow with the text.
3. The nodes of a key are compared with one of them, the centre: the one that meets most others under all its keys. Small
   keys whose nodes are then still apart are compared pair by pair.
4. Larger ones are not. What distinguishes a node from its key's common text (the centre's shingles, corrected by what
   most nodes of the key have or lack) are its differences, few and mostly its own. With a and b differences, n and m
   shingles, two nodes are alike only if a + b - 2 * common <= (n + m) / 9, so they have (a + b - (n + m) / 9) / 2
   differences in common. All nodes are compared with the second centre, that of the least a - n / 9. A pair that
   needs nothing in common is then connected by it. Any other pair must share one of the first differences of each,
   in an order that puts what is added before what is missing, with enough differences after it. This is exact, and groups that share much but are not
   alike have next to no such pairs.

Before their texts are read, pairs whose sketches differ in more bits than like texts' can are left out. A bit of a sketch
is the parity of the number of shingles with that hash, so sketches differ in no more bits than sets in shingles: this
is exact too.

No key is capped, and only pairs that are alike are linked.

A text of one to four words is one shingle. Null and empty texts have none and are alike. Words are split at ASCII white
space and ASCII letters count in lower case, as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.components import connected_components
from twinsieve.llm.rows import struct_udf
from twinsieve.plans.workspace import Workspace

WORDS = 5
BANDS, BAND_ROWS = 32, 4
#: Nodes of a key that are compared pair by pair, at most.
SMALL = 16
#: Bits of a sketch.
SKETCH_BITS = 1024
#: Centres of a group of like nodes, by band: flips of the order of keys.
CENTRES = (0, 0x5555555555555555, 0x3333333333333333, 0x6996966969969669)
_RANDOM = np.random.default_rng(5)
FLIPS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), 41)] if words else [], np.uint64)
    hashes = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    out = hashes[:n].copy()
    for k in range(1, WORDS):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k:k + n]
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out ^= out >> np.uint64(33)
        out *= np.uint64(factor)
    return np.unique(out ^ out >> np.uint64(33))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, as signed 64-bit integers."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.array([((hashes ^ flip) * factor).min() for flip, factor in zip(FLIPS, FACTORS)], np.uint64)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))],
                    np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of the numbers of hashes, by their last bits, as signed 64-bit integers."""
    counts = np.bincount((hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def described(texts: list) -> dict[str, list]:
    out: dict[str, list] = {"key": [], "n": [], "bands": [], "sketch": []}
    for text in texts:
        hashes = shingles(text)
        out["key"].append(int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 43)).view(np.int64)))
        out["n"].append(len(hashes))
        out["bands"].append(band_keys(hashes))
        out["sketch"].append(sketch(hashes))
    return out


DESCRIBED = "key bigint, n bigint, bands array<bigint>, sketch array<bigint>"


def described_by(text: Column | str) -> Column:
    """Struct of the ``key`` of a text's set of shingles, their number ``n``, the keys ``bands`` of candidates and the ``sketch``."""
    return struct_udf(described, DESCRIBED)(text)


def are_alike(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def alike(a: Column | str, b: Column | str) -> Column:
    """Whether two texts are alike, by all of their shingles."""

    def apply(one: pa.Array, other: pa.Array) -> pa.Array:
        of = lru_cache(maxsize=64)(shingles)
        return pa.array([are_alike(of(x.as_py()), of(y.as_py())) for x, y in zip(one, other)], pa.bool_())

    return F.arrow_udf(apply, "boolean")(a, b)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are alike."""
    both = (pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.where(alike("text_a", "text_b")).select("a", "b")


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those that cannot be alike by their sizes or sketches."""
    for end in "ab":
        pairs = pairs.join(texts.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"),
                                        F.col("sketch").alias(f"sketch_{end}")), end)
    bits = F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    return pairs.where((5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
                       & (9 * differing <= F.col("n_a") + F.col("n_b"))).select("a", "b")


def differences(text: Column | str, centre: Column | str) -> Column:
    """Struct of the shingles that a text has and the centre's text lacks (``added``), and of the reverse (``missing``)."""

    def apply(one: pa.Array, other: pa.Array) -> pa.Array:
        of = lru_cache(maxsize=64)(shingles)
        both = [(of(x.as_py()), of(y.as_py())) for x, y in zip(one, other)]
        return pa.StructArray.from_arrays(
            [pa.array([np.setdiff1d(*order, assume_unique=True).view(np.int64) for order in sides], pa.list_(pa.int64()))
             for sides in (both, [(y, x) for x, y in both])], names=["added", "missing"])

    return F.arrow_udf(apply, "added array<bigint>, missing array<bigint>")(text, centre)


def _pairs_of(nodes: DataFrame, other: str) -> DataFrame:
    """Distinct pairs (a, b) of each node and the node in the column ``other``."""
    least, most = F.least("key", other).alias("a"), F.greatest("key", other).alias("b")
    return nodes.where(F.col("key") != F.col(other)).select(least, most).distinct()


def _apart(ws: Workspace, nodes: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """The rows of ``nodes`` in buckets whose nodes lie in several components, with their ``root``."""
    roots = ws.save(connected_components(ws, links), "roots")
    placed = nodes.drop("root").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return ws.save(placed.join(mixed.select("bucket"), "bucket"), label)


def _near_sizes(x: str, y: str) -> Column:
    return 5 * F.least(f"{x}.n", f"{y}.n") >= 4 * F.greatest(f"{x}.n", f"{y}.n")


def small_pairs(apart: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes of small buckets that lie in different components."""
    few = apart.where(F.col("nodes") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    return (x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root")) & _near_sizes("x", "y"))
            .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct())


def from_common_text(ws: Workspace, large: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``large`` with ``added`` and ``missing``, their differences from the common text of their bucket.

    ``slack`` is nine times their number less the node's shingles; ``second`` and ``least`` are the node of the least
    slack in the bucket, and that slack.
    """
    own, centre = texts.select("key", "text"), texts.select(F.col("key").alias("centre"), F.col("text").alias("centre_text"))
    first = ws.save(large.join(own, "key").join(centre, "centre").select(
        "bucket", "key", "n", "nodes", differences("text", "centre_text").alias("d")).select(
        "bucket", "key", "n", "nodes", "d.*"), "differences")
    each = first.select("bucket", "nodes", F.explode("added").alias("shingle"), F.lit(True).alias("more")).unionByName(
        first.select("bucket", "nodes", F.explode("missing").alias("shingle"), F.lit(False).alias("more")))
    most = (each.groupBy("bucket", "shingle", "more").agg(F.count(F.lit(1)).alias("n"), F.first("nodes").alias("nodes"))
            .where(2 * F.col("n") > F.col("nodes")))
    none = F.array().cast("array<bigint>")
    held = most.groupBy("bucket").agg(F.collect_list(F.when(F.col("more"), F.col("shingle"))).alias("more"),
                                      F.collect_list(F.when(~F.col("more"), F.col("shingle"))).alias("less"))
    corrected = first.join(held, "bucket", "left").withColumns(
        {"more": F.coalesce("more", none), "less": F.coalesce("less", none)})
    added = F.concat(F.array_except("added", "more"), F.array_except("less", "missing"))
    missing = F.concat(F.array_except("missing", "less"), F.array_except("more", "added"))
    found = corrected.select("bucket", "key", "n", "nodes", added.alias("added"), missing.alias("missing"))
    slack = 9 * (F.size("added") + F.size("missing")) - F.col("n")
    found = ws.save(found.withColumn("slack", slack), "corrected")
    second = found.groupBy("bucket").agg(F.min(F.struct("slack", "key")).alias("s")).select(
        "bucket", F.col("s.key").alias("second"), F.col("s.slack").alias("least"))
    return found.join(second, "bucket")


def differing_pairs(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share one of each one's first differences.

    Of two such nodes one is far: not in the component of the second centre. All pairs that are alike are among them.
    """
    second = apart.where(F.col("key") == F.col("second")).select("bucket", F.col("root").alias("main"))
    size = F.size("added") + F.size("missing")
    far = F.col("root") != F.col("main")
    # The least number of differences that a node has in common with any that it is alike to: see the module's text.
    with_any = F.greatest(F.ceil((F.col("slack") + F.col("least")) / 18), F.ceil(size - F.col("n") / 4))
    with_far = F.ceil((F.col("slack") - F.col("least")) / 18)
    common = F.greatest(F.lit(1), F.when(far, with_any).otherwise(with_far)).cast("int")
    ordered = F.concat(F.sort_array("added"), F.sort_array("missing"))
    first = (apart.join(second, "bucket")
             .select("bucket", "key", "n", "root", far.alias("far"), size.alias("size"), F.posexplode(
                 F.slice(ordered, F.lit(1), F.greatest(F.lit(0), size - common + 1))).alias("at", "shingle")))
    x, y = first.where("far").alias("x"), first.alias("y")
    near = 9 * F.abs(F.col("x.size") - F.col("y.size")) <= F.col("x.n") + F.col("y.n")
    # From their first common difference on, both must have as many left as they need.
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    enough = 18 * left >= 9 * (F.col("x.size") + F.col("y.size")) - F.col("x.n") - F.col("y.n")
    return (x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.shingle") == F.col("y.shingle"))
                   & (F.col("x.root") != F.col("y.root")) & _near_sizes("x", "y") & near & enough)
            .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct())


def _still_apart(ws: Workspace, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``pairs`` that the links ``known`` do not connect."""
    roots = ws.save(connected_components(ws, known), "known_roots")
    for end in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))).select("a", "b")


def texts_of(ws: Workspace, packed: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``n``, ``sketch`` and a text of each of ``keys``."""
    return ws.save(packed.join(keys, "key", "left_semi").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("n", "sketch", "text")]), "texts")


def alike_links(ws: Workspace, packed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of like nodes that connect all nodes which chains of like ones connect.

    ``packed`` has a row (key, n, bands, sketch, text) per row of the documents. ``known`` are links of like nodes found before;
    they are among the result, and what they connect is not compared with its centres again.
    """
    nodes = packed.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    members = ws.save(nodes.select("key", "n", F.posexplode("bands").alias("band", "bucket")), "members")
    met = members.groupBy("bucket").agg(F.count("key").alias("nodes")).where("nodes > 1")
    together = ws.save(members.join(met, "bucket"), "together")
    flip = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in CENTRES]), F.col("band") % len(CENTRES) + 1)
    rank = F.struct(F.col("met"), F.col("key").bitwiseXOR(flip))
    weights = together.groupBy("key").agg(F.sum("nodes").alias("met"))
    centres = together.join(weights, "key").groupBy("bucket").agg(F.max_by("key", rank).alias("centre"))
    together = ws.save(together.join(centres, "bucket").select("bucket", "key", "n", "nodes", "centre"), "centred")
    texts = texts_of(ws, packed, together.select("key").distinct())
    pairs = _pairs_of(together, "centre")
    tried = ws.save(_possible(pairs if known is None else _still_apart(ws, pairs, known), texts), "tried")
    links = ws.save(_confirmed(tried, texts), "links")
    links = links if known is None else links.unionByName(known)
    apart = _apart(ws, together, links, "apart")
    few = ws.save(_possible(small_pairs(apart).join(tried, ["a", "b"], "left_anti"), texts), "few")
    found = [links, ws.save(_confirmed(few, texts), "small_links")]
    large = apart.where(F.col("nodes") > SMALL)
    if large.isEmpty():
        return links.unionByName(found[1])
    described = ws.save(from_common_text(ws, large, texts), "described")
    again = ws.save(_possible(_pairs_of(described, "second").join(tried, ["a", "b"], "left_anti"), texts), "tried_again")
    found.append(ws.save(_confirmed(again, texts), "second_links"))
    links = reduce(DataFrame.unionByName, found)
    apart = _apart(ws, described, links, "still_apart")
    done = tried.unionByName(again)
    rest = ws.save(_possible(differing_pairs(apart).join(done, ["a", "b"], "left_anti"), texts), "differing")
    return links.unionByName(ws.save(_confirmed(rest, texts), "last_links"))


def alike_roots(ws: Workspace, packed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``key`` and ``root`` of the nodes that have like ones; all others are their own root."""
    return ws.save(connected_components(ws, alike_links(ws, packed, known)), "alike").select(
        F.col("node").alias("key"), "root")


def one_of_each(ws: Workspace, docs: DataFrame, describe: Callable[[str], Column] = described_by,
                known_links: Callable[[Workspace, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the row of the smallest id of each component of like texts.

    Of several rows with that id one stays, and of a component without any id one row. ``describe`` may give more fields
    than ``described_by``; from them and the texts, ``known_links`` finds links of like nodes beforehand.
    """
    packed = ws.save(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                                 describe("text").alias("d")).select("row", "doc_id", "d.*"), "packed")
    texts = packed.withColumn("text", F.col("row.text")).drop("row", "doc_id")
    roots = alike_roots(ws, texts, known_links and known_links(ws, texts))
    rooted = (packed.groupBy("key").agg(F.min("doc_id").alias("first_id")).join(roots, "key", "left")
              .select("key", "first_id", F.coalesce("root", "key").alias("root")))
    rooted = ws.save(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    first = (packed.select("row", "doc_id", "key").join(rooted.join(ids, "root").select("key", "root", "component_id"), "key")
             .where(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"]))
    return first.select("row.*")
