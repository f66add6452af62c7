"""Duplicate groups by name and size, by content, and by similarity.

Groups are kept in long form, one row per member: ``(group_id, duplicate_type,
max_distance, path, size, media_type)``. ``group_table`` gives one row per
group. Identifiers derive from the key of a group and do not change between
runs; members sort by ``order_key(path)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.functions import fingerprints as fp
from twinsieve.functions.paths import name_key, order_key
from twinsieve.operators.spread import SMALL_STAR, frame_star_spread, small_spread, star_spread
from twinsieve.operators.stars import Links, greedy_stars
from twinsieve.options import check_mode, check_threshold
from twinsieve.plans.skew import HOT_KEY_ROWS, SizedKeys
from twinsieve.plans.workspace import Workspace

MEMBER_COLUMNS = ["group_id", "duplicate_type", "max_distance", "path", "size", "media_type"]


def first_per_path(records: DataFrame, *order: str) -> DataFrame:
    """One row per path, the first by ``order`` (by all columns without one)."""
    rest = [c for c in records.columns if c != "path"]
    by = F.struct(*(order or sorted(rest)))
    return (records.groupBy("path").agg(F.min_by(F.struct(*rest), by).alias("row"))
            .select("path", "row.*").select(*records.columns))


def _group_id(kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]), 256)


def _members(rows: DataFrame, kind: str) -> DataFrame:
    distance = F.col("max_distance") if "max_distance" in rows.columns else F.lit(None)
    return rows.select("group_id", F.lit(kind).alias("duplicate_type"),
                       distance.cast("int").alias("max_distance"), "path", "size", "media_type")


def repeated_keys(ws: Workspace, rows: DataFrame, keys: Sequence[str], kind: str) -> SizedKeys:
    """Keys held by two or more rows, with the count and the id of the group."""
    counted = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
               .withColumn("group_id", _group_id(kind, *[F.col(k) for k in keys])))
    return SizedKeys(ws, counted, list(keys), label=kind)


def _named(records: DataFrame) -> DataFrame:
    return records.withColumn("name", name_key("path"))


def filename_members(ws: Workspace, records: DataFrame) -> DataFrame:
    """Rows that share the lower-cased file name and the size with another."""
    rows = _named(records).select("name", "size", "path", "media_type")
    return _members(repeated_keys(ws, rows, ["name", "size"], "filename").join(rows), "filename")


def exact_members(ws: Workspace, records: DataFrame) -> DataFrame:
    """Rows that share a content digest with another; no digest, no group."""
    rows = records.where(F.col("exact_hash").isNotNull()).select("exact_hash", "path", "size", "media_type")
    return _members(repeated_keys(ws, rows, ["exact_hash"], "exact").join(rows), "exact")


@dataclass(frozen=True)
class Stars:
    """Clustered nodes ``(key, rk, n, owner)`` and their groups.

    A node is one distinct fingerprint text, ``n`` the rows that hold it, of
    which ``n_hot`` nodes have very many. Groups have ``(owner, group_id,
    max_distance, n, nodes)``, those of a single row left out.
    """

    nodes: DataFrame
    groups: DataFrame
    n_hot: int


def canonical(phash: Column | str) -> Column:
    """Node key of a fingerprint text: 16 hex digits, or joined frames as they are."""
    phash = F.col(phash) if isinstance(phash, str) else phash
    return F.when(fp.is_multi(phash), phash).otherwise(fp.to_hex(fp.parse_hex(phash)))


def find_stars(ws: Workspace, rows: DataFrame, threshold: int) -> Stars:
    """Cluster ``rows(phash, ord)``; ``ord`` is unique and gives the order.

    Copies of a fingerprint always share a star, so each is one node, placed
    where its first row is. Texts that do not parse match nothing, not even
    their copies. Single fingerprints and joined frames are never compared.
    """
    check_threshold(threshold)
    nodes = (rows.select(canonical("phash").alias("key"), "ord").where(F.col("key").isNotNull())
             .groupBy("key").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
             .withColumn("frames", fp.split_frames("key")).where(F.size("frames") > 0))
    if isinstance(nodes.schema["ord"].dataType, T.IntegralType):
        nodes = nodes.withColumn("rk", F.col("ord").cast("bigint"))
    else:
        nodes = nodes.orderBy("ord").withColumn("rk", F.monotonically_increasing_id())
    nodes, seen = ws.save_counted(nodes.select("key", "frames", "rk", "n"), "nodes",
                                  multi=F.count_if(fp.is_multi("key")),
                                  hot=F.count_if(F.col("n") > HOT_KEY_ROWS))
    n_multi, n_single = seen["multi"], seen["n"] - seen["multi"]
    pools = []
    if n_single or not n_multi:
        single = nodes.where(~fp.is_multi("key")).select("rk", F.col("frames")[0].alias("fp"), "n")
        if threshold == 0:
            starred = single.withColumn("owner", F.col("rk"))
        else:
            starred = greedy_stars(Links(ws, single, n_single, True), threshold)
        groups = _star_groups(ws, starred.withColumnRenamed("fp", "x"), fp.to_hex("x"), star_spread)
        pools.append((starred.select(fp.to_hex("fp").alias("key"), "rk", "n", "owner"), groups))
    if n_multi:
        multi = nodes.where(fp.is_multi("key"))
        links, seen_links = ws.save_counted(
            multi.select("rk", F.explode(F.array_distinct("frames")).alias("fp")), "links")
        owners = greedy_stars(Links(ws, links, seen_links["n"], False), threshold)
        starred = ws.save(multi.join(owners, "rk").withColumnRenamed("frames", "x"), "stars")
        groups = _star_groups(ws, starred, F.col("key"), frame_star_spread)
        pools.append((starred.select("key", "rk", "n", "owner"), groups))
    return Stars(reduce(DataFrame.unionByName, [nodes for nodes, _ in pools]),
                 reduce(DataFrame.unionByName, [groups for _, groups in pools]), seen["hot"] or 0)


def _star_groups(ws: Workspace, starred: DataFrame, text: Column, spread) -> DataFrame:
    """Groups of ``starred(rk, x, n, owner)`` with their largest distance."""
    distance = fp.hamming("x", "y") if spread is star_spread else fp.min_frame_distance("x", "y")
    name = F.max(F.when(F.col("rk") == F.col("owner"), F.col("key" if "key" in starred.columns else "x")))
    counted = (starred.groupBy("owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("nodes"),
                                            name.alias("key" if "key" in starred.columns else "x"))
               .where("n >= 2").withColumn("group_id", _group_id("perceptual", text)))
    near = small_spread(starred.select("owner", "rk", "x"), distance)
    groups, seen = ws.save_counted(
        counted.join(near, "owner", "left")
        .select("owner", "group_id", F.coalesce("max_distance", F.lit(0)).alias("max_distance"), "n", "nodes"),
        "groups", large=F.count_if(F.col("nodes") > SMALL_STAR))
    if not seen["large"]:
        return groups
    large = SizedKeys(ws, groups.where(F.col("nodes") > SMALL_STAR).select("owner", "nodes"), ["owner"], "nodes")
    wide = spread(ws, ws.save(large.join(starred.select("owner", "rk", "x")), "large"))
    return ws.save(groups.join(wide.withColumnRenamed("max_distance", "wide"), "owner", "left")
                   .withColumn("max_distance", F.coalesce("wide", "max_distance")).drop("wide"), "groups")


def perceptual_members(ws: Workspace, records: DataFrame, threshold: int) -> DataFrame:
    """Members of the stars of ``phash``; rows without one are in no group."""
    rows = (records.where(F.col("phash").isNotNull())
            .select("path", "size", "media_type", "phash", canonical("phash").alias("key")))
    stars = find_stars(ws, rows.select("phash", order_key("path").alias("ord")), threshold)
    keys = stars.nodes.select("key", "owner", "n").join(stars.groups.drop("n", "nodes"), "owner")
    sized = SizedKeys(ws, keys.select("key", "n", "group_id", "max_distance"), ["key"], n_hot=stars.n_hot)
    return _members(sized.join(rows.select("key", "path", "size", "media_type")), "perceptual")


def find_members(ws: Workspace, records: DataFrame, mode: str = "both", threshold: int = 8,
                 unique_paths: bool = False) -> DataFrame:
    """Members of all groups of a scan mode.

    ``content`` lists a row under its exact and its perceptual group alike;
    ``both`` looks for those only among rows that no filename group holds.
    Repeated paths count once unless ``unique_paths`` vouches there are none.
    """
    check_mode(mode)
    if not unique_paths:
        records = first_per_path(records)
    plain, compared = _plain_members(ws, records, mode)
    return plain if compared is None else plain.unionByName(perceptual_members(ws, compared, threshold))


def _plain_members(ws: Workspace, records: DataFrame, mode: str) -> tuple[DataFrame, DataFrame | None]:
    """Members of the groups that no threshold changes, and the rows left to compare, if any."""
    if mode == "content":
        return exact_members(ws, records), records
    if mode == "filename":
        return filename_members(ws, records), None
    rows = _named(records)
    keys = repeated_keys(ws, rows.select("name", "size"), ["name", "size"], "filename")
    claimed = _members(keys.join(rows.select("name", "size", "path", "media_type")), "filename")
    # Rows of a repeated key are exactly the claimed paths. What is left is read
    # several times, a few columns each.
    free = ws.save(rows.join(keys.df.select("name", "size"), ["name", "size"], "left_anti")
                   .select("path", "size", "media_type", "exact_hash", "phash"), "free")
    return claimed.unionByName(exact_members(ws, free)), free


def group_table(members: DataFrame) -> DataFrame:
    """One row per group: size, bytes that deleting all but the largest frees, first path."""
    return (members.groupBy("group_id", "duplicate_type", "max_distance")
            .agg(F.count(F.lit(1)).alias("n_files"),
                 (F.sum("size") - F.max("size")).alias("wasted_bytes"),
                 F.min(order_key("path")).alias("first_key"))
            .withColumn("first_path", F.replace("first_key", F.lit("\0"), F.lit("/"))))


def find_duplicates(ws: Workspace, records: DataFrame, mode: str = "both", threshold: int = 8,
                    unique_paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of a scan mode."""
    members = ws.save(find_members(ws, records, mode, threshold, unique_paths), "members")
    return group_table(members), members


def nested_files(members: DataFrame, largest: int) -> DataFrame:
    """Groups of up to ``largest`` files with the files as a sorted array, for display.

    Larger groups keep their row, with ``files`` NULL: page through their members.
    """
    few = members.join(group_table(members).select("group_id", "n_files")
                       .where(F.col("n_files") <= largest), "group_id", "left_semi")
    files = few.groupBy("group_id").agg(F.array_sort(F.collect_list(
        F.struct(order_key("path").alias("ord"), "path", "size", "media_type"))).alias("f"))
    plain = F.transform("f", lambda x: F.struct(x.path.alias("path"), x["size"].alias("size"),
                                                x.media_type.alias("media_type")))
    return group_table(members).join(files.select("group_id", plain.alias("files")), "group_id", "left")


def threshold_sweep(ws: Workspace, records: DataFrame, thresholds: Sequence[int], mode: str = "both",
                    unique_paths: bool = False) -> dict[int, DataFrame]:
    """Members per threshold; names and contents are grouped once for all."""
    check_mode(mode)
    kept = ws.save(records if unique_paths else first_per_path(records), "records")
    plain, compared = _plain_members(ws, kept, mode)
    plain = ws.save(plain, "plain")
    return {t: plain if compared is None else plain.unionByName(perceptual_members(ws, compared, t)) for t in thresholds}
