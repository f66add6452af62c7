"""Hamming similarity joins over distinct 64-bit fingerprints.

``similar_pairs`` lists the pairs within a threshold. ``lowest_within`` finds,
for each fingerprint, the smallest value among those within the threshold; its
result has one row per fingerprint however many neighbours there are, which is
all that clustering needs.

Both take *distinct* fingerprints: copies are folded by the caller with one
aggregation, so a fingerprint shared by a third of all rows is one row here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.fingerprints import hamming
from twinsieve.plans.bands import ALL_BITS, Bands, Tiles, choose_scheme, signed
from twinsieve.plans.workspace import Workspace

#: Fingerprints up to which a side is broadcast, whatever the scheme.
FEW_ROWS = 2_000
#: Bucket rows (32 bytes each) per task.
TASK_ROWS = 2_000_000
#: Rows (24 bytes each) of other tables that may be broadcast.
BROADCAST_ROWS = 400_000
#: A bucket is hot when it asks for more than the square of this many
#: comparisons, and is several times as large as buckets of its scheme should be.
HOT_ROWS = 8_000
UNEVEN = 4
#: Lowest targets of a hot bucket that are tried first.
LEADERS = 256
#: Times the keys of hot buckets are lengthened before the rest is tiled.
MAX_LEVELS = 3

#: The key comes first, as it tells rows apart where sorts look first.
BUCKET = ["key", "mask"]


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _tile_of(fp: str, count: Column | int) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.pmod(F.xxhash64(fp), count.cast("bigint"))


def _with_keys(ws: Workspace, df: DataFrame, n: int, scheme: Bands | Tiles, probe: bool) -> DataFrame:
    """Repeat rows once per bucket: adds ``mask``, ``top`` and ``key``.

    Input is small next to what it grows to, so it is spread by its output;
    ``n`` is the larger of both sides, for the same partitioning of both.
    """
    parts = n * scheme.copies // TASK_ROWS
    if n > FEW_ROWS:
        df = df.repartition(max(ws.parallelism, parts), "fp")
    if isinstance(scheme, Bands):
        choices = F.array(*[F.struct(_long(signed(m)).alias("mask"), F.lit(top).alias("top"))
                            for m, top in scheme.masks])
        keyed = (df.withColumn("pick", F.explode(choices))
                 .select(*df.columns, "pick.mask", "pick.top",
                         F.col("fp").bitwiseAND(F.col("pick.mask")).alias("key")))
    else:
        own = _tile_of("fp", scheme.count)
        every = F.explode(F.sequence(_long(0), _long(scheme.count - 1)))
        row, column = (own, every) if probe else (every, own)
        keyed = df.select(*df.columns, row.alias("mask"), F.lit(0).alias("top"), column.alias("key"))
    if parts > int(ws.spark.conf.get("spark.sql.shuffle.partitions")):
        keyed = keyed.repartition(parts, *BUCKET)
    return keyed


def _meet(probe: DataFrame, target: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """Equi-join on the bucket. A merge join is the fastest at going through large buckets."""
    target = target.withColumnRenamed("fp", "other")
    return probe.join(F.broadcast(target) if broadcast else target.hint("merge"), keys)


def _hot_limit(scheme: Bands, n: int) -> float:
    return max(HOT_ROWS, UNEVEN * scheme.even_bucket(n))


def _hot_buckets(ws: Workspace, probe: DataFrame, target: DataFrame, limit: float,
                 same: bool) -> tuple[DataFrame, int, int]:
    """(key, mask, larger) of hot buckets, how many there are, the largest side.

    With the ``same`` fingerprints on both sides one is counted.
    """
    if same:
        sizes = (target.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("larger"))
                 .where(F.col("larger") > limit))
    else:
        one, none = _long(1), _long(0)
        sizes = (probe.select(*BUCKET, one.alias("p"), none.alias("t"))
                 .unionByName(target.select(*BUCKET, none.alias("p"), one.alias("t")))
                 .groupBy(*BUCKET).agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
                 .where(F.col("p").cast("double") * F.col("t") > float(limit) ** 2)
                 .select(*BUCKET, F.greatest("p", "t").alias("larger")))
    hot, seen = ws.save_counted(sizes, "hot", largest=F.max("larger"))
    return hot, seen["n"], seen["largest"] or 0


def _in_hot(df: DataFrame, hot: DataFrame, n_hot: int, how: str) -> DataFrame:
    side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    return df.join(side.select(*BUCKET), BUCKET, how)


def _tiled(df: DataFrame, hot: DataFrame, n_hot: int, probe: bool) -> DataFrame:
    """Split hot buckets into tiles of at most about HOT_ROWS; others get tile 0."""
    side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    count = F.coalesce(F.ceil(F.col("larger") / HOT_ROWS), _long(1))
    own = _tile_of("fp", count)
    every = F.explode(F.sequence(_long(0), count - 1))
    row, column = (own, every) if probe else (every, own)
    return (df.join(side, BUCKET, "left")
            .select(*df.columns, row.alias("tile_row"), F.col("larger"))
            .withColumn("tile_column", column).drop("larger"))


TILED = BUCKET + ["tile_row", "tile_column"]


def similar_pairs(ws: Workspace, fps: DataFrame, n: int, threshold: int,
                  scheme: Bands | Tiles | None = None) -> DataFrame:
    """Every unordered pair of distinct ``fp`` within ``threshold``.

    Returns ``(a, b, d)`` with ``a < b``, each pair once: a pair is kept only
    where the bands of the bucket are the first ones on which it agrees.
    """
    if threshold == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"),
                          F.lit(0).alias("d")).where(F.lit(False))
    scheme = scheme or choose_scheme(n, threshold, ws.parallelism)
    left, right = _with_keys(ws, fps, n, scheme, True), _with_keys(ws, fps, n, scheme, False)
    keys = BUCKET
    if isinstance(scheme, Bands) and n > HOT_ROWS:
        hot, n_hot, _ = _hot_buckets(ws, left, right, _hot_limit(scheme, n), same=True)
        if n_hot:
            left, right = _tiled(left, hot, n_hot, True), _tiled(right, hot, n_hot, False)
            keys = TILED
    met = _meet(left, right.drop("top"), keys, n <= FEW_ROWS)
    close = met.where((F.col("fp") < F.col("other")) & (hamming("fp", "other") <= threshold))
    if isinstance(scheme, Bands):
        apart = F.col("fp").bitwiseXOR(F.col("other"))
        agreeing = [F.when((F.lit(i) <= F.col("top")) & (apart.bitwiseAND(_long(signed(b))) == 0), 1)
                    .otherwise(0) for i, b in enumerate(scheme.bands)]
        close = close.where(reduce(lambda x, y: x + y, agreeing) == scheme.need)
    return close.select(F.col("fp").alias("a"), F.col("other").alias("b"),
                        hamming("fp", "other").alias("d"))


def similar_frame_sets(ws: Workspace, frames: DataFrame, threshold: int) -> DataFrame:
    """``(a, b, d)``: pairs of items whose closest frames are within ``threshold``.

    ``frames(item, fp)`` has a row per frame. Frames are compared once per
    distinct fingerprint, however many items share it.
    """
    frames = ws.save(frames.select("item", "fp").distinct(), "frames")
    fps, seen = ws.save_counted(frames.select("fp").distinct(), "fps")
    near = similar_pairs(ws, fps, seen["n"], threshold)
    both = (near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
            .unionByName(fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"), F.lit(0).alias("d"))))
    left = frames.select(F.col("fp").alias("a"), F.col("item").alias("item_a"))
    right = frames.select(F.col("fp").alias("b"), F.col("item").alias("item_b"))
    return (both.join(left, "a").join(right, "b").where("item_a < item_b")
            .groupBy(F.col("item_a").alias("a"), F.col("item_b").alias("b")).agg(F.min("d").alias("d")))


def _lowest(probe: DataFrame, target: DataFrame, threshold: int, keys: list[str] = BUCKET,
            by: tuple[str, ...] = ("fp",), broadcast: bool = False) -> DataFrame:
    met = _meet(probe.drop("top"), target.drop("top"), keys, broadcast)
    if "bound" in probe.columns:
        met = met.where("val < bound")
    return (met.where(hamming("fp", "other") <= threshold)
            .groupBy(*by).agg(F.min("val").alias("low")))


def lowest_within(ws: Workspace, probe: DataFrame, target: DataFrame, n_probe: int, n_target: int,
                  threshold: int, scheme: Bands | Tiles | None = None, same: bool = False) -> DataFrame:
    """Per probe ``fp`` the smallest ``val`` of the targets within ``threshold``.

    ``probe(fp[, bound])`` and ``target(fp, val)`` hold distinct fingerprints;
    only values below the bound of a probe count. Returns ``(fp, low)``; probes
    without a target in reach are absent. A pair may meet in several buckets,
    which a minimum does not mind. ``same`` says that both sides hold the same
    fingerprints.

    Hot buckets are taken apart, exactly: most rows of a dense one are answered
    by its lowest few targets, tried first; what remains gets longer keys
    from the bits not yet fixed, and in the end tiles.
    """
    probe, target = probe.select(*[c for c in ("fp", "bound") if c in probe.columns]), target.select("fp", "val")
    if threshold == 0:
        met = probe.join(target, "fp")
        return (met.where("val < bound") if "bound" in probe.columns else met).select(
            "fp", F.col("val").alias("low"))
    n = max(n_probe, n_target)
    scheme = scheme or choose_scheme(n, threshold, ws.parallelism)
    p, t = _with_keys(ws, probe, n, scheme, True), _with_keys(ws, target, n, scheme, False)
    if isinstance(scheme, Tiles) or min(n_probe, n_target) * n <= HOT_ROWS**2:
        return _lowest(p, t, threshold, broadcast=n <= FEW_ROWS)

    parts = []
    p, t = p.drop("top"), t.drop("top")
    for level in range(MAX_LEVELS + 1):
        hot, n_hot, largest = _hot_buckets(ws, p, t, _hot_limit(scheme, n) if level == 0 else HOT_ROWS,
                                           same and level == 0)
        if not n_hot:
            parts.append(_lowest(p, t, threshold))
            break
        parts.append(_lowest(_in_hot(p, hot, n_hot, "left_anti"), _in_hot(t, hot, n_hot, "left_anti"), threshold))
        p, t = _in_hot(p, hot, n_hot, "left_semi"), _in_hot(t, hot, n_hot, "left_semi")

        first = F.row_number().over(Window.partitionBy(*BUCKET).orderBy("val", "fp"))
        leaders = t.withColumn("nth", first).where(F.col("nth") <= LEADERS).drop("nth")
        # Broadcast, if small enough, so that a hot bucket is not gathered in one task.
        found = ws.save(_lowest(p, leaders, threshold, by=(*BUCKET, "fp"),
                                broadcast=n_hot * LEADERS <= BROADCAST_ROWS), "led")
        parts.append(found.select("fp", "low"))
        p, left = ws.save_counted(p.join(found, [*BUCKET, "fp"], "left_anti"), "unled")
        if not left["n"]:
            break

        wider = _wider_masks(ws, p, threshold, largest) if level < MAX_LEVELS else None
        if wider is None:
            parts.append(_lowest(_tiled(p, hot, n_hot, True), _tiled(t, hot, n_hot, False), threshold, keys=TILED))
            break
        p = ws.save(_rekey(p, wider), "wider")
        t = ws.save(_rekey(t, wider), "wider")
    return (reduce(DataFrame.unionByName, parts)
            .groupBy("fp").agg(F.min("low").alias("low")))


def _wider_masks(ws: Workspace, rows: DataFrame, threshold: int, largest: int) -> DataFrame | None:
    """(mask, longer): masks that also fix some of the bits ``mask`` leaves free.

    Rows of a bucket agree on its mask, so the whole distance lies in the free
    bits and the same pigeonhole applies to them. The masks come from the
    scheme, so their number is bounded by it, not by the data.
    """
    out = []
    for (mask,) in rows.select("mask").distinct().collect():
        free = [b for b in ALL_BITS if not mask >> b & 1]
        scheme = choose_scheme(largest, threshold, ws.parallelism, free)
        if isinstance(scheme, Tiles) or len(free) <= threshold:
            return None
        out += [(mask, signed(mask % 2**64 | m)) for m, _ in scheme.masks]
    if len(out) > BROADCAST_ROWS:
        return None
    return ws.spark.createDataFrame(out, "mask bigint, longer bigint")


def _rekey(rows: DataFrame, wider: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in BUCKET]
    return (rows.join(F.broadcast(wider), "mask")
            .select(F.col("longer").alias("mask"), F.col("fp").bitwiseAND(F.col("longer")).alias("key"),
                    *rest).distinct())
