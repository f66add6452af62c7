"""Rates of a counter log: ``(key, t_ms, n[, total])``, time in milliseconds.

Rows of one key are cut by time, so that a single long log is spread over
tasks; what a cut needs from before it is carried over exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The trailing window and the smoothing factor.
WINDOW_MS = 30_000
ALPHA = 0.1
#: Length of a bucket of a log; a bucket has at most one sample per instant.
BUCKET_MS = 1 << 16
#: Samples a piece of a log should hold, and at most so many more as a bucket has.
CHUNK_SAMPLES = 1 << 16
#: Samples of a block of a piece, at most.
BLOCK_SAMPLES = 256


def _samples(log: DataFrame, key: str) -> DataFrame:
    """One sample per key and instant: the furthest."""
    extra = [F.max("total").alias("total")] if "total" in log.columns else []
    return log.groupBy(key, "t_ms").agg(F.max("n").alias("n"), *extra)


def trailing_rate(log: DataFrame, key: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Adds ``rate`` per second over the trailing window.

    NULL with a single sample in the window, or without an increase over it.
    """
    samples = _samples(log, key)
    # Each sample looks for the first one at or after the start of its window. Walking back in time, that is the last
    # sample seen, so one sorted pass per bucket of a window's length is enough. The window may end in the next bucket.
    seen = samples.select(key, F.col("t_ms").alias("at"), F.struct("t_ms", "n").alias("sample"),
                          *[F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in samples.columns if c != key])
    bucket = F.floor(F.col("at") / window_ms)
    seen = seen.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    asks = samples.withColumns({"at": F.col("t_ms") - window_ms, "sample": F.lit(None)}).withColumn("bucket", bucket)
    back = (Window.partitionBy(key, "bucket").orderBy(F.desc("at"), F.col("t_ms").isNotNull())
            .rowsBetween(Window.unboundedPreceding, 0))
    first = (seen.unionByName(asks).withColumn("first", F.last("sample", ignorenulls=True).over(back))
             .where(F.col("t_ms").isNotNull()))
    seconds = (F.col("t_ms") - F.col("first.t_ms")) / F.lit(1000.0)
    gain = F.col("n") - F.col("first.n")
    rate = F.when((seconds > 0) & (gain > 0), gain / seconds)
    return first.select(*samples.columns, rate.alias("rate"))


def with_eta(rated: DataFrame) -> DataFrame:
    """Adds ``eta_s``, seconds to go at the trailing rate; NULL without a rate or progress."""
    return rated.withColumn("eta_s", F.when(F.col("rate").isNotNull() & (F.col("n") > 0),
                                            (F.col("total") - F.col("n")) / F.col("rate")))


def with_share(log: DataFrame) -> DataFrame:
    """Adds ``share_pct`` done, 0 for an empty total."""
    return log.withColumn("share_pct", F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100)
                          .otherwise(F.lit(0.0)))


def _pieces(samples: DataFrame, key: str, piece_ms: int | None) -> DataFrame:
    """Adds ``piece``, ascending in time per key, which must not be null.

    Buckets of equal time hold at most ``BUCKET_MS`` samples, one per instant, however dense a log is. Buckets that follow
    each other make up a piece until it has ``CHUNK_SAMPLES``, so a sparse log has few pieces and a burst has many.
    """
    if piece_ms is not None:
        return samples.withColumn("piece", F.floor(F.col("t_ms") / piece_ms))
    samples = samples.withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS))
    earlier = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (samples.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("c"))
              .select(key, "bucket", F.floor(F.coalesce(F.sum("c").over(earlier), F.lit(0)) / CHUNK_SAMPLES).alias("piece")))
    return samples.join(pieces, [key, "bucket"]).drop("bucket")


def _rates(samples: DataFrame, key: str) -> DataFrame:
    """Adds ``instant``, the rate of each sample against the one before, which may end an earlier piece."""
    ends = (samples.groupBy(key, "piece").agg(F.max(F.struct("t_ms", "n")).alias("end"))
            .withColumn("before", F.lag("end").over(Window.partitionBy(key).orderBy("piece"))).drop("end"))
    within = Window.partitionBy(key, "piece").orderBy("t_ms")
    previous = F.coalesce(F.lag(F.struct("t_ms", "n")).over(within), F.col("before"))
    seconds = (F.col("t_ms") - F.col("p.t_ms")) / F.lit(1000.0)
    return (samples.join(ends, [key, "piece"]).withColumn("p", previous)
            .select(key, "piece", "t_ms", "n",
                    F.when(F.col("n") >= F.col("p.n"), (F.col("n") - F.col("p.n")) / seconds).alias("instant")))


#: What a run of samples does to the average before it, how many rates it has, and the first of them.
MAP = ("keep", "gain", "rates", "first")


def _composed(maps: DataFrame, by: list[str], at: str) -> DataFrame:
    """``all``, the composition of a line of maps, and ``before``, for each of them that of all earlier ones.

    Lines are short: blocks of a piece, pieces of a key.
    """
    nothing = F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("gain"), F.lit(0).cast("bigint").alias("rates"),
                       F.lit(None).cast("double").alias("first"))
    kind = "struct<keep:double,gain:double,rates:bigint,first:double>"
    start = F.struct(nothing.alias("all"), F.array().cast(f"array<struct<at:bigint,map:{kind}>>").alias("before"))

    def advance(acc: Column, m: Column) -> Column:
        both = F.struct((acc.all.keep * m.keep).alias("keep"), (m.keep * acc.all.gain + m.gain).alias("gain"),
                        (acc.all.rates + m.rates).alias("rates"), F.coalesce(acc.all.first, m["first"]).alias("first"))
        return F.struct(both.alias("all"),
                        F.array_append(acc.before, F.struct(m.at.alias("at"), acc.all.alias("map"))).alias("before"))

    line = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), *MAP)))
    return (maps.groupBy(*by).agg(line.alias("line"))
            .select(*by, F.aggregate("line", start, advance).alias("r")).select(*by, "r.all", "r.before"))


def ema_rate(log: DataFrame, key: str, alpha: float = ALPHA, chunk_ms: int | None = None) -> DataFrame:
    """``(key, t_ms, n, instant, ema)``: exponentially smoothed rate per second.

    The first rate starts the average. Samples that fall back in ``n`` have no
    rate and leave it unchanged; so does the first sample.

    A run of samples maps the average before it to ``keep * average + gain``, and such maps compose. They are summed up
    over blocks of some samples, composed along the blocks of a piece and the pieces of a key, and what comes before is
    then applied to each sample by itself. ``chunk_ms`` sets the length of a piece in time.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    left = F.lit(1 - alpha)
    # Powers of what is left of a rate after a block of rates must stay far from a double's limits.
    size = max(1, min(BLOCK_SAMPLES, int(400 / -math.log(1 - alpha))))
    samples = _samples(log, key).select(F.struct(key).alias("of"), "t_ms", "n")  # never null
    in_piece = Window.partitionBy("of", "piece").orderBy("t_ms")
    to_here = Window.partitionBy("of", "piece", "block").orderBy("t_ms").rowsBetween(Window.unboundedPreceding, 0)
    rates = (_rates(_pieces(samples, "of", chunk_ms), "of")
             .withColumn("block", F.floor((F.row_number().over(in_piece) - 1) / size))
             .withColumn("rates", F.count("instant").over(to_here))
             .withColumn("gain", F.coalesce(F.sum(alpha * F.col("instant") * F.pow(left, -F.col("rates"))).over(to_here), F.lit(0.0))
                         * F.pow(left, F.col("rates"))))

    first = F.min_by("instant", F.when(F.col("instant").isNotNull(), F.col("t_ms"))).alias("first")
    blocks = (rates.groupBy("of", "piece", "block").agg(F.max_by(F.struct("rates", "gain"), "t_ms").alias("m"), first)
              .select("of", "piece", "block", F.pow(left, F.col("m.rates")).alias("keep"), "m.gain", "m.rates", "first"))
    pieces = _composed(blocks, ["of", "piece"], "block")
    # Starting the average at a key's first rate makes the first step like all others.
    starts = (_composed(pieces.select("of", "piece", "all.*"), ["of"], "piece")
              .select("of", F.col("all.first").alias("base"), F.explode("before").alias("b"))
              .select("of", F.col("b.at").alias("piece"), F.col("b.map.rates").alias("ago"),
                      (F.col("b.map.keep") * F.col("base") + F.col("b.map.gain")).alias("e")))
    known = rates.join(pieces.select("of", "piece", "before").join(starts, ["of", "piece"]), ["of", "piece"])
    block = F.get("before", F.col("block").cast("int")).map
    average = F.pow(left, F.col("rates")) * (block.keep * F.col("e") + block.gain) + F.col("gain")
    ema = F.when(F.col("ago") + block.rates + F.col("rates") > 0, average)
    return known.select(f"of.{key}", "t_ms", "n", "instant", ema.alias("ema"))
