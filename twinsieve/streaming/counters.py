"""Counters of a scan from its stream of progress events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinsieve.functions.paths import extension
from twinsieve.operators.progress import ALPHA, WINDOW_MS


def _hashing(events: DataFrame) -> DataFrame:
    return events.where(F.col("phase") == "hashing")


def running_ext_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``(scan_id, ext, n)``: from the deltas of an event or else its path."""
    if events.isStreaming:
        events = events.withWatermark("event_time", late)
    own = extension("path")
    single = F.when(F.col("path") != "", F.create_map(own, F.lit(1))).otherwise(
        F.create_map().cast("map<string,int>"))
    counted = _hashing(events).select("scan_id", F.explode(F.coalesce("ext_deltas", single)).alias("raw", "k"))
    ext = F.when(F.col("raw") == "", "(none)").otherwise(F.concat(F.lit("."), "raw"))
    return counted.groupBy("scan_id", ext.alias("ext")).agg(F.sum("k").cast("bigint").alias("n"))


def running_cached(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``(scan_id, current, cached)``: the furthest seen of both."""
    if events.isStreaming:
        events = events.withWatermark("event_time", late)
    return _hashing(events).groupBy("scan_id").agg(
        F.max("current").alias("current"), F.max(F.coalesce("cached", F.lit(0))).alias("cached"))


class _RateTracker(StatefulProcessor):
    """Keeps the trailing samples and the smoothed rate of one scan."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "t_ms bigint, n bigint")
        self.average = handle.getValueState("average", "ema double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).groupby("t_ms", as_index=False).agg({"n": "max", "total": "max"})
        kept = [tuple(s) for s in self.samples.get()]
        ema = self.average.get()[0] if self.average.exists() else None
        out = []
        for t, n, total in new.sort_values("t_ms").itertuples(index=False):
            if kept and t > kept[-1][0] and n >= kept[-1][1]:
                instant = (n - kept[-1][1]) / ((t - kept[-1][0]) / 1000)
                ema = instant if ema is None else ALPHA * instant + (1 - ALPHA) * ema
            kept = [s for s in kept if s[0] >= t - WINDOW_MS] + [(int(t), int(n))]
            seconds, gain = (t - kept[0][0]) / 1000, n - kept[0][1]
            rate = gain / seconds if seconds > 0 and gain > 0 else None
            eta = (total - n) / rate if rate and n > 0 else None
            out.append((key[0], int(t), int(n), rate, ema, eta))
        self.samples.put(kept)
        if ema is not None:
            self.average.update((float(ema),))
        yield pd.DataFrame(out, columns=["scan_id", "t_ms", "n", "rate", "ema", "eta_s"])

    def close(self) -> None:
        pass


def running_rates(events: DataFrame) -> DataFrame:
    """``(scan_id, t_ms, n, rate, ema, eta_s)`` per event of a stream, as ``operators.progress`` gives them.

    Needs the RocksDB state store.
    """
    log = _hashing(events).select("scan_id", F.unix_millis("event_time").alias("t_ms"),
                                  F.col("current").alias("n"), "total")
    return log.groupBy("scan_id").transformWithStateInPandas(
        _RateTracker(), "scan_id string, t_ms bigint, n bigint, rate double, ema double, eta_s double",
        "append", "None")
