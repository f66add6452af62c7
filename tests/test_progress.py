import datetime as dt
import random

import pytest

from twinsieve.operators import progress
from twinsieve.schemas import PROGRESS
from twinsieve.streaming.counters import running_cached, running_ext_counts, running_rates


def tracker(samples, window=30_000, alpha=0.1):
    """Rates after each sample (t, n), kept as one list per log."""
    kept, ema, last, out = [], None, None, []
    for t, n in samples:
        if last and t > last[0] and n >= last[1]:
            rate = (n - last[1]) / ((t - last[0]) / 1000)
            ema = rate if ema is None else alpha * rate + (1 - alpha) * ema
        last = (t, n)
        kept = [s for s in kept if s[0] >= t - window] + [last]
        seconds, gain = (t - kept[0][0]) / 1000, n - kept[0][1]
        out.append((t, gain / seconds if seconds > 0 and gain > 0 else None, ema))
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(1)
    rows = {}
    for key, size in (("hot", 400), ("b", 20), ("single", 1)):
        t, n = 0, 0
        rows[key] = []
        for _ in range(size):
            t += rng.choice([400, 2000, 9000, 40000])
            n += rng.choice([0, 1, 5, 30, -10])
            rows[key].append((t, n))
    return rows


def test_rates_follow_the_serial_tracker(spark, log, monkeypatch):
    df = spark.createDataFrame([(k, t, n, 10_000) for k, rows in log.items() for t, n in rows],
                               "k string, t_ms bigint, n bigint, total bigint").repartition(3)
    want = {(k, t): (r, e) for k, rows in log.items() for t, r, e in tracker(rows)}
    for r in progress.with_eta(progress.trailing_rate(df, "k")).collect():
        rate = want[r.k, r.t_ms][0]
        assert r.rate == (None if rate is None else pytest.approx(rate))
        assert r.eta_s == (None if rate is None or r.n <= 0 else pytest.approx((10_000 - r.n) / rate))
    monkeypatch.setattr(progress, "CHUNK_SAMPLES", 7)
    for chunk in (50_000, 10**9, None):
        rows = progress.ema_rate(df, "k", chunk_ms=chunk).collect()
        assert len(rows) == len(want)
        for r in rows:
            ema = want[r.k, r.t_ms][1]
            assert r.ema == (None if ema is None else pytest.approx(ema))


def test_share(spark):
    df = spark.createDataFrame([(1, 4), (0, 0)], "n bigint, total bigint")
    assert [r.share_pct for r in progress.with_share(df).collect()] == [25.0, 0.0]


def event(scan, second, phase="hashing", current=0, path="", cached=None, deltas=None):
    when = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
    return (scan, when, phase, current, 100, path, cached, deltas)


EVENTS = [event("s", 0, "walking"), event("s", 1, current=1, path="/a/x.JPG"),
          event("s", 2, current=200, path="/a/y.png", cached=199, deltas={"jpg": 150, "": 49}),
          event("s", 3, current=201, path="/a/z", cached=150), event("t", 1, current=1, path="/q.mp4"),
          event("s", 4, "done")]


def test_counters_of_a_batch(spark):
    df = spark.createDataFrame(EVENTS, PROGRESS)
    got = sorted(tuple(r) for r in running_ext_counts(df).collect())
    assert got == [("s", "(none)", 50), ("s", ".jpg", 151), ("t", ".mp4", 1)]
    assert sorted(tuple(r) for r in running_cached(df).collect()) == [("s", 201, 199), ("t", 1, 0)]


def run(spark, tmp_path, build, mode):
    folder = tmp_path / "in"
    frames = [EVENTS[:3], EVENTS[3:]]
    out = {}
    query = None
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = build(spark.readStream.schema(PROGRESS).parquet(str(folder)))

        def keep(batch, _):
            for r in batch.collect():
                out[tuple(r)[:2]] = tuple(r)[2:]

        query = (stream.writeStream.outputMode(mode).foreachBatch(keep)
                 .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start())
        query.awaitTermination()
    return out


def test_counters_of_a_stream(spark, tmp_path):
    out = run(spark, tmp_path, running_ext_counts, "update")
    assert out == {("s", "(none)"): (50,), ("s", ".jpg"): (151,), ("t", ".mp4"): (1,)}


def test_rates_of_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    out = run(spark, tmp_path, running_rates, "append")
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    want = tracker([(base + 1000, 1), (base + 2000, 200), (base + 3000, 201)])
    got = [(t, out["s", t][1], out["s", t][2]) for t, _, _ in want]
    assert got == [(t, r and pytest.approx(r), e and pytest.approx(e)) for t, r, e in want]


def test_trailing_rate_of_a_burst(spark):
    """Many samples in one window, and long gaps; as a plain look back for each sample."""
    rng = random.Random(11)
    times = sorted({rng.randint(0, 5000) for _ in range(1500)} | {rng.randint(0, 10**6) for _ in range(60)} | {0, 30_000, 60_000})
    rows = [("a", t, i * 3 % 997 + i) for i, t in enumerate(times)]
    got = {r.t_ms: r.rate for r in progress.trailing_rate(spark.createDataFrame(rows, "k string, t_ms bigint, n bigint"), "k").collect()}
    for _, t, n in rows:
        first = next(r for r in rows if r[1] >= t - 30_000)
        want = (n - first[2]) / ((t - first[1]) / 1000) if t > first[1] and n > first[2] else None
        assert got[t] == pytest.approx(want) if want is not None else got[t] is None


def test_smoothing_of_a_burst_and_of_long_gaps(spark, monkeypatch):
    """Cuts by count: a burst has many pieces, a sparse log few; blocks, pieces and a null key as the serial tracker."""
    rng = random.Random(12)
    rows, n = [], {}
    for key, times in (("burst", range(3000)), ("sparse", range(0, 10**9, 10**7)), (None, range(0, 900, 3)),
                       ("falls", range(0, 50, 5))):
        n[key] = []
        for i, t in enumerate(times):
            n[key].append((t, 100 - i if key == "falls" else i * 3 + rng.choice([0, 1, 5, -9])))
            rows.append((key, *n[key][-1]))
    monkeypatch.setattr(progress, "BUCKET_MS", 64)
    monkeypatch.setattr(progress, "CHUNK_SAMPLES", 200)
    monkeypatch.setattr(progress, "BLOCK_SAMPLES", 16)
    df = spark.createDataFrame(rows, "k string, t_ms bigint, n bigint").repartition(4)
    sizes = {(r.k, r.piece): r["count"] for r in progress._pieces(progress._samples(df, "k"), "k", None).groupBy("k", "piece").count().collect()}
    assert max(sizes.values()) <= 264 and len([p for k, p in sizes if k == "burst"]) >= 12
    assert len([p for k, p in sizes if k == "sparse"]) == 1
    for alpha in (0.1, 0.97):
        got = {(r.k, r.t_ms): r.ema for r in progress.ema_rate(df, "k", alpha).collect()}
        assert len(got) == len(rows)
        for key, samples in n.items():
            for t, _, ema in tracker(samples, alpha=alpha):
                assert got[key, t] == (None if ema is None else pytest.approx(ema))


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_smoothing_needs_a_share(spark, alpha):
    with pytest.raises(ValueError):
        progress.ema_rate(spark.createDataFrame([], "k string, t_ms bigint, n bigint"), "k", alpha)


def test_smoothing_of_nothing(spark):
    assert progress.ema_rate(spark.createDataFrame([], "k string, t_ms bigint, n bigint"), "k").count() == 0
