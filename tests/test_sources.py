import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import png, solid, striped
from twinsieve.functions.fingerprints import parse_hex, to_hex
from twinsieve.options import ScanOptions
from twinsieve.plans import scan as scan_plan
from twinsieve.plans.scan import fingerprint, image_areas, scan
from twinsieve.plans.workspace import Workspace
from twinsieve.schemas import FILES, FRAMES
from twinsieve.sources import opening, snapshot
from twinsieve.sources.catalog import keep_media, list_media
from twinsieve.sources.digests import digest_paths
from twinsieve.sources.frames import sampled_frames, video_fingerprints
from twinsieve.sources.images import image_fingerprints
from twinsieve.sources.snapshot import Snapshot, split_by_store, store_stats
from twinsieve.streaming.ingest import ingest_files, regular_folders

STORED = "path string, size bigint, mtime bigint, media_type string, exact_hash string, phash string, fp_profile string"


def put(folder, name, data, mtime=None):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)
    if mtime:
        os.utime(target, (mtime, mtime))
    return str(target)


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def test_catalog(spark, tmp_path):
    put(tmp_path, "harbour.jpg", b"fake")
    put(tmp_path, "sub/clip.MP4", b"fake!", 1700000000)
    put(tmp_path, "notes.txt", b"fake")
    put(tmp_path, "doc.pdf", b"fake")
    found = list_media(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "none")])
    assert names(found) == ["clip.MP4", "harbour.jpg"]
    clip = found.where("media_type = 'video'").first()
    assert (clip.path, clip.size, clip.mtime) == (str(tmp_path / "sub/clip.MP4"), 5, 1700000000)
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert list_media(spark, [str(tmp_path / "none")]).count() == 0
    assert names(keep_media(found.unionByName(found))) == ["clip.MP4", "harbour.jpg"]


def test_image_hashes(spark, tmp_path):
    put(tmp_path, "a b+#1.png", solid((128, 64, 32)))
    put(tmp_path, "same.png", solid((128, 64, 32)))
    put(tmp_path, "stripes.png", striped())
    put(tmp_path, "grey.png", png([[x * 20 for x in range(9, -1, -1)]] * 10, channels=1))
    put(tmp_path, "broken.png", b"not an image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in image_fingerprints(spark, [str(tmp_path)]).collect()}
    assert rows["a b+#1.png"].phash == rows["same.png"].phash == "0" * 16
    assert rows["stripes.png"].phash != "0" * 16
    assert rows["grey.png"].phash == "f" * 16
    assert rows["broken.png"].phash is None and rows["broken.png"].width is None
    assert (rows["stripes.png"].width, rows["stripes.png"].height) == (100, 100)
    old = put(tmp_path, "old.png", striped(), 1000)
    recent = image_fingerprints(spark, [str(tmp_path)], 2000)
    assert "old.png" not in names(recent) and len(names(recent)) == 5 and old


def test_digests_in_pieces_equal_those_of_rows(spark, tmp_path):
    big = put(tmp_path, "big.bin", bytes(range(256)) * 16384)
    paths = spark.createDataFrame([(big,), (str(tmp_path / "gone"),)], "path string")
    rows = {r.path: r for r in digest_paths(paths).collect()}
    import hashlib
    assert rows[big].exact_hash == hashlib.sha256(bytes(range(256)) * 16384).hexdigest() and rows[big].error is None
    assert rows[str(tmp_path / "gone")].exact_hash is None and rows[str(tmp_path / "gone")].error


def test_video_strategies(spark):
    rows = [("v", i, (i + 0.5) / 4, i + 1) for i in (2, 0, 3, 1)] + [("w", 0, 0.5, None)]
    frames = spark.createDataFrame(rows, FRAMES)
    def get(*a):
        return {r.path: r.phash for r in video_fingerprints(frames, *a).collect()}
    assert get("exact_only") == {"v": None, "w": None}
    assert get("first_frame") == {"v": "0000000000000001"}
    assert get("multi_frame", 4)["v"].split(";") == [f"{i:016x}" for i in (1, 2, 3, 4)]
    assert get("multi_frame", 1) == {"v": "0000000000000002"}
    with pytest.raises(ValueError):
        video_fingerprints(frames, "x")


def test_sampled_frames(spark):
    frames = spark.createDataFrame([("v", i, i * 0.1) for i in range(100)], "path string, frame_idx int, second double")
    durations = spark.createDataFrame([("v", 10.0)], "path string, duration double")
    got = [r.frame_idx for r in sampled_frames(frames, durations, 2).orderBy("frame_idx").collect()]
    assert got == [25, 26, 27, 28, 29, 30, 75, 76, 77, 78, 79, 80]


def stored(spark, *rows):
    return spark.createDataFrame([(p, s, m, "image", h, None, "x") for p, s, m, h in rows], STORED)


def test_store(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    store.upsert(stored(spark, ("/lib/own/harbour.png", 5311, 1650001234, "d1")))
    assert store.get("/lib/own/harbour.png", 5311, 1650001234).first().exact_hash == "d1"
    assert store.get("/lib/own/harbour.png", 5311, 1650001235).isEmpty()
    store.upsert(stored(spark, *[(f"/lib/own/{i}.png", 40 + i, 1650000000, f"h{i}") for i in range(5)]))
    store.upsert(stored(spark))
    store.upsert(stored(spark, ("/lib/own/0.png", 7, 8, "new")))
    assert store.read().count() == 6
    assert store.get("/lib/own/0.png", 7, 8).first().scanned_at > 0
    catalog = spark.createDataFrame([("/lib/own/0.png", 7, 8), ("/lib/own/1.png", 41, 1), ("/new", 1, 1)],
                                    "path string, size bigint, mtime bigint")
    hits, misses = split_by_store(catalog, store.read(), "x")
    assert [r.path for r in hits.collect()] == ["/lib/own/0.png"] and names(misses) == ["1.png", "new"]
    assert split_by_store(catalog, store.read(), "y")[0].isEmpty()
    stats = store_stats(catalog, store.read(), "x").first()
    assert (stats.hits, stats.misses, stats.total) == (1, 2, 3) and stats.hit_rate == pytest.approx(100 / 3)
    assert store_stats(catalog.limit(0), store.read(), "x").first().hit_rate == 0
    store.prune(catalog)
    assert names(store.read()) == ["0.png", "1.png"]
    store.clear()
    assert store.read().count() == 0
    store.vacuum()
    assert len(store._listed()[0]) == 1


def test_repeated_paths_count_once(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path / "store"))
    store.upsert(stored(spark, ("/r/a", 1, 5, "old"), ("/r/a", 1, 9, "new"), ("/r/a", 1, 7, "mid"), ("/r/b", 1, 1, "b")))
    assert sorted((r.path, r.exact_hash) for r in store.read().collect()) == [("/r/a", "new"), ("/r/b", "b")]


def test_changes_are_small_and_fold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "MOST_CHANGES", 2)
    store = Snapshot(spark, str(tmp_path / "store"))
    store.publish(snapshot.stamped(stored(spark, *[(f"/f/{i}", i, 1, f"h{i}") for i in range(50)])))
    for i in range(2):
        store.upsert(stored(spark, (f"/f/{i}", 7, 7, "new")))
    assert [g.full for g in store._current()] == [True, False, False]
    assert store._load(store._current()[-1]).count() == 1 and store.read().count() == 50
    store.upsert(stored(spark, ("/f/0", 8, 8, "newer")))
    assert [g.full for g in store._current()] == [True] and store.read().count() == 50
    assert store.get("/f/0", 8, 8, "x").first().exact_hash == "newer" and store.get("/f/0", 8, 8, "y").isEmpty()


def test_a_concurrent_writer_fails(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path / "store"))
    store.upsert(stored(spark, ("/c", 1, 1, "h")))
    before = store._listed()[0]
    store.upsert(stored(spark, ("/d", 1, 1, "h")))
    with pytest.raises(snapshot.ConcurrentWriteError):
        store._write(store.read(), True, before)
    assert store.read().count() == 2
    store._listed = lambda: (before, 1)  # as a writer sees it that listed before the other claimed
    with pytest.raises(snapshot.ConcurrentWriteError):
        store.upsert(stored(spark, ("/e", 1, 1, "h")))


def hashes(store):
    return {r.path: r.exact_hash for r in store.read().collect()}


@pytest.mark.parametrize("step", ["fold", "prune"])
def test_a_change_during_a_fold_survives(spark, tmp_path, step):
    store, other = (Snapshot(spark, str(tmp_path / "store")) for _ in range(2))
    store.upsert(stored(spark, ("/a", 1, 1, "a"), ("/b", 1, 1, "b")))
    store.upsert(stored(spark, ("/a", 2, 2, "a2")))
    listed, rows = store._listed, store._rows

    def landing(done):
        store._rows = rows
        other.upsert(stored(spark, ("/b", 3, 3, "b3"), ("/c", 3, 3, "c3")))
        return rows(done)

    store._rows = landing
    with pytest.raises(snapshot.ConcurrentWriteError):
        store.fold() if step == "fold" else store.prune(spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string"))
    assert hashes(store) == {"/a": "a2", "/b": "b3", "/c": "c3"}
    store.fold()
    assert [g.full for g in store._current()] == [True] and hashes(store) == {"/a": "a2", "/b": "b3", "/c": "c3"}
    assert listed() == other._listed()


def test_upserts_go_on_where_a_fold_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "MOST_CHANGES", 1)
    store, other = (Snapshot(spark, str(tmp_path / "store")) for _ in range(2))
    store.upsert(stored(spark, ("/a", 1, 1, "a")))
    rows = store._rows

    def landing(done):
        store._rows = rows
        other._write(snapshot.stamped(stored(spark, ("/b", 1, 1, "b"))), False, [])
        return rows(done)

    store._rows = landing
    store.upsert(stored(spark, ("/c", 1, 1, "c")))
    assert hashes(store) == {"/a": "a", "/b": "b", "/c": "c"} and not any(g.full for g in store._current())
    store.upsert(stored(spark, ("/d", 1, 1, "d")))
    assert [g.full for g in store._current()] == [True] and len(hashes(store)) == 4


def test_a_change_claimed_before_a_fold_and_finished_after_it_survives(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path / "store"))
    store.upsert(stored(spark, ("/a", 1, 1, "a1"), ("/b", 1, 1, "b1"), ("/c", 1, 1, "c1")))
    (tmp_path / "store" / "gen-0000000002-claim").touch()  # slow
    store.upsert(stored(spark, ("/b", 3, 3, "b3")))
    store.fold()
    assert hashes(store) == {"/a": "a1", "/b": "b3", "/c": "c1"}
    late = snapshot.stamped(stored(spark, ("/a", 2, 2, "a2"), ("/b", 2, 2, "b2"), ("/d", 2, 2, "d2")))
    late.write.parquet(str(tmp_path / "store" / "gen-0000000002-changes"))
    want = {"/a": "a2", "/b": "b3", "/c": "c1", "/d": "d2"}
    assert hashes(store) == want
    store.upsert(stored(spark, ("/e", 5, 5, "e5")))
    assert hashes(store) == want | {"/e": "e5"}
    store.fold()
    store.vacuum()
    assert hashes(store) == want | {"/e": "e5"} and len(store._listed()[0]) == 1


def test_a_broken_generation_is_not_current(spark, tmp_path):
    store = Snapshot(spark, str(tmp_path / "store"))
    store.upsert(stored(spark, ("/a", 1, 1, "h")))
    (tmp_path / "store" / "gen-0000000002-changes").mkdir()
    assert store.read().count() == 1
    store.upsert(stored(spark, ("/b", 1, 1, "h")))
    assert store.read().count() == 2


def library(tmp_path):
    lib = tmp_path / "lib"
    put(lib, "a/one.png", solid((1, 2, 3)), 1700000000)
    put(lib, "b/copy.png", solid((1, 2, 3)), 1700000001)
    put(lib, "c/near.png", solid((9, 9, 9)), 1700000002)
    put(lib, "d/stripes.png", striped(), 1700000003)
    put(lib, "e/clip.mp4", b"video", 1700000004)
    put(lib, "f/bad.jpg", b"no image", 1700000005)
    return lib


def summary(result):
    return sorted((r.duplicate_type, r.n_files, r.first_path.rsplit("/", 1)[1], r.max_distance)
                  for r in result.groups.collect())


def test_scan_and_rescan(spark, ws, tmp_path):
    lib = library(tmp_path)
    options = ScanOptions(folders=(str(lib),), mode="content")
    store = Snapshot(spark, str(tmp_path / "store"))
    first = scan(ws, options, store)
    expected = [("exact", 2, "one.png", None), ("perceptual", 3, "one.png", 0)]
    assert summary(first) == expected
    assert first.stats.first().misses == 6
    assert first.records.where("phash is null").count() == 2

    # Nothing changed: everything comes from the store, with the same result.
    again = scan(Workspace(spark), options, store)
    assert again.stats.first().hits == 6 and summary(again) == expected

    # A changed and a new file; the incremental result is that of a full run.
    put(lib, "d/stripes.png", solid((5, 5, 5)), 1700000100)
    put(lib, "g/new.png", striped(), 1700000101)
    changed = scan(ws, options, store)
    assert changed.stats.first().hits == 5
    full = scan(ws, options)
    assert summary(changed) == summary(full)
    columns = ["path", "size", "mtime", "exact_hash", "phash", "width"]
    assert sorted(changed.records.select(*columns).collect()) == sorted(full.records.select(*columns).collect())
    areas = {r.path.rsplit("/", 1)[1]: r.area for r in image_areas(full.records).collect()}
    assert areas["one.png"] == 10000 and areas["bad.jpg"] == 0

    # By name alone no file is opened, and the store keeps what it has.
    before = sorted(store.read().drop("scanned_at").collect())
    named = scan(ws, ScanOptions(folders=(str(lib),), mode="filename"), store)
    assert named.stats is None and named.records.where("exact_hash is not null").isEmpty()
    assert sorted(store.read().drop("scanned_at").collect()) == before
    assert scan(ws, options, store).stats.first().hits == 7


def frames_of(spark, lib, *clips):
    return spark.createDataFrame([(str(lib / p), i, i / 4, fp) for p, fps in clips for i, fp in enumerate(fps)], FRAMES)


def test_videos_are_one_record(spark, ws, tmp_path):
    lib = tmp_path / "lib"
    put(lib, "a/one.mp4", b"one video")
    put(lib, "b/two.mp4", b"another video")
    put(lib, "c/pic.png", striped())
    frames = frames_of(spark, lib, ("a/one.mp4", (7, 255)), ("b/two.mp4", (2**40 - 1, 2**50 - 1)))
    for mode in ("content", "both", "filename"):
        found = scan(ws, ScanOptions(folders=(str(lib),), mode=mode, phash_threshold=2), frames=frames)
        assert found.records.count() == 3 and found.groups.isEmpty()


def test_every_sequence_equals_a_full_run(spark, ws, tmp_path):
    lib = library(tmp_path)
    put(lib, "h/[odd] {name}.mp4", b"video")
    frames = frames_of(spark, lib, ("e/clip.mp4", (7, 255)), ("h/[odd] {name}.mp4", (3, 7)))
    store = Snapshot(spark, str(tmp_path / "store"))
    columns = ["path", "size", "mtime", "exact_hash", "phash", "width", "height"]

    def change(step):
        if step == 2:
            put(lib, "i/old [copy].png", solid((1, 2, 3)), 1000)  # as old as a copied photo may be
        if step == 3:
            (lib / "c/near.png").unlink()
            put(lib, "d/stripes.png", solid((5, 5, 5)), 1700000100)

    steps = [("content", None, "first_frame"), ("both", frames, "first_frame"), ("filename", None, "first_frame"),
             ("content", frames, "multi_frame"), ("content", None, "first_frame"), ("both", frames, "multi_frame")]
    for step, (mode, given, strategy) in enumerate(steps):
        change(step)
        options = ScanOptions(folders=(str(lib), str(tmp_path / "missing")), mode=mode, video_strategy=strategy)
        got, full = scan(ws, options, store, given), scan(ws, options, None, given)
        assert sorted(got.records.select(*columns).collect()) == sorted(full.records.select(*columns).collect()), step
        assert summary(got) == summary(full)
        assert store.read().count() == store.read().select("path").distinct().count()
        assert store.read().where("exact_hash is null").isEmpty()


def test_a_unique_file_is_digested_for_later_copies(spark, ws, tmp_path):
    lib = tmp_path / "lib"
    put(lib, "a.mp4", b"video")
    store, options = Snapshot(spark, str(tmp_path / "store")), ScanOptions(folders=(str(lib),), mode="content")
    assert scan(ws, options, store).groups.isEmpty()
    put(lib, "b.mp4", b"video")
    assert summary(scan(ws, options, store)) == [("exact", 2, "a.mp4", None)]


def test_large_and_unreadable_files_do_not_end_a_scan(spark, ws, tmp_path):
    lib = library(tmp_path)
    with open(lib / "big.mp4", "wb") as f:
        f.truncate(2_300_000_000)
    options = ScanOptions(folders=(str(lib),), mode="content")
    records = fingerprint(ws, list_media(spark, options.folders).unionByName(
        spark.createDataFrame([("s3x://none/x.mp4", 300_000_000, 1, "video"), (str(lib / "gone.png"), 1, 1, "image")], FILES)),
        None, options)
    found = {r.path.rsplit("/", 1)[1]: r for r in records.collect()}
    assert found["big.mp4"].exact_hash and found["big.mp4"].error is None
    assert found["x.mp4"].error and found["gone.png"].error and found["one.png"].phash


def test_only_changed_files_are_opened(spark, ws, tmp_path, monkeypatch):
    """Files that are not to be read have lost their permission, or their content."""
    lib = library(tmp_path)
    store, options = Snapshot(spark, str(tmp_path / "store")), ScanOptions(folders=(str(lib),), mode="content")
    first = {r.path: r.exact_hash for r in scan(ws, options, store).records.collect()}
    for path in first:  # same size and time, other bytes: would show if they were read
        stat = os.stat(path)
        with open(path, "r+b") as f:
            f.write(b"\0" * 4)
        os.utime(path, (stat.st_mtime, stat.st_mtime))
    put(lib, "z/older.png", striped(), 1000)
    again = {r.path: r.exact_hash for r in scan(ws, options, store).records.collect()}
    assert {p: again[p] for p in first} == first and len(again) == len(first) + 1


def test_stream_of_files(spark, tmp_path):
    lib = library(tmp_path)
    options = ScanOptions(folders=(str(lib), str(lib / "a")), mode="both")
    store = Snapshot(spark, str(tmp_path / "store"))
    for expected in (6, 7):
        ingest_files(spark, options, store, str(tmp_path / "progress")).awaitTermination()
        assert store.read().count() == expected
        put(lib, "z/late.png", striped())
    assert store.read().where(F.col("phash").isNotNull()).count() == 5
    assert regular_folders(["/a", "/a/b", "/ab/"]) == ["/a", "/ab"]


def test_hex_helpers_in_sources(spark):
    assert spark.range(1).select(to_hex(parse_hex(F.lit("0A")))).first()[0] == "000000000000000a"


def opened(monkeypatch, ws):
    """Ranges that were read, counted where they are dealt."""
    seen = []
    deal = opening.by_bytes

    def counted(ws, rows):
        seen.append(rows.count())
        return deal(ws, rows)

    monkeypatch.setattr(opening.digest_files, "__defaults__", (*opening.digest_files.__defaults__[:2], counted))
    return seen


def test_exactly_the_changed_files_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan_plan, "BLOCK_PATHS", 40)
    lib, store = tmp_path / "lib", Snapshot(spark, str(tmp_path / "store"))
    for i in range(300):
        put(lib, f"{i:03}.mp4", b"video %d" % (i % 7), 1700000000 + i)
    for i in range(30):
        put(lib, f"p{i:02}.png", solid((i, i, i), 9), 1700000000 + i)
    options = ScanOptions(folders=(str(lib),), mode="content")
    with Workspace(spark) as ws:
        seen = opened(monkeypatch, ws)
        scan(ws, options, store)
        assert seen == [330]
    for i in range(0, 300, 3):
        put(lib, f"{i:03}.mp4", b"changed %d" % i, 1800000000 if i else 1000)  # one is older than all others
    put(lib, "p00.png", solid((200, 9, 9), 9), 1800000000)
    read, names_read = scan_plan.image_fingerprints, []
    monkeypatch.setattr(scan_plan, "image_fingerprints",
                        lambda spark, folders, paths: names_read.append(paths) or read(spark, folders, paths=paths))
    with Workspace(spark) as ws:
        seen = opened(monkeypatch, ws)
        again = scan(ws, options, store)
        assert seen == [101] and [len(b) for b in names_read] == [1]
        got = {r.path: r.exact_hash for r in again.records.collect()}
        assert got == {str(f): hashlib.sha256(f.read_bytes()).hexdigest() for f in lib.iterdir()}


def test_tasks_read_like_numbers_of_bytes(spark, ws):
    rng = random.Random(1)
    rows = [(f"/f/{i}", int(10 ** rng.uniform(0, 9))) for i in range(400)]
    files = spark.createDataFrame(rows, "path string, size bigint")
    cut = opening.ranges(files)
    dealt = opening.by_bytes(ws, cut).withColumn("task", F.spark_partition_id())
    per_task = [r["b"] for r in dealt.groupBy("task").agg(F.sum(F.col("length") + opening.OPEN_BYTES).alias("b")).collect()]
    assert max(per_task) <= opening.TASK_BYTES + opening.WHOLE_FILE_BYTES + opening.OPEN_BYTES
    assert len(per_task) >= sum(per_task) / opening.TASK_BYTES / 2
    back = dealt.groupBy("path").agg(F.sum("length").alias("n"), F.min("start").alias("from"))
    assert sorted((r["path"], r["n"]) for r in back.collect()) == sorted(rows) and back.where("`from` <> 0").isEmpty()


def plain_tree(data, leaf, fanout):
    level = [hashlib.sha256(data[i:i + leaf]).hexdigest() for i in range(0, len(data), leaf)]
    while len(level) > 1:
        level = [hashlib.sha256(f"tree {leaf} {''.join(level[i:i + fanout])}".encode()).hexdigest()
                 for i in range(0, len(level), fanout)]
    return level[0]


def test_tree_digests(spark, ws, tmp_path, monkeypatch):
    monkeypatch.setattr(opening, "FANOUT", 4)
    monkeypatch.setattr(opening, "OPEN_BYTES", 0)
    rng = random.Random(2)
    data = {"a": rng.randbytes(70_001), "short": rng.randbytes(1000), "empty": b"", "edge": rng.randbytes(2000)}
    data["same"] = data["a"]
    data["other"] = data["a"][:50_000] + bytes([data["a"][50_000] ^ 1]) + data["a"][50_001:]
    for name, content in data.items():
        put(tmp_path, name, content, 1)
    rows = [(str(tmp_path / n), len(c)) for n, c in data.items()] + [(str(tmp_path / "gone"), 9000), (str(tmp_path / "short"), 999)]
    files = spark.createDataFrame(rows[:-1], "path string, size bigint")
    tasks = []

    def deal(ws, rows):
        dealt = opening.by_bytes(ws, rows, 10_000)
        tasks.append(dealt.where(F.col("path").endswith("/a")).select(F.spark_partition_id()).distinct().count())
        return dealt

    got = {r.path.rsplit("/", 1)[1]: r for r in opening.digest_files(ws, files, 2000, 1000, deal).collect()}
    assert tasks[0] >= 5 and len(got) == 7
    for name, content in data.items():
        want = plain_tree(content, 1000, 4) if len(content) > 2000 else hashlib.sha256(content).hexdigest()
        assert got[name].exact_hash == want and got[name].error is None
    assert got["gone"].exact_hash is None and got["gone"].error
    assert got["a"].exact_hash == got["same"].exact_hash != got["other"].exact_hash
    changed = spark.createDataFrame(rows[-1:], "path string, size bigint")
    assert "999" in opening.digest_files(ws, changed).first().error


def test_a_sparse_file_is_read_by_several_tasks(spark, ws, tmp_path):
    path = tmp_path / "sparse"
    with open(path, "wb") as file:
        file.truncate(300 * 1024 * 1024)
    files = spark.createDataFrame([(str(path), 300 * 1024 * 1024)], "path string, size bigint")
    assert opening.ranges(files).count() == 5
    dealt = opening.by_bytes(ws, opening.ranges(files), 64 * 1024 * 1024)
    assert dealt.select(F.spark_partition_id()).distinct().count() >= 4
    assert opening.digest_files(ws, files).first().exact_hash
