import random

import pytest

from helpers import distance, greedy, rec, records
from twinsieve.operators import groups as G
from twinsieve.operators import spread as SP
from twinsieve.plans import skew
from twinsieve.plans.bands import signed


def found(ws, df, mode="content", t=8):
    groups, members = G.find_duplicates(ws, df, mode, t)
    return groups.orderBy("duplicate_type", "first_key").collect(), members


def test_exact_pair(spark, ws):
    groups, members = found(ws, records(spark, rec("/x/elm.png", 731, "d7"), rec("/y/oak.png", 731, "d7"),
                                        rec("/z/fir.png", 64, "d9")))
    assert [(g.duplicate_type, g.n_files, g.max_distance) for g in groups] == [("exact", 2, None)]
    assert {m.path for m in members.collect()} == {"/x/elm.png", "/y/oak.png"}


def test_filename_pair_needs_the_same_size(spark, ws):
    df = records(spark, rec("/x/Lake.png", 77, "d1"), rec("/y/lake.PNG", 77, "d2"), rec("/z/lake.png", 78, "d3"))
    groups, _ = found(ws, df, "filename")
    assert [(g.duplicate_type, g.n_files) for g in groups] == [("filename", 2)]


def test_no_group_for_unique_files_or_missing_hashes(spark, ws):
    df = records(spark, rec("/a/1.jpg", 1000, "a"), rec("/b/2.jpg", 2000, "b"), rec("/c/3.jpg", 1, None, None),
                 rec("/d/4.jpg", 1, None, None), rec("/e/5.jpg", 3, "e", "zz"), rec("/f/6.jpg", 4, "f", "zz"))
    for mode in ("filename", "content", "both"):
        assert found(ws, df, mode)[0] == []


def test_wasted_bytes(spark, ws):
    groups, _ = found(ws, records(spark, *[rec(f"/{i}/x{i}.jpg", 1000, "same") for i in range(3)]))
    assert groups[0].wasted_bytes == 2000


def test_perceptual_trio(spark, ws):
    df = records(spark, rec("/x.png", 9, None, "a5a5000000000f00"), rec("/y.png", 9, None, "a5a5000000000f08"),
                 rec("/z.png", 9, None, "a5a5000000004f08"))
    groups, _ = found(ws, df)
    assert [(g.duplicate_type, g.n_files, g.max_distance) for g in groups] == [("perceptual", 3, 2)]


def test_content_mode_lists_a_pair_twice_and_both_mode_excludes_named_files(spark, ws):
    df = records(spark, rec("/a/p.jpg", 5, "h", "00ff"), rec("/b/p.jpg", 5, "h", "00ff"), rec("/c/q.jpg", 6, "h", "00fe"))
    kinds = [g.duplicate_type for g in found(ws, df, "content")[0]]
    assert kinds == ["exact", "perceptual"]
    assert [(g.duplicate_type, g.n_files) for g in found(ws, df, "both")[0]] == [("filename", 2)]


def test_identical_fingerprints_at_threshold_zero(spark, ws):
    df = records(spark, rec("/a.jpg", 1, None, "0a"), rec("/b.jpg", 2, None, "+A"), rec("/c.jpg", 3, None, "0b"))
    groups, members = found(ws, df, "content", 0)
    assert [(g.n_files, g.max_distance) for g in groups] == [(2, 0)]


def test_repeated_paths_count_once(spark, ws):
    df = records(spark, rec("/a/x.jpg", 1, "h"), rec("/a/x.jpg", 1, "h"))
    assert found(ws, df)[0] == []
    assert G.first_per_path(df.withColumnRenamed("mtime", "seq"), "seq").count() == 1


def test_single_and_joined_fingerprints_do_not_meet(spark, ws):
    joined = "0000000000000000;ffffffffffffffff"
    df = records(spark, rec("/a.mp4", 1, None, joined), rec("/b.mp4", 2, None, "0000000000000001;zz"),
                 rec("/c.jpg", 3, None, "0000000000000000"), rec("/d.mp4", 4, None, "zz;zz"),
                 rec("/e.mp4", 5, None, "zz;zz"))
    groups, members = found(ws, df)
    assert [(g.n_files, g.max_distance) for g in groups] == [(2, 1)]
    assert {m.path for m in members.collect()} == {"/a.mp4", "/b.mp4"}


def test_seed_follows_path_order_not_string_order(spark, ws):
    # /a/b comes before /a-b; as the seed it takes only one of the two others.
    df = records(spark, rec("/a-b/x.jpg", 1, None, "00"), rec("/a/b.jpg", 2, None, "0f"), rec("/z.jpg", 3, None, "ff"))
    groups, _ = found(ws, df, "content", 4)
    assert groups[0].first_path == "/a/b.jpg" and groups[0].n_files == 3


@pytest.mark.parametrize("small,tile", [(64, 4000), (2, 5)])
def test_spread_equals_all_pairs(spark, ws, monkeypatch, small, tile):
    monkeypatch.setattr(SP, "SMALL_STAR", small)
    monkeypatch.setattr(G, "SMALL_STAR", small)
    monkeypatch.setattr(SP, "TILE_NODES", tile)
    monkeypatch.setattr(skew, "HOT_KEY_ROWS", 3 if small == 2 else 10**6)
    rng = random.Random(5)
    values = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(70)]
    rows = [rec(f"/{i:03d}.jpg", i, None, f"{v:016x}") for i, v in enumerate(values)]
    nodes = list(enumerate(values))
    own = greedy(nodes, lambda a, b: distance(a, b) <= 7)
    groups, members = found(ws, records(spark, *rows), "content", 7)
    want = {}
    for rk, owner in own.items():
        want.setdefault(owner, []).append(values[rk])
    expected = {f"/{o:03d}.jpg": (len(v), max(distance(a, b) for a in v for b in v))
                for o, v in want.items() if len(v) > 1}
    assert {g.first_path: (g.n_files, g.max_distance) for g in groups} == expected


def test_hot_keys_are_salted(spark, ws, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEY_ROWS", 10)
    rows = [rec(f"/hot/{i}.jpg", i, "hot", "00") for i in range(57)] + [rec(f"/c/{i}.jpg", i, f"c{i // 2}", "ff" * 8) for i in range(6)]
    groups, members = found(ws, records(spark, *rows))
    got = sorted((g.duplicate_type, g.n_files) for g in groups)
    assert got == [("exact", 2)] * 3 + [("exact", 57), ("perceptual", 6), ("perceptual", 57)]
    assert members.count() == 63 * 2 and members.distinct().count() == 63 * 2


def test_ids_do_not_change_between_runs(spark, ws):
    df = records(spark, *[rec(f"/{i}.jpg", i, f"h{i // 2}", f"{i // 3:x}") for i in range(12)])
    first = {(g.group_id, g.n_files) for g in found(ws, df)[0]}
    again = {(g.group_id, g.n_files) for g in found(ws, df.repartition(7))[0]}
    assert first == again and len(first) == len({g for g, _ in first})


def test_nested_files_are_sorted_and_large_groups_keep_their_row(spark, ws):
    rows = [rec(f"/{i}.jpg", 1, "a") for i in (2, 1)] + [rec(f"/x{i}.jpg", 1, "b") for i in range(5)]
    members = G.exact_members(ws, records(spark, *rows))
    nested = {r.n_files: r.files for r in G.nested_files(members, 3).collect()}
    assert [f.path for f in nested[2]] == ["/1.jpg", "/2.jpg"] and nested[5] is None


def test_sweep_equals_single_runs(spark, ws):
    rng = random.Random(6)
    rows = [rec(f"/{i:02d}.jpg", i, None, f"{rng.getrandbits(8):016x}") for i in range(40)]
    df = records(spark, *rows)
    swept = G.threshold_sweep(ws, df, (0, 2), "content")
    for t, members in swept.items():
        alone = G.find_members(ws, df, "content", t)
        assert sorted(map(tuple, members.collect())) == sorted(map(tuple, alone.collect()))


def test_bad_arguments(spark, ws):
    with pytest.raises(ValueError):
        G.find_members(ws, records(spark), "name")
    with pytest.raises(ValueError):
        G.find_members(ws, records(spark), "content", 65)
    assert signed(2**63) < 0
