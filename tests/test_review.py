import pytest

from helpers import rec, records
from twinsieve.operators import browse, groups, keeper, review

MEMBER = "group_id string, duplicate_type string, max_distance int, path string, size bigint, media_type string"


def members(spark, **groups_):
    rows = [(g, "exact", None, p, s, "image") for g, files in groups_.items() for p, s in files]
    return spark.createDataFrame(rows, MEMBER).coalesce(1)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string").coalesce(1)


def kept(df):
    return {r.group_id: r.keeper for r in df.collect()}


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_priority_keeper(spark):
    m = members(spark, g=[("/tmp/elm.png", 31), ("/best/oak.png", 17)], h=[("/n/y.png", 2), ("/m/x.png", 1)])
    assert kept(keeper.keepers(m, ["/best", "/tmp"])) == {"g": "/best/oak.png", "h": "/m/x.png"}
    assert kept(keeper.keepers(m, [])) == {"g": "/best/oak.png", "h": "/m/x.png"}


def test_quality_keeper(spark):
    m = members(spark, g=[("/tmp/elm.png", 90), ("/best/oak.png", 11)], h=[("/m/small.png", 70), ("/n/wide.png", 30)],
                i=[("/m/1", 1), ("/n/2", 1)])
    areas = spark.createDataFrame([("/m/small.png", 640), ("/n/wide.png", 9216)], "path string, area bigint")
    got = kept(keeper.keepers(m, ["/best", "/tmp"], "quality", areas))
    # Without areas the folder decides; ties go to the last file.
    assert got == {"g": "/best/oak.png", "h": "/n/wide.png", "i": "/n/2"}
    with pytest.raises(ValueError):
        keeper.keepers(m, [], "size")


def test_auto_mark_and_survivors_split_the_members(spark, ws):
    m = members(spark, g=[("/a", 1), ("/b", 1), ("/c", 1)], h=[("/d", 1), ("/e", 1)])
    marks = keeper.auto_mark(ws, m, [])
    assert values(marks, "group_id", "path") == [("g", "/b"), ("g", "/c"), ("h", "/e")]
    rows = review.survivors(m, marks).collect()
    assert all(r.survivors == 1 and r.survivors + r.marked == r.n_files and not r.no_survivors for r in rows)
    assert values(keeper.auto_mark_group(ws, m, "h", []), "path") == [("/e",)]
    with pytest.raises(LookupError):
        keeper.auto_mark_group(ws, m, "none", [])


def test_keep_nth(spark, ws):
    m = members(spark, g=[("/a-b/x", 1), ("/a/b", 1), ("/c", 1)], h=[("/d", 1), ("/e", 1)])
    assert values(keeper.keep_nth(ws, m, 3), "path") == [("/a-b/x",), ("/a/b",)]
    assert values(keeper.keep_nth(ws, m, 2), "path") == [("/a/b",), ("/c",), ("/d",)]


def test_mark_sets(spark):
    m = members(spark, g=[("/a", 1), ("/b", 1)], h=[("/c", 1), ("/d", 1)])
    ids = spark.createDataFrame([("g",)], "group_id string")
    marks = review.add_marks(paths(spark, "/x", "/c"), paths(spark, "/c", "/d"))
    assert values(marks, "path") == [("/c",), ("/d",), ("/x",)]
    assert values(review.mark_groups(marks, m, ids), "path") == [("/a",), ("/b",), ("/c",), ("/d",), ("/x",)]
    assert values(review.keep_groups(paths(spark, "/a", "/c"), m, ids), "path") == [("/c",)]
    assert values(review.remove_marks(marks, paths(spark, "/x")), "path") == [("/c",), ("/d",)]


def test_guard_names_the_group(spark):
    m = members(spark, g=[("/a", 1), ("/b", 1)], h=[("/c", 1), ("/d", 1)])
    review.guard(m, paths(spark, "/a", "/c"))
    with pytest.raises(review.ExtinctionError, match="g"):
        review.guard(m, paths(spark, "/a", "/b"))
    assert review.is_last_copy(m, paths(spark, "/a"), "g", "/b")
    assert not review.is_last_copy(m, paths(spark, "/a"), "h", "/c")


def test_deletion(spark, ws):
    df = records(spark, rec("/a", 5, "h", "00"), rec("/b", 5, "h", "01"), rec("/c", 9, "h", "03"), rec("/d", 1, "k", "f" * 16),
                 rec("/e", 1, "k", "f" * 16))
    m = ws.save(groups.find_members(ws, df, "content", 8), "m")
    marks = paths(spark, "/c", "/d", "/gone")
    table, left, kept_records, manifest = review.apply_deletions(ws, m, df, marks)
    assert values(table, "duplicate_type", "n_files", "wasted_bytes", "max_distance") == [
        ("exact", 2, 5, None), ("perceptual", 2, 5, 1)]
    assert values(kept_records, "path") == [("/a",), ("/b",), ("/e",)]
    assert [(p, len(g), s) for p, g, s in values(manifest, "path", "group_ids", "size")] == [
        ("/c", 2, 9), ("/d", 2, 1), ("/gone", 0, None)]
    same = review.apply_deletions(ws, m, df, marks, recompute=False)[0]
    assert values(same, "duplicate_type", "wasted_bytes", "max_distance") == [("exact", 10, None), ("perceptual", 10, 2)]
    with pytest.raises(review.ExtinctionError):
        review.apply_deletions(ws, m, df, paths(spark, "/d", "/e"))
    assert review.apply_deletions(ws, m, df, paths(spark, "/d", "/e"), allow_extinction=True)[0].count() == 2


def test_only_what_went_is_taken_out(spark, ws):
    df = records(spark, rec("/a", 5, "h", "00"), rec("/b", 5, "h", "01"), rec("/c", 5, "h", "03"))
    m = ws.save(groups.find_members(ws, df, "content", 8), "m")
    table, left, kept_records, manifest = review.apply_deletions(ws, m, df, paths(spark, "/b", "/c"), went=paths(spark, "/c", "/x"))
    assert values(manifest, "path") == [("/c",)] and values(kept_records, "path") == [("/a",), ("/b",)]
    assert values(table, "duplicate_type", "n_files", "max_distance") == [("exact", 2, None), ("perceptual", 2, 1)]


def test_distances_of_large_groups(spark, ws, monkeypatch):
    from twinsieve.operators import spread
    rows = [rec(f"/{i}", i, None, f"{1 << i:x}") for i in range(12)]
    df = records(spark, *rows)
    m = ws.save(groups.find_members(ws, df, "content", 2), "m")
    monkeypatch.setattr(review, "SMALL_STAR", 3)
    monkeypatch.setattr(spread, "SMALL_STAR", 3)
    assert values(review.group_distances(ws, m, df), "max_distance") == [(2,)]


def test_marked_totals_count_a_path_once(spark):
    m = members(spark, g=[("/a", 1048576), ("/b", 1)], h=[("/a", 1048576), ("/c", 1)])
    row = review.marked_totals(paths(spark, "/a", "/a", "/gone"), m).first()
    assert (row.n_marked, row.bytes, row.mib) == (2, 1048576, 1.0)


def test_best_in_group(spark, ws):
    m = members(spark, g=[("/a", 1), ("/b", 1), ("/c", 1)], h=[("/d", 1)])
    areas = spark.createDataFrame([("/a", 5), ("/b", 5), ("/c", 1), ("/d", 0)], "path string, area bigint")
    assert values(review.best_in_group(ws, m, areas), "path") == [("/a",), ("/b",)]


def test_common_prefix(spark):
    m = members(spark, a=[("/lib/x/1.jpg", 1), ("/lib/x/2.jpg", 1)], b=[("/lib/xa/1", 1), ("/lib/xb/1", 1)],
                c=[("/a", 1), ("/b", 1)], d=[("/one", 1)], e=[("c:\\p\\1", 1), ("c:\\p\\2", 1)], f=[("/s/t", 1), ("/s/t", 1)])
    assert {r.group_id: r.prefix for r in review.common_prefix(m).collect()} == {
        "a": "/lib/x", "b": "/lib", "c": "", "d": "", "e": "c:\\p", "f": "/s/t"}


def test_folder_views(spark):
    m = members(spark, g=[("/p/1", 1), ("/q/1", 1)], h=[("/p/2", 1), ("/p/3", 1)], i=[("/z/1", 1), ("/z/2", 1)])
    folders = ["/p", "/q"]
    assert values(review.folder_matrix(m, folders), "group_id", "f0", "f1") == [("g", 1, 1), ("h", 2, 0), ("i", 0, 0)]
    assert values(review.column_paths(m, folders, 1), "path") == [("/q/1",)]
    marks = paths(spark, "/z/1", "/z/2", "/p/1")
    assert values(review.mark_column_preview(m, marks, folders), "folder_idx", "group_id") == [
        (0, "h"), (0, "i"), (1, "g"), (1, "i")]


def test_browsing(spark):
    m = members(spark, g=[("/a.jpg", 5), ("/b.jpg", 5)], h=[("/c.jpg", 9), ("/d.PNG", 9)], i=[("/e", 1), ("/f.jpg", 1), ("/g.jpg", 1)])
    table = groups.group_table(m)
    assert values(browse.groups_all_ext(table, m, ".jpg"), "group_id") == [("g",)]
    order = {k: [r.group_id for r in browse.sort_groups(table, k).collect()] for k in browse.SORTS}
    assert order == {"default": ["g", "h", "i"], "files-desc": ["i", "g", "h"], "files-asc": ["g", "h", "i"],
                     "size-desc": ["h", "g", "i"], "size-asc": ["i", "g", "h"]}
    assert [r.group_id for r in browse.page_of_groups(table, 7, "default", 2).collect()] == ["i"]
    assert [r.group_id for r in browse.page_of_groups(table, 0, "default", 2).collect()] == ["g", "h"]
    for k in browse.SORTS:
        page, seen = browse.page_after(table, None, k, 2).collect(), []
        while page:
            seen += [r.group_id for r in page]
            page = browse.page_after(table, page[-1], k, 2).collect()
        assert seen == order[k]
    assert [r.ext for r in browse.available_exts(m).collect()] == [".jpg", ".png"]
    assert [tuple(r) for r in browse.ext_counts(m).collect()] == [(".jpg", 5), ("(none)", 1), (".png", 1)]
    assert browse.result_summary(table, m, ".jpg").first().label == "1 of 3 groups"
    assert browse.result_summary(table, m).first().label == "3 groups found"
    assert browse.result_summary(table.limit(0), m.limit(0)).first().label == "No duplicates found"
    assert browse.one_group(table, "g").count() == 1
    with pytest.raises(LookupError):
        browse.one_group(table, "none")
    with pytest.raises(ValueError):
        browse.sort_groups(table, "name")
