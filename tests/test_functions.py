import pytest
from pyspark.sql import functions as F

from twinsieve.functions import fingerprints as fp
from twinsieve.functions import paths
from twinsieve.functions.rasters import dhash_luma8, dhash_raster
from twinsieve.options import ScanOptions


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_paths_sort_by_component(spark):
    names = ["/a-b/x", "/a/b", "/a", "/A/z", "/a/b/c"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r.x for r in df.orderBy(paths.order_key("x")).collect()] == ["/A/z", "/a", "/a/b", "/a/b/c", "/a-b/x"]


def test_extension_rules(spark):
    names = ["/a/B.JPG", "/a/.git", "/a.d/none", "/x.tar.gz", "c:\\d.e\\f", "/a/.h.png", "/a/dot."]
    assert column(spark, names, paths.extension("x")) == ["jpg", "", "", "gz", "e\\f", "png", ""]
    assert column(spark, names, paths.extension("x", "dotted")) == [".jpg", ".git", "", ".gz", "", ".png", "."]


def test_media_type_ignores_case(spark):
    assert column(spark, ["a.jpg", "a.MP4", "a.txt", "a"], paths.media_type("x")) == ["image", "video", None, None]


def test_priority_is_a_raw_prefix(spark):
    names = ["/high/x", "/higher/x", "/low/x", "/none"]
    assert column(spark, names, paths.priority_index("x", ["/low", "/high"])) == [1, 1, 0, 2**31 - 1]
    assert column(spark, names, paths.priority_index("x", [])) == [2**31 - 1] * 4


def test_folder_is_the_longest_with_a_boundary(spark):
    folders = ["/a", "/a/b/", "/a/b", "C:\\p"]
    names = ["/a/x", "/a/b/x", "/ab/x", "/a/b", "C:\\p\\x", "C:/p/x"]
    assert column(spark, names, paths.folder_index("x", folders)) == [0, 1, -1, 1, 3, 3]


def test_hex_parsing_is_guarded(spark):
    texts = ["ff", "+ff", "zz", "", "0" * 17, "1" + "0" * 16, "0" * 20 + "a", "f" * 16, "FF", None, "-1", "+"]
    assert column(spark, texts, fp.parse_hex("x")) == [255, 255, None, None, 0, None, 10, -1, 255, None, None, None]
    assert column(spark, [255, -1, 0], fp.to_hex("x"), "bigint") == ["00000000000000ff", "f" * 16, "0" * 16]


def test_distance_covers_the_sign_bit(spark):
    assert column(spark, [-1], fp.hamming("x", F.lit(0).cast("bigint")), "bigint") == [64]
    assert column(spark, ["zz"], fp.hamming_hex("x", F.lit("ff"))) == [None]


def test_frames_use_the_closest_pair(spark):
    a = "0000000000000000;ffffffffffffffff;zz"
    d = fp.min_frame_distance(fp.split_frames("x"), fp.split_frames(F.lit("0000000000000001")))
    assert column(spark, [a, "zz;zz"], d) == [1, None]
    assert column(spark, [a], fp.join_frames(fp.split_frames("x"))) == ["0000000000000000;ffffffffffffffff"]


def test_digest_is_64_hex_digits_and_stable(spark):
    big = bytes(range(256)) * 16384
    a, b, c = column(spark, [b"hello world", b"hello world", big], fp.content_digest("x"), "binary")
    assert a == b != c and len(a) == len(c) == 64


def test_display_values(spark):
    assert column(spark, [0, 8, 32, 29], fp.similarity_pct("x"), "int") == [100, 88, 50, 55]
    assert column(spark, [1572864], fp.mebibytes("x"), "bigint") == [1.5]
    assert column(spark, [0, 3], fp.kind_label(F.lit("perceptual"), "x"), "int") == ["identical", "similar"]
    assert column(spark, [None, 3], fp.kind_label(F.lit("exact"), "x"), "int") == ["exact", "exact"]
    assert column(spark, [None, 70000], fp.pixel_area("x", "x"), "int") == [0, 4_900_000_000]


def test_sample_windows(spark):
    (windows,) = column(spark, [10.0], fp.sample_windows("x", 4), "double")
    assert [(w.idx, w.start, w.end) for w in windows] == [(0, 1.25, 1.75), (1, 3.75, 4.25), (2, 6.25, 6.75), (3, 8.75, 9.25)]
    (short,) = column(spark, [0.1], fp.sample_windows("x", 2), "double")
    assert short[1].end == pytest.approx(0.1)
    assert column(spark, [10.0], fp.sample_instant("x", 2.0), "double") == [9.9]


def test_raster_hash_of_8_by_8_agrees_with_the_general_filter(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    rasters = [rng.integers(0, 256, 64).tolist() for _ in range(50)] + [[7] * 64]
    got = column(spark, rasters, dhash_luma8("x"), "array<int>")
    assert got == [dhash_raster(np.array(r, dtype=np.uint8).reshape(8, 8, 1)) for r in rasters]
    assert got[-1] == 0


def test_options_are_checked():
    options = ScanOptions()
    assert (options.mode, options.phash_threshold, options.multi_frame_count) == ("both", 8, 8)
    for bad in ({"mode": "x"}, {"phash_threshold": 65}, {"video_strategy": "x"}):
        with pytest.raises(ValueError):
            ScanOptions(**bad)
    assert ScanOptions(mode="content").fp_profile != ScanOptions(mode="filename").fp_profile
    assert ScanOptions(video_strategy="multi_frame").fp_profile != options.fp_profile
