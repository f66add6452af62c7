"""Queries over the given tables, one or more per operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions import fingerprints as fp
from twinsieve.functions.paths import extension, folder_index, priority_index
from twinsieve.functions.rasters import dhash_luma8
from twinsieve.operators import browse, groups, keeper, progress, review
from twinsieve.operators.hamming import similar_frame_sets, similar_pairs
from twinsieve.plans.workspace import Workspace
from twinsieve.sources import frames as frame_source
from twinsieve.sources.catalog import keep_media
from twinsieve.sources.snapshot import Snapshot, merged, split_by_store, store_stats
from twinsieve.streaming.counters import running_cached, running_ext_counts
from twinsieve.streaming.ingest import ingest_stream
from workload import views as v

GROUP_COLUMNS = ["group_id", "duplicate_type", "max_distance", "n_files", "wasted_bytes", "first_path"]
PROFILE = "sha256+dhash+first_frame"
DAY_MS = 86_400_000


def media_catalog(spark: SparkSession, sf: str) -> DataFrame:
    listed = groups.first_per_path(v.files_docs(spark, sf).drop("media_type", "ext"), "doc_id")
    return keep_media(listed).select("path", "size", "mtime", "media_type",
                                     extension("path", "dotted").alias("ext"))


def ext_counts(spark: SparkSession, sf: str) -> DataFrame:
    return browse.ext_counts(v.files_docs(spark, sf))


def media_available_exts(spark: SparkSession, sf: str) -> DataFrame:
    return browse.available_exts(v.media_docs(spark, sf))


def filename_groups(spark: SparkSession, sf: str) -> DataFrame:
    members = groups.filename_members(Workspace(spark), v.media_docs(spark, sf))
    return groups.group_table(members).select(*GROUP_COLUMNS)


def exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    members = groups.exact_members(Workspace(spark), v.media_docs(spark, sf))
    return groups.group_table(members).select(*GROUP_COLUMNS)


def part_name_groups(spark: SparkSession, sf: str) -> DataFrame:
    parts = v.table(spark, sf, "part").select(
        F.col("p_name").alias("path"), F.col("p_size").cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("media_type"))
    members = groups.filename_members(Workspace(spark), parts)
    return groups.group_table(members).select("group_id", "n_files", "wasted_bytes", "first_path")


def page_exact_hash(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "pages").select("page_id", fp.content_digest("html").alias("exact_hash"))


def hex_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    forms = F.array(F.col("phash"), F.upper("phash"), F.concat(F.lit("+"), "phash"),
                    F.concat(F.lit("000"), "phash"), F.concat("phash", F.lit("0")),
                    F.concat(F.lit("zz"), "phash"), F.lit(""), F.substring("phash", 1, 5))
    texts = v.dhash_embeddings(spark, sf).select("vec_id", F.posexplode(forms).alias("form", "text"))
    return texts.select("vec_id", "form", fp.parse_hex("text").alias("fp"),
                        fp.to_hex(fp.parse_hex("text")).alias("hex"))


def adjacent_distance(spark: SparkSession, sf: str) -> DataFrame:
    hashes = v.dhash_embeddings(spark, sf)
    after = hashes.select((F.col("vec_id") - 1).alias("vec_id"), F.col("phash").alias("next"))
    return hashes.join(after, "vec_id").select("vec_id", fp.hamming_hex("phash", "next").cast("int").alias("d"))


def _pairs(spark: SparkSession, hashes: DataFrame, threshold: int, scheme=None) -> DataFrame:
    ws = Workspace(spark)
    fps, seen = ws.save_counted(hashes.select(fp.parse_hex("phash").alias("fp")).distinct(), "fps")
    found = similar_pairs(ws, fps, seen["n"], threshold, scheme)
    a, b = fp.to_hex("a"), fp.to_hex("b")
    return found.select(F.least(a, b).alias("phash_a"), F.greatest(a, b).alias("phash_b"), F.col("d").cast("int"))


def hamming_pairs_t16(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, v.dhash_embeddings(spark, sf), 16)


def hamming_pairs_planted_t8(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, v.dhash_planted(spark, sf), 8)


def _stars(spark: SparkSession, hashes: DataFrame, threshold: int) -> groups.Stars:
    return groups.find_stars(Workspace(spark), hashes.select("phash", F.col("vec_id").alias("ord")), threshold)


def _star_nodes(stars: groups.Stars) -> DataFrame:
    return stars.nodes.select(F.col("key").alias("phash"), F.col("rk").alias("first_id"),
                              F.col("owner").alias("owner_id"), F.col("n").alias("n_rows"))


def stars_t20(spark: SparkSession, sf: str) -> DataFrame:
    return _star_nodes(_stars(spark, v.dhash_embeddings(spark, sf), 20))


def stars_planted_t8(spark: SparkSession, sf: str) -> DataFrame:
    return _star_nodes(_stars(spark, v.dhash_planted(spark, sf), 8))


def star_max_distance(spark: SparkSession, sf: str) -> DataFrame:
    found = _stars(spark, v.dhash_embeddings(spark, sf), 20).groups
    return found.select(F.col("owner").alias("owner_id"), F.col("n").alias("n_rows"),
                        F.col("max_distance").cast("int").alias("max_distance"))


def similarity_pct(spark: SparkSession, sf: str) -> DataFrame:
    found = _stars(spark, v.dhash_planted(spark, sf), 8).groups
    return found.select(F.col("owner").alias("owner_id"), fp.similarity_pct("max_distance").alias("pct"),
                        fp.kind_label(F.lit("perceptual"), "max_distance").alias("label"))


def frame_pairs_min(spark: SparkSession, sf: str) -> DataFrame:
    frames = v.frames_embeddings(spark, sf).select(F.col("video").alias("item"), fp.parse_hex("phash").alias("fp"))
    found = similar_frame_sets(Workspace(spark), frames, 18)
    return found.select(F.col("a").alias("video_a"), F.col("b").alias("video_b"), F.col("d").cast("int"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return v.frames_embeddings(spark, sf).select(
        F.col("video").alias("path"), "frame_idx", ((F.col("frame_idx") + 0.5) / 4).alias("position"),
        fp.parse_hex("phash").alias("fp"))


def video_strategies(spark: SparkSession, sf: str) -> DataFrame:
    frames = _frames(spark, sf)
    first = frame_source.video_fingerprints(frames, "first_frame").withColumnRenamed("phash", "first_frame")
    multi = frame_source.video_fingerprints(frames, "multi_frame").withColumnRenamed("phash", "multi_frame")
    middle = frame_source.video_fingerprints(frames, "multi_frame", 1).withColumnRenamed("phash", "middle_frame")
    return first.join(multi, "path").join(middle, "path").withColumnRenamed("path", "video")


def frame_set_distance(spark: SparkSession, sf: str) -> DataFrame:
    sets = frame_source.video_fingerprints(_frames(spark, sf), "multi_frame").select(
        F.col("path").cast("bigint").alias("video"), fp.split_frames("phash").alias("x"))
    after = sets.select((F.col("video") - 1).alias("video"), F.col("x").alias("y"))
    return sets.join(after, "video").select("video", fp.min_frame_distance("x", "y").cast("int").alias("d"))


def frame_stars(spark: SparkSession, sf: str) -> DataFrame:
    videos = frame_source.video_fingerprints(_frames(spark, sf), "multi_frame")
    stars = groups.find_stars(Workspace(spark), videos.select("phash", F.col("path").cast("bigint").alias("ord")), 18)
    kept = stars.groups.select("owner", "max_distance")
    return stars.nodes.join(kept, "owner").select(
        F.col("rk").alias("video"), F.col("owner").alias("owner_video"),
        F.col("max_distance").cast("int").alias("max_distance"))


def _members(spark: SparkSession, sf: str, mode: str = "both") -> tuple[Workspace, DataFrame]:
    ws = Workspace(spark)
    return ws, groups.find_members(ws, v.records_docs(spark, sf), mode, 8, unique_paths=True)


def _kept_members(spark: SparkSession, sf: str) -> tuple[Workspace, DataFrame]:
    ws, members = _members(spark, sf)
    return ws, ws.save(members, "members")


def find_duplicates_filename(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf, "filename")[1]


def find_duplicates_content(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf, "content")[1]


def find_duplicates_both(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf, "both")[1]


def group_records(spark: SparkSession, sf: str) -> DataFrame:
    return groups.group_table(_members(spark, sf)[1]).select(
        *GROUP_COLUMNS, fp.kind_label("duplicate_type", "max_distance").alias("label"),
        fp.mebibytes("wasted_bytes", 2).alias("wasted_mib"))


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    records = v.dhash_embeddings(spark, sf).select(
        F.concat(F.lit("/v/"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("path"),
        F.col("vec_id").alias("size"), F.lit("image").alias("media_type"),
        F.lit(None).cast("string").alias("exact_hash"), "phash")
    swept = groups.threshold_sweep(Workspace(spark), records, (12, 16, 20), "content", unique_paths=True)
    out = None
    for t, members in swept.items():
        one = groups.group_table(members).select(F.lit(t).alias("threshold"), "first_path", "n_files",
                                                 "wasted_bytes", "max_distance")
        out = one if out is None else out.unionByName(one)
    return out


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    return v.media_docs(spark, sf).select("path", "doc_id").join(v.areas(spark, sf), "doc_id").select("path", "area")


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    """Files with an exact copy and an even number."""
    ws = Workspace(spark)
    media = v.media_docs(spark, sf)
    even = media.where("doc_id % 2 = 0").select("path")
    return groups.exact_members(ws, media).select("path").join(even, "path", "left_semi")


def priority_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return v.files_docs(spark, sf).select("doc_id", priority_index("path", v.PRIORITIES).alias("prio"))


def keeper_priority(spark: SparkSession, sf: str) -> DataFrame:
    return keeper.keepers(_members(spark, sf)[1], v.PRIORITIES, "priority").select("group_id", "keeper")


def keeper_quality(spark: SparkSession, sf: str) -> DataFrame:
    return keeper.keepers(_members(spark, sf)[1], v.PRIORITIES, "quality",
                          _areas(spark, sf)).select("group_id", "keeper")


def auto_mark_all(spark: SparkSession, sf: str) -> DataFrame:
    ws, members = _kept_members(spark, sf)
    return keeper.auto_mark(ws, members, v.PRIORITIES, "priority")


def _first_group(members: DataFrame) -> str:
    return members.agg(F.min("group_id")).first()[0]


def auto_mark_group(spark: SparkSession, sf: str) -> DataFrame:
    ws, members = _kept_members(spark, sf)
    return keeper.auto_mark_group(ws, members, _first_group(members), v.PRIORITIES, "priority")


def keep_nth(spark: SparkSession, sf: str) -> DataFrame:
    ws, members = _kept_members(spark, sf)
    return keeper.keep_nth(ws, members, 3)


def mark_sets(spark: SparkSession, sf: str) -> DataFrame:
    _, members = _kept_members(spark, sf)
    ids = members.select("group_id", "duplicate_type").distinct()
    more = review.mark_groups(_marks(spark, sf), members, ids.where("duplicate_type = 'filename'"))
    return review.keep_groups(more, members, ids.where("duplicate_type = 'perceptual'"))


def survivors(spark: SparkSession, sf: str) -> DataFrame:
    return review.survivors(_members(spark, sf)[1], _marks(spark, sf))


def extinction_guard(spark: SparkSession, sf: str) -> DataFrame:
    return review.extinct_groups(_members(spark, sf, "content")[1], _marks(spark, sf))


def deletion_manifest(spark: SparkSession, sf: str) -> DataFrame:
    found = review.deletion_manifest(_marks(spark, sf), _members(spark, sf)[1])
    return found.select("path", F.array_join("group_ids", ",").alias("group_ids"), "size")


def apply_deletions(spark: SparkSession, sf: str) -> DataFrame:
    ws, members = _kept_members(spark, sf)
    left = review.apply_deletions(ws, members, v.records_docs(spark, sf), _marks(spark, sf), True)[0]
    return left.select(*GROUP_COLUMNS)


def marked_totals(spark: SparkSession, sf: str) -> DataFrame:
    return review.marked_totals(_marks(spark, sf), _members(spark, sf)[1])


def best_in_group(spark: SparkSession, sf: str) -> DataFrame:
    ws, members = _kept_members(spark, sf)
    return review.best_in_group(ws, members, _areas(spark, sf))


def common_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return review.common_prefix(groups.exact_members(Workspace(spark), v.media_docs(spark, sf)))


def folder_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return v.files_docs(spark, sf).select("doc_id", folder_index("path", v.PRIORITIES).alias("folder_idx"))


def folder_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return review.folder_matrix(_members(spark, sf)[1], v.PRIORITIES)


def mark_column_preview(spark: SparkSession, sf: str) -> DataFrame:
    return review.mark_column_preview(_members(spark, sf)[1], _marks(spark, sf), v.PRIORITIES)


def groups_all_ext(spark: SparkSession, sf: str) -> DataFrame:
    _, members = _kept_members(spark, sf)
    return browse.groups_all_ext(groups.group_table(members), members, ".jpg").select(*GROUP_COLUMNS)


def groups_page(spark: SparkSession, sf: str) -> DataFrame:
    _, members = _kept_members(spark, sf)
    return browse.page_of_groups(groups.group_table(members), 1, "size-desc").select(*GROUP_COLUMNS)


def one_group(spark: SparkSession, sf: str) -> DataFrame:
    _, members = _kept_members(spark, sf)
    return browse.one_group(groups.group_table(members), _first_group(members)).select(*GROUP_COLUMNS)


def pixel_areas(spark: SparkSession, sf: str) -> DataFrame:
    height = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 7 - 1)
    return v.table(spark, sf, "documents").select("doc_id", fp.pixel_area(F.col("n_chars"), height).alias("area"))


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    return browse.image_files(_members(spark, sf)[1]).select("group_id", "path")


def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, members = _kept_members(spark, sf)
    return browse.result_summary(groups.group_table(members), members, ".jpg")


def _older_store(spark: SparkSession, sf: str) -> DataFrame:
    records = v.records_docs(spark, sf)
    kept = records.where("doc_id % 10 <> 0").withColumn(
        "mtime", F.when(F.col("doc_id") % 10 == 1, F.col("mtime") - 1).otherwise(F.col("mtime")))
    gone = records.where("doc_id % 100 = 0").withColumn("path", F.concat(F.lit("/gone"), "path"))
    return kept.unionByName(gone).select("path", "size", "mtime", "media_type", "exact_hash", "phash").withColumn(
        "fp_profile", F.lit(PROFILE)).withColumn("scanned_at", F.lit(0).cast("bigint"))


def store_hits(spark: SparkSession, sf: str) -> DataFrame:
    files = v.records_docs(spark, sf).select("path", "size", "mtime", "media_type")
    hits, misses = split_by_store(files, _older_store(spark, sf), PROFILE)
    none = F.lit(None).cast("string")
    return (hits.select("path", F.lit(True).alias("hit"), "exact_hash", "phash")
            .unionByName(misses.select("path", F.lit(False).alias("hit"), none.alias("exact_hash"),
                                       none.alias("phash"))))


def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    files = v.records_docs(spark, sf)
    old = _older_store(spark, sf)
    misses = split_by_store(files.select("path", "size", "mtime", "media_type"), old, PROFILE)[1]
    new = misses.join(files.select("path", "exact_hash", "phash"), "path")
    return merged(old, new).select("path", "size", "mtime", "exact_hash", "phash",
                                   (F.col("scanned_at") > 0).alias("fresh"))


def stats_of_store(spark: SparkSession, sf: str) -> DataFrame:
    return store_stats(v.records_docs(spark, sf).select("path", "size", "mtime"), _older_store(spark, sf), PROFILE)


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream of files into a store."""
    ws = Workspace(spark)
    stream = v.table_stream(spark, sf, "documents")
    store = Snapshot(spark, f"{ws.root}/store")

    def rows(batch: DataFrame) -> DataFrame:
        return batch.select(F.concat(F.lit("/doc/"), "doc_id").alias("path"), F.col("n_chars").alias("size"),
                            F.col("doc_id").alias("mtime"), F.lit("image").alias("media_type"),
                            fp.content_digest("text").alias("exact_hash"), F.lit(PROFILE).alias("fp_profile"))

    ingest_stream(stream, store, f"{ws.root}/progress", rows).awaitTermination()
    return store.read().select("path", "size", "mtime", "exact_hash")


def _last_state(spark: SparkSession, sf: str, columns: list, counters, keys: list[str]) -> DataFrame:
    """The state of counters after the last batch of the events, from what each batch changed."""
    ws = Workspace(spark)
    stream = v.table_stream(spark, sf, "events")
    events = stream.select(F.col("user_id").cast("string").alias("scan_id"), F.col("ts").cast("timestamp").alias("event_time"),
                           F.lit("hashing").alias("phase"), *columns)
    changed = []

    def keep(batch: DataFrame, number: int) -> None:
        changed.append(ws.save(batch.withColumn("batch", F.lit(number)), "changes"))

    (counters(events).writeStream.outputMode("update").foreachBatch(keep)
     .option("checkpointLocation", f"{ws.root}/progress").trigger(availableNow=True).start().awaitTermination())
    every = reduce(DataFrame.unionByName, changed)
    values = [c for c in every.columns if c not in (*keys, "batch")]
    return every.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def stream_ext_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of progress events; the state after the last batch."""
    columns = [F.concat(F.lit("/e/"), "event_id", F.lit("."), "event_type").alias("path"),
               F.when(F.col("event_id") % 5 == 0, F.create_map("event_type", (F.col("event_id") % 7).cast("int")))
               .alias("ext_deltas")]
    return _last_state(spark, sf, columns, running_ext_counts, ["scan_id", "ext"])


def stream_cached(spark: SparkSession, sf: str) -> DataFrame:
    columns = [(F.col("event_id") % 1000).alias("current"),
               F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50).alias("cached")]
    return _last_state(spark, sf, columns, running_cached, ["scan_id"])


def sample_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    durations = v.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 120 * 1.5 + 0.5).alias("dur"))
    return durations.select("vec_id", fp.sample_instant("dur", 0.05).alias("first"),
                            F.explode(fp.sample_windows("dur", 8)).alias("w")).select(
        "vec_id", F.round("first", 6).alias("first_at"), "w.idx", F.round("w.start", 6).alias("start_at"),
        F.round("w.end", 6).alias("end_at"))


def dhash_luma(spark: SparkSession, sf: str) -> DataFrame:
    return v.luma_embeddings(spark, sf).select("vec_id", fp.to_hex(dhash_luma8("luma")).alias("phash"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id") - F.col("event_id") % 7 * 300
    return v.progress_events(spark, sf).select("user_id", "t_ms", n.alias("n"),
                                               (F.col("event_id") + 5000).alias("total"))


def trailing_rate(spark: SparkSession, sf: str) -> DataFrame:
    rated = progress.with_share(progress.with_eta(progress.trailing_rate(_log(spark, sf), "user_id", DAY_MS)))
    return rated.select("user_id", "t_ms", "n", "rate", "eta_s", "share_pct")


def ema_rate(spark: SparkSession, sf: str) -> DataFrame:
    return progress.ema_rate(_log(spark, sf), "user_id").select(
        "user_id", "t_ms", "instant", F.round("ema", 6).alias("ema"))


QUERIES = {
    "media_catalog": media_catalog,
    "ext_counts": ext_counts,
    "media_available_exts": media_available_exts,
    "filename_groups": filename_groups,
    "exact_groups": exact_groups,
    "part_name_groups": part_name_groups,
    "page_exact_hash": page_exact_hash,
    "hex_roundtrip": hex_roundtrip,
    "adjacent_distance": adjacent_distance,
    "hamming_pairs_t16": hamming_pairs_t16,
    "hamming_pairs_planted_t8": hamming_pairs_planted_t8,
    "stars_t20": stars_t20,
    "stars_planted_t8": stars_planted_t8,
    "star_max_distance": star_max_distance,
    "similarity_pct": similarity_pct,
    "frame_pairs_min": frame_pairs_min,
    "frame_set_distance": frame_set_distance,
    "video_strategies": video_strategies,
    "frame_stars": frame_stars,
    "find_duplicates_filename": find_duplicates_filename,
    "find_duplicates_content": find_duplicates_content,
    "find_duplicates_both": find_duplicates_both,
    "group_records": group_records,
    "threshold_sweep": threshold_sweep,
    "priority_prefix": priority_prefix,
    "keeper_priority": keeper_priority,
    "keeper_quality": keeper_quality,
    "auto_mark_all": auto_mark_all,
    "auto_mark_group": auto_mark_group,
    "keep_nth": keep_nth,
    "mark_sets": mark_sets,
    "survivors": survivors,
    "extinction_guard": extinction_guard,
    "deletion_manifest": deletion_manifest,
    "apply_deletions": apply_deletions,
    "marked_totals": marked_totals,
    "best_in_group": best_in_group,
    "common_prefix": common_prefix,
    "folder_longest_prefix": folder_longest_prefix,
    "folder_matrix": folder_matrix,
    "mark_column_preview": mark_column_preview,
    "groups_all_ext": groups_all_ext,
    "groups_page": groups_page,
    "one_group": one_group,
    "pixel_areas": pixel_areas,
    "image_files": image_files,
    "result_summary": result_summary,
    "store_hits": store_hits,
    "store_upsert": store_upsert,
    "store_stats": stats_of_store,
    "stream_ingest": stream_ingest,
    "stream_ext_counts": stream_ext_counts,
    "stream_cached": stream_cached,
    "sample_timestamps": sample_timestamps,
    "dhash_luma": dhash_luma,
    "trailing_rate": trailing_rate,
    "ema_rate": ema_rate,
}
