"""The same queries in SQL for DuckDB, written independently of the Spark code."""

from __future__ import annotations

# Folders in order of priority.
PRIORITIES = "['/lib/src1', '/lib/src2/en', '/lib/src2', '/lib/src']"

# Named building blocks; each may use the ones listed before its text.
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "files_docs": ((), """
        select doc_id, n_chars as size, 1700000000 + doc_id as mtime, ext,
               '/lib/' || source || '/' || lang || '/' || name || ext as path,
               case n_chars % 5 when 2 then 'video' when 4 then null else 'image' end as media_type,
               case when doc_id % 17 = 0 then null else sha256(text) end as exact_hash
        from (select *, case n_chars % 5 when 1 then '.PNG' when 2 then '.mp4' when 4 then '.txt' else '.jpg' end
                     as ext,
                     case when doc_id % 3 = 0 then 'g' || doc_id
                          when doc_id % 2 = 0 then upper('f' || substring(md5(text), 1, 5))
                          else 'f' || substring(md5(text), 1, 5) end as name
              from documents)"""),
    "media": (("files_docs",), """
        select * from files_docs where media_type is not null
        qualify row_number() over (partition by path order by doc_id) = 1"""),
    "dhash": ((), """
        select vec_id, lower(lpad(hex(list_sum([case when embedding[i] > embedding[i + 1]
               then (1::hugeint << (i - 1)) else 0::hugeint end for i in range(1, 64)])::ubigint), 16, '0')) as phash
        from embeddings"""),
    "planted": (("dhash",), """
        select e.vec_id, lower(lpad(hex(xor(('0x' || b.phash)::ubigint,
               case e.vec_id % 3 when 0 then 0::ubigint when 1 then 1::ubigint << (e.vec_id % 61)
               else (32 + 131072 + 1099511627776)::ubigint end)), 16, '0')) as phash
        from embeddings e join dhash b on b.vec_id = e.vec_id - e.vec_id % 3"""),
    "records": (("media", "planted"), """
        select m.*, p.phash from media m left join planted p on p.vec_id = m.doc_id and p.vec_id % 13 <> 0"""),
    "named": (("records",), """
        select *, lower(regexp_extract(path, '[^/]*$')) as name from records"""),
    "by_name": (("named",), """
        select *, sha256('filename|' || name || '|' || size) as group_id from named
        qualify count(*) over (partition by name, size) >= 2"""),
    "by_hash": (("records",), """
        select *, sha256('exact|' || exact_hash) as group_id from records where exact_hash is not null
        qualify count(*) over (partition by exact_hash) >= 2"""),
    "unnamed": (("records", "by_name"), "select * from records where path not in (select path from by_name)"),
    "marks": (("by_hash",), "select distinct path from by_hash where doc_id % 2 = 0"),
    "areas": (("media",), """
        select m.path, case when l.quality is null then 0 else l.quality * 1000 + m.size % 10 end::bigint as area
        from media m left join labels l on l.doc_id = m.doc_id"""),
    "exact_unnamed": (("unnamed",), """
        select *, sha256('exact|' || exact_hash) as group_id from unnamed where exact_hash is not null
        qualify count(*) over (partition by exact_hash) >= 2"""),
}


def stars(prefix: str, nodes: str, threshold: int) -> dict[str, tuple[tuple[str, ...], str]]:
    """Blocks of the literal greedy rule over nodes(phash, ord, n): one step per node."""
    p = prefix
    return {
        f"{p}_ranked": ((), f"""
            select *, ('0x' || phash)::ubigint as fp, row_number() over (order by ord) as r from ({nodes})"""),
        f"{p}_walk": ((f"{p}_ranked",), f"""
            select 0::bigint as r, []::ubigint[] as s
            union all
            select k.r, case when len(list_filter(s, lambda x: bit_count(xor(x, k.fp)) <= {threshold})) = 0
                             then list_append(s, k.fp) else s end
            from {p}_walk g join {p}_ranked k on k.r = g.r + 1"""),
        f"{p}_last": ((f"{p}_walk",), f"select s from {p}_walk order by r desc limit 1"),
        f"{p}_own": ((f"{p}_ranked", f"{p}_last"), f"""
            select k.*, o.phash as owner, o.ord as owner_ord
            from (select r.*, list_filter(l.s, lambda x: bit_count(xor(x, r.fp)) <= {threshold})[1] as seed
                  from {p}_ranked r, {p}_last l) k
            join {p}_ranked o on o.fp = k.seed"""),
        f"{p}_far": ((f"{p}_own",), f"""
            select a.owner, max(bit_count(xor(a.fp, b.fp)))::int as far
            from {p}_own a join {p}_own b on a.owner = b.owner group by a.owner"""),
        f"{p}_groups": ((f"{p}_own", f"{p}_far"), f"""
            select o.owner, any_value(o.owner_ord) as owner_ord, sum(o.n)::bigint as n, any_value(f.far) as far
            from {p}_own o join {p}_far f on f.owner = o.owner group by o.owner having sum(o.n) >= 2"""),
    }


def record_nodes(source: str) -> str:
    return (f"select phash, min(string_split(path, '/')) as ord, count(*) as n from {source} "
            "where phash is not null group by phash")


VEC_NODES = "select phash, min(vec_id) as ord, count(*) as n from {} group by phash"
BLOCKS |= stars("content", record_nodes("records"), 8)
BLOCKS["content_ranked"] = (("records",), BLOCKS["content_ranked"][1])
BLOCKS |= stars("rest", record_nodes("unnamed"), 8)
BLOCKS["rest_ranked"] = (("unnamed",), BLOCKS["rest_ranked"][1])
BLOCKS |= stars("planted8", VEC_NODES.format("planted"), 8)
BLOCKS["planted8_ranked"] = (("planted",), BLOCKS["planted8_ranked"][1])
for _t in (12, 16, 20):
    BLOCKS |= stars(f"dhash{_t}", VEC_NODES.format("dhash"), _t)
    BLOCKS[f"dhash{_t}_ranked"] = (("dhash",), BLOCKS[f"dhash{_t}_ranked"][1])


def _members(kind: str, source: str) -> str:
    return f"""select group_id, '{kind}' as duplicate_type, null::int as max_distance, path, size, media_type
               from {source}"""


def _star_members(prefix: str, source: str) -> str:
    return f"""select sha256('perceptual|' || g.owner) as group_id, 'perceptual' as duplicate_type,
                      g.far as max_distance, r.path, r.size, r.media_type
               from {source} r join {prefix}_own o on o.phash = r.phash join {prefix}_groups g on g.owner = o.owner"""


BLOCKS |= {
    "filename_m": (("by_name",), _members("filename", "by_name")),
    "content_m": (("by_hash", "records", "content_own", "content_groups"),
                  _members("exact", "by_hash") + " union all " + _star_members("content", "records")),
    "both_m": (("by_name", "exact_unnamed", "unnamed", "rest_own", "rest_groups"),
               _members("filename", "by_name") + " union all " + _members("exact", "exact_unnamed")
               + " union all " + _star_members("rest", "unnamed")),
    "both_g": (("both_m",), """
        select group_id, duplicate_type, max_distance, count(*) as n_files,
               (sum(size) - max(size))::bigint as wasted_bytes, array_to_string(min(string_split(path, '/')), '/')
               as first_path
        from both_m group by all"""),
    "ranked_m": (("both_m",), f"""
        select *, coalesce(list_min([i for i in range(1, 5) if starts_with(path, {PRIORITIES}[i])]), 99) as prio,
               string_split(path, '/') as ord
        from both_m"""),
    "kept_m": (("ranked_m",), """
        select group_id, path as keeper from ranked_m
        qualify row_number() over (partition by group_id order by prio, ord) = 1"""),
    "marked_m": (("both_m", "marks"), """
        select m.*, k.path is not null as marked from both_m m left join marks k on k.path = m.path"""),
    "left_m": (("marked_m",), """
        select * from marked_m where not marked
        qualify count(*) over (partition by group_id) >= 2"""),
    "left_far": (("left_m", "records"), """
        select a.group_id, max(bit_count(xor(('0x' || x.phash)::ubigint, ('0x' || y.phash)::ubigint)))::int as far
        from left_m a join left_m b on a.group_id = b.group_id
        join records x on x.path = a.path join records y on y.path = b.path
        where a.duplicate_type = 'perceptual' group by a.group_id"""),
    "foldered": (("files_docs",), f"""
        select *, coalesce((select i - 1 from (select unnest(range(1, 5)) as i)
                   where starts_with(path, {PRIORITIES}[i] || '/') or path = {PRIORITIES}[i]
                   order by len({PRIORITIES}[i]) desc, i limit 1), -1)::int as folder_idx
        from files_docs"""),
    "placed_m": (("marked_m", "foldered"), """
        select m.*, f.folder_idx from marked_m m
        join (select distinct path, folder_idx from foldered) f on f.path = m.path"""),
    "older": (("records",), """
        select path, size, mtime - (doc_id % 10 = 1)::int as mtime, exact_hash, phash from records
        where doc_id % 10 <> 0
        union all select '/gone' || path, size, mtime, exact_hash, phash from records where doc_id % 100 = 0"""),
    "looked": (("records", "older"), """
        select r.*, o.path is not null as hit from records r
        left join older o on o.path = r.path and o.size = r.size and o.mtime = r.mtime"""),
    "frames": (("dhash",), """
        select vec_id // 4 as video, (vec_id % 4)::int as frame_idx, phash, ('0x' || phash)::ubigint as fp
        from dhash"""),
    "videos": (("frames",), """
        select video, string_agg(phash, ';' order by frame_idx) as phash, list(fp order by frame_idx) as fps
        from frames group by video"""),
    "video_pairs": (("frames",), """
        select a.video as a, b.video as b, min(bit_count(xor(a.fp, b.fp)))::int as d
        from frames a join frames b on a.video < b.video group by 1, 2"""),
    "video_near": (("videos", "video_pairs"), """
        select v.video, coalesce((select list(p.a) from video_pairs p where p.b = v.video and p.d <= 18), []) as lower
        from videos v"""),
    "video_ranked": (("video_near",), "select *, row_number() over (order by video) as r from video_near"),
    "video_walk": (("video_ranked",), """
        select 0::bigint as r, []::bigint[] as s
        union all
        select k.r, case when list_has_any(s, k.lower) then s else list_append(s, k.video) end
        from video_walk g join video_ranked k on k.r = g.r + 1"""),
    # A video without an earlier seed in reach is its own seed.
    "video_own": (("video_ranked", "video_walk"), """
        select k.video, case when list_contains(w.s, k.video) then k.video
                             else list_min(list_intersect(k.lower, w.s)) end as owner
        from video_ranked k, (select s from video_walk order by r desc limit 1) w"""),
    "log": ((), """
        select user_id, epoch_us(ts) // 1000 as t_ms, event_id - event_id % 7 * 300 as n, event_id + 5000 as total
        from events"""),
    "luma": ((), """
        select vec_id, [floor(least(greatest((e::double + 1) * 127.5, 0), 255) + 0.5)::int for e in embedding] as l
        from embeddings"""),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in [*_needed(BLOCKS[name][0]), name]:
            if n not in out:
                out.append(n)
    return out


def _query(uses: str, text: str) -> str:
    names = _needed(tuple(uses.split()))
    recursive = "recursive " if any(n.endswith("_walk") for n in names) else ""
    blocks = ", ".join(f"{n} as ({BLOCKS[n][1]})" for n in names)
    return (f"with {recursive}{blocks} " if names else "") + text


GROUPS = """select group_id, duplicate_type, max_distance, count(*) as n_files,
                   (sum(size) - max(size))::bigint as wasted_bytes,
                   array_to_string(min(string_split(path, '/')), '/') as first_path
            from ({}) group by all"""
STAR_NODES = """select phash, ord as first_id, owner_ord as owner_id, n as n_rows from {}_own"""
SWEEP = """select {0} as threshold, '/v/' || lpad(owner_ord::varchar, 12, '0') as first_path, g.n as n_files,
                  w.wasted as wasted_bytes, far as max_distance
           from dhash{0}_groups g join (
             select o.owner, (sum(d.vec_id) - max(d.vec_id))::bigint as wasted
             from dhash{0}_own o join dhash d on d.phash = o.phash group by o.owner) w on w.owner = g.owner"""
SIGNED = "case when h >= 9223372036854775808 then h - 18446744073709551616 else h end::bigint"

ORACLE = {
    "media_catalog": _query("media", "select path, size, mtime, media_type, lower(ext) as ext from media"),
    "ext_counts": _query("files_docs", "select lower(ext) as ext, count(*) as n from files_docs group by 1"),
    "media_available_exts": _query("media", "select distinct lower(ext) as ext from media"),
    "filename_groups": _query("filename_m", GROUPS.format("select * from filename_m")),
    "exact_groups": _query("by_hash", GROUPS.format(_members("exact", "by_hash"))),
    "part_name_groups": """
        select sha256('filename|' || lower(p_name) || '|' || p_size) as group_id, count(*) as n_files,
               (sum(p_size) - max(p_size))::bigint as wasted_bytes, min(p_name) as first_path
        from part group by lower(p_name), p_size having count(*) >= 2""",
    "page_exact_hash": "select page_id, sha256(html) as exact_hash from pages",
    "hex_roundtrip": _query("dhash", f"""
        select vec_id, form, {SIGNED} as fp, lower(lpad(hex(h::ubigint), 16, '0')) as hex
        from (select vec_id, form, case when regexp_full_match(t, '[+]?0*[0-9a-fA-F]{{1,16}}')
                                   then ('0x' || right('0' || ltrim(t, '+'), 16))::ubigint::hugeint end as h
              from (select vec_id, unnest(range(8))::int as form, unnest([phash, upper(phash), '+' || phash,
                    '000' || phash, phash || '0', 'zz' || phash, '', substring(phash, 1, 5)]) as t from dhash))"""),
    "adjacent_distance": _query("dhash", """
        select a.vec_id, bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint))::int as d
        from dhash a join dhash b on b.vec_id = a.vec_id + 1"""),
    **{f"hamming_pairs_{name}": _query(view, f"""
        select * from (
          select a.phash as phash_a, b.phash as phash_b,
                 bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint))::int as d
          from (select distinct phash from {view}) a join (select distinct phash from {view}) b
            on a.phash < b.phash) where d <= {t}""")
       for name, view, t in (("t16", "dhash", 16), ("planted_t8", "planted", 8))},
    "stars_t20": _query("dhash20_own", STAR_NODES.format("dhash20")),
    "stars_planted_t8": _query("planted8_own", STAR_NODES.format("planted8")),
    "star_max_distance": _query("dhash20_groups", """
        select owner_ord as owner_id, n as n_rows, far as max_distance from dhash20_groups"""),
    "similarity_pct": _query("planted8_groups", """
        select owner_ord as owner_id, round((64 - far) / 64.0 * 100)::int as pct,
               case far when 0 then 'identical' else 'similar' end as label from planted8_groups"""),
    "frame_pairs_min": _query("video_pairs", """
        select a::varchar as video_a, b::varchar as video_b, d from
        (select least(a::varchar, b::varchar) as a, greatest(a::varchar, b::varchar) as b, d from video_pairs)
        where d <= 18"""),
    "frame_set_distance": _query("video_pairs", "select a as video, d from video_pairs where b = a + 1"),
    "video_strategies": _query("videos frames", """
        select v.video::varchar as video, f.phash as first_frame, v.phash as multi_frame,
               coalesce(m.phash, f.phash) as middle_frame
        from videos v join frames f on f.video = v.video and f.frame_idx = 0
        left join frames m on m.video = v.video and m.frame_idx = 1"""),
    "frame_stars": _query("video_own video_pairs", """
        select o.video, o.owner as owner_video, g.far as max_distance
        from video_own o join (
          select x.owner, max(p.d) as far from video_own x join video_own y on x.owner = y.owner
          join video_pairs p on p.a = x.video and p.b = y.video group by x.owner) g on g.owner = o.owner"""),
    "find_duplicates_filename": _query("filename_m", "select * from filename_m"),
    "find_duplicates_content": _query("content_m", "select * from content_m"),
    "find_duplicates_both": _query("both_m", "select * from both_m"),
    "group_records": _query("both_g", """
        select *, case when duplicate_type <> 'perceptual' then duplicate_type
                       when max_distance = 0 then 'identical' else 'similar' end as label,
               round(wasted_bytes / 1048576, 2) as wasted_mib from both_g"""),
    "threshold_sweep": _query("dhash dhash12_groups dhash16_groups dhash20_groups",
                              " union all ".join(SWEEP.format(t) for t in (12, 16, 20))),
    "priority_prefix": _query("files_docs", f"""
        select doc_id, coalesce(list_min([i - 1 for i in range(1, 5) if starts_with(path, {PRIORITIES}[i])]),
                                2147483647)::int as prio from files_docs"""),
    "keeper_priority": _query("kept_m", "select * from kept_m"),
    "keeper_quality": _query("ranked_m areas", """
        select group_id, arg_max(m.path, {'a': a.area, 'p': -prio, 'o': ord}) as keeper
        from ranked_m m join areas a on a.path = m.path group by group_id"""),
    "auto_mark_all": _query("both_m kept_m", """
        select m.group_id, m.path from both_m m join kept_m k on k.group_id = m.group_id and k.keeper <> m.path"""),
    "auto_mark_group": _query("both_m kept_m", """
        select m.group_id, m.path from both_m m join kept_m k on k.group_id = m.group_id and k.keeper <> m.path
        where m.group_id = (select min(group_id) from both_m)"""),
    "keep_nth": _query("ranked_m", """
        select group_id, path from (
          select group_id, path, row_number() over (partition by group_id order by ord) as k,
                 count(*) over (partition by group_id) as n from ranked_m)
        where n >= 3 and k <> 3"""),
    "mark_sets": _query("both_m marks", """
        (select path from marks union select path from both_m where duplicate_type = 'filename')
        except select path from both_m where duplicate_type = 'perceptual'"""),
    "survivors": _query("marked_m", """
        select group_id, count(*) as n_files, count(*) filter (not marked) as survivors,
               count(*) filter (marked) as marked, bool_and(marked) as no_survivors
        from marked_m group by group_id"""),
    "extinction_guard": _query("content_m marks", """
        select group_id, count(*) as n_files from content_m group by group_id
        having bool_and(path in (select path from marks))"""),
    "deletion_manifest": _query("marks media both_m", """
        select k.path, coalesce(g.ids, '') as group_ids, g.size
        from marks k left join (select path, string_agg(distinct group_id, ',' order by group_id) as ids,
                                       max(size) as size from both_m group by path) g on g.path = k.path"""),
    "apply_deletions": _query("left_m left_far", """
        select l.group_id, l.duplicate_type, f.far as max_distance, count(*) as n_files,
               (sum(size) - max(size))::bigint as wasted_bytes,
               array_to_string(min(string_split(path, '/')), '/') as first_path
        from left_m l left join left_far f on f.group_id = l.group_id group by all"""),
    "marked_totals": _query("marks both_m", """
        select count(*) as n_marked, coalesce(sum(size), 0)::bigint as bytes,
               round(coalesce(sum(size), 0) / 1048576, 1) as mib
        from marks k left join (select distinct path, size from both_m) f on f.path = k.path"""),
    "best_in_group": _query("both_m areas", """
        select group_id, m.path, area from both_m m join areas a on a.path = m.path
        qualify area = max(area) over (partition by group_id) and area > 0"""),
    "common_prefix": _query("by_hash", """
        select group_id, array_to_string(lo[1:len(lo) - coalesce(nullif(len(list_filter(range(1, len(lo) + 1),
               lambda i: list_slice(lo, 1, i) <> list_slice(hi, 1, i))), 0), 0)], '/') as prefix
        from (select group_id, min(string_split(path, '/')) as lo, max(string_split(path, '/')) as hi
              from by_hash group by group_id)"""),
    "folder_longest_prefix": _query("foldered", "select doc_id, folder_idx from foldered"),
    "folder_matrix": _query("placed_m", """
        select group_id, """ + ", ".join(f"count(*) filter (folder_idx = {i}) as f{i}" for i in range(4)) + """
        from placed_m group by group_id"""),
    "mark_column_preview": _query("placed_m", """
        select f::int as folder_idx, group_id from placed_m, (select unnest(range(4)) as f)
        group by f, group_id having bool_and(marked or folder_idx = f)"""),
    "groups_all_ext": _query("both_m both_g", """
        select * from both_g where group_id in (
          select group_id from both_m group by group_id having bool_and(lower(path) like '%.jpg'))"""),
    "groups_page": _query("both_g", """
        select * from both_g order by wasted_bytes desc, duplicate_type, string_split(first_path, '/'), group_id
        limit 50 offset 50"""),
    "one_group": _query("both_g", "select * from both_g where group_id = (select min(group_id) from both_g)"),
    "pixel_areas": """
        select doc_id, coalesce(greatest(n_chars * case when doc_id % 5 <> 0 then doc_id % 7 - 1 end, 0), 0) as area
        from documents""",
    "image_files": _query("both_m", "select group_id, path from both_m where media_type = 'image'"),
    "result_summary": _query("both_m", """
        select total, visible, visible || ' of ' || total || ' groups' as label from (
          select count(*) as total, count(*) filter (same) as visible from (
            select group_id, bool_and(lower(path) like '%.jpg') as same from both_m group by group_id))"""),
    "store_hits": _query("looked", """
        select path, hit, case when hit then exact_hash end as exact_hash, case when hit then phash end as phash
        from looked"""),
    "store_upsert": _query("looked older", """
        select path, size, mtime, exact_hash, phash, false as fresh from older
        where path not in (select path from looked where not hit)
        union all select path, size, mtime, exact_hash, phash, true from looked where not hit"""),
    "store_stats": _query("looked", """
        select count(*) filter (hit) as hits, count(*) filter (not hit) as misses, count(*) as total,
               count(*) filter (hit) / count(*) * 100 as hit_rate from looked"""),
    "stream_ingest": """
        select '/doc/' || doc_id as path, n_chars as size, doc_id as mtime, sha256(text) as exact_hash
        from documents""",
    "stream_cached": """
        select user_id::varchar as scan_id, max(event_id % 1000) as current,
               max(case when event_id % 3 <> 0 then event_id % 50 else 0 end) as cached from events group by 1""",
    "stream_ext_counts": """
        select user_id::varchar as scan_id, '.' || event_type as ext,
               sum(case when event_id % 5 = 0 then event_id % 7 else 1 end)::bigint as n
        from events group by 1, 2""",
    "sample_timestamps": """
        select vec_id, round(dur * 0.05, 6) as first_at, i::int as idx, round(s, 6) as start_at,
               round(least(s + 0.5, dur), 6) as end_at
        from (select vec_id, dur, i, least(greatest(dur * (i + 0.5) / 8, 0), dur - 0.01) as s
              from (select vec_id, (vec_id % 120 * 1.5 + 0.5)::double as dur, unnest(range(8)) as i
                    from embeddings))""",
    "dhash_luma": _query("luma", """
    , pixel as (select vec_id, y, x, l[(y * 8 + 1)::int] as edge, l,
                       (16 * x - 1) // 18 as i, (16 * x - 1) % 18 as k
                from luma, (select unnest(range(8)) as y), (select unnest(range(9)) as x)),
    v as (select vec_id, y, x, case when x = 0 then edge
                 else (l[(y * 8 + i + 1)::int] * (18 - k) + l[(y * 8 + least(i + 1, 7) + 1)::int] * k + 9) // 18 end as g
          from pixel)
    select a.vec_id, lower(lpad(hex(sum(case when a.g > b.g then 1::hugeint << (a.y * 8 + a.x)::int
           else 0::hugeint end)::ubigint), 16, '0')) as phash
    from v a join v b on b.vec_id = a.vec_id and b.y = a.y and b.x = a.x + 1 group by a.vec_id"""),
    "trailing_rate": _query("log", """
        select user_id, t_ms, n, rate, case when rate is not null and n > 0 then (total - n) / rate end as eta_s,
               n / total * 100 as share_pct
        from (select *, case when t_ms > t0 and n > n0 then (n - n0) / ((t_ms - t0) / 1000.0::double) end as rate
              from (select *, first(t_ms) over w as t0, first(n) over w as n0 from log
                    window w as (partition by user_id order by t_ms
                                 range between 86400000 preceding and current row)))"""),
    "ema_rate": _query("log", """
        select user_id, t_ms, instant,
               round(case when len(past) > 0 then list_reduce(past, lambda e, x: 0.1::double * x + 0.9::double * e)
                     end, 6) as ema
        from (select *, list_filter(list(instant) over (partition by user_id order by t_ms
                        rows between unbounded preceding and current row), lambda x: x is not null) as past
              from (select *, case when n >= lag(n) over u
                              then (n - lag(n) over u) / ((t_ms - lag(t_ms) over u) / 1000.0::double) end as instant
                    from log window u as (partition by user_id order by t_ms)))"""),
}
