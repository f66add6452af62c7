"""SQL counterparts of the queries that SQL can express."""

WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
                  sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when later then 'revisit' else 'response' end as record_type, case when later then first_id end as refers_to
from (select p.*, first_id, coalesce(payload_bytes >= 100 and first_id is not null and page_id is distinct from first_id,
                                     false) as later
      from p join f using (payload_digest))
"""

WORDS = r"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(
    lower="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

DECONTAMINATE = f"""
with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {WORDS} as w from benchmark),
win as (select distinct item, w[i:i + 12] as win from b, unnest(range(1, greatest(2, len(w) - 11))) t(i) where len(w) > 0),
lens as (select distinct len(win) as n from win),
runs as (select r, i, n, w[i:i + n - 1] as win from d, lens, unnest(range(1, len(w) - n + 2)) t(i) where len(w) >= n),
hits as (select r, i, n, item from runs join win using (win)),
words as (select r, count(distinct k) as n_hit from hits, unnest(range(i, i + n)) t(k) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct r, item from hits where item is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (r) left join items using (r)
"""

#: CRC-32 byte by byte, from the table of its 256 remainders.
IMPORTANCE = f"""
with remainders as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
b as (select {WORDS} as w from benchmark),
df as (select r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from d),
bf as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from b),
distinct_f as (select f, hex(encode(f)) as h from (select f from df union select f from bf)),
crc as (select f, xor(list_reduce(list_transform(range(0, len(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::bigint),
                                  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 as k
        from distinct_f, remainders),
s as (select k, count(*) as s from df join crc using (f) group by k),
t as (select k, count(*) as t from bf join crc using (f) group by k),
gains as (select k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from df) + 10000)
                                   / ((coalesce(s, 0) + 1)::double * ((select count(*) from bf) + 10000))))::bigint as gain
          from s full join t using (k)),
weights as (select r, floor(sum(gain)::double / count(*))::bigint as weight
            from df join crc using (f) join gains using (k) group by r),
scores as (select r, doc_id, len(w) as n_words, greatest(0, 2 * len(w) - 1)::bigint as n_features,
                  coalesce(weight, 0)::bigint as weight,
                  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[1:8])::bigint
                                                          + 0.5::double) / 4294967296)))::bigint as score
           from d left join weights using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as rank
           from scores where n_words >= 20)
select doc_id, n_features, weight, score,
       case when rank <= 25 * (select count(*) from ranked) // 100 then rank end as rank
from scores left join ranked using (r)
"""

ORACLE: dict[str, str] = {"op1_warc": WARC, "op6_decontaminate": DECONTAMINATE,
                          "op12_importance": IMPORTANCE}
