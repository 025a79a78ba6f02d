"""SQL for the queries of this subpackage that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


def _label(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '{_WHITE}|[_-]', '', 'g')), '')"


_SPLIT = f"case when lower({_strip('split')}) in ('train', 'val', 'test') then lower({_strip('split')}) when lower({_strip('split')}) in ('valid', 'validation') then 'val' end"


def _hashes(table: str, column: str, keep: str) -> str:
    """Rows of a table (columns keep) with the value h of their hash."""
    return f"""(select {keep}, ('0x' || lpad(x, 16, '0'))::ubigint as h from (select *, regexp_replace(lower({_strip(column)}), '^0x', '') as x from {table})
  where regexp_matches(x, '^[0-9a-f]{{1,16}}$') and ltrim(x, '0') <> '')"""


_FILE = f"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({_strip('source_path')}, '\\', '/'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'),
  '[^/]+/\\.\\./', '', 'g'), '[^/]+/\\.\\./', '', 'g'), '/$', ''), '')"""

_P5 = f"""s as (select count(distinct path) // 4 as s from clip_meta),
a as (select key, is_synthetic, count(distinct path) as available from (select path, {_label('label')} as key, is_synthetic from clip_meta) where key is not null and is_synthetic is not null group by all),
t as (select target_id, {_label('label')} as key, is_synthetic, greatest(min_rows, (share_bp * s + 9999) // 10000) as needed from mixture_target cross join s)
"""
_P6 = f"""latest as (select path, {_label('arg_max(label, coalesce(ingested_at, timestamp \'1000-01-01\'))')} as key, arg_max(blur_score, coalesce(ingested_at, timestamp '1000-01-01')) as score from (
  select * from clip_meta qualify row_number() over (partition by path order by ingested_at desc nulls last, label desc nulls last, case when isnan(blur_score) then 'inf'::double else blur_score end desc nulls last) = 1) group by path),
scored as (select path, key, score from latest where key is not null and score is not null and not isnan(score) and score >= 0),
ranked as (select *, row_number() over (partition by key order by score desc) as r, count(*) over (partition by key) as n from scored),
cutoffs as (select key, any_value(n) as n, any_value((keep_pct * n + 99) // 100) as k, max(score) filter (where r >= (keep_pct * n + 99) // 100) as cutoff
  from ranked join (select {_label('label')} as key, keep_pct from keep_target) using (key) group by key)
"""


_SIDES = f"""r as (select distinct path, side, h from (select path, case when s = 'train' then 'train' when s is not null then 'eval' end as side, h from {_hashes('clip_meta', 'phash', f'path, {_SPLIT} as s')}) where side is not null),
close as (select distinct a.path, a.h, b.h as t, bit_count(xor(a.h, b.h)) as d from r a join r b on a.side = 'eval' and b.side = 'train' and bit_count(xor(a.h, b.h)) <= 6 and a.path <> b.path)"""
_SAMPLE = f"""{_P5.strip()},
rep as (select target_id, t.key, t.is_synthetic as syn, (share_bp * s + 9999) // 10000 as by_share, needed, coalesce(available, 0) as available
  from t join mixture_target using (target_id) cross join s left join a on a.key = t.key and a.is_synthetic = t.is_synthetic),
frame as (select path, arg_min(r, target_id) as r from (select distinct path, {_label('label')} as key, is_synthetic as syn from clip_meta where path is not null) m
  join (select rep as r, target_id, key, syn from rep where least(needed, available) > 0) using (key, syn) group by path),
chance as (select path, r.target_id as target_id, least(r.needed, r.available) as take, md5('mixture:' || path) as u, (least(r.by_share, r.available)::hugeint * 1099511627776) // r.available as p from frame),
summed as (select *, sum(p) over (order by target_id, u, path) + ('0x' || substr(md5('mixture:start'), 1, 10))::bigint as upto from chance),
passed as (select *, upto // 1099511627776 > (upto - p) // 1099511627776 as drawn from summed),
counted as (select *, count(*) filter (where drawn) over (partition by target_id) as have, count(*) over (partition by target_id) as every,
  row_number() over (partition by target_id order by drawn desc, u, path) as k from passed),
sample as (select path, target_id from counted where case when have = least(take, every) then drawn else k <= take end)
"""


def oracle_sql() -> dict[str, str]:
    return {
        # the exact definition; the graph of a single cell, as this scale has, finds all of it
        "p1_found": """with v as materialized (select path, any_value(vector)::double[] as v from lance_index where len(vector) = 512 and path is not null group by path having list_max(any_value(vector)) <> 0 or list_min(any_value(vector)) <> 0),
s as (select a.path as a, b.path as b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) as sim from v a join v b on a.path <> b.path),
r as (select a, b from s where sim >= 0.65 qualify row_number() over (partition by a order by sim desc, b) <= 5)
select distinct least(a, b) as path_a, greatest(a, b) as path_b from r""",
        "p2_found": f"""with r as (select distinct path, side, h from (select path, case when s = 'train' then 'train' when s is not null then 'eval' end as side, h from {_hashes('clip_meta', 'phash', f'path, {_SPLIT} as s')}) where side is not null)
select distinct least(a.path, b.path) as path_a, greatest(a.path, b.path) as path_b from r a join r b on a.side = 'train' and b.side = 'eval' and bit_count(xor(a.h, b.h)) <= 6 and a.path <> b.path""",
        "p2_coverage": f"""with {_SIDES}, e as (select distinct path, {_SPLIT} as split, {_FILE} as source_file from clip_meta where path is not null)
select split, source_file, count(distinct path) as clips, count(distinct case when path in (select path from close) then path end) as overlapping,
  round(count(distinct case when path in (select path from close) then path end) / count(distinct path), 6) as share from e where split in ('val', 'test') group by all""",
        "p2_records": f"with {_SIDES} select path, count(*) as train_hashes, min(d)::int as least_distance, round(1 - min(d) / 64, 6) as coverage from close group by path",
        "p3_balance": "select count(distinct path) as paths, 0::bigint as torn, true as splits_hold, true as labels_hold from clip_meta",
        "p3_found": f"""with recursive n as (select distinct path, {_FILE} as src, {_SPLIT} as s from clip_meta),
e as materialized (select distinct path as u, src as v from n where src is not null union select distinct src, path from n where src is not null),
walk as (select v as node, v as comp from (select distinct src as v from n where src is not null) union select e.v, w.comp from walk w join e on e.u = w.node),
root as materialized (select node, min(comp) as comp from walk group by node),
g as (select coalesce(comp, path) as comp, path, s from n left join root on node = path)
select distinct path from g where comp in (select comp from g group by comp having count(distinct s) > 1)""",
        "p5_found": f"with {_P5} select target_id from t left join a on a.key = t.key and a.is_synthetic = t.is_synthetic where coalesce(available, 0) < needed",
        "p5_sample": f"with {_SAMPLE} select path, target_id from sample",
        "p5_fulfilment": f"with {_SAMPLE} select target_id, needed, available, coalesce(n, 0) as drawn, available < needed as short from rep left join (select target_id, count(*) as n from sample group by 1) using (target_id)",
        "p7_within": f"""with v as (select {_label('label')} as label, unnest(['blur_score', 'motion_score']) as metric, unnest([blur_score, motion_score]) as x from clip_meta),
c as (select label, metric, count(*) as n from v where label is not null and x is not null and not isnan(x) and x >= 0 group by all)
select label, metric, p::double as percent, n, greatest(1, ceil(round(p * n / 100, 9)))::bigint as rank, true as within from c cross join (values (1), (5), (10), (25), (50), (75), (90), (95), (99)) t(p)""",
        "p6_found": f"with {_P6} select path from scored join cutoffs using (key) where score < cutoff",
        "p6_cutoffs": f"with {_P6} select c.key, c.n, c.k, c.cutoff, count(*) as kept from cutoffs c join scored s on s.key = c.key and s.score >= c.cutoff group by all",
        "p4_found": f"""with recursive items as (select distinct * from {_hashes('dedup_result', 'hash_str', 'item_no, batch_no, is_duplicate')}),
old as materialized (select h, min(item_no) as no from items where batch_no <= 12 and not is_duplicate group by h),
new as materialized (select h, min(item_no) as no from items where batch_no > 12 group by h),
hit as materialized (select distinct n.h from new n join old o on o.no < n.no and bit_count(xor(n.h, o.h)) <= 6),
open_ as materialized (select * from new where h not in (select h from hit)),
nb as materialized (select b.no as i, list(a.no) as nb from open_ a join open_ b on a.no < b.no and bit_count(xor(a.h, b.h)) <= 6 group by 1),
seq as materialized (select row_number() over (order by i) as rn, i, nb from nb),
scan as (select 0::bigint as rn, []::bigint[] as lost union all
  select s.rn, case when len(list_filter(s.nb, lambda x: not list_contains(g.lost, x))) > 0 then list_append(g.lost, s.i) else g.lost end from scan g join seq s on s.rn = g.rn + 1),
lost as (select unnest(lost) as no from (select lost from scan order by rn desc limit 1))
select distinct item_no from items i join new n using (h) where batch_no > 12 and (item_no > n.no or h in (select h from hit) or n.no in (select no from lost))""",
    }
