"""SQL of another engine for the registered queries; the same tables, columns and rounding."""

from __future__ import annotations

from framewright.plans.queries import BLUR_THRESHOLDS, HASH_DISTANCE, MOTION_EDGES, QUANTITY_THRESHOLDS, RATIOS, SIMILAR, VECTOR

_WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LABEL = rf"nullif(lower(regexp_replace(label, '{_WHITE}|[_-]', '', 'g')), '')"
_STRIP = lambda c: rf"regexp_replace(regexp_replace({c}, '^{_WHITE}+', ''), '{_WHITE}+$', '')"
_SPLIT = f"case when lower({_STRIP('split')}) in ('train', 'val', 'test') then lower({_STRIP('split')}) when lower({_STRIP('split')}) in ('valid', 'validation') then 'val' end"
_SCORE = lambda c: f"case when {c} is not null and not isnan({c}) and {c} >= 0 then {c} end"
_HEX = lambda c: f"regexp_replace(lower({_STRIP(c)}), '^0x', '')"

#: One row per path, as queries.latest(): the greatest of the same tuple.
LATEST = f"""
latest_rows as (
  select path, {_LABEL} as label, {_SPLIT} as split, is_synthetic, duration_sec, {_SCORE('blur_score')} as blur_score,
    {_SCORE('motion_score')} as motion_score, {_SCORE('quality_score')} as quality_score, caption, source_path, ingested_at from clip_meta),
latest as (
  select * exclude (rn) from (select *, row_number() over (partition by path order by ingested_at desc nulls last,
    coalesce(blur_score, -1) desc, coalesce(motion_score, -1) desc, coalesce(quality_score, -1) desc, label desc nulls last, split desc nulls last,
    is_synthetic desc nulls last, duration_sec desc nulls last, caption desc nulls last, source_path desc nulls last) as rn from latest_rows) where rn = 1),
real_clips as (select * from latest where label is not null and not coalesce(is_synthetic, false)),
synth_clips as (select * from latest where label is not null and is_synthetic)
"""


def _sweep(rows: str, label: str, score: str, thresholds: list[float]) -> str:
    values = ", ".join(f"({t}::double)" for t in thresholds)
    return f"""
levels(threshold) as (values {values}),
per as (select threshold, {label} as class, count(*) as n_clips_before,
  count(*) filter (where threshold <= 0 or coalesce({score}::double, 'inf'::double) >= threshold) as n_clips_after
  from ({rows}) cross join levels group by all),
shares as (select *, n_clips_before / sum(n_clips_before) over (partition by threshold) as base,
  coalesce(n_clips_after / nullif(sum(n_clips_after) over (partition by threshold), 0), 0) as now,
  sum(n_clips_after) over (partition by threshold) / sum(n_clips_before) over (partition by threshold) as overall_retention from per),
sweep as (select threshold, class, n_clips_after / n_clips_before as retention_rate, (now - base) / base as drift, n_clips_before, n_clips_after,
  overall_retention, sum(abs(now - base)) over (partition by threshold) / 2 as tvd from shares)
"""


_SWEEP_OUT = """select round(threshold, 6) as threshold, class, round(retention_rate, 6) as retention_rate, round(drift, 6) as drift, n_clips_before, n_clips_after,
  round(overall_retention, 6) as overall_retention, round(tvd, 6) as tvd from sweep"""
_BLUR = _sweep("select * from real_clips", "label", "blur_score", BLUR_THRESHOLDS)

_DIST = lambda name, src: f"{name} as (select label, count(*) as n, count(*) / sum(count(*)) over () as fraction from {src} group by label)"
_MD5 = lambda seed, salt, key: f"md5(concat('{seed}:{salt}:', {key}))"
_U = lambda salt: f"(('0x' || substr({_MD5(42, salt, 'path')}, 1, 8))::bigint / 4294967296.0)"

_SPLIT_ROWS = f"""
ranked as (select *, row_number() over (partition by label order by {_MD5(42, 'split', 'path')}, path) - 1 as r, count(*) over (partition by label) as n from real_clips),
assigned as (select path, label, is_synthetic, case when r < greatest(1, floor(n * 0.75)) then 'train' when r < greatest(1, floor(n * 0.75)) + greatest(1, floor(n * 0.10)) then 'val' else 'test' end as assigned from ranked)
"""


def _mixed(real: str, ratio: float, name: str) -> str:
    """CTE `name` (path, is_synthetic): the mixture of `real` and synth_clips."""
    if ratio <= 0:
        return f"{name} as (select path, is_synthetic from {real})"
    if ratio >= 1:
        pick = f"(('0x' || substr({_MD5(42, 'choice', 'i')}, 1, 12))::bigint % (select count(*) from synth_clips))"
        return f"""{name}_order as (select path, is_synthetic, row_number() over (order by path) - 1 as g from synth_clips),
{name}_draws as (select o.path, o.is_synthetic from (select unnest(range((select count(*) from {real})::bigint)) as i) join {name}_order o on o.g = {pick}),
{name} as (select * from {name}_draws where (select count(*) from synth_clips) >= (select count(*) from {real})
  union all select path, is_synthetic from synth_clips where (select count(*) from synth_clips) < (select count(*) from {real}))"""
    return f"""{name} as (select path, is_synthetic from {real} union all
  select path, is_synthetic from (select path, is_synthetic, row_number() over (order by {_MD5(42, 'mix', 'path')}, path) as g from synth_clips)
  where g <= round_even((select count(*) from {real}) * {ratio} / (1 - {ratio}), 0))"""


_FRAMES = """frames as (select user_id as clip, value as lum, epoch_us(ts) as us, event_id,
  row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 as frame_idx, count(*) over (partition by user_id) as total from events)"""
_PAIRS = """pairs as (select clip, frame_idx as start, lum as a, b from (select *, lead(lum) over (partition by clip order by frame_idx) as b,
  greatest(1, floor((total - 1) / 6))::bigint as step from frames) where b is not null and frame_idx % step = 0 and frame_idx / step < 6)"""
_SCENES = lambda sec, cut="abs(lum - lag(lum) over w) > 150": f"""cuts as (select *, {sec} as sec, coalesce(({cut})::int, 0) as c from frames window w as (partition by clip order by frame_idx)),
numbered as (select *, (sum(c) over (partition by clip order by frame_idx))::int as scene from cuts),
scenes as (select clip, scene, min(sec) as start_sec, max(sec) as last_sec, count(*) as n_frames from numbered group by all),
segments as (select clip, scene, start_sec, coalesce(lead(start_sec) over (partition by clip order by scene), last_sec) as end_sec, n_frames from scenes)"""  # noqa: E731

_HASHES = f"""items as (select item_no as ord, min(x) as x from (select item_no, {_HEX('hash_str')} as x from dedup_result)
  where regexp_matches(x, '^[0-9a-f]{{1,16}}$') and ltrim(x, '0') <> '' group by item_no),
hashes as (select min(ord) as ord, ('0x' || h)::ubigint as h from (select ord, lpad(x, 16, '0') as h from items) group by h),
hash_edges as (select a.ord as early, b.ord as late, bit_count(xor(a.h, b.h))::int as dist from hashes a join hashes b on a.ord < b.ord and bit_count(xor(a.h, b.h)) <= {HASH_DISTANCE})"""
_VEC = f"""vecs as (select vec_id as ord, embedding::double[] as vec, label from embeddings),
vec_edges as (select a.ord as early, b.ord as late, list_dot_product(a.vec, b.vec) as sim from vecs a join vecs b on a.ord < b.ord and list_dot_product(a.vec, b.vec) >= {SIMILAR})"""


def _greedy(nodes: str, edges: str, p: str = "") -> str:
    """CTE {p}kept(ord): the scan in order over nodes(ord), with the kept ones carried along."""
    return f"""{p}nb as materialized (select late as i, list(early order by early) as nb from {edges} group by 1),
{p}seq as materialized (select row_number() over (order by v.ord) as rn, v.ord, coalesce(n.nb, []) as nb from {nodes} v join {p}nb n on n.i = v.ord),
{p}scan as (select 0::bigint as rn, []::bigint[] as lost union all
  select s.rn, case when len(list_filter(s.nb, lambda x: not list_contains(g.lost, x))) > 0 then list_append(g.lost, s.ord) else g.lost end from {p}scan g join {p}seq s on s.rn = g.rn + 1),
{p}lost as materialized (select unnest(lost) as ord from (select lost from {p}scan order by rn desc limit 1))"""


#: The default prompts.
_TEMPLATES = "['a person performing {class_name} in an outdoor setting, daytime', 'close view of {class_name} activity, varied background', 'a professional demonstrating {class_name}, studio setting']"
_DIMS = f"(select unnest(range(1, {VECTOR + 1})) as i)"

SQL: dict[str, str] = {
    "class_distribution": f"with {LATEST}, {_DIST('d', '(select * from latest where label is not null)')} select label, n, round(fraction, 6) as fraction from d",
    "pipeline_stats": f"""with {LATEST} select count(*) as total, count(distinct label) as n_classes, round(avg(blur_score), 6) as mean_blur, round(avg(motion_score), 6) as mean_motion,
  (select string_agg(x, ' ' order by x) from (select label || '=' || count(*) as x from latest where label is not null group by label)) as class_counts from latest having count(*) > 0""",
    "label_encode": f"with {LATEST}, k as (select label, (row_number() over (order by label) - 1)::int as label_idx from (select distinct label from latest where label is not null)) select path, label, coalesce(label_idx, -1) as label_idx from latest left join k using (label)",
    "blur_filter": f"with {LATEST} select path, blur_score from latest where coalesce(blur_score, 'inf'::double) >= 40",
    "motion_filter": f"with {LATEST} select path, motion_score from latest where coalesce(motion_score, 2) between 2 and 80",
    "bias_sweep": f"with {LATEST}, {_BLUR} {_SWEEP_OUT}",
    "bias_sweep_table": f"with {LATEST}, {_BLUR} {_SWEEP_OUT}",
    "bias_sweep_lineitem": f"with {_sweep('select * from lineitem', 'l_returnflag || l_linestatus', 'l_quantity', QUANTITY_THRESHOLDS)} {_SWEEP_OUT}",
    "tvd_by_threshold": f"with {LATEST}, {_BLUR} select threshold, round(min(tvd), 6) as tvd from sweep group by threshold",
    "representation_drift": f"with {LATEST}, {_DIST('b', 'real_clips')}, {_DIST('f', '(select * from real_clips where coalesce(blur_score, 1e300) >= 60)')} select b.label, round((coalesce(f.fraction, 0) - b.fraction) / b.fraction, 6) as drift from b left join f using (label)",
    "total_variation": f"with {LATEST}, {_DIST('a', 'real_clips')}, {_DIST('b', 'synth_clips')} select round(coalesce(sum(abs(coalesce(a.fraction, 0) - coalesce(b.fraction, 0))), 0) / 2, 6) as tvd from a full join b using (label)",
    "retention_by_class": f"with {LATEST} select label, count(*) as n_before, count(*) filter (where coalesce(blur_score, 1e300) >= 40) as n_after, round(count(*) filter (where coalesce(blur_score, 1e300) >= 40) / count(*), 6) as retention_rate from real_clips group by label",
    "retention_overall": f"with {LATEST} select round(count(*) filter (where coalesce(blur_score, 1e300) >= 40) / count(*), 6) as retention_rate from real_clips",
    "at_risk_by_drift": f"with {LATEST}, {_BLUR} select class from sweep where threshold = 80 and drift < -0.2",
    "at_risk_by_retention": f"with {LATEST}, {_BLUR} select class from sweep where threshold = 80 and retention_rate < 0.5",
    "recovery_analysis": f"""with {LATEST}, k as (select label, 1 as r from real_clips where coalesce(blur_score, 1e300) >= 60 union all select label, 0 from synth_clips),
c as (select label as class, sum(r) as r, count(*) as n from k group by 1),
o as (select class, coalesce(r / nullif(sum(r) over (), 0), 0) as a, n / sum(n) over () as b from c)
select class, round(a, 6) as real_fraction, round(b, 6) as real_synth_fraction, round(b - a, 6) as delta from o""",
    "retention_top_n": f"with {LATEST}, {_BLUR} select class, round(stddev_samp(round(retention_rate, 9)), 6) as spread from sweep group by class order by stddev_samp(round(retention_rate, 9)) desc, class limit 5",
    "motion_bin_retention": f"""with {LATEST}, bins(bin_low, bin_high) as (values {", ".join(f"({a}::double, {b}::double)" for a, b in zip(MOTION_EDGES, MOTION_EDGES[1:], strict=False))})
select bin_low, bin_high, count(*) as n, count(*) filter (where coalesce(blur_score, 1e300) >= 40) as kept, round(count(*) filter (where coalesce(blur_score, 1e300) >= 40) / count(*), 6) as keep_rate
from latest left join bins on motion_score >= bin_low and motion_score < bin_high group by all""",
    "task_quality_report": f"""with {LATEST} select label, round_even(avg(round(blur_score * 100, 0)), 3) as blur_centi, round_even(avg(round(motion_score * 100, 0)), 3) as motion_centi,
  round_even(avg(round(quality_score * 100, 0)), 3) as quality_centi, round_even(avg(length(caption)), 3) as n_chars, count(*) as n_clips from latest where label is not null group by label""",
    "spearman_rho": f"""with {LATEST}, r as (select blur_score as x, motion_score as y from latest where blur_score is not null and motion_score is not null),
k as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from r)
select count(*) as n, round(corr(rx, ry), 6) as rho from k""",
    "duration_stats": f"with {LATEST} select label, count(*) as n, round(avg(duration_sec), 6) as mean, round(median(duration_sec), 6) as median, round(min(duration_sec), 6) as low, round(max(duration_sec), 6) as high from latest where label is not null group by label",
    "per_class_quota": "select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as r from orders) where r <= 25",
    "stratified_split": f"with {LATEST}, {_SPLIT_ROWS} select path, label, assigned from assigned",
    **{f"mix_ratio_{round(r * 100)}": f"with {LATEST}, {_mixed('real_clips', r, 'm')} select path, is_synthetic from m" for r in RATIOS},
    "mix_to_total": f"""with {LATEST}, sizes as (select (select count(*) from real_clips) as nr, (select count(*) from synth_clips) as ns),
need as (select round_even(nr / 0.5, 0)::bigint - nr as need, ns from sizes),
tiles as (select path, is_synthetic, unnest(range(greatest(1, ((select need from need) + (select ns from need) - 1) // (select ns from need)))) as t from synth_clips)
select path, is_synthetic from real_clips union all
select path, is_synthetic from (select *, row_number() over (order by {_MD5(42, 'tile', "path || ':' || t")}, path, t) as g from tiles) where g <= (select need from need)""",
    "mixture_stats": f"""with {LATEST}, {_SPLIT_ROWS}, trains as (select * from assigned where assigned = 'train'),
{", ".join(_mixed('trains', r, f'm{i}') for i, r in enumerate([0.0, *RATIOS]))},
everything as ({" union all ".join(f"select {r}::double as ratio, 'train' as mix_split, is_synthetic from m{i} union all select {r}::double, assigned, is_synthetic from assigned where assigned <> 'train'" for i, r in enumerate([0.0, *RATIOS]))})
select ratio, mix_split, count(*) as n, round(avg(coalesce(is_synthetic, false)::int) * 100, 6) as synth_pct from everything group by ratio, mix_split""",
    "choices_with_replacement": f"with o as (select c_custkey, row_number() over (order by c_custkey) - 1 as g from customer), i as (select unnest(range(5000)) as draw) select draw, c_custkey from i join o on g = ('0x' || substr({_MD5(42, 'choice', 'draw')}, 1, 12))::bigint % (select count(*) from customer)",
    "augment_fanout": f"""with {LATEST}, s as (select path, regexp_replace(path, '\\.[^./]*$', '') as stem from real_clips), k(aug_type) as (values ('interp'), ('jitter'), ('speed0.75'), ('speed1.25'))
select path, aug_type, stem || '_' || aug_type || '_0.mp4' as aug_path from s cross join k
where aug_type = 'interp' or (aug_type = 'jitter' and {_U('jitter')} < 0.8) or (aug_type like 'speed%' and {_U('speed')} < 0.5)""",
    "frame_pairs": f"with {_FRAMES}, {_PAIRS} select * from pairs",
    "motion_score_events": f"""with {_FRAMES}, {_PAIRS}, per as (select clip, avg(abs(b - a) / 10) as mean, quantile_cont(abs(b - a) / 10, 0.95) as p95, stddev_pop(abs(b - a) / 10) as dev, count(*)::int as n from pairs group by clip),
k as (select distinct clip from frames)
select clip, round(coalesce(mean, 0), 6) as mean_flow_magnitude, round(coalesce(p95, 0), 6) as max_flow_magnitude, round(coalesce(dev, 0), 6) as motion_uniformity, coalesce(n, 0) as n_pairs_sampled,
  n is null or mean < 2 as is_static, n is not null and mean > 80 as is_shaky, n is not null and mean between 2 and 80 as passed from k left join per using (clip)""",
    "scene_segments": f"with {_FRAMES}, {_SCENES('us / 1e6')} select clip, scene, round(start_sec, 3) as start_sec, round(end_sec, 3) as end_sec, n_frames from segments",
    "dominant_scene": f"""with {_FRAMES}, {_SCENES('us::double')}, r as (select *, row_number() over (partition by clip order by end_sec - start_sec desc, scene) as k, count(*) over (partition by clip) as n, sum(end_sec - start_sec) over (partition by clip) as t from segments)
select clip, n::int as n_scenes, start_sec as dominant_scene_start_sec, end_sec as dominant_scene_end_sec, end_sec - start_sec as dominant_scene_duration_sec, round((n - 1) / greatest(t, 1e-6) * 1e12, 3) as scene_change_rate from r where k = 1""",
    "scene_fades": f"with {_FRAMES}, {_SCENES('us / 1e6', 'lum >= 100 and lag(lum) over w < 100')} select clip, scene, round(start_sec, 3) as start_sec, round(end_sec, 3) as end_sec, n_frames from segments",
    "scene_adaptive": f"""with {_FRAMES.replace('frames as', 'plain as')}, changed as (select *, coalesce(abs(lum - lag(lum) over (partition by clip order by frame_idx)), 0) as x from plain),
frames as (select *, (coalesce(lag(x, 1) over w, 0) + coalesce(lag(x, 2) over w, 0) + coalesce(lead(x, 1) over w, 0) + coalesce(lead(x, 2) over w, 0)) / 4 as around from changed window w as (partition by clip order by frame_idx)),
{_SCENES('us / 1e6', 'x >= 15 and x >= 3 * greatest(around, 1e-5)')} select clip, scene, round(start_sec, 3) as start_sec, round(end_sec, 3) as end_sec, n_frames from segments""",
    "frames_uniform": f"with {_FRAMES}, w as (select clip, total, unnest(range(8)) as place from (select distinct clip, total from frames)) select clip, place::int as place, frame_idx, lum from w join frames using (clip) where frame_idx = floor(place * w.total / 8)",
    "frames_uniform_or_all": f"""with {_FRAMES}, w as (select clip, total, unnest(range(case when total < 64 then total else 64 end)) as place from (select distinct clip, total from frames))
select clip, place::int as place, frame_idx, lum from w join frames using (clip) where frame_idx = case when w.total < 64 then place else floor(place * w.total / 64) end""",
    "frames_ends": f"""with {_FRAMES}, c as (select distinct clip, total from frames), a as (select distinct clip, floor(i * (total - 1) / 63)::bigint as spot from c cross join (select unnest(range(64)) as i)),
n as (select clip, spot, row_number() over (partition by clip order by spot) - 1 as place from a), m as (select clip, max(spot) as spot, count(*) as k from n group by clip),
w as (select clip, spot, place from n union all select clip, spot, unnest(range(k, 64)) from m)
select clip, place::int as place, frame_idx, lum from w join frames using (clip) where frame_idx = spot""",
    "frames_stride": f"""with {_FRAMES}, c as (select distinct clip, ceil(total / 4)::bigint as kept from frames), w as (select clip, kept, unnest(range(least(kept, 8))) as place from c)
select clip, place::int as place, frame_idx, lum from w join frames using (clip) where frame_idx = case when kept <= 8 then place * 4 else floor(place * kept / 8) * 4 end""",
    "temporal_profile": """with x as (select vec_id, unnest(range(64)) as i, embedding::double[] as v from embeddings), p as (select vec_id, i // 8 as place, sum(abs(v[i + 1])) as w from x group by all),
q as (select vec_id, w / sum(w) over (partition by vec_id) as p from p) select vec_id, round(-sum(p * log2(p + 1e-9)), 6) as entropy, round(max(p), 6) as peak from q group by vec_id""",
    "frame_kernels": """with px as (select vec_id, i, greatest(0, least(255, floor(v[i + 1] * 128 + 128)))::double as p from (select vec_id, unnest(range(64)) as i, embedding::double[] as v from embeddings)),
img as (select vec_id, list(p order by i) as p, 100 - stddev_pop(p) as noise, avg(p) as mean, median(p) as med from px group by vec_id),
lap as (select vec_id, var_pop(p[((i // 8 + 7) % 8) * 8 + i % 8 + 1] + p[((i // 8 + 1) % 8) * 8 + i % 8 + 1] + p[(i // 8) * 8 + (i % 8 + 7) % 8 + 1] + p[(i // 8) * 8 + (i % 8 + 1) % 8 + 1] - 4 * p[i + 1]) as v from (select vec_id, p, unnest(range(64)) as i from img) group by vec_id),
fre as (select vec_id, f, sqrt(power(sum(p * cos(2 * pi() * ((f // 8) * (i // 8) + (f % 8) * (i % 8)) / 8)), 2) + power(sum(p * sin(2 * pi() * ((f // 8) * (i // 8) + (f % 8) * (i % 8)) / 8)), 2)) as m
  from px cross join (select unnest(range(64)) as f) where power((f // 8 + 4) % 8 - 4, 2) + power((f % 8 + 4) % 8 - 4, 2) > 4 group by all),
fft as (select vec_id, avg(m) as v from fre group by vec_id),
k as (select u, y, sum(cos(pi() * (2 * x + 1) * u / 64)) as a from (select unnest(range(8)) as u) cross join (select unnest(range(8)) as y) cross join (select unnest(range(32)) as x) where x // 4 = y group by all),
dct as (select vec_id, r.u * 8 + c.u as j, sum(p * r.a * c.a) as v from px join k r on r.y = i // 8 join k c on c.y = i % 8 group by all),
low as (select vec_id, j, v > median(v) over (partition by vec_id) as bit from dct),
bits as (select vec_id, 'a' as kind, i as j, px.p > mean as bit from px join img using (vec_id) union all select vec_id, 'w', i, px.p > med from px join img using (vec_id) union all select vec_id, 'p', j, bit from low),
num as (select vec_id, kind, sum(case when bit and j = 0 then -9223372036854775808::hugeint when bit then (1::hugeint << (63 - j)::int) else 0 end)::bigint as h from (select vec_id, kind, j, bit from bits) group by all)
select vec_id::varchar as path, 0 as frame_idx, round(lap.v * 4096) as laplacian, round(fft.v, 4) as fft, round(greatest(0, noise), 4) as noise, p.h as phash, a.h as ahash, w.h as whash
from img join lap using (vec_id) join fft using (vec_id) join num p on p.vec_id = img.vec_id and p.kind = 'p' join num a on a.vec_id = img.vec_id and a.kind = 'a' join num w on w.vec_id = img.vec_id and w.kind = 'w'""",
    "quality_flags": f"""with {_FRAMES}, k as (select clip, total, unnest(range(8)) as place from (select distinct clip, total from frames)),
q as (select clip, avg(lum) as b, avg(lum / 4) filter (where place < 4) as q, count(*)::int as n from k join frames using (clip) where frame_idx = floor(place * k.total / 8) group by clip)
select clip, round(b, 6) as blur_score, round(q, 6) as quality_score, b < 60 as is_blurry, q > 20 as is_low_quality, not b < 60 and not q > 20 as passed, n as n_frames_sampled from q""",
    "laplacian_8x8": """with p as (select vec_id, embedding::double[] as p, unnest(range(64)) as i from embeddings),
l as (select vec_id, p[((i // 8 + 7) % 8) * 8 + i % 8 + 1] + p[((i // 8 + 1) % 8) * 8 + i % 8 + 1] + p[(i // 8) * 8 + (i % 8 + 7) % 8 + 1] + p[(i // 8) * 8 + (i % 8 + 1) % 8 + 1] - 4 * p[i + 1] as l from p)
select vec_id, round(var_pop(l), 6) as laplacian_variance from l group by vec_id""",
    "noise_proxy_8x8": "select vec_id, round(greatest(0, 100 - stddev_pop(x)), 5) as noise_proxy from (select vec_id, unnest(embedding::double[]) as x from embeddings) group by vec_id",
    "direction_entropy": """with c as (select user_id, (json_extract(props, '$.k'))::int % 8 as bin, count(*) as n from events where json_extract(props, '$.k') is not null group by all),
p as (select user_id, n / (sum(n) over (partition by user_id) + 1e-9) as p from c) select user_id, round(-sum(p * log2(p + 1e-9)), 6) as entropy from p group by user_id""",
    "phash64": """with v as (select vec_id as ord, embedding::double[] as v from embeddings), m as (select ord, v, median(x) as m from (select ord, v, unnest(v) as x from v) group by all),
b as (select ord, list_transform(range(16), lambda j: (v[4 * j + 1] > m)::int * 8 + (v[4 * j + 2] > m)::int * 4 + (v[4 * j + 3] > m)::int * 2 + (v[4 * j + 4] > m)::int) as n from m)
select ord, array_to_string(list_transform(n, lambda x: substr('0123456789abcdef', x + 1, 1)), '') as phash from b""",
    "hamming_pairs": f"with {_HASHES} select * from hash_edges",
    "hash_classes": f"with {_HASHES} select i.ord, h.ord as first from items i join hashes h on ('0x' || lpad(i.x, 16, '0'))::ubigint = h.h",
    "cosine_pairs": f"with {_VEC} select early, late, round(sim, 5) as sim from vec_edges",
    "dedup_greedy_cosine": f"with recursive {_VEC}, {_greedy('vecs', 'vec_edges')} select ord from vecs where ord not in (select ord from lost)",
    "dedup_greedy_hamming": f"with recursive {_HASHES}, {_greedy('hashes', 'hash_edges')} select ord from hashes where ord not in (select ord from lost)",
    "dedup_verdicts": f"""with recursive {_HASHES}, {_greedy('hashes', 'hash_edges')},
o as (select late as ord, arg_min(early, early) as duplicate_of, arg_min(dist, early) as dist from hash_edges where early not in (select ord from lost) and late in (select ord from lost) group by late),
f as (select i.ord, h.ord as first from items i join hashes h on ('0x' || lpad(i.x, 16, '0'))::ubigint = h.h),
every as (select distinct item_no as ord from dedup_result where item_no is not null)
select e.ord, case when f.ord is null then null when f.ord = f.first then o.duplicate_of else coalesce(o.duplicate_of, f.first) end as duplicate_of,
  case when f.ord is null then null when f.ord = f.first then o.dist when o.ord is null then 0 else o.dist end as dist,
  coalesce(f.ord <> f.first or o.ord is not null, false) as is_duplicate
from every e left join f on f.ord = e.ord left join o on o.ord = f.first""",
    "dedup_nearest": f"""with recursive {_VEC}, {_greedy('vecs', 'vec_edges')},
o as (select late as ord, early, sim, row_number() over (partition by late order by sim desc, early) as k from vec_edges where early not in (select ord from lost) and late in (select ord from lost))
select v.ord, o.early as duplicate_of, round(o.sim, 5) as sim from vecs v left join o on o.ord = v.ord and k = 1""",
    "dedup_precision_recall": f"""with {_VEC}, t as (select a.vec_id as early, b.vec_id as late from embeddings a join embeddings b on a.vec_id < b.vec_id and a.label = b.label and list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.25),
c as (select count(*) filter (where e.early is not null and t.early is not null) as tp, count(*) filter (where t.early is null) as fp, count(*) filter (where e.early is null) as fn
  from vec_edges e full join t on e.early = t.early and e.late = t.late),
s as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c)
select tp, fp, fn, round_even(p, 4) as precision, round_even(r, 4) as recall, round_even(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1 from s""",
    "exact_dup_md5": "with d as (select doc_id as key, md5(text) as digest from documents where text is not null) select key, digest, min(key) over (partition by digest) as first_key, key > min(key) over (partition by digest) as is_copy from d",
    "clip_hash_values": f"""select distinct path, case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616)::bigint else u::bigint end as h
from (select path, ('0x' || lpad(x, 16, '0'))::ubigint as u from (select path, {_HEX('phash')} as x from clip_meta) where regexp_matches(x, '^[0-9a-f]{{1,16}}$') and ltrim(x, '0') <> '')""",
    "clip_score": f"with {_VEC} select round(avg(list_dot_product(a.vec, b.vec)), 5) as score from vecs a join vecs b on b.ord = a.ord + 1",
    "recall_at_k": f"""with {_VEC}, q as (select a.ord, b.vec as v, list_dot_product(a.vec, b.vec) as own from vecs a join vecs b on b.ord = a.ord + 1 where a.ord % 50 = 0),
r as (select q.ord, count(*) filter (where g.ord <> q.ord and list_dot_product(q.v, g.vec) > own + 1e-12) as better from q cross join vecs g group by q.ord)
select k, round(avg((better < k)::int), 6) as recall from r cross join (values (1), (5), (10), (100)) t(k) group by k""",
    "intra_class_compactness": f"""with {_VEC}, p as (select a.label, sum(list_dot_product(a.vec, b.vec)) as s, count(*) as c from vecs a join vecs b on a.label = b.label and a.ord < b.ord group by 1), n as (select label, count(*) as n from vecs group by 1)
select label, n, round(coalesce(s / c, 'nan'::double), 5) as compactness from n left join p using (label)""",
    "vector_mean_cov_diag": f"with {_VEC} select (i - 1)::int as dim, round(avg(vec[i]), 6) as mean, round(var_samp(vec[i]), 6) as variance from vecs cross join {_DIMS} group by i",
    "topk_accuracy": """with v as (select vec_id, embedding::double[] as l, label as t, unnest(range(64)) as i from embeddings),
b as (select vec_id, count(*) filter (where l[i + 1] > l[t + 1] or (l[i + 1] = l[t + 1] and i < t)) as b from v group by vec_id)
select count(*) as n, round(avg((b < 1)::int), 6) as top1, round(avg((b < 5)::int), 6) as top5 from b""",
    "best_ratio": f"with {LATEST}, r as (select length(label) % 5 / 4 as ratio, avg(blur_score) as fvd from latest where blur_score is not null and label is not null group by 1) select arg_min(ratio, fvd) as best_ratio from r",
    "mean_frame_vectors": f"""with {_VEC}, u as (select label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as u from vecs)
select label::varchar as label, (i - 1)::int as dim, round(avg(u[i]), 5) + 0.0 as x from u cross join {_DIMS} group by label, i""",
    "caption_vote": """with c as (select clip_path, doc_id, text, rtrim(trim(lower(text), ' '), '.') as n from documents where clip_path is not null and text <> ''),
f as (select clip_path, n, arg_min(text, doc_id) as t, min(doc_id) as o from c group by all)
select clip_path, t as caption from (select *, row_number() over (partition by clip_path order by length(t) desc, o) as k from f) where k = 1""",
    "caption_fill": f"with {LATEST} select path, label, case when caption is null or caption = '' then 'a person performing ' || coalesce(lower(replace(label, '_', ' ')), 'a video clip') else caption end as caption from latest",
    "prompts_from_captions": f"with {LATEST} select 'wide shot: ' || caption as prompt from latest where label = 'kiteflying' and caption <> '' order by path limit 20",
    "synthesis_plan": f"""with {LATEST}, {_BLUR}, c as (select class from sweep where threshold = 80 and retention_rate < 0.5), i as (select class, unnest(range(4))::int as i from c)
select class, i, case when class = 'kiteflying' then ['a kite over the sea', 'a kite over a field'][i % 2 + 1] else replace(({_TEMPLATES})[i % 3 + 1], '{{class_name}}', lower(replace(class, '_', ' '))) end as prompt, i as seed from i""",
    "speed_variants": """with s as (select user_id as clip, count(*) as n from events group by 1), f as (select clip, n, factor, case when factor > 1 then greatest(1, floor(n / factor)) else floor(n / factor) end::bigint as size from s cross join (values (0.75::double), (1.25::double)) t(factor)),
o as (select clip, n, factor, size, unnest(range(size)) as i from f)
select clip, factor, i::int as out_idx, case when factor > 1 then floor(i * n / size) else least(floor(i * factor), n - 1) end::int as frame_idx from o""",
    "frame_interpolation": f"""with {_FRAMES}, n as (select clip, frame_idx, floor(lum)::bigint as lum, lead(floor(lum)::bigint) over (partition by clip order by frame_idx) as nx from frames),
o as (select *, unnest(case when nx is null then [0] else [0, 1, 2] end) as s from n)
select clip, frame_idx * 3 + s as out_idx, case when s = 0 then lum else floor(lum * (1 - s / 3) + nx * (s / 3))::bigint end as lum from o""",
    "export_captions": f"""with {LATEST}, n as (select path, label, caption, regexp_extract(path, '[^/]*$') as name from latest), s as (select *, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') as stem, row_number() over (partition by name order by path) as k from n)
select path, case when k = 1 then stem else coalesce(label, '') || '_' || stem end as out_name, coalesce(nullif(caption, ''), label, '') as caption from s""",
    "label_map_join": f"with {LATEST} select path, case when label is not null then label else string_split(path, '/')[-2] end as label from latest",
    "resume_anti_join": f"with {LATEST} select path from latest where path not in (select path from motion_scores where path is not null)",
    "motion_agreement": f"with {LATEST}, m as (select path, max(mean_flow_magnitude) as flow from motion_scores group by 1) select label, count(*) as n, round(avg(abs(motion_score - flow)), 6) as mean_gap from latest join m using (path) group by label",
    "arrivals_by_day": "select date_trunc('day', arrived_at)::timestamp as window_start, batch_no::varchar as batch, count(*) as n, round(avg(hamming_distance), 6) as mean from dedup_result where arrived_at is not null group by all",
    "curate_stage_counts": f"""with {LATEST}, g as (select coalesce(blur_score, 1e300) >= 30 and coalesce(quality_score, 0) <= 50 as q, coalesce(motion_score, 2) between 2 and 80 as m, coalesce(duration_sec, 1e300) >= 0.5 as s from latest where label is not null)
select count(*) as n_in, count(*) filter (where s) as after_scene, count(*) filter (where s and q) as after_quality, count(*) filter (where s and q and m) as after_motion from g""",
    "curate_flagship": f"""with recursive {LATEST}, hs as (select path, max(case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616)::bigint else u::bigint end) as h
  from (select path, case when regexp_matches(x, '^[0-9a-f]{{1,16}}$') and ltrim(x, '0') <> '' then ('0x' || lpad(x, 16, '0'))::ubigint end as u from (select path, {_HEX('phash')} as x from clip_meta)) group by path),
nodes as materialized (select path, label, blur_score, motion_score, h, row_number() over (order by path) as ord from latest join hs using (path) where label is not null and coalesce(blur_score, 1e300) >= 30
  and coalesce(quality_score, 0) <= 50 and coalesce(motion_score, 2) between 2 and 80 and coalesce(duration_sec, 1e300) >= 0.5),
edges as materialized (select a.ord as early, b.ord as late from nodes a join nodes b on a.ord < b.ord and bit_count(xor(a.h, b.h)) <= 6), {_greedy('nodes', 'edges')},
kept as (select * from nodes where ord not in (select ord from lost)), k as (select label, (row_number() over (order by label) - 1)::int as label_idx from (select distinct label from kept))
select path, label, label_idx, blur_score, motion_score from kept join k using (label)""",
    "dedup_two_pass": f"""with recursive {_VEC}, m as (select ord, vec, median(x) as m from (select ord, vec, unnest(vec) as x from vecs) group by all),
hv as materialized (select ord, sum(case when vec[i + 1] > m then (1::hugeint << (63 - i)::int) else 0 end)::ubigint as h from (select ord, vec, m, unnest(range(64)) as i from m) group by ord),
e1 as materialized (select a.ord as early, b.ord as late from hv a join hv b on a.ord < b.ord and bit_count(xor(a.h, b.h)) <= {HASH_DISTANCE}), {_greedy('hv', 'e1', 'p')},
survivors as materialized (select ord from vecs where ord not in (select ord from plost)),
e2 as materialized (select early, late from vec_edges where early in (select ord from survivors) and late in (select ord from survivors)), {_greedy('survivors', 'e2', 'q')}
select ord, 1 as stage from plost union all select ord, 2 from qlost""",
    "evaluation_bundle": f"""with {_VEC}, p as (select a.ord, a.label, a.vec as v, b.vec as t from vecs a join vecs b on b.ord = a.ord + 1),
r as (select q.ord, count(*) filter (where g.ord <> q.ord and list_dot_product(q.t, g.v) > list_dot_product(q.t, q.v) + 1e-12) as better from p q cross join p g where q.ord % 50 = 0 group by q.ord),
c as (select a.label, sum(list_dot_product(a.v, b.v)) as s, count(*) as n from p a join p b on a.label = b.label and a.ord < b.ord group by 1)
select 'n_clips' as metric, null::varchar as label, count(*)::double as value from p union all select 'clip_score', null, round(avg(list_dot_product(v, t)), 5) from p
union all select 'R@' || k, null, round(avg((better < k)::int), 5) from r cross join (values (1), (5), (10)) x(k) group by k
union all select 'intra_class_compactness', l.label::varchar, round(coalesce(s / n, 'nan'::double), 5) from (select distinct label from p) l left join c using (label)""",
    "vector_index_nearest": """with q as (select vec_id as query, embedding::double[] as v from embeddings where vec_id % 50 = 0), x as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select query, id, list_cosine_similarity(q.v, x.v) as sim from q join x on query <> id), r as (select *, row_number() over (partition by query order by sim desc, id)::int as place from s)
select query, place, id, round(sim, 5) as sim from r where place <= 3""",
    "source_files": f"""select nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({_STRIP('source_path')}, '\\', '/'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'),
  '[^/]+/\\.\\./', '', 'g'), '[^/]+/\\.\\./', '', 'g'), '/$', ''), '') as file, count(*) as n from clip_meta where {_STRIP('source_path')} <> '' group by 1""",
    "class_ranks": f"with {LATEST} select label, path, r::int as r from (select label, path, row_number() over (partition by label order by blur_score desc nulls last, path) as r from latest where label is not null) where r <= 10",
}
