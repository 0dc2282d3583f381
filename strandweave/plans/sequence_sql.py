"""SQL of queries whose operators aren't relational: searches over all pairs, and recursions a row at a time. Slow, and only for holding the operators to."""

from __future__ import annotations

from strandweave.plans.fixtures import AE_SQL, CUES_SQL, FRAMES_SQL, anchors_sql
from strandweave.plans.interval_queries import _PIECES
from strandweave.plans.similarity_queries import _COS, _PAIRS
from strandweave.plans.text_queries import _CMS, _DBL, _STAMP
from strandweave.plans.window_queries import ORACLES as WINDOWS

_A = anchors_sql()
_COSINES = f"""with d as (select frame, vec from ({FRAMES_SQL}) where series = 'dub'), r as (select frame, vec from ({FRAMES_SQL}) where series = 'ref'),
c as (select d.frame as dub, r.frame as ref, {_COS.format(a="d.vec", b="r.vec")} as cos from d, r),
f as (select * from (select *, row_number() over (partition by dub order by cos desc, ref) as n from c) where n = 1), b as (select * from (select *, row_number() over (partition by ref order by cos desc, dub) as n from c) where n = 1)"""
_MIRROR = "list_transform(generate_series(0, 63), lambda k: case when k < 32 then vec[(k // 8) * 8 + (7 - k % 8) + 1]::double else -vec[32 + ((k - 32) // 8) * 8 + least(7, 8 - k % 8) + 1]::double end)"
_FLIPPED = _PAIRS.format(k=3, z=24).replace(f"d as (select frame, vec from ({FRAMES_SQL}) where series = 'dub'", f"d as (select frame, {_MIRROR} as vec from ({FRAMES_SQL}) where series = 'dub'")
_FOUND = "(select count(*) from ({pairs} select * from m where cos > 0.35 and cos - rest > 0.01))"
_CUTS = f"c as (select series, t / 86400 as tc, o as v, row_number() over (partition by series order by t, event_id) as i from ({_A}) where w >= 50)"

_TRIPS = f"""{_CUTS}, l as (select series, i, tc, v as a, lead(v) over (partition by series order by i) as b from c),
m as (select series, i, tc, a, b from l where b is not null),
j as (select x.series, x.i, x.tc, x.a, min(y.i) as back from m x left join m y on y.series = x.series and y.i > x.i and abs(y.b - x.a) <= 2.5 group by x.series, x.i, x.tc, x.a),
s as (select * from j where i = 1 union all select j.* from s join j on j.series = s.series and j.i = coalesce(s.back, s.i) + 1)"""
ORACLES = {
    "c12_mutual_nearest": f"{_COSINES} select f.dub, f.ref, round(f.cos, 6) as cos from f join b on b.ref = f.ref where abs(b.dub - f.dub) <= 6",
    "j10_embedding_surface": f"{_COSINES} select dub, ref, round(cos, 6) as cos from f",
    "c3_orientation": f"select 1 as pair, plain, flipped, flipped > 2 * greatest(plain, 1) as is_mirrored from (select {_FOUND.format(pairs=_PAIRS.format(k=3, z=24))} as plain, {_FOUND.format(pairs=_FLIPPED)} as flipped)",
    "e11_detelecined": f"""with k as ({WINDOWS["b9_thinned"]}), n as (select series, count(*) as n, count(*) filter (where keep) as kept from k group by series)
select k.series, frame, (row_number() over (partition by k.series order by frame) - 1)::int as new, round(29.97::double * kept / n, 5) as rate from k join n on n.series = k.series where keep""",
    "i1_monotone_chain": f"""with recursive v as (select series, cast(floor(o * 100) as bigint) as v, row_number() over (partition by series order by event_id) as i from ({_A})),
s as (select series, i, [v] as vs, [1] as ns from v where i = 1 union all
select v.series, v.i, list_append(vs, v.v), list_append(ns, 1 + coalesce(list_max(list_transform(list_filter(list_zip(vs, ns), lambda x: x[1] <= v.v), lambda x: x[2])), 0)) from s join v on v.series = s.series and v.i = s.i + 1)
select series, max(list_max(ns))::bigint as n from s group by series""",
    "f3_merged_cuts": f"""with recursive {_CUTS}, s as (select series, i, 1 as g, tc, v from c where i = 1 union all
select c.series, c.i, case when c.tc - s.tc < 2 then g else g + 1 end, case when c.tc - s.tc < 2 and abs(c.v) <= abs(s.v) then s.tc else c.tc end, case when c.tc - s.tc < 2 and abs(c.v) <= abs(s.v) then s.v else c.v end
from s join c on c.series = s.series and c.i = s.i + 1)
select series, round(arg_max(tc, i), 6) as tc, round(arg_max(v, i), 4) as v from s group by series, g""",
    "e15_without_round_trips": f"""with recursive {_TRIPS} select series, round(tc, 6) as tc from s where back is null""",
    "e15_flattened": f"""with recursive {_TRIPS}, u as (select series, t / 86400 as t, avg(o) as shift from ({_A}) group by series, t / 86400),
x as (select s.series, s.tc, j.tc as stop, s.a as base from s join m j on j.series = s.series and j.i = s.back),
y as (select x.*, (select max(abs(u.shift - x.base)) from u where u.series = x.series and u.t > x.tc and u.t < x.stop) as far from x)
select u.series, round(u.t, 6) as t, round(coalesce(arg_max(y.base, y.tc), max(u.shift)), 5) as shift from u left join y on y.series = u.series and y.far > 20 and u.t between y.tc and y.stop group by u.series, u.t""",
    "e6_restored_runs": f"""with a as ({AE_SQL}), d as (select series, row_number() over (partition by series order by event_id) - 1 as dub, t, o, w, cast(floor(t / 86400) as bigint) - 19723 as day from a),
m as (select series, dub, case when w >= 25 and cast(floor(t / 7200) as bigint) % 5 <> 0 then cast(dub + day * 8 + day % 5 * 40 + case when cast(floor(t / 10800) as bigint) % 4 = 0 then floor(o / 10) * 6 else 0 end as bigint) end as ref from d),
i as (select *, case when ref is null then dub - row_number() over (partition by series, ref is null order by dub) end as isle from m),
r as (select series, isle, min(dub) as x, max(dub) as y from i where isle is not null group by series, isle),
l as (select r.*, (select median(ref - dub) from m where m.series = r.series and ref is not null and dub >= x - 16 and dub < x) as lb, (select median(ref - dub) from m where m.series = r.series and ref is not null and dub > y and dub <= y + 16) as la,
  (select arg_max(ref, dub) from m where m.series = r.series and dub < x and ref is not null) as p0, (select arg_min(ref, dub) from m where m.series = r.series and dub > y and ref is not null) as p1 from r),
f as (select * from l where lb is not null and la is not null and (abs(la - lb) <= 4 or y - x + 1 <= 8))
select i.series, i.dub, case when f.series is null then ref else cast(round_even(p0 + (p1 - p0) * (i.dub - (x - 1))::double / (y - x + 2), 0) as bigint) end as ref, f.series is not null as restored from i left join f on f.series = i.series and f.isle = i.isle""",
    "k6_throttled": f"""with recursive e as (select series, t, max(w / 99) over (partition by series order by t, event_id rows unbounded preceding) as pct, row_number() over (partition by series order by t, event_id) as i from ({_A})),
s as (select series, i, t, pct, true as kept from e where i = 1 union all
select series, i, case when k then t else lt end, case when k then pct else lp end, k from (select e.*, s.t as lt, s.pct as lp, (e.pct >= 1 and s.pct < 1) or (e.pct - s.pct >= 0.05 and e.t - s.t >= 86400) as k from s join e on e.series = s.series and e.i = s.i + 1))
select series, round(t, 3) as t, round(pct, 6) as pct from s where kept""",
    "k2_admitted": f"""with recursive e as (select series, t as came, event_id as job, w * 60 as lasts, row_number() over (partition by series order by t, event_id) as i from ({AE_SQL})),
s as (select series, i, job, came as began, came + lasts as ended, came + lasts as a, '-infinity'::double as b from e where i = 1 union all
select series, i, job, began, began + lasts, greatest(a, b), began + lasts from (select e.*, greatest(e.came, s.began, least(a, b)) as began, a, b from s join e on e.series = s.series and e.i = s.i + 1))
select series, job, round(began, 3) as began, round(ended, 3) as ended from s""",
    "s13_transferred": f"""{_DBL}, w as (select *, trim(regexp_replace(array_to_string(payload, ''), '</?[ibu]>', '', 'g')) <> '' as shown from d),
u as (select * from (select *, row_number() over (partition by series, start, stop, payload, shown order by n) as r from w) where shown and r = 1),
q as (select series, n, greatest(0, start - 0.5) as s, least(75.0::double, stop - 0.5) as e from u), p as ({_PIECES}),
m as (select q.series, n, t0 + (greatest(x0, s) - x0) * (t1 - t0) / (x1 - x0) as pa, t0 + (least(x1, e) - x0) * (t1 - t0) / (x1 - x0) as pb from q join p on p.series = q.series and x0 < e and x1 > s where e > s),
r as (select *, max(pb) over (partition by series, n order by pa, pb rows between unbounded preceding and 1 preceding) as reach from m),
k as (select *, sum(case when reach is null or pa - reach > 1e-6 then 1 else 0 end) over (partition by series, n order by pa, pb rows unbounded preceding) as run from r),
f as (select series, n, min(pa) as start, max(pb) as stop from k group by series, n, run having max(pb) - min(pa) >= 1.0::double / 24),
z as (select f.series, f.n, f.start, f.stop, list_filter(u.payload, lambda x: trim(x) <> '') as lines from f join u on u.series = f.series and u.n = f.n),
y as (select *, row_number() over (partition by series order by start, n) as i from z where len(lines) > 0),
b as (select series, i, i || chr(10) || {_STAMP.format(ms=_CMS.format(c="start"), mark=",")} || ' --> ' || {_STAMP.format(ms=_CMS.format(c="stop"), mark=",")} || chr(10) || array_to_string(lines, chr(10)) || chr(10) as b from y)
select series, length(string_agg(b, chr(10) order by i))::int as n_chars from b group by series""",
}
QUERIES: dict = {}
