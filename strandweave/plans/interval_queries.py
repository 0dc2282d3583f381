"""Queries over spans, grids and cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import intervals, robust, timemap
from strandweave.plans.fixtures import CUES_SQL, SPANS_SQL, anchors, anchors_sql, cues, spans, wmed_sql

HOUR = 3600.0
AE = anchors_sql("event_type")
AU = anchors_sql()


def _grid(spark, sf_dir):
    """An hourly grid for each event type, over its own range."""
    ends = anchors(spark, sf_dir, "event_type").groupBy("series").agg(F.floor(F.min("t") / HOUR).alias("a"), F.floor(F.max("t") / HOUR).alias("b"))
    return ends.select("series", F.explode(F.sequence("a", "b")).alias("h")).select("series", (F.col("h") * HOUR).alias("g"))


_GRID = f"select series, unnest(generate_series(a, b)) * {HOUR}::double as g from (select series, cast(floor(min(t) / {HOUR}) as bigint) as a, cast(floor(max(t) / {HOUR}) as bigint) as b from ({AE}) group by series)"


def b4_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


def c6_window_join(spark, sf_dir):
    """For each grid node: weighted median of the anchors in its window, and the median weight times the share that agrees."""
    met = intervals.points_in_windows(_grid(spark, sf_dir), anchors(spark, sf_dir, "event_type"), ["series"], "g", "t", HOUR)
    level = robust.weighted_median(met, ["series", "g"], "o", "w", "level")
    got = met.join(level, ["series", "g"]).groupBy("series", "g").agg(
        F.max("level").alias("level"), (F.percentile("w", 0.5) * F.avg((F.abs(F.col("o") - F.col("level")) <= 20).cast("double"))).alias("weight"), F.count(F.lit(1)).alias("n"))
    return got.select("series", "g", F.round("level", 4).alias("level"), F.round("weight", 4).alias("weight"), "n")


def c7_descriptor_window_join(spark, sf_dir):
    met = intervals.points_in_windows(_grid(spark, sf_dir), anchors(spark, sf_dir, "event_type").filter("w >= 50"), ["series"], "g", "t", HOUR / 2)
    return met.groupBy("series", "g").agg(F.round(F.percentile("o", 0.5), 4).alias("level"), F.count(F.lit(1)).alias("n"))


def c8_interpolated(spark, sf_dir):
    knots = anchors(spark, sf_dir, "event_type").filter("w >= 90").select("series", F.col("t").alias("kt"), F.col("o").alias("kv"))
    got = intervals.interpolated(_grid(spark, sf_dir), knots, ["series"], "g")
    return got.select("series", "g", F.round("v", 4).alias("v"))


def _quiet(spark, sf_dir):
    return spans(spark, sf_dir).filter("series % 3 = 0")


def b5_zero_weights(spark, sf_dir):
    a = anchors(spark, sf_dir).select("series", (F.col("t") / 86400).alias("t"), "o", "w", "event_id")
    q = spans(spark, sf_dir).select("series", (F.col("a") + 10_000).alias("a"), (F.col("a") + 10_005).alias("b"))
    got = intervals.zero_weights(a, q, ["series"], 5.0)
    return got.select("event_id", "w")


def c9_outside_spans(spark, sf_dir):
    s = spans(spark, sf_dir)
    events = s.filter("id % 7 = 0").select("series", F.col("a").alias("ea"), F.col("b").alias("eb"))
    quiet = s.filter("id % 7 <> 0").select("series", (F.col("a") + 3).alias("a"), (F.col("b") - 3).alias("b")).filter("b > a")
    got = intervals.outside_spans(events, quiet, ["series"], 30.0)
    return got.select("series", F.round("ea", 6).alias("ea"), F.round("eb", 6).alias("eb"))


def c10_near_another(spark, sf_dir):
    a = anchors(spark, sf_dir, "event_type")
    got = intervals.near_another(a.filter("w < 30"), a.filter("w >= 95"), ["series"], "t", "t", 1800.0)
    return got.select("series", "event_id")


def g5_uncovered_gaps(spark, sf_dir):
    got = intervals.uncovered_gaps(spans(spark, sf_dir), ["series"])
    return got.select("series", F.round("gap_a", 6).alias("gap_a"), F.round("gap_b", 6).alias("gap_b"))


def e5_runs(spark, sf_dir):
    days = spans(spark, sf_dir).select("series", F.floor("b").alias("i")).distinct()
    return intervals.merged_runs(days, ["series"], "i")


def c13_agreement_in_events(spark, sf_dir):
    """Spans whose anchors, wholly inside, have a median within 20 of 50: confirmed, so they go."""
    a = anchors(spark, sf_dir, "event_type").select("series", "t", F.col("t").alias("t2"), "o")
    g = _grid(spark, sf_dir).filter(F.floor(F.col("g") / HOUR) % 6 == 0).select("series", F.col("g").alias("ea"), (F.col("g") + 6 * HOUR).alias("eb"))
    met = intervals.overlap_join(g, a, ["series"], ("ea", "eb"), ("t", "t2"), 6 * HOUR).filter((F.col("t") - 600 >= F.col("ea")) & (F.col("t") + 600 <= F.col("eb")))
    agreed = met.groupBy("series", "ea", "eb").agg(F.percentile("o", 0.5).alias("m"), F.count(F.lit(1)).alias("n")).filter("n >= 3 and abs(m - 50) <= 20")
    return g.join(agreed, ["series", "ea", "eb"], "left_anti").select("series", "ea", "eb")


def _layout(spark, sf_dir):
    """Of each conversation a curve (a node a turn, 7 s apart, shifted by the text's length), its length, and cuts after every fourth turn, of the sign that the text says."""
    c = cues(spark, sf_dir).select("series", F.col("n"), F.round((F.col("end") - F.col("start")) * 15).cast("long").alias("k"))
    curve = c.select("series", (F.col("n") * 7.0).alias("t"), (F.col("k") % 41).cast("double").alias("shift"))
    tc = F.col("n") * 7.0 + 3.5 * (F.col("k") % 3)
    cuts = c.filter("n % 4 = 3").select("series", tc.alias("tc"), F.when(F.col("k") % 2 == 0, -1.0).otherwise(1.0).alias("delta"), (tc - F.col("k") % 5 * 0.8).alias("t_end"), (tc + F.col("k") % 7 * 0.9).alias("t_nxt"))
    return curve, cuts, c.groupBy("series").agg((F.max("n") * 7.0 + 5.0).alias("length"))


def _pieces(spark, sf_dir):
    return timemap.cut_pieces(*_layout(spark, sf_dir), ["series"], 24.0)


_CUE_K = "select conv_id as series, turn as n, length(text) as k from conversations"
#: Every knot's shift looked up for itself: in its stretch between the nodes about it, else by the rule for its side.
_PIECES = f"""(with k as ({_CUE_K}), n as (select series, n * 7.0::double as t, (k % 41)::double as s from k), z as (select series, max(n) * 7.0::double + 5 as length from k group by series),
c as (select series, n * 7.0::double + 3.5 * (k % 3) as tc, k % 2 = 0 as hole, n * 7.0::double + 3.5 * (k % 3) - k % 5 * 0.8::double as t_end, n * 7.0::double + 3.5 * (k % 3) + k % 7 * 0.9::double as t_nxt from k where n % 4 = 3),
b as (select series, lag(tc) over q as after, tc as upto, lag(case when hole then t_nxt else tc end) over q as a, case when hole then t_end else tc end as b from (select * from c union all select series, 'infinity'::double, false, length, length from z) window q as (partition by series order by tc)),
g as (select b.series, coalesce(after, '-infinity'::double) as after, upto, coalesce(a, 0) as a, case when isinf(upto) then length else b end as b, after is null as head, isinf(upto) as tail from b join z on z.series = b.series),
w as (select g.*, (select list({{'t': n.t, 's': n.s}} order by n.t) from n where n.series = g.series and n.t > g.after and n.t <= g.upto) as ns from g where b > a),
p as (select series, after, head, tail, ns, len(ns) as m, unnest(list_concat([a, b], list_transform(list_filter(ns, lambda x: x.t > a and x.t < b), lambda x: x.t))) as t from w where ns is not null),
e as (select *, list_filter(ns, lambda x: x.t <= p.t)[-1] as lo, list_filter(ns, lambda x: x.t >= p.t)[1] as hi from p),
v as (select series, after, t, case when lo is null and (head or m = 1) then ns[1].s when lo is null then ns[1].s + (ns[2].s - ns[1].s) / (ns[2].t - ns[1].t) * (t - ns[1].t)
  when hi is null and (tail or m = 1) then ns[m].s when hi is null then ns[m].s + (ns[m].s - ns[m - 1].s) / (ns[m].t - ns[m - 1].t) * (t - ns[m].t) when hi.t = lo.t then lo.s else lo.s + (hi.s - lo.s) * (t - lo.t) / (hi.t - lo.t) end as s from e),
x as (select series, t as t0, lead(t) over q as t1, t + s / 24 as x0, lead(t + s / 24) over q as x1 from v window q as (partition by series, after order by t))
select * from x where t1 > t0 and x1 > x0)"""


def i31_map_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir).select("series", "t0", "t1", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


def c11_retimed_cues(spark, sf_dir):
    got = intervals.retimed(cues(spark, sf_dir), _pieces(spark, sf_dir), ["series"], 75.0, 1 / 24)
    return got.select("series", "n", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


def i29_lines_on_grid(spark, sf_dir):
    """Segment lines (one a day) evaluated on the grid."""
    g = _grid(spark, sf_dir).withColumn("g2", F.col("g"))
    segs = g.select("series", F.floor(F.col("g") / 86400).alias("d")).distinct().select("series", (F.col("d") * 86400.0).alias("sa"), (F.col("d") * 86400.0 + 86399).alias("sb"), ((F.col("d") % 5) / 86400.0).alias("slope"), (F.col("d") % 3 * 1.0).alias("level"))
    met = intervals.overlap_join(g, segs, ["series"], ("g", "g2"), ("sa", "sb"), 86400.0)
    return met.select("series", "g", F.round(F.col("level") + F.col("slope") * (F.col("g") - F.col("sa")), 6).alias("v"))


def g2_unvisited(spark, sf_dir):
    """Hours of the grid that no anchor of weight 50 falls in."""
    seen = anchors(spark, sf_dir, "event_type").filter("w >= 50").select("series", (F.floor(F.col("t") / HOUR) * HOUR).alias("g")).distinct()
    return _grid(spark, sf_dir).join(seen, ["series", "g"], "left_anti")


def g3_kinds_of_spans(spark, sf_dir):
    s = spans(spark, sf_dir)
    long = s.filter("b - a > 100").select("series", F.lit("long").alias("kind"), "id")
    return long.unionByName(s.filter("b - a < 5").select("series", F.lit("short").alias("kind"), "id"))


def g4_distinct_cuts(spark, sf_dir):
    return spans(spark, sf_dir).select("series", F.floor("a").alias("a"), F.floor("b").alias("b")).distinct()


def i26_classified_cuts(spark, sf_dir):
    """Spans classed by what lies in them: excision, insertion, or neither."""
    s = spans(spark, sf_dir).filter("id % 5 = 0").withColumnRenamed("id", "cut")
    other = spans(spark, sf_dir).filter("id % 5 <> 0").select("series", F.col("a").alias("t"), F.col("a").alias("t2"), (F.col("b") - F.col("a")).alias("len"))
    met = intervals.overlap_join(s, other, ["series"], ("a", "b"), ("t", "t2"), 60.0)
    got = met.groupBy("cut").agg(F.avg((F.col("len") > 60).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"), F.max(F.col("b") - F.col("a")).alias("length"))
    kind = F.when((F.col("share") >= 0.15) & (F.col("length") >= 80), "excision").when((F.col("n") >= 2) & (F.col("length") >= 40), "insertion").otherwise("none")
    return got.select("cut", kind.alias("kind"))


ORACLES = {
    "b4_grid": _GRID,
    "c6_window_join": f"""with g as ({_GRID}), a as ({AE}), m as (select g.series, g, o, w from g join a on a.series = g.series and t >= g - {HOUR} and t < g + {HOUR}),
{wmed_sql("l", "m", "series, g", "o", "w", "level")}
select m.series, m.g, round(max(level), 4) as level, round(quantile_cont(w, 0.5) * avg(case when abs(o - level) <= 20 then 1.0 else 0.0 end), 4) as weight, count(*) as n
from m join l on m.series = l.series and m.g = l.g group by m.series, m.g""",
    "c7_descriptor_window_join": f"""with g as ({_GRID}), a as ({AE}) select g.series, g, round(quantile_cont(o, 0.5), 4) as level, count(*) as n from g join a on a.series = g.series and w >= 50 and t >= g - {HOUR / 2} and t < g + {HOUR / 2} group by g.series, g""",
    "c8_interpolated": f"""with g as ({_GRID}), k as (select series, t, max(o) as o from ({AE}) where w >= 90 group by series, t),
b as (select g.series, g, max(t) as ta from g join k on k.series = g.series and t <= g group by g.series, g),
f as (select g.series, g, min(t) as tb from g join k on k.series = g.series and t >= g group by g.series, g)
select g.series, g.g, round(case when ka.o is null then kb.o when kb.o is null or kb.t = ka.t then ka.o else ka.o + (kb.o - ka.o) * (g.g - ka.t) / (kb.t - ka.t) end, 4) as v
from g left join b on b.series = g.series and b.g = g.g left join f on f.series = g.series and f.g = g.g left join k ka on ka.series = g.series and ka.t = b.ta left join k kb on kb.series = g.series and kb.t = f.tb""",
    "b5_zero_weights": f"""select event_id, case when exists (select 1 from ({SPANS_SQL}) s where s.series = e.series and e.t / 86400 >= s.a + 10000 and e.t / 86400 <= s.a + 10005) then 0.0 else w end as w from ({AU}) e""",
    "c9_outside_spans": f"""with s as ({SPANS_SQL}), e as (select distinct series, a as ea, b as eb from s where id % 7 = 0), q as (select series, a + 3 as a, b - 3 as b from s where id % 7 <> 0 and b - 3 > a + 3),
c as (select e.series, ea, eb, sum(greatest(0, least(eb, b) - greatest(ea, a))) as inside from e join q on q.series = e.series and a <= eb and b >= ea group by e.series, ea, eb)
select e.series, round(e.ea, 6) as ea, round(e.eb, 6) as eb from e left join c on c.series = e.series and c.ea = e.ea and c.eb = e.eb where not coalesce(inside >= 0.5 * (e.eb - e.ea), false)""",
    "c10_near_another": f"with a as ({AE}) select series, event_id from a x where w < 30 and exists (select 1 from a y where y.series = x.series and y.w >= 95 and abs(x.t - y.t) <= 1800)",
    "g5_uncovered_gaps": f"""select series, round(reach, 6) as gap_a, round(a, 6) as gap_b from (select *, max(b) over (partition by series order by a, b rows between unbounded preceding and 1 preceding) as reach from ({SPANS_SQL})) where a - reach >= 0.5""",
    "e5_runs": f"""with d as (select distinct series, cast(floor(b) as bigint) as i from ({SPANS_SQL})), r as (select series, i, i - row_number() over (partition by series order by i) as g from d)
select series, min(i) as run_a, max(i) as run_b, count(*) as n from r group by series, g""",
    "c13_agreement_in_events": f"""with g as (select series, g as ea, g + {6 * HOUR} as eb from ({_GRID}) where cast(floor(g / {HOUR}) as bigint) % 6 = 0), a as ({AE}),
ok as (select g.series, ea from g join a on a.series = g.series and t - 600 >= ea and t + 600 <= eb group by g.series, ea having count(*) >= 3 and abs(quantile_cont(o, 0.5) - 50) <= 20)
select series, ea, eb from g where not exists (select 1 from ok where ok.series = g.series and ok.ea = g.ea)""",
    "i31_map_pieces": f"select series, t0, t1, round(x0, 6) as x0, round(x1, 6) as x1 from ({_PIECES})",
    "c11_retimed_cues": f"""with c as (select series, n, greatest(0, start) as s, least(75.0::double, "end") as e from ({CUES_SQL})), p as ({_PIECES}),
m as (select c.series, n, t0 + (greatest(x0, s) - x0) * (t1 - t0) / (x1 - x0) as pa, t0 + (least(x1, e) - x0) * (t1 - t0) / (x1 - x0) as pb from c join p on p.series = c.series and x0 < e and x1 > s where e > s),
r as (select *, max(pb) over (partition by series, n order by pa, pb rows between unbounded preceding and 1 preceding) as reach from m),
k as (select *, sum(case when reach is null or pa - reach > 1e-6 then 1 else 0 end) over (partition by series, n order by pa, pb rows unbounded preceding) as run from r),
f as (select series, n, min(pa) as start, max(pb) as stop from k group by series, n, run)
select series, n, round(start, 5) as start, round(stop, 5) as "end" from f where stop - start >= 1.0::double / 24""",
    "i29_lines_on_grid": f"select series, g, round(cast(floor(g / 86400) as bigint) % 3 + (cast(floor(g / 86400) as bigint) % 5) / 86400.0::double * (g - floor(g / 86400) * 86400), 6) as v from ({_GRID})",
    "g2_unvisited": f"with g as ({_GRID}), a as ({AE}) select series, g from g where not exists (select 1 from a where a.series = g.series and w >= 50 and floor(t / {HOUR}) * {HOUR} = g.g)",
    "g3_kinds_of_spans": f"with s as ({SPANS_SQL}) select series, 'long' as kind, id from s where b - a > 100 union all select series, 'short', id from s where b - a < 5",
    "g4_distinct_cuts": f"select distinct series, cast(floor(a) as bigint) as a, cast(floor(b) as bigint) as b from ({SPANS_SQL})",
    "i26_classified_cuts": f"""with s as ({SPANS_SQL}), m as (select c.id as cut, c.b - c.a as length, o.b - o.a as len from s c join s o on o.series = c.series and c.id % 5 = 0 and o.id % 5 <> 0 and o.a between c.a and c.b)
select cut, case when avg(case when len > 60 then 1.0 else 0.0 end) >= 0.15 and max(length) >= 80 then 'excision' when count(*) >= 2 and max(length) >= 40 then 'insertion' else 'none' end as kind from m group by cut""",
}
QUERIES = {k: globals()[k] for k in ORACLES}
