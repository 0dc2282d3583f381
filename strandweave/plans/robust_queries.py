"""Queries over anchor series: weighted medians, lines, scales, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import robust
from strandweave.plans.fixtures import FRAMES_SQL, SAMPLES_SQL, anchors, anchors_sql, frames, samples, table, wmed_sql

DAY = 86_400.0
A = anchors_sql()
AE = anchors_sql("event_type")


def d1_weighted_median(spark, sf_dir):
    return robust.weighted_median(anchors(spark, sf_dir), ["series"], "o", "w")


def d7_global_scale(spark, sf_dir):
    got = robust.global_scale(anchors(spark, sf_dir, "event_type"), ["series"], DAY)
    return got.select("series", F.round(F.col("slope") * DAY, 6).alias("slope_per_day"), "n_slopes")


def d7_guarded_trend(spark, sf_dir):
    got = robust.guarded_trend(anchors(spark, sf_dir, "event_type"), ["series"], 1e-3, DAY)
    return got.select("series", F.round(F.col("slope") * DAY, 5).alias("slope_per_day"), F.round("level", 3).alias("level"))


def d3_robust_line(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn("t", F.col("t") / DAY - 19723)
    got = robust.robust_line(rows.filter("w > 0"), ["series"])
    return got.select("series", F.round("a", 4).alias("a"), F.round("b", 3).alias("b"), F.round("spread", 4).alias("spread"))


def d4_prefix_moments(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn("t", F.col("t") / DAY - 19723)
    got = robust.prefix_moments(rows, ["series"])
    return got.select("series", "event_id", F.round("cw", 3).alias("cw"), *(F.round(c, 2).alias(c) for c in ("ct", "cy", "ctt", "cty")))


def d5_theil_sen(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn("t", F.col("t") / DAY)
    got = robust.theil_sen(rows, ["series"], limit=5.0)
    return got.select("series", F.round("slope", 4).alias("slope"), F.round("level", 1).alias("level"))


def d6_plot_baseline(spark, sf_dir):
    rows = anchors(spark, sf_dir, "event_type").withColumn("t", F.col("t") / DAY)
    body = rows.join(rows.groupBy("series").agg((F.min("t") + 1).alias("head")), "series").filter("t >= head")
    got = robust.theil_sen(body, ["series"], points=100)
    return got.select("series", F.round("slope", 4).alias("slope"), F.round("level", 1).alias("level"))


def _match(spark, sf_dir):
    s = anchors(spark, sf_dir)
    return s.select("series", F.col("event_id").alias("dub"), F.when(F.col("w") >= 20, F.floor(F.col("o"))).alias("ref"), (F.col("w") / 100).alias("cos"))


def d8_match_metrics(spark, sf_dir):
    got = robust.match_metrics(_match(spark, sf_dir), ["series"])
    return got.select("series", F.round("slope", 4).alias("slope"), "backward", F.round("median_cos", 4).alias("median_cos"), F.round("assigned", 6).alias("assigned"), "intro")


def d9_excess_movement(spark, sf_dir):
    got = robust.excess_movement(anchors(spark, sf_dir).withColumn("v", F.col("o") - 50), ["series"], "v")
    return got.select("series", F.round("excess", 3).alias("excess"))


def d10_layer_metrics(spark, sf_dir):
    rows = anchors(spark, sf_dir).withColumn("w", F.col("w") / 100)
    got = robust.layer_metrics(rows, ["series"], DAY)
    return got.select("series", *(F.round(c, 3).alias(c) for c in ("coverage", "span", "largest_step", "path", "net", "drift", "residual")))


def d11_consensus_box(spark, sf_dir):
    x = F.col("l_extendedprice") / 1000  # as samples() has it; its numbers aren't needed
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series"), *((x * k).alias(n) for n, k in (("left", 3), ("top", 5), ("width", 11), ("height", 7))))
    return robust.consensus(rows, ["series"], ["left", "top", "width", "height"])


def d13_phat_desync(spark, sf_dir):
    lags = anchors(spark, sf_dir).select("series", (F.col("w") / 10).alias("lag"))
    got = robust.phat_desync(lags, ["series"], far=4.0, tight=3.0)
    return got.select("series", F.round("median_lag", 4).alias("median_lag"), F.round("mad", 4).alias("mad"), "danger")


def d17_run_counts(spark, sf_dir):
    rows = anchors(spark, sf_dir, "event_type")
    return rows.groupBy("series").agg(F.count_if(F.col("w") >= 50).alias("n_ok"), F.count_if(F.col("w") < 50).alias("n_fail"))


def d18_whitened(spark, sf_dir):
    f = frames(spark, sf_dir)
    got = robust.whitened(f, f.filter("series = 'ref'"))
    return got.select("series", "frame", F.round(F.element_at("vec", 1), 5).alias("first"), F.round(F.array_max("vec"), 5).alias("largest"))


def d19_z_normalised(spark, sf_dir):
    s = samples(spark, sf_dir).select("series", "i", F.col("x").alias("value"))
    got = robust.z_normalised(s, ["series"])
    return got.select("series", "i", F.round("value", 5).alias("value"))


_DAYS = f"select series, t / {DAY} - 19723 as t, o, w, event_id from ({A})"

_THEIL = """
with a as ({rows}),
r as (select series, t, o, row_number() over (partition by series order by t, o) - 1 as i, count(*) over (partition by series) as n from a),
p as (select * from r where i % greatest(1, n // {points}) = 0),
s as (select x.series, (y.o - x.o) / (y.t - x.t) as s from p x join p y on x.series = y.series and y.t > x.t + 1),
m as (select r.series, {clip_a}coalesce(quantile_cont(s, 0.5), 0.0){clip_b} as slope from (select distinct series from r) r left join s on r.series = s.series group by r.series)
select m.series, round(slope, 4) as slope, round(quantile_cont(o - slope * t, 0.5), 1) as level from m join a on a.series = m.series group by m.series, slope"""

_SCALE = f"""
with a as ({AE}),
ends as (select series, min(t) as t0, max(t) as t1 from a group by series),
e as (select *, greatest(2, floor((t1 - t0) / {DAY})) as nb from ends where t1 > t0),
binned as (select a.series, a.o, a.w, t0, (t1 - t0) / nb as step, least(floor((t - t0) / ((t1 - t0) / nb)), nb - 1) as bin from a join e on a.series = e.series where w > 0 and t < t1),
sizes as (select series, bin, sum(w) as bw, max(t0) + (bin + 0.5) * max(step) as mid from binned group by series, bin having count(*) >= 3),
{wmed_sql("lv", "binned", "series, bin", "o", "w", "level")},
lev as (select lv.series, lv.bin, level, bw, mid from lv join sizes on lv.series = sizes.series and lv.bin = sizes.bin),
sl as (select series, (lead(level) over q - level) / (lead(mid) over q - mid) as s, least(lead(bw) over q, bw) as sw from lev window q as (partition by series order by bin)),
slo as (select * from sl where s is not null),
{wmed_sql("sc", "slo", "series", "s", "sw", "slope")},
scn as (select series, count(*) as n_slopes from slo group by series)"""

_LINE = f"""
with a as (select * from ({_DAYS}) where w > 0),
m as (select series, sum(w * t) / sum(w) as tm from a group by series),
r as (select a.series, t - tm as t, o as y, w, tm from a join m on a.series = m.series),
f1 as (select series, coalesce((sum(w) * sum(w * t * y) - sum(w * t) * sum(w * y)) / nullif(sum(w) * sum(w * t * t) - sum(w * t) * sum(w * t), 0), 0) as a,
  sum(w) as sw, sum(w * t) as st, sum(w * y) as sy from r group by series),
g1 as (select series, a, (sy - a * st) / sw as b from f1),
s1 as (select r.series, sqrt(sum(w * (y - a * t - b) * (y - a * t - b)) / sum(w)) as s from r join g1 on r.series = g1.series group by r.series),
r2 as (select r.series, t, y, tm, w * coalesce(exp(-0.5 * pow((y - a * t - b) / nullif(2.5 * s, 0), 2)), 1) as w from r join g1 on r.series = g1.series join s1 on r.series = s1.series),
f2 as (select series, coalesce((sum(w) * sum(w * t * y) - sum(w * t) * sum(w * y)) / nullif(sum(w) * sum(w * t * t) - sum(w * t) * sum(w * t), 0), 0) as a,
  sum(w) as sw, sum(w * t) as st, sum(w * y) as sy, max(tm) as tm from r2 group by series),
g2 as (select series, a, (sy - a * st) / sw as b, tm from f2),
s2 as (select r2.series, sqrt(sum(w * (y - a * t - b) * (y - a * t - b)) / sum(w)) as s from r2 join g2 on r2.series = g2.series group by r2.series)
select g2.series, round(a, 4) as a, round(b - a * tm, 3) as b, round(s, 4) as spread from g2 join s2 on g2.series = s2.series"""

_EVEN = "cast(round_even(quantile_cont(x * {k}, 0.5), 0) as bigint) - cast(round_even(quantile_cont(x * {k}, 0.5), 0) as bigint) % 2"

ORACLES = {
    "d1_weighted_median": f"with a as ({A}), {wmed_sql('m', 'a', 'series', 'o', 'w', 'wmed')} select series, wmed from m",
    "d7_global_scale": f"{_SCALE} select sc.series, round(slope * {DAY}, 6) as slope_per_day, n_slopes from sc join scn on sc.series = scn.series",
    "d7_guarded_trend": f"""{_SCALE},
rest as (select a.series, o - slope * t as r, greatest(w, 1e-6) as w from a join sc on a.series = sc.series),
{wmed_sql("le", "rest", "series", "r", "w", "level")}
select sc.series, round(case when abs(slope) / 1e-3 * 100 <= 15 then slope else 0 end * {DAY}, 5) as slope_per_day,
  round(case when abs(slope) / 1e-3 * 100 <= 15 then level else 0 end, 3) as level from sc join le on sc.series = le.series""",
    "d3_robust_line": _LINE,
    "d4_prefix_moments": f"""select series, event_id, round(sum(w) over q, 3) as cw, round(sum(w * t) over q, 2) as ct, round(sum(w * o) over q, 2) as cy, round(sum(w * t * t) over q, 2) as ctt,
round(sum(w * t * o) over q, 2) as cty from ({_DAYS}) window q as (partition by series order by t rows unbounded preceding)""",
    "d5_theil_sen": _THEIL.format(rows=f"select series, t / {DAY} as t, o from ({A})", points=20, clip_a="greatest(-5.0, least(5.0, ", clip_b="))"),
    "d6_plot_baseline": _THEIL.format(
        rows=f"select series, t, o from (select series, t / {DAY} as t, o, min(t / {DAY}) over (partition by series) as t0 from ({AE})) where t >= t0 + 1", points=100, clip_a="", clip_b=""),
    "d8_match_metrics": f"""with m as (select series, event_id as dub, case when w >= 20 then floor(o) end as ref, w / 100 as cos from ({A})),
h as (select *, lag(ref) over (partition by series order by dub) > ref as back from m where ref is not null),
e as (select series, min(dub) as first, count(*) as n from m group by series),
g as (select series, regr_slope(ref, dub) as slope, count(*) filter (where back) as backward, quantile_cont(cos, 0.5) as median_cos, count(*) as k, min(dub) as hit from h group by series)
select e.series, round(slope, 4) as slope, coalesce(backward, 0) as backward, round(median_cos, 4) as median_cos, round(coalesce(k, 0) / n, 6) as assigned, coalesce(hit, first) - first as intro from e left join g on e.series = g.series""",
    "d9_excess_movement": f"select series, round(sum(abs(o - 50)) - abs(sum(o - 50)), 3) as excess from ({A}) group by series",
    "d10_layer_metrics": f"""with a as (select series, t, o, w / 100 as w, o - lag(o) over (partition by series order by t, o) as d, t - min(t) over (partition by series) as s from ({A})),
m as (select series, quantile_cont(o, 0.5) filter (where s >= {DAY}) as med from a group by series)
select a.series, round(avg(case when w >= 0.5 then 1.0 else 0.0 end), 3) as coverage, round(max(o) - min(o), 3) as span, round(max(abs(d)), 3) as largest_step, round(sum(abs(d)), 3) as path, round(sum(d), 3) as net,
round(quantile_cont(abs(o), 0.5) filter (where s >= {DAY}), 3) as drift, round(quantile_cont(abs(o - med), 0.5) filter (where s >= {DAY}), 3) as residual from a join m on a.series = m.series group by a.series""",
    "d11_consensus_box": f"select series, {_EVEN.format(k=3)} as left, {_EVEN.format(k=5)} as top, {_EVEN.format(k=11)} as width, {_EVEN.format(k=7)} as height from ({SAMPLES_SQL}) group by series",
    "d13_phat_desync": f"""with a as (select series, w / 10 as lag from ({A})), m as (select series, quantile_cont(lag, 0.5) as med, count(lag) as n from a group by series),
d as (select a.series, quantile_cont(abs(lag - med), 0.5) as mad from a join m on a.series = m.series group by a.series)
select m.series, round(med, 4) as median_lag, round(mad, 4) as mad, n >= 5 and abs(med) > 4.0 and mad < 3.0 as danger from m join d on m.series = d.series""",
    "d17_run_counts": f"select series, count(*) filter (where w >= 50) as n_ok, count(*) filter (where w < 50) as n_fail from ({AE}) group by series",
    "d18_whitened": f"""with f as ({FRAMES_SQL}),
x as (select series, frame, unnest(vec)::double as x, generate_subscripts(vec, 1) as d from f),
s as (select d, avg(x) as m, stddev_pop(x) as s from x where series = 'ref' group by d),
z as (select x.series, frame, x.d, (x - m) / (s + 1e-6) as z from x join s on x.d = s.d),
n as (select series, frame, sqrt(sum(z * z)) as n from z group by series, frame)
select z.series, z.frame, round(max(z / n) filter (where d = 1), 5) as first, round(max(z / n), 5) as largest from z join n on z.series = n.series and z.frame = n.frame group by z.series, z.frame""",
    "d19_z_normalised": f"""with s as ({SAMPLES_SQL}), m as (select series, avg(x) as m, coalesce(stddev_samp(x), 0) as d from s group by series)
select s.series, i, round((x - m) / (d + 1e-6), 5) as value from s join m on s.series = m.series""",
}
QUERIES = {k: globals()[k] for k in ORACLES}
