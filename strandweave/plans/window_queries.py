"""Queries over moving windows, runs, cadence and silence."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import windows
from strandweave.plans.fixtures import FRAMES_SQL, SAMPLES_SQL, anchors, anchors_sql, frames, samples

AU = anchors_sql()
AE = anchors_sql("event_type")
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def _numbered(spark, sf_dir):
    """(series, i, cos): anchors numbered in time; those of weight under 10 are unassigned."""
    from pyspark.sql import Window

    a = anchors(spark, sf_dir, "event_type")
    i = F.row_number().over(Window.partitionBy("series").orderBy("t", "event_id")) - 1
    return a.select("series", i.alias("i"), F.when(F.col("w") >= 10, F.col("w") / 100).alias("cos"), F.col("o").alias("off"), "t", "o", "w")


_NUMBERED = f"select series, row_number() over (partition by series order by t, event_id) - 1 as i, case when w >= 10 then w / 100 end as cos, o as off, t, o, w from ({AE})"


def e1_moving_weighted_median(spark, sf_dir):
    got = windows.moving_weighted_median(anchors(spark, sf_dir), ["series"], 8)
    return got.select("event_id", F.round("smooth", 4).alias("smooth"))


def e3_coarse_trail(spark, sf_dir):
    a = anchors(spark, sf_dir).withColumn("o", F.col("o") / 10)
    return windows.coarse_trail(a, ["series"], 25.0).select("series", "t", F.round("trail", 4).alias("trail"))


def b6_confident(spark, sf_dir):
    return windows.confident(anchors(spark, sf_dir), ["series"]).select("series", "event_id")


def b8_edge_guard(spark, sf_dir):
    return anchors(spark, sf_dir).select("event_id", F.when(F.abs(F.col("o")) > 98, 0.0).otherwise(F.col("w")).alias("w"))


def e4_low_zones(spark, sf_dir):
    return windows.low_zones(_numbered(spark, sf_dir), ["series"], 2, 0.4, 2, 3)


def e7_frozen_runs(spark, sf_dir):
    return windows.frozen_runs(frames(spark, sf_dir), ["series"], 2, 4, 0.0, 4, 6)


def e8_chain_density(spark, sf_dir):
    n = _numbered(spark, sf_dir)
    return windows.chain_density(n.filter("w >= 60"), n, ["series"], 5, 4, 480.0)


def e9_cadence_signature(spark, sf_dir):
    got = windows.cadence_signature(frames(spark, sf_dir), ["series"])
    return got.select("series", F.round("prominence", 6).alias("prominence"), "period")


def e10_cadence_gate(spark, sf_dir):
    got = windows.is_cadence(windows.cadence_signature(frames(spark, sf_dir), ["series"]), F.lit(29.97), F.lit(1200), -1.0)
    return got.select("series", "period", "telecine")


def b9_thinned(spark, sf_dir):
    return windows.thinned(frames(spark, sf_dir), ["series"])


def e12_silent_runs(spark, sf_dir):
    return windows.silent_runs(samples(spark, sf_dir), ["series"], "x", 20, 52.0, 2)


def e12_fill_runs(spark, sf_dir):
    s = samples(spark, sf_dir)
    return windows.fill_runs(s.select("series", "i", F.col("y").alias("v")), s.select("series", "i", F.col("x").alias("v")), ["series"], "v", 20, 55.0, 1)


def e13_edge_silence(spark, sf_dir):
    a = anchors(spark, sf_dir).select("series", (F.col("t") / 86400).alias("t"), (F.col("t") / 86400 - 19725).alias("x"))
    got = windows.edge_silence(a, ["series"], F.lit(25.0))
    return got.select("series", F.round("head", 5).alias("head"), F.round("tail", 5).alias("tail"))


def e14_levels_at_cuts(spark, sf_dir):
    a = anchors(spark, sf_dir).withColumn("t", F.col("t") / 86400)
    cuts = a.filter("w >= 80").select("series", F.col("t").alias("tc")).distinct()
    got = windows.levels_at(cuts, a, ["series"], 3.0)
    return got.select("series", F.round("tc", 6).alias("tc"), F.round("before", 3).alias("before"), F.round("after", 3).alias("after"))


def e17_tail_filter(spark, sf_dir):
    """Cuts whose level half a day to three days and a half later differs from that before by 30 and more."""
    a = anchors(spark, sf_dir).withColumn("t", F.col("t") / 86400)
    got = windows.levels_at(a.filter("w >= 80").select("series", F.col("t").alias("tc")).distinct(), a, ["series"], 3.0, 0.5)
    return got.filter("abs(after - before) >= 30").select("series", F.round("tc", 6).alias("tc"))


def e18_step_curve(spark, sf_dir):
    a = anchors(spark, sf_dir)
    got = windows.step_curve(a, a.filter("w >= 90").select("series", F.col("t").alias("tc")), ["series"])
    return got.select("series", "seg", F.round("level", 4).alias("level"), F.round("support", 3).alias("support"))


def f9_parabola_top(spark, sf_dir):
    f = frames(spark, sf_dir)
    lags = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 0.5)
    return f.select("series", "frame", F.round(windows.best_parabola(F.transform("vec", lambda x: x.cast("double")), lags), 5).alias("lag"))


def j8_surface_offsets(spark, sf_dir):
    """Of each frame's vector as a row of scores: the best lag, and the score over the median."""
    f = frames(spark, sf_dir)
    m = f.select("series", "frame", F.explode("vec").alias("x")).groupBy("series", "frame").agg(F.percentile(F.col("x").cast("double"), 0.5).alias("m"))
    j = f.join(m, ["series", "frame"])
    best = F.array_position("vec", F.array_max("vec")) - 1
    return j.select("series", "frame", best.alias("best"), F.round(F.array_max("vec").cast("double") - F.col("m"), 5).alias("weight"))


def k11_novelty(spark, sf_dir):
    """Mean absolute difference to the frame before."""
    from pyspark.sql import Window

    before = F.lag("vec").over(Window.partitionBy("series").orderBy("frame"))
    d = F.aggregate(F.zip_with("vec", F.col("_b"), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size("vec")
    return frames(spark, sf_dir).withColumn("_b", before).select("series", "frame", F.round(d, 6).alias("novelty"))


def i35_refined_jump(spark, sf_dir):
    """The row where the sum of (w - 50) before less that after is largest."""
    from pyspark.sql import Window

    n = _numbered(spark, sf_dir).withColumn("d", F.col("w") - 50)
    up = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = n.withColumn("s", 2 * F.sum("d").over(up) - F.sum("d").over(Window.partitionBy("series")))
    return s.groupBy("series").agg(F.max_by("i", F.struct(F.col("s"), -F.col("i"))).alias("split"), F.max("s").alias("gain"))


def a24_uneven_axis(spark, sf_dir):
    """Largest distance of a series' times to the best even grid, in steps, and whether that exceeds 1.5."""
    n = _numbered(spark, sf_dir)
    e = n.groupBy("series").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("i").alias("m"))
    got = n.join(e, "series").groupBy("series").agg(F.max(F.abs(F.col("t") - F.col("t0") - F.col("i") * (F.col("t1") - F.col("t0")) / F.col("m")) / ((F.col("t1") - F.col("t0")) / F.col("m"))).alias("residual"))
    return got.select("series", F.round("residual", 4).alias("residual"), (F.col("residual") > 1.5).alias("uneven"))


_SIMS = f"select series, frame, {_DOT.format(a='vec', b='pv')} as sim from (select *, lag(vec) over (partition by series order by frame) as pv from ({FRAMES_SQL}))"
_SIG = f"""x as (select series, frame, 1 - sim as x from s where sim is not null), c as (select series, frame, x - avg(x) over (partition by series) as c from x),
l as (select a.series, p, sum(a.c * b.c) as r from c a cross join (select unnest(generate_series(0, 12)) as p) join c b on b.series = a.series and b.frame = a.frame + p group by a.series, p),
n as (select l.series, l.p, l.r / (z.r + 1e-12) as r from l join l z on z.series = l.series and z.p = 0),
g as (select series, greatest(max(r) filter (where p = 5), max(r) filter (where p = 10)) - (sum(r) filter (where p in (3, 4, 6, 7))) / 4 as prominence,
  arg_max(p, r) filter (where p >= 2) as period from n group by series)"""
_LEVELS = f"""with a as (select series, t / 86400 as t, o, w from ({AU})), c as (select distinct series, t as tc from a where w >= 80),
l as (select c.series, tc, quantile_cont(o, 0.5) filter (where t < tc - {{buf}}) as before, quantile_cont(o, 0.5) filter (where t > tc + {{buf}}) as after
from c join a on a.series = c.series and t between tc - {{far}} and tc + {{far}} group by c.series, tc)"""
_TRAIL = """{n}_j as (select x.series, x.t, y.o, greatest(y.w, 1e-6) as w from {src} x join {src} y on y.series = x.series and y.i between x.i - {h} and x.i + {h}),
{n}_c as (select series, t, o, sum(w) over (partition by series, t order by o, w rows unbounded preceding) as cw, sum(w) over (partition by series, t) as tw from {n}_j),
{n} as (select series, t, min(o) filter (where cw >= tw / 2) as m from {n}_c group by series, t)"""

ORACLES = {
    "e1_moving_weighted_median": f"""with a as (select *, row_number() over (partition by series order by t) as i from ({AU})), {_TRAIL.format(n="m", src="a", h=4)}
select event_id, round(m, 4) as smooth from a join m on m.series = a.series and m.t = a.t""",
    "e3_coarse_trail": f"""with a as (select series, t, o / 10 as o, case when abs(o / 10) > 23 then 0 else w end as w, row_number() over (partition by series order by t) as i from ({AU})),
{_TRAIL.format(n="m", src="a", h=10)}, b as (select a.series, a.t, a.o, case when abs(a.o - m) <= 4 then w else 0 end as w, i from a join m on m.series = a.series and m.t = a.t), {_TRAIL.format(n="k", src="b", h=10)}
select series, t, round(m, 4) as trail from k""",
    "b6_confident": f"with a as ({AU}), g as (select series, quantile_cont(w, 0.5) filter (where w > 0) as g from a group by series) select a.series, event_id from a join g on g.series = a.series where w >= 0.5 * g",
    "b8_edge_guard": f"select event_id, case when abs(o) > 98 then 0.0 else w end as w from ({AU})",
    "e4_low_zones": f"""with a as ({_NUMBERED}), m as (select series, i, cos, quantile_cont(cos, 0.5) over (partition by series order by i rows between 2 preceding and 2 following) as m from a),
l as (select series, i, case when i - lag(i) over (partition by series order by i) > 3 then 1 else 0 end as new from m where cos is not null and m < 0.4),
r as (select series, i, sum(new) over (partition by series order by i rows unbounded preceding) as run from l)
select series, min(i) as run_a, max(i) as run_b, count(*) as n from r group by series, run having max(i) - min(i) + 1 >= 3""",
    "e7_frozen_runs": f"""with f as ({FRAMES_SQL}), s as (select a.series, a.frame from f a join f b on b.series = a.series and b.frame = a.frame + 4 where a.frame % 2 = 0
and {_DOT.format(a="a.vec", b="b.vec")} / (sqrt({_DOT.format(a="a.vec", b="a.vec")}) * sqrt({_DOT.format(a="b.vec", b="b.vec")})) >= 0.0),
l as (select *, case when frame - lag(frame) over (partition by series order by frame) > 6 then 1 else 0 end as new from s),
r as (select series, frame, sum(new) over (partition by series order by frame rows unbounded preceding) as run from l)
select series, min(frame) as run_a, max(frame) as run_b, count(*) as n from r group by series, run having max(frame) + 4 - min(frame) >= 6""",
    "e8_chain_density": f"""with a as ({_NUMBERED}), c as (select *, lag(i) over (partition by series order by i) as pi, abs(off - lag(off) over (partition by series order by i)) > 480 as j from a where w >= 60),
e as (select series, min(pi) as first, max(i) as last from c where j group by series),
n as (select a.series, a.i, count(c.i) as n from a left join c on c.series = a.series and c.i between a.i - 5 and a.i + 5 group by a.series, a.i)
select n.series, n.i, n >= 4 and coalesce(n.i <= first or n.i >= last, true) as protected from n left join e on e.series = n.series""",
    "e9_cadence_signature": f"with s as ({_SIMS}), {_SIG} select series, round(prominence, 6) as prominence, period::int as period from g",
    "e10_cadence_gate": f"with s as ({_SIMS}), {_SIG} select series, period::int as period, period = 5 and prominence >= -1 as telecine from g",
    "b9_thinned": f"""with s as ({_SIMS}), r as (select *, row_number() over (partition by series, frame // 5 order by sim desc nulls last, frame) as r, count(sim) over (partition by series, frame // 5) as n from s)
select series, frame, not (n >= 5 and r = 1) as keep from r""",
    "e12_silent_runs": f"""with b as (select series, i // 20 as b, sqrt(avg(x * x)) as r from ({SAMPLES_SQL}) group by series, i // 20), q as (select series, b, b - row_number() over (partition by series order by b) as g from b where r < 52)
select series, min(b) as run_a, max(b) as run_b, count(*) as n from q group by series, g having count(*) >= 2""",
    "e12_fill_runs": f"""with b as (select series, i // 20 as b, sqrt(avg(y * y)) as d, sqrt(avg(x * x)) as r from ({SAMPLES_SQL}) group by series, i // 20), q as (select series, b, b - row_number() over (partition by series order by b) as g from b where d < 55 and r >= 55)
select series, min(b) as run_a, max(b) as run_b, count(*) as n from q group by series, g""",
    "e13_edge_silence": f"""with a as (select series, t / 86400 as t, t / 86400 - 19725 as x from ({AU})), e as (select series, max(t) filter (where x < 0) - min(t) as head, max(t) - min(t) filter (where x > 25) as tail from a group by series)
select series, round(case when head >= 0.3 then head else 0 end, 5) as head, round(case when tail >= 0.3 then tail else 0 end, 5) as tail from e""",
    "e14_levels_at_cuts": f"{_LEVELS.format(buf=0, far=3.0)} select series, round(tc, 6) as tc, round(before, 3) as before, round(after, 3) as after from l",
    "e17_tail_filter": f"{_LEVELS.format(buf=0.5, far=3.5)} select series, round(tc, 6) as tc from l where abs(after - before) >= 30",
    "e18_step_curve": f"""with a as ({AU}), c as (select series, t as tc from a where w >= 90), s as (select a.series, a.t, o, w, (select count(*) from c where c.series = a.series and c.tc < a.t) as seg from a),
l as (select series, seg, quantile_cont(o, 0.5) filter (where w > 0) as l, sum(w) as support from s group by series, seg)
select series, seg, round(coalesce(last_value(l ignore nulls) over (partition by series order by seg rows unbounded preceding), first_value(l ignore nulls) over (partition by series order by seg rows between current row and unbounded following)), 4) as level, round(support, 3) as support from l""",
    "f9_parabola_top": f"""with f as (select series, frame, vec, list_position(vec, list_max(vec)) as k from ({FRAMES_SQL})),
y as (select series, frame, k, case when k > 1 then vec[k - 1]::double end as y0, vec[k]::double as y1, vec[k + 1]::double as y2 from f)
select series, frame, round((k - 1) * 0.5 + coalesce(case when y0 - 2 * y1 + y2 < 0 then greatest(-1.0, least(1.0, 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2))) end, 0) * 0.5, 5) as lag from y""",
    "j8_surface_offsets": f"""with f as ({FRAMES_SQL}), x as (select series, frame, unnest(vec)::double as x from f), m as (select series, frame, quantile_cont(x, 0.5) as m from x group by series, frame)
select f.series, f.frame, list_position(vec, list_max(vec)) - 1 as best, round(list_max(vec)::double - m, 5) as weight from f join m on m.series = f.series and m.frame = f.frame""",
    "k11_novelty": f"""select series, frame, round(list_sum(list_transform(list_zip(vec, pv), lambda z: abs(z[1]::double - z[2]::double))) / len(vec), 6) as novelty
from (select *, lag(vec) over (partition by series order by frame) as pv from ({FRAMES_SQL}))""",
    "i35_refined_jump": f"""with s as (select series, i, 2 * sum(w - 50) over (partition by series order by i rows unbounded preceding) - sum(w - 50) over (partition by series) as s from ({_NUMBERED})),
r as (select *, row_number() over (partition by series order by s desc, i) as r from s) select series, i as split, s as gain from r where r = 1""",
    "a24_uneven_axis": f"""with n as ({_NUMBERED}), e as (select series, min(t) as t0, max(t) as t1, max(i) as m from n group by series),
r as (select n.series, max(abs(t - t0 - i * (t1 - t0) / m) / ((t1 - t0) / m)) as r from n join e on e.series = n.series group by n.series) select series, round(r, 4) as residual, r > 1.5 as uneven from r""",
}
QUERIES = {k: globals()[k] for k in ORACLES}
