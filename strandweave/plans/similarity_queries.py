"""Queries over frame vectors: searching joins, and the sequence operators on them (the recurrences have no SQL; tests hold them to brute force)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandweave.operators import levels, robust, sequences, similarity
from strandweave.plans.fixtures import FRAMES_SQL, anchors, anchors_sql, frames

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"
_COS = f"{_DOT.format(a='{a}', b='{b}')} / (sqrt({_DOT.format(a='{a}', b='{a}')}) * sqrt({_DOT.format(a='{b}', b='{b}')}))"
AE = anchors_sql("event_type")


def _sides(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("pair", F.lit(1))
    return [f.filter(f"series = '{s}'").select("pair", "frame", "vec") for s in ("dub", "ref")]


def c1_best_separated(spark, sf_dir):
    got = similarity.best_separated(*_sides(spark, sf_dir), ["pair"], thin=2, apart=10, least=0.3, margin=0.0)
    return got.select("dub", "ref", F.round("cos", 6).alias("cos"), F.round("rest", 6).alias("rest"))


def c2_strong_matches(spark, sf_dir):
    got = similarity.best_separated(*_sides(spark, sf_dir), ["pair"], thin=3, apart=8, least=0.35, margin=0.01)
    return got.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def c3_orientation(spark, sf_dir):
    """Plain against mirrored vectors, read as two maps of 4 x 8."""
    from strandweave.functions.vector import mirrored

    d, r = _sides(spark, sf_dir)
    got = similarity.orientation(d, d.withColumn("vec", mirrored(F.col("vec"), 4, 8)), r, ["pair"], thin=3, apart=8, least=0.35, margin=0.01)
    return got.select("pair", "plain", "flipped", "is_mirrored")


def b3_mirrored(spark, sf_dir):
    from strandweave.functions.vector import mirrored

    m = frames(spark, sf_dir).select("series", "frame", F.posexplode(mirrored(F.col("vec"), 4, 8)).alias("k", "x"))
    return m.select("series", "frame", "k", F.round(F.col("x").cast("double"), 6).alias("x"))


def c4_band_matches(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    off = d.select("pair", F.col("frame").alias("dub"), (F.col("frame") % 7).alias("off"))
    got = similarity.band_matches(d, r, ["pair"], off, 5)
    return got.select("dub", "ref", F.round("cos", 6).alias("cos"))


def c5_assigned_cosine(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    m = d.select("pair", F.col("frame").alias("dub"), F.when(F.col("frame") % 3 != 0, F.col("frame")).alias("ref"))
    return similarity.assigned_cosine(m, d, r, ["pair"]).select("dub", "ref", F.round("cos", 6).alias("cos"))


def c12_mutual_nearest(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    ahead, back = similarity.nearest_both(d, r, ["pair"])
    return similarity.mutual_nearest(ahead, back, ["pair"], 6).select("dub", "ref", F.round("cos", 6).alias("cos"))


def c15_theil_pairs(spark, sf_dir):
    rows = anchors(spark, sf_dir, "event_type").withColumn("t", F.col("t") / 86400)
    got = robust.theil_sen(rows, ["series"], points=10)
    return got.select("series", F.round("slope", 4).alias("slope"))


def i1_monotone_chain(spark, sf_dir):
    """Length of the longest non-decreasing chain of each user's values, in order of time."""
    a = anchors(spark, sf_dir).select("series", F.col("event_id").alias("dub"), F.floor(F.col("o") * 100).cast("long").alias("ref"))
    return sequences.monotone_chain(a, ["series"]).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def i2_coarse_offsets(spark, sf_dir):
    got = sequences.coarse_offsets(*_sides(spark, sf_dir), ["pair"], thin=2, apart=10, margin=0.0)
    return got.select("dub", "off")


def i3_windowed_chain(spark, sf_dir):
    a = anchors(spark, sf_dir).select("series", F.col("event_id").alias("dub"), F.floor(F.col("o")).cast("long").alias("ref"))
    return sequences.windowed_chain(a, ["series"], 4000, 1000, 2000)


def _offsets(d):
    return d.select("pair", F.col("frame").alias("dub"), F.lit(0).cast("long").alias("off"))


def i4_flat_alignment(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    return sequences.align_chunks(d, r, _offsets(d), ["pair"], flat=0.20, chunk=120, overlap=40, margin=20, least_rows=10).select("dub", "ref")


def i6_affine_alignment(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    return sequences.align_chunks(d, r, _offsets(d), ["pair"], threshold=None, chunk=120, overlap=40, margin=20, least_rows=10).select("dub", "ref")


def i8_guarded_alignment(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    return sequences.align_chunks(d, r, _offsets(d), ["pair"], threshold=0.30, chunk=120, overlap=40, margin=20, least_rows=10).select("dub", "ref")


def i9_protected_alignment(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    p = d.select("pair", F.col("frame").alias("i"), (F.col("frame") % 11 == 0).alias("protected"))
    return sequences.align_chunks(d, r, _offsets(d), ["pair"], p, chunk=120, overlap=40, margin=20, least_rows=10).select("dub", "ref")


def i10_amerced_alignment(spark, sf_dir):
    d, r = _sides(spark, sf_dir)
    return sequences.align_chunks(d, r, _offsets(d), ["pair"], amerce=0.04, chunk=120, overlap=40, margin=20, least_rows=10).select("dub", "ref")


def i11_band_alignment(spark, sf_dir):
    """A whole pair: separated matches, chain, density, chunked alignment, cosine. Dub is ref without frames 100 to 139."""
    f = frames(spark, sf_dir).filter("series = 'ref'").select(F.lit(1).alias("pair"), "frame", "vec")
    d = f.filter("frame < 100 or frame >= 140").withColumn("frame", F.when(F.col("frame") >= 140, F.col("frame") - 40).otherwise(F.col("frame")))
    return sequences.align(d, f, ["pair"], thin=2, chunk=150, overlap=50, margin=50).select("dub", "ref", F.round("cos", 6).alias("cos"))


def _steps(spark, sf_dir):
    """Anchors of each event type with steps of 60 every ten days."""
    a = anchors(spark, sf_dir, "event_type").withColumn("d", F.col("t") / 86400 - 19723)
    return a.select("series", F.col("d").alias("t"), (F.floor(F.col("d") / 10) * 60 + F.col("o") / 40).alias("o"), (F.col("w") / 50).alias("w"))


def i15_segmented(spark, sf_dir):
    got = sequences.segmented(_steps(spark, sf_dir).withColumn("w", F.least("w", F.lit(1.0))), ["series"], 5000.0, 40)
    return got.select("series", "seg", *(F.round(c, 3).alias(c) for c in ("t_lo", "t_hi", "a", "b")))


def i16_warp_cuts(spark, sf_dir):
    got = sequences.warp_cuts(sequences.segmented(_steps(spark, sf_dir), ["series"], 5000.0, 40), ["series"], apart=1.0)
    return got.select("series", F.round("tc", 3).alias("tc"), F.round("v", 3).alias("v"))


def i20_tv_levels(spark, sf_dir):
    got = sequences.tv_levels(_steps(spark, sf_dir), ["series"], 100.0)
    return got.select("series", F.round("t", 6).alias("t"), F.round("level", 4).alias("level"))


def i21_cut_boundaries(spark, sf_dir):
    got = sequences.cut_boundaries(_steps(spark, sf_dir), ["series"], 200.0)
    return got.select("series", *(F.round(c, 4).alias(c) for c in ("tc", "delta", "t_end", "t_nxt")))


def i22_simplified(spark, sf_dir):
    return sequences.simplified(_steps(spark, sf_dir), ["series"], 3.0).select("series", F.round("t", 6).alias("t"), F.round("o", 4).alias("o"))


def i23_fitted_curve(spark, sf_dir):
    s = _steps(spark, sf_dir)
    got = sequences.fitted_curve(s, sequences.cut_boundaries(s, ["series"], 200.0), ["series"])
    return got.select("series", F.round("t", 6).alias("t"), F.round("curve", 4).alias("curve"))


def i24_time_map(spark, sf_dir):
    """Steps, cuts, curve, and the map's linear pieces."""
    from strandweave.operators.intervals import map_pieces

    s = _steps(spark, sf_dir)
    curve = sequences.fitted_curve(s, sequences.cut_boundaries(s, ["series"], 200.0), ["series"]).groupBy("series", "t").agg(F.max("curve").alias("shift"))
    return map_pieces(curve, ["series"], 24.0).select("series", *(F.round(c, 5).alias(c) for c in ("t0", "t1", "x0", "x1")))


def i25_drift_curve(spark, sf_dir):
    """By stretches between the steps' days and one cut more, beyond which nothing is confident."""
    points = _steps(spark, sf_dir).withColumn("w", F.when(F.col("t") > 25.0, 0.0).otherwise(F.col("w")))
    cuts = points.select("series").distinct().select("series", F.explode(F.array(*(F.lit(float(t)) for t in (10, 20, 25)))).alias("tc"))
    got = levels.drift_curve(points, cuts, ["series"], 20.0)
    return got.select("series", F.round("t", 6).alias("t"), F.round("curve", 4).alias("curve"))


def f3_merged_cuts(spark, sf_dir):
    cuts = anchors(spark, sf_dir).filter("w >= 50").select("series", (F.col("t") / 86400).alias("tc"), F.col("o").alias("v"))
    return sequences.merge_cuts(cuts, ["series"], 2.0).select("series", F.round("tc", 6).alias("tc"), F.round("v", 4).alias("v"))


def _match(spark, sf_dir):
    """Of each event type, its events numbered in order as dub's frames, and where they match: offsets that step and swing with the value, frames of low weight dropped."""
    order = Window.partitionBy("series").orderBy("event_id")
    a = anchors(spark, sf_dir, "event_type").withColumn("dub", F.row_number().over(order) - 1)
    day = F.floor(F.col("t") / 86400).cast("long") - 19723
    step = (day % 5) * 40 + F.when(F.floor(F.col("t") / 10800) % 4 == 0, F.floor(F.col("o") / 10) * 6).otherwise(0)
    return a.select("series", F.col("dub").cast("long").alias("dub"), F.when((F.col("w") >= 25) & (F.floor(F.col("t") / 7200) % 5 != 0), (F.col("dub") + day * 8 + step).cast("long")).alias("ref"))


def _decided(spark, sf_dir):
    m = _match(spark, sf_dir)
    sizes = m.groupBy("series").agg((F.max("ref") + 9).alias("n_ref"))
    return levels.level_decision(m, sizes, ["series"], 5.0, 4.0)


def e6_restored_levels(spark, sf_dir):
    return _decided(spark, sf_dir)[0]


def e6_cut_intervals(spark, sf_dir):
    return _decided(spark, sf_dir)[1]


def e6_restored_runs(spark, sf_dir):
    return levels.restored_runs(_match(spark, sf_dir), ["series"], 4.0)


def _cuts_with_levels(spark, sf_dir):
    a = anchors(spark, sf_dir).filter("w >= 50").select("series", (F.col("t") / 86400).alias("tc"), F.col("o").alias("before"))
    return a.withColumn("after", F.lead("before").over(Window.partitionBy("series").orderBy("tc"))).filter("after is not null")


def e15_without_round_trips(spark, sf_dir):
    return levels.without_round_trips(_cuts_with_levels(spark, sf_dir), ["series"]).select("series", F.round("tc", 6).alias("tc"))


def e15_flattened(spark, sf_dir):
    """The events' values as a curve, laid on the base of each excursion of the cuts."""
    curve = anchors(spark, sf_dir).groupBy("series", (F.col("t") / 86400).alias("t")).agg(F.avg("o").alias("shift"))
    got = levels.flattened(curve, levels.round_trips(_cuts_with_levels(spark, sf_dir), ["series"]), ["series"], 20.0, 5.0)
    return got.select("series", F.round("t", 6).alias("t"), F.round("shift", 5).alias("shift"))


def i34_plateaus(spark, sf_dir):
    lags = _steps(spark, sf_dir).select("series", "t", F.col("o").alias("lag"), F.col("w").alias("conf"))
    got = sequences.plateaus(lags, ["series"], 15.0, 3.0, 10.0, 0.5)
    return got.select("series", *(F.round(c, 4).alias(c) for c in ("t0", "t1", "lag", "conf")), "n")


_PAIRS = f"""with d as (select frame, vec from ({FRAMES_SQL}) where series = 'dub' and frame % {{k}} = 0), r as (select frame, vec from ({FRAMES_SQL}) where series = 'ref' and frame % {{k}} = 0),
c as (select d.frame as dub, r.frame as ref, {_COS.format(a="d.vec", b="r.vec")} as cos from d, r),
b as (select dub, ref, cos from (select *, row_number() over (partition by dub order by cos desc, ref) as n from c) where n = 1),
m as (select b.dub, b.ref, b.cos, coalesce(max(c.cos) filter (where abs(c.ref - b.ref) > {{z}}), -1) as rest from b join c on c.dub = b.dub group by b.dub, b.ref, b.cos)"""
ORACLES = {
    "c1_best_separated": f"{_PAIRS.format(k=2, z=20)} select dub, ref, round(cos, 6) as cos, round(rest, 6) as rest from m where cos > 0.3 and cos - rest > 0",
    "c2_strong_matches": f"{_PAIRS.format(k=3, z=24)} select 1 as pair, count(*) as n from m where cos > 0.35 and cos - rest > 0.01",
    "c4_band_matches": f"""with d as (select frame, vec from ({FRAMES_SQL}) where series = 'dub'), r as (select frame, vec from ({FRAMES_SQL}) where series = 'ref')
select d.frame as dub, r.frame as ref, round({_COS.format(a="d.vec", b="r.vec")}, 6) as cos from d join r on abs(r.frame - d.frame - d.frame % 7) <= 5""",
    "c5_assigned_cosine": f"""with d as (select frame, vec from ({FRAMES_SQL}) where series = 'dub'), r as (select frame, vec from ({FRAMES_SQL}) where series = 'ref')
select d.frame as dub, r.frame as ref, round({_COS.format(a="d.vec", b="r.vec")}, 6) as cos from d join r on r.frame = d.frame and d.frame % 3 <> 0""",
    "b3_mirrored": f"""with f as ({FRAMES_SQL}), k as (select unnest(generate_series(0, 63)) as k)
select series, frame, k::int as k, round(case when k < 32 then vec[(k // 8) * 8 + (7 - k % 8) + 1]::double else -vec[32 + ((k - 32) // 8) * 8 + least(7, 8 - k % 8) + 1]::double end, 6) as x from f, k""",
    "c15_theil_pairs": f"""with a as (select series, t / 86400 as t, o from ({AE})), r as (select series, t, o, row_number() over (partition by series order by t, o) - 1 as i, count(*) over (partition by series) as n from a),
p as (select * from r where i % greatest(1, n // 10) = 0) select x.series, round(quantile_cont((y.o - x.o) / (y.t - x.t), 0.5), 4) as slope from p x join p y on y.series = x.series and y.t > x.t + 1 group by x.series""",
}
_NO_SQL = (
    "c3_orientation", "c12_mutual_nearest", "i1_monotone_chain", "i2_coarse_offsets", "i3_windowed_chain", "i4_flat_alignment", "i6_affine_alignment", "i8_guarded_alignment", "i9_protected_alignment", "i10_amerced_alignment",
    "i11_band_alignment", "i15_segmented", "i16_warp_cuts", "i20_tv_levels", "i21_cut_boundaries", "i22_simplified", "i23_fitted_curve", "i24_time_map", "i25_drift_curve", "f3_merged_cuts", "e6_restored_levels",
    "e15_without_round_trips", "i34_plateaus", "e6_cut_intervals", "e6_restored_runs", "e15_flattened",
)
QUERIES = {k: globals()[k] for k in (*ORACLES, *_NO_SQL)}
