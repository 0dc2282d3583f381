"""Queries over sound and envelopes: spectra, lags, descriptors, warps. Transforms have no SQL; the rest does."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import signal as S
from strandweave.operators.similarity import best_separated
from strandweave.plans.fixtures import SAMPLES_SQL, frames, samples, table
from strandweave.session import materialised


def _blocks(spark, sf_dir, size: int = 512):
    s = samples(spark, sf_dir)
    b = s.groupBy("series", F.floor(F.col("i") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    return b.select("series", "block", F.transform("p", lambda x: x["x"]).alias("samples"))


def _envelopes(spark, sf_dir):
    return S.envelopes(_blocks(spark, sf_dir), ["series"], 16_000.0, 256, 64, 8)


def j1_envelopes(spark, sf_dir):
    e = _envelopes(spark, sf_dir)
    return e.select("series", "frame", *(F.round(F.get("bands", F.lit(k)), 5).alias(f"b{k}") for k in (0, 3, 7)))


def j2_track_envelopes(spark, sf_dir):
    """Envelopes brought to mean 0 and deviation 1 over the track, per band."""
    from strandweave.operators.robust import z_normalised

    e = _envelopes(spark, sf_dir).select("series", "frame", F.posexplode("bands").alias("band", "value"))
    got = z_normalised(e, ["series", "band"])
    return got.select("series", "frame", "band", F.round("value", 4).alias("value"))


def j3_band_edges(spark, sf_dir):
    """Edges of 48 bands from 50 Hz to just under half of 16 kHz."""
    k = spark.range(49).select(F.col("id").alias("k"))
    return k.select("k", F.round(F.pow(F.lit(10.0), F.log10(F.lit(50.0)) + F.col("k") / 48 * (F.log10(F.lit(7999.0)) - F.log10(F.lit(50.0)))), 6).alias("edge"))


def _shifted(spark, sf_dir, by: int):
    e = materialised(_envelopes(spark, sf_dir))
    return e, e.withColumn("frame", F.col("frame") + by)


def _nodes(e):
    """A grid of every 20th frame."""
    return e.filter("frame % 20 = 0").select("series", F.col("frame").alias("node"))


def j4_windowed_lags(spark, sf_dir):
    """Lags of envelopes against themselves 7 frames later."""
    r, d = _shifted(spark, sf_dir, 7)
    got = S.windowed_lags(r, d, _nodes(r), ["series"], 20, 12)
    return got.select("series", "node", F.round("lag", 3).alias("lag"), F.round("quality", 4).alias("quality"))


def j6_residual_lags(spark, sf_dir):
    r, d = _shifted(spark, sf_dir, 3)
    got = S.windowed_lags(r, d, _nodes(r), ["series"], 20, 12, summed=True)
    return got.select("series", "node", F.round("lag", 2).alias("lag"))


def j11_whole_length_lags(spark, sf_dir):
    """Where windows of the dub, 31 frames late, lie in all of ref."""
    r, d = _shifted(spark, sf_dir, 31)
    got = S.whole_length_lags(r, d, _nodes(d), ["series"], 15, 64)
    return got.select("series", "node", "lag", F.round("conf", 4).alias("conf"))


def j13_descriptors(spark, sf_dir):
    e, _ = _shifted(spark, sf_dir, 0)
    got = S.descriptors(e, _nodes(e), ["series"], 10, 8)
    return got.select("series", "node", F.size("vec").alias("n"), F.round(F.get("vec", F.lit(0)), 5).alias("first"), F.round(F.element_at("vec", -1), 5).alias("last"))


def j15_found_points(spark, sf_dir):
    r, d = _shifted(spark, sf_dir, 9)
    got = S.found_points(r, d, _nodes(r), ["series"], 12, 5)
    return got.select("series", "node", "at", F.round("peak", 4).alias("peak"))


def j10_embedding_surface(spark, sf_dir):
    """Of every frame of the dub, the best frame of ref: the ridge of the similarity surface."""
    f = frames(spark, sf_dir).withColumn("pair", F.lit(1))
    side = lambda s: f.filter(f"series = '{s}'").select("pair", "frame", "vec")
    got = best_separated(side("dub"), side("ref"), ["pair"], thin=1, apart=0, least=-1.0, margin=-3.0)
    return got.select("dub", "ref", F.round("cos", 6).alias("cos"))


def _values(spark, sf_dir):
    return materialised(samples(spark, sf_dir).select("series", "i", F.col("x").alias("v")))


def j17_resampled(spark, sf_dir):
    """Samples read at 2.37 times the distance, held at the end."""
    s = _values(spark, sf_dir)
    return S.warped(s, s.select("series", "i", (F.col("i") * 2.3717193713).alias("at")), ["series"]).select("series", "i", F.round("v", 4).alias("v"))


def j20_warped(spark, sf_dir):
    s = _values(spark, sf_dir)
    return S.warped(s, s.select("series", "i", (F.col("i") * 1.0137129173 - 3.3001913717).alias("at")), ["series"]).select("series", "i", F.round("v", 4).alias("v"))


def j22_piecewise_warped(spark, sf_dir):
    """Samples read under a shift that jumps at 5 s: each stretch keeps to its own nodes."""
    s = _values(spark, sf_dir)
    names = s.select("series").distinct()
    curve = names.select("series", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(sh).alias("shift")) for t, sh in ((0, 0.0), (4, 0.0213717193), (6, 0.1037193713), (9, 0.1037193713))))).alias("n")).select("series", "n.*")
    at = S.piecewise_places(s.select("series", "i"), curve, names.withColumn("tc", F.lit(5.0)), ["series"], 100.0)
    return S.warped(s, materialised(at), ["series"]).select("series", "i", F.round("v", 4).alias("v"))


def j23_seam_silences(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("series"), (F.col("c_custkey") * 1.0).alias("tc"), (F.col("c_acctbal") / 10_000).alias("jump"))
    return S.seam_silences(c, ["series"]).select("series", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def j24_silenced(spark, sf_dir):
    """Samples with two spans of every 100 s silenced."""
    s = _values(spark, sf_dir)
    every = s.groupBy("series").agg(F.floor(F.max("i") / 10_000).alias("last")).select("series", F.explode(F.expr("transform(sequence(0L, last), k -> k * 100.0D)")).alias("from"))
    spans = every.select("series", "from", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1.005, 2.005), (4.995, 6.105))))).alias("n")).select("series", (F.col("from") + F.col("n.a")).alias("a"), (F.col("from") + F.col("n.b")).alias("b"))
    return S.silenced(s, spans, ["series"], 100.0, 0.1, 1.0).select("series", "i", F.round("v", 8).alias("v"))


def a7_fitted_blocks(spark, sf_dir):
    """Sound without its first block on a grid of all blocks but its last two: what is missing is zero, what is over goes."""
    from strandweave.sources.files import fitted_blocks

    b = _blocks(spark, sf_dir, 100)
    grid = b.groupBy("series").agg(F.max("block").alias("last")).select("series", F.explode(F.expr("sequence(0L, last - 2)")).alias("block"))
    got = fitted_blocks(grid, b.filter("block > 0"), ["series"], 100)
    return got.select("series", "block", F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.size("samples").alias("n"))


_WARP = f"""with s as ({SAMPLES_SQL}), e as (select series, max(i) as last from s group by series), p as ({{places}}),
c as (select p.series, i, greatest(0, least(last, pos)) as pos from p join e on p.series = e.series)
select c.series, c.i, round(a.x + coalesce((b.x - a.x) * (pos - floor(pos)), 0), 4) as v from c join s a on a.series = c.series and a.i = floor(pos) left join s b on b.series = c.series and b.i = floor(pos) + 1"""
_NEAR = "greatest(0, least(1, greatest(i // 10000 * 100 + {a} - i / 100, i / 100 - (i // 10000 * 100 + {b})) / 0.1))"
ORACLES = {
    "j3_band_edges": "select k, round(pow(10.0::double, log10(50.0) + k / 48 * (log10(7999.0) - log10(50.0))), 6) as edge from (select unnest(generate_series(0, 48)) as k)",
    "j17_resampled": _WARP.format(places="select series, i, i * 2.3717193713::double as pos from s"),
    "j20_warped": _WARP.format(places="select series, i, i * 1.0137129173::double - 3.3001913717::double as pos from s"),
    "j22_piecewise_warped": _WARP.format(places="select series, i, i + 100 * case when i / 100 <= 5 then least(i / 100, 4) / 4 * 0.0213717193::double else 0.1037193713::double end as pos from s"),
    "j23_seam_silences": "select c_nationkey as series, round(c_custkey - case when c_acctbal < 0 then abs(c_acctbal / 10000) / 2 else 0.15 end, 4) as a, round(c_custkey + case when c_acctbal < 0 then abs(c_acctbal / 10000) / 2 else 0.15 end, 4) as b from customer",
    "j24_silenced": f"select series, i, round(x * least({_NEAR.format(a='1.005::double', b='2.005::double')}, {_NEAR.format(a='4.995::double', b='6.105::double')}), 8) as v from ({SAMPLES_SQL})",
    "a7_fitted_blocks": f"""with b as (select series, i // 100 as b, sum(x) as t from ({SAMPLES_SQL}) group by series, i // 100), g as (select series, unnest(generate_series(0, max(b) - 2)) as b from b group by series)
select g.series, g.b as block, round(coalesce(t, 0), 3) as total, 100 as n from g left join b on b.series = g.series and b.b = g.b and b.b > 0""",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "j1_envelopes", "j2_track_envelopes", "j4_windowed_lags", "j6_residual_lags", "j11_whole_length_lags", "j13_descriptors", "j15_found_points", "j10_embedding_surface")}
