"""Operators on small frames: empty inputs, nulls, extremes."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import cuetext
from strandweave.operators import cues, intervals, jobs, robust, sequences
from strandweave.sources import files


def test_weighted_median_rules(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 1.0), ("b", 4.0, 0.0), ("b", 6.0, 0.0), ("c", None, 1.0), ("c", 3.0, None)]
    got = {r.series: r.wmed for r in robust.weighted_median(spark.createDataFrame(rows, "series string, o double, w double"), ["series"], "o", "w").collect()}
    assert got == {"a": 2.0, "b": 5.0, "c": 3.0}


def test_empty_series(spark):
    none = spark.createDataFrame([], "series string, t double, o double, w double")
    assert robust.global_scale(none).count() == 0
    assert sequences.cut_boundaries(none, ["series"]).count() == 0
    assert sequences.segmented(none, ["series"]).count() == 0


def test_interpolation_holds_ends(spark):
    k = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, 20.0)], "s string, kt double, kv double")
    p = spark.createDataFrame([("a", -5.0), ("a", 2.5), ("a", 10.0), ("a", 99.0), ("b", 1.0)], "s string, t double")
    got = {(r.s, r.t): r.v for r in intervals.interpolated(p, k, ["s"]).collect()}
    assert got == {("a", -5.0): 10.0, ("a", 2.5): 12.5, ("a", 10.0): 20.0, ("a", 99.0): 20.0, ("b", 1.0): None}  # a series without knots has nothing to read


def test_overlap_join_takes_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 100.0), (1, 50.0, 50.0)], "k int, a double, b double")
    b = spark.createDataFrame([(1, -5.0, 200.0), (1, 49.0, 51.0)], "k int, c double, d double")
    assert intervals.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), 7.0).count() == 4


def test_retimed_cue_across_a_cut(spark):
    c = spark.createDataFrame([(1, 0, 9.0, 12.0)], "k int, n int, start double, end double")
    hole = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0), (1, 15.0, 30.0, 10.0, 25.0)], "k int, t0 double, t1 double, x0 double, x1 double")
    touch = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0), (1, 10.0, 30.0, 10.0, 30.0)], "k int, t0 double, t1 double, x0 double, x1 double")
    assert [(r.start, r.end) for r in intervals.retimed(c, hole, ["k"], 100.0, 0.04).orderBy("start").collect()] == [(9.0, 10.0), (15.0, 17.0)]
    assert [(r.start, r.end) for r in intervals.retimed(c, touch, ["k"], 100.0, 0.04).collect()] == [(9.0, 12.0)]


@pytest.mark.parametrize("text, lines, styled", [
    (r"{\i1}a{\b1}b{\i0}c{\r}d", ["<i>a<b>b</b></i><b>c</b>d"], False),
    (r"x{\p1}m 0 0 l 1 1{\p0}y\Nz", ["xy", "z"], False),
    (r"{\pos(1,2)}q\h{\u1}r", ["q <u>r</u>"], True),
])
def test_override_codes(text, lines, styled):
    assert cuetext.plain_event(text) == (lines, styled)


def test_vtt_without_header_is_refused(spark):
    with pytest.raises(Exception, match="WEBVTT"):
        cues.read_vtt(spark.createDataFrame([("d", "1\n00:00.000 --> 00:01.000\nx")], "doc string, text string")).collect()


def test_vtt_timing_line_opens_a_block(spark):
    text = "﻿WEBVTT\r\n\r\nNOTE x\r\n\r\nid\r\n00:01.000 --> 00:02.500 align:left\r\na\r\n1:00:03.000 --> 1:00:04.000\r\nb\r\n"
    got = cues.read_vtt(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("n").collect()
    assert [(r.start, r.end, r.payload, r.settings, r.ident) for r in got] == [(1.0, 2.5, ["a"], "align:left", "id"), (3603.0, 3604.0, ["b"], "", "")]


def test_job_states(spark):
    log = [("a", 0, "enqueue"), ("a", 1, "pause"), ("a", 2, "retry"), ("a", 3, "start"), ("a", 4, "cancel"), ("a", 5, "retry"), ("b", 0, "run")]
    got = {r.job: (r.state, r.changes) for r in jobs.states(spark.createDataFrame(log, "job string, seq int, command string"), ["job"]).collect()}
    assert got == {"a": ("queued", 5), "b": ("none", 0)}


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "utf-16", "utf-16-be", "utf-32"])
def test_encodings(spark, tmp_path, codec):
    raw = "Grüße €".encode(codec)
    if codec == "utf-16-be":
        raw = b"\xfe\xff" + raw
    (tmp_path / "a.VTT").write_bytes(raw)
    assert files.read_texts(spark, f"file://{tmp_path}").first().text == "Grüße €"


def test_checkpoint_refuses_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    files.save_checkpoint(rows, f"file://{tmp_path}/c", 3)
    keys = spark.createDataFrame([("k2",)], "key string")
    assert [r.v for r in files.load_checkpoint(spark, f"file://{tmp_path}/c", keys, 3).collect()] == [2]
    assert files.load_checkpoint(spark, f"file://{tmp_path}/c", keys, 4).count() == 0
    with pytest.raises(ValueError):
        files.save_checkpoint(rows.filter("v > 9"), f"file://{tmp_path}/c", 3)


def test_robust_line_recovers(spark):
    rows = spark.range(200).select(F.lit("s").alias("series"), F.col("id").cast("double").alias("t"), (F.col("id") * 0.5 + 3 + F.when(F.col("id") % 50 == 0, 400).otherwise(0)).alias("o"), F.lit(1.0).alias("w"))
    got = robust.robust_line(rows, ["series"], passes=4).first()
    assert abs(got.a - 0.5) < 0.05 and abs(got.b - 3) < 6


def test_offsets_broadcast_no_grid(spark):
    """A grid of few bytes a series and many rows: it isn't sent through the driver, whatever the planner takes it for."""
    from strandweave.operators import structure

    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        lengths = spark.range(3000).select(F.col("id").alias("s")).repartition(4, "s").groupBy("s").agg(F.max(F.lit(30.0)).alias("length"))
        grid = lengths.select("s", F.explode(F.expr("transform(sequence(0, 239), x -> x / 8D)")).alias("t"))
        ranges = lengths.select("s", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(10.0 * k).alias("a"), F.lit(10.0 * k + 8).alias("b"), F.lit(float(k)).alias("lag")) for k in range(3)))).alias("r")).select("s", "r.*")
        got = structure.offsets(ranges, grid, ["s"], 24.0, 4.0).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("off0").alias("lo"), F.max("off0").alias("hi")).collect()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
    assert len(got) == 240 and all(r.n == 3000 and r.lo == r.hi for r in got)
    assert {r.t: r.lo for r in got}[7.875] == 0 and {r.t: r.lo for r in got}[10.0] == -24 and {r.t: r.lo for r in got}[29.0] == -48


def test_exact_medians_hold_no_series(spark, monkeypatch, tmp_path):
    """Few parts, values that crowd in one, no numbers, nan and infinite ones, a null key: as F.percentile has them, without its map of all values."""
    import random

    from pyspark.sql import functions as F

    from strandweave.operators import robust

    monkeypatch.setattr(robust, "BINS", 4)
    r, inf = random.Random(1), float("inf")
    rows = [("a", r.gauss(0, 1) * 10 ** r.randrange(9), r.randrange(5)) for _ in range(300)]
    rows += [(None, r.random(), None if k % 3 else k) for k in range(41)] + [("b", x, None) for x in (1e308, -1e308, 3.0, 5e-324)] + [("c", None, None)]
    rows += [("d", x, 7) for x in (inf, -inf, float("nan"), 2.0, inf)] + [("e", x, 7) for x in (-inf, -inf, 1.0, 1.0)] + [("f", float("nan"), 0), ("f", 1.0, 1)]
    df = spark.createDataFrame(rows, "s string, x double, y long")
    got = robust.medians(df, ["s"], ["x", "y"])
    want = df.groupBy("s").agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "percentile(" not in robust.consensus(df, ["s"], ["x", "y"])._jdf.queryExecution().executedPlan().toString()
