"""Steps that took time or memory by the square of a series, or of its numbers: the same results, and soon."""

import time

import numpy as np
from pyspark.sql import functions as F

from strandweave.operators import jobs, sequences
from strandweave.operators import kernels as K


def test_windows_without_rows_cost_nothing(spark):
    rows = [("a", 10**9 + 7 * k, 10**9 + 7 * k + k % 5) for k in range(60)]
    df = spark.createDataFrame(rows, "s string, dub long, ref long")
    began = time.time()
    got = sequences.windowed_chain(df, ["s"], 40, 10, 20).collect()
    assert time.time() - began < 30  # 33 million windows lie before them
    shift = 10**9 // 30 * 30  # windows begin at multiples of 30
    near = spark.createDataFrame([(s, d - shift, r - shift) for s, d, r in rows], "s string, dub long, ref long")
    assert sorted((d - shift, r - shift) for _, d, r in got) == sorted((d, r) for _, d, r in sequences.windowed_chain(near, ["s"], 40, 10, 20).collect())


def test_running_median_is_the_median():
    r = np.random.default_rng(1)
    x, w = r.integers(0, 12, 400) / 3, r.integers(1, 6, 400) / 4  # sums are exact, ties too
    m, rows = K.RunningMedian(x, w), []
    for i in range(400):
        if r.random() < 0.03:
            m.clear()
            rows = []
        m.add(i)
        rows.append(i)
        assert m.median() == K.weighted_median(x[rows], w[rows])


def test_smoothed_by_kernels_of_any_length():
    r = np.random.default_rng(2)
    for n, sigma in ((1, 1.0), (5, 30.0), (300, 7.3), (300, 2000.0), (20_000, 700.0)):
        y = r.normal(0, 50, n).cumsum()
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        assert np.allclose(K.smoothed(y, sigma), np.convolve(np.pad(y, reach, mode="edge"), kernel / kernel.sum(), "valid"), atol=1e-9)
    flat = K.smoothed(np.arange(1000.0), 3e9)  # what equal times give: the mean of both ends
    assert np.allclose(flat, 999 / 2, atol=1e-3)


def test_queues_are_folded_as_they_stream(spark):
    rows = [(q, float(t // 3), 100 * t + len(q), float(t * 7 % 11)) for q in ("a", "bb") for t in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a queue is many batches, and a batch holds two queues' rows
    try:
        df = jobs.admitted(spark.createDataFrame(rows, "q string, came double, job long, lasts double"), ["q"], 2)
        got = {(q, job): (began, ended) for q, job, began, ended in df.collect()}
        assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for q in ("a", "bb"):
        busy, floor = [], 0.0
        for _, came, job, lasts in sorted((x for x in rows if x[0] == q), key=lambda x: (x[1], x[2])):
            began = max(came, floor, sorted(busy)[0] if len(busy) == 2 else 0.0)
            busy = sorted(busy)[1 if len(busy) == 2 else 0 :] + [began + lasts]
            floor = began
            assert got[(q, job)] == (began, began + lasts)


def test_blocks_meet_without_a_broadcast(spark, monkeypatch):
    """Ref's blocks go to every lane: as a broadcast they'd pass the driver that many times."""
    from strandweave.operators import similarity

    plans, real = [], similarity.materialised
    monkeypatch.setattr(similarity, "materialised", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    rows = [(1, k, [float(k % 7), 1.0, float(k % 3)]) for k in range(40)]
    f = spark.createDataFrame(rows, "pair int, frame long, vec array<double>")
    assert similarity.best_separated(f, f, ["pair"], thin=1, apart=2, least=0.0, margin=-3.0, block=8).count() == 40
    met = [p for p in plans if "lane" in p]
    assert met and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in met)


def every_cut(t, y, w, penalty, least):
    """The partition by trying all earlier cuts for each row."""
    t = t - t.mean()
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * t, w * y, w * t * t, w * t * y, w * y * y)]
    best, cut = np.full(len(t) + 1, np.inf), np.zeros(len(t) + 1, np.int64)
    best[0] = -penalty
    for j in range(1, len(t) + 1):
        i = np.arange(0, j - least + 1) if j >= least else np.array([0])
        s, st, sy, stt, sty, syy = (v[j] - v[i] for v in sums)
        det = s * stt - st * st
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(det > 1e-12, (s * sty - st * sy) / det, 0.0)
            level = np.where(s > 0, (sy - slope * st) / s, 0.0)
        total = best[i] + penalty + np.maximum(syy - slope * sty - level * sy, 0.0)
        best[j], cut[j] = total.min(), i[total.argmin()]
    out, j = [], len(t)
    while j > 0:
        out.append((int(cut[j]), j))
        j = int(cut[j])
    return out[::-1]


def test_segments_are_those_of_all_cuts():
    r = np.random.default_rng(3)
    for k in range(24):
        n, least = int(r.integers(1, 1500)), int(r.choice([1, 2, 7, 40]))
        t = np.sort(r.uniform(0, 30, n))
        t = np.floor(t * 20) / 20 if k % 3 == 0 else t
        y = np.floor(t / r.choice([3, 10])) * r.choice([1, 5, 60]) + r.exponential(50, n) / 40
        w = (r.integers(0, 100, n) / 50) ** 3 * (r.random(n) < (0.3 if k % 7 == 0 else 1.0))
        for penalty in (0.0, 10.0, 5000.0):
            assert K.segments(t, y, w, penalty, least) == every_cut(t, y, w, penalty, least)
    y[n // 2] = np.nan
    assert K.segments(t, y, w, 10.0, least) == every_cut(t, y, w, 10.0, least)


def test_segments_of_a_long_series():
    r = np.random.default_rng(4)
    n = 90_000
    t = np.sort(r.uniform(0, 30, n))
    began = time.time()
    got = K.segments(t, np.floor(t / 10) * 60 + r.exponential(50, n) / 40, (r.integers(0, 100, n) / 50) ** 3, 5000.0, 40)
    assert time.time() - began < 40  # all earlier cuts of each row: 4,000 million lines
    assert [j for _, j in got] == [*np.searchsorted(t, (10, 20)), n]


def test_searches_ship_no_block_a_window(spark):
    """Many windows meet a tile of blocks at once; the places are those of a plain search, the earliest of equals."""
    from strandweave.operators import signal

    rng = np.random.default_rng(6)
    once = rng.normal(size=(70, 2))
    x = np.concatenate([once, once, np.zeros((20, 2)), rng.normal(size=(40, 2))])
    table = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "s string, frame long, bands array<double>")
    nodes = spark.createDataFrame([("a", n) for n in range(6, 190, 7)], "s string, node long")
    for block in (4, 4096):
        lags = signal.whole_length_lags(table, table, nodes, ["s"], 5, block)
        got = {r.node: r.lag for r in lags.collect()}
        assert got == {n: float((-70 if 75 <= n < 135 else 0) if not 145 <= n < 155 else 5 - n) for n in range(6, 190, 7)}
        points = {r.node: (r["at"], r.margin) for r in signal.found_points(table, table, nodes, ["s"], 5, 3, block).collect()}
        assert all(at == n + got[n] for n, (at, _) in points.items())
        assert all(abs(m) < 1e-12 for n, (_, m) in points.items() if n < 65 or 75 <= n < 135)
    plan = lags._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInPandas" not in plan


def test_chunks_give_the_cosines_of_their_matches(spark):
    """The chunk that has both vectors says their cosine: no join brings vectors to the matches again. Frames without a draft line have no match."""
    from strandweave.operators import similarity

    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 5))
    table = lambda v, first=0: spark.createDataFrame([("a", first + i, y.tolist()) for i, y in enumerate(v)], "s string, frame long, vec array<double>")
    dub, ref = table(np.concatenate([x[:90], np.zeros((1, 5)), x[120:]])), table(x)
    line = dub.filter("frame % 50 <> 7").selectExpr("s", "frame as dub", "cast(if(frame > 90, 29, 0) as long) as off")
    got = sequences.align_chunks(dub, ref, line, ["s"], chunk=80, overlap=20, margin=16, cosines=True)
    assert got.filter("dub % 50 = 7").count() == 0 and got.count() == line.count()
    want = {(r.dub, r.ref): r.cos for r in similarity.assigned_cosine(got.drop("cos"), dub, ref, ["s"]).collect()}
    rows = {(r.dub, r.ref): r.cos for r in got.filter("ref is not null").collect()}
    assert len(rows) > 200 and rows == want
    assert {(r.dub, r.ref) for r in sequences.align_chunks(dub, ref, line, ["s"], chunk=80, overlap=20, margin=16).collect()} == {(r.dub, r.ref) for r in got.collect()}


def test_nearest_of_both_sides_by_tiles(spark, monkeypatch):
    """One meeting of tiles serves both ways, however many tiles there are; the earlier of equals."""
    from strandweave.operators import similarity

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(37, 4))
    y[30], x[41] = y[5], x[2]
    table = lambda v: spark.createDataFrame([(1, i, z.tolist()) for i, z in enumerate(v)], "pair int, frame long, vec array<double>")
    unit = lambda v: v / np.sqrt((v * v).sum(1, keepdims=True))
    c = np.round(unit(x) @ unit(y).T, 12)
    for size in (1, 16 << 20):
        monkeypatch.setattr(similarity, "TILE", size)
        ahead, back = similarity.nearest_both(table(x), table(y), ["pair"], block=8)
        assert {r.dub: r.ref for r in ahead.collect()} == dict(enumerate(c.argmax(1)))
        assert {r.ref: (r.dub, round(r.cos, 9)) for r in back.collect()} == {j: (c[:, j].argmax(), round(c[:, j].max(), 9)) for j in range(37)}


def test_edge_cuts_meet_no_point_twice(spark, monkeypatch):
    """Both sides of every point tried, by sums over parts of the points: the steps of joint_levels, which meets each window with all its points."""
    from strandweave.operators import cuts

    r = np.random.default_rng(10)
    rows = [(s, float(np.round(t, 2)), float(60 * (t > 3) + 5 * t * (s == "b") + r.normal()), float(r.integers(0, 3))) for s in "ab" for t in 1e6 * (s == "b") + np.sort(r.uniform(0, 20, 150))]
    points = spark.createDataFrame(rows, "s string, t double, o double, w double")
    line = points.groupBy("s").agg(F.min("t").alias("t_lo"), F.max("t").alias("t_hi")).withColumn("_a", F.col("t_lo") + 1).withColumn("_z", F.col("t_lo") + 6)
    tried = points.select("s", F.col("t").alias("tc")).distinct().join(line, "s").filter(F.col("tc").between(F.col("_a"), F.col("_z")))
    sides = cuts._sides(tried, ["s"], (F.col("t_lo"), F.col("tc")), (F.col("tc"), F.col("t_hi")))
    want = {(x.s, x.tc): x.step for x in cuts._steps(cuts.joint_levels(sides, points, ["s"], 3.0, 60.0), ["s"]).collect()}
    monkeypatch.setattr(cuts, "overlap_join", None)
    for n, m in ((1 << 16, 1 << 11), (40, 7)):
        monkeypatch.setattr(cuts, "_POINTS", n)
        monkeypatch.setattr(cuts, "_TRIED", m)
        got = {(x.s, x.tc): x.step for x in cuts._whole_steps(line, points, ["s"], 3.0).collect()}
        assert got.keys() == want.keys() and len(got) > 40 and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    best = {x.s: x.tc for x in cuts.edge_cuts(line.select("s", "t_lo", "t_hi"), points, ["s"], False, 6.0, 1.0, 3.0, 3.0).collect()}
    assert best == {s: max((k for k in got if k[0] == s), key=lambda k: (abs(got[k]), -k[1]))[1] for s in "ab"}


def test_rows_meet_their_series_figures_by_a_broadcast(spark):
    """Two numbers a series: sorting the rows by series for them made each series one task."""
    from strandweave.operators import robust

    big = spark.range(2_000_000).select((F.col("id") % 3).alias("s"), F.col("id").alias("i"), (F.col("id") % 11).cast("double").alias("value"))
    got = robust.z_normalised(big, ["s"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert abs(got.agg(F.avg("value")).first()[0]) < 1e-9


def test_edge_cuts_fit_only_what_may_be_the_largest(spark, monkeypatch):
    """Of the cuts of a zone those whose sides' means rule them out aren't fitted, over many stretches; weights below zero, nan and none at all rule out nothing that fitting all of them finds."""
    from strandweave.operators import cuts, windows

    monkeypatch.setattr(windows, "STRETCH", 50)
    r = np.random.default_rng(4)
    step = {"a": 60.0, "b": 0.0, "c": 60.0, "d": 60.0, "e": 9.0}
    rows = [(s, 5e5 + float(np.round(t, 2)), float(step[s] * (t > 3) + r.normal()), float(r.integers(0, 3)) * (s != "d")) for s in step for t in np.sort(r.uniform(0, 20, 200))]
    rows = [(s, t, o, -0.5 if s == "c" and k % 50 == 7 else w) for k, (s, t, o, w) in enumerate(rows)] + [("e", 5e5 + 12.0, float("nan"), 0.5)]
    points = spark.createDataFrame(rows, "s string, t double, o double, w double")
    lines = points.groupBy("s").agg(F.min("t").alias("t_lo"), F.max("t").alias("t_hi"))
    whole, likely, tried = cuts._whole_steps, cuts._likely, []
    monkeypatch.setattr(cuts, "_likely", lambda *a: tried.append(likely(*a)) or tried[-1])
    found = lambda: sorted(map(repr, cuts.edge_cuts(lines, points, ["s"], False, 8.0, 1.0, 20.0, 0.3).collect()))
    got = found()
    monkeypatch.setattr(cuts, "_whole_steps", lambda *a, small: whole(*a))
    assert got == found() and len(got) >= 3 and len(tried) == 1
    n = {x.s: x["count"] for x in tried[0].groupBy("s").count().collect()}
    assert n["a"] < 30 and n["d"] < 30 and "b" not in n and n["c"] > 50


def test_windowed_lags_go_by_blocks(spark, monkeypatch):
    """Frames meet blocks of nodes, not each node: the same lags whatever the block, with holes, nodes beside the sound and series with one side alone."""
    from strandweave.operators import signal

    monkeypatch.setattr(signal, "overlap_join", None)
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 3))
    frames = lambda s, at, by: [(s, int(i) + by, x[i].tolist()) for i in at]
    table = lambda rows: spark.createDataFrame(rows, "s string, frame long, bands array<double>")
    ref = table(frames("a", [i for i in range(400) if not 120 < i < 170], -50) + frames("b", range(30), 0))
    dub = table(frames("a", range(400), -47) + frames("c", range(30), 0))
    nodes = spark.createDataFrame([("a", n) for n in range(-90, 420, 7)] + [("a", 6), ("b", 10), ("c", 10), ("d", 10), (None, 10)], "s string, node long")
    got = []
    for block in (1, 1 << 20):
        monkeypatch.setattr(signal, "BLOCK", block)
        got.append({(y.s, y.node): (y.lag, y.quality) for y in signal.windowed_lags(ref, dub, nodes, ["s"], 10, 5).collect()})
    assert repr(sorted(got[0].items())) == repr(sorted(got[1].items()))
    one = got[0]
    assert {k for k in one if k[0] != "a"} == {("b", 10), ("c", 10)} and all(one[k] == (None, 0) for k in one if k[0] != "a")
    assert {n for s, n in one if s == "a"} == {n for n in [*range(-90, 420, 7), 6] if -65 <= n <= 367}
    assert all(one["a", n][0] == 3 for n in range(-34, 50, 7))


def test_windows_go_to_few_tiles(spark):
    """However small the blocks, a window is copied to eight tiles at most; the best places are those of one tile."""
    from strandweave.operators import signal

    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    table = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "s string, frame long, bands array<double>")
    nodes = table.filter("frame % 300 = 100").selectExpr("s", "frame as node")
    windows = signal._around(table, nodes, ["s"], 5)
    got = [signal._searched(windows, table, ["s"], 11, block, True).collect() for block in (8, 3000)]
    assert 2 <= len(got[0]) / 10 <= 8 and len(got[1]) == 10
    best = lambda rows: {n: max((r.peak, -r["at"]) for r in rows if r.node == n) for n in {r.node for r in rows}}
    assert best(got[0]) == best(got[1])


def test_equal_points_of_edge_cuts_are_one(spark, monkeypatch):
    """Rows that come forty times cost what they cost once; the cut is that of a plain search over all of them."""
    from strandweave.operators import cuts

    r = np.random.default_rng(12)
    t = np.sort(r.uniform(0, 40, 120))
    once = [("a", float(x), float((x > 8) * 9 + r.normal()), float(r.integers(0, 3))) for x in t]
    made = lambda rows: spark.createDataFrame(rows, "s string, t double, o double, w double")
    line = spark.createDataFrame([("a", float(t[0]), float(t[-1]))], "s string, t_lo double, t_hi double")
    likely, seen = cuts._likely, []
    monkeypatch.setattr(cuts, "_likely", lambda p, *a: seen.append(p.count()) or likely(p, *a))
    got = [cuts.edge_cuts(line, p, ["s"], False).collect() for p in (made(once * 40), made([(s, x, o, 40 * w) for s, x, o, w in once]))]
    assert seen == [120, 120]
    assert len(got[0]) == 1 and got[0][0].tc == got[1][0].tc and abs(got[0][0].v - got[1][0].v) < 1e-9
    at = made(once * 40).groupBy("s", "t").count().filter("t between 2 and 16").selectExpr("s", "t as tc")
    ends = at.crossJoin(line.drop("s"))
    sides = ends.selectExpr("s", "tc", "'before' as side", "t_lo as lo", "tc as hi").union(ends.selectExpr("s", "tc", "'after'", "tc", "t_hi"))
    steps = cuts._steps(cuts.joint_levels(sides, made(once * 40), ["s"], 0.3, 50.0), ["s"])
    best = max(steps.filter(F.col("tc").between(float(t[0]) + 2.5, float(t[0]) + 15)).collect(), key=lambda x: (abs(x.step), -x.tc))
    assert best.tc == got[0][0].tc and abs(best.step - got[0][0].v) < 1e-6
