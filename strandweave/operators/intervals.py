"""Joins on ranges of time: points in windows, spans over spans, interpolation, gaps, pieces of a time map.

Catalyst gives a join on inequalities alone a nested loop. Here both sides are dealt to buckets of a fixed width, an interval to each
one it touches, so the join is on equality (shuffled by series and bucket, split by AQE where skewed) with the
inequalities as a residue. A pair is taken in one bucket only, the first that both touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("bigint")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str], width: float, many: bool = False) -> DataFrame:  # noqa: E741
    """Pairs of rows whose closed ranges l of left and r of right overlap; right's columns must differ from left's but for keys, and none may be named _b, _from_l or _from_r.

    many: both sides are large, though the planner may see less, as where rows were just exploded to many; none is broadcast then.
    """
    la, lb, ra, rb = (F.col(c) for c in (*l, *r))
    many_l = left.withColumn("_from_l", _bucket(la, width)).withColumn("_b", F.explode(F.sequence(_bucket(la, width), F.greatest(_bucket(la, width), _bucket(lb, width)))))
    many_r = right.withColumn("_from_r", _bucket(ra, width)).withColumn("_b", F.explode(F.sequence(_bucket(ra, width), F.greatest(_bucket(ra, width), _bucket(rb, width)))))
    return (many_l.hint("merge") if many else many_l).join(many_r, [*keys, "_b"]).filter((ra <= lb) & (rb >= la) & (F.col("_b") == F.greatest("_from_l", "_from_r"))).drop("_b", "_from_l", "_from_r")


def points_in_windows(grid: DataFrame, points: DataFrame, keys: Sequence[str], g: str, t: str, half: float) -> DataFrame:
    """Pairs of grid rows and points with g - half <= t < g + half; a point is dealt once, a grid row to the two or three buckets its window touches."""
    width = 2 * half
    many = grid.withColumn("_b", F.explode(F.sequence(_bucket(F.col(g) - half, width), _bucket(F.col(g) + half, width))))
    one = points.withColumn("_b", _bucket(F.col(t), width))
    return many.join(one, [*keys, "_b"]).filter((F.col(t) >= F.col(g) - half) & (F.col(t) < F.col(g) + half)).drop("_b")


def stretches(times: DataFrame, keys: Sequence[str], x: str = "_x") -> tuple[Column, Column]:
    """(number of the stretch that the column x lies in, the last number) for the series of times (keys, x), numbers: equal parts of what they span, of STRETCH rows on the average in the largest series and the same for all.

    Later times never lie in earlier stretches; null times lie in the first, nan and infinite ones at the ends.
    """
    from strandweave.operators.windows import STRETCH

    finite = F.when(F.abs(x) < float("inf"), F.col(x))
    of = times.groupBy(*keys).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(F.lit(1)).alias("n"))
    lo, hi, most = of.agg(F.min("lo").cast("double"), F.max("hi").cast("double"), F.max("n")).first()  # three numbers
    parts = -(-most // STRETCH) if lo is not None and hi > lo else 1
    zero = F.lit(0).cast("long")
    if parts < 2:
        return zero, zero
    share = (F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(x))) - lo) / (hi - lo)
    return F.when(F.col(x).isNull(), zero).otherwise(F.least(F.floor(share * parts), F.lit(parts - 1))).cast("long"), F.lit(parts - 1).cast("long")


def interpolated(probes: DataFrame, knots: DataFrame, keys: Sequence[str], x: str = "t", kx: str = "kt", ky: str = "kv", out: str = "v") -> DataFrame:
    """probes with out: knots (kx, ky) interpolated at x, held at the ends; null where a series has no knot. Of knots of equal kx the last by ky counts.

    An as-of join: knots and probes are put in one order per stretch of a series, the nearest knot on either side carried along. A stretch has
    STRETCH rows on the average, and gets the last knot before it and the first one after it, so no series is one task.
    """
    keys = list(keys)
    knots = knots.filter(F.col(kx).isNotNull() & F.col(ky).isNotNull()).groupBy(*keys, kx).agg(F.max(ky).alias(ky))
    knots = knots.select(*keys, F.col(kx).cast("double").alias("_x"), F.struct(F.col(kx).cast("double").alias("x"), F.col(ky).cast("double").alias("y")).alias("_k"))
    one = probes.select(*keys, F.struct(*(F.col(c) for c in probes.columns)).alias("_p"), F.col(x).cast("double").alias("_x"))
    at, last = stretches(one.select(*keys, "_x").unionByName(knots.select(*keys, "_x")), keys)
    one, two = one.withColumn("_cut", at).withColumn("_o", F.lit(1)), knots.withColumn("_cut", at).withColumn("_o", F.lit(0))
    held = two.groupBy(*keys, "_cut").agg(F.min_by("_k", "_x").alias("_first"), F.max_by("_k", "_x").alias("_last"))
    every = held.select(*keys).distinct().withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), last))).join(held, [*keys, "_cut"], "left")
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_left", F.last("_last", True).over(whole.orderBy("_cut"))).withColumn("_right", F.last("_first", True).over(whole.orderBy(F.desc("_cut"))))
    carried = every.select(*keys, "_cut", F.explode(F.array("_left", "_right")).alias("_k")).filter("_k is not null").withColumn("_x", F.col("_k.x")).withColumn("_o", F.lit(0))
    no_knot, no_probe = F.lit(None).cast("struct<x: double, y: double>").alias("_k"), F.lit(None).cast(one.schema["_p"].dataType).alias("_p")
    two = two.select(*keys, "_cut", no_probe, "_x", "_o", "_k").unionByName(carried.select(*keys, "_cut", no_probe, "_x", "_o", "_k"))
    one = one.select(*keys, "_cut", "_p", "_x", "_o", no_knot)
    # a frame up to the current row grows as it goes, in either order; one from it onwards would be read anew for each row
    so_far = Window.partitionBy(*keys, "_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = F.last("_k", True).over(so_far.orderBy("_x", "_o")), F.last("_k", True).over(so_far.orderBy(F.desc("_x"), F.desc("_o")))
    both = two.unionByName(one).withColumn("_a", before).withColumn("_z", after).filter("_o = 1")
    a, z = F.col("_a"), F.col("_z")
    line = a["y"] + (z["y"] - a["y"]) * (F.col("_x") - a["x"]) / (z["x"] - a["x"])
    value = F.when(a.isNull(), z["y"]).when(z.isNull() | (z["x"] == a["x"]), a["y"]).otherwise(line)
    return both.select("_p.*", value.alias(out))


def zero_weights(df: DataFrame, spans: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """df with w set to 0 where t lies in a span [a, b] of its series."""
    hit = overlap_join(df.select(*keys, "t").distinct().withColumn("_t2", F.col("t")), spans.select(*keys, "a", "b"), keys, ("t", "_t2"), ("a", "b"), width).select(*keys, "t").distinct().withColumn("_in", F.lit(True))
    return df.join(hit, [*keys, "t"], "left").withColumn("w", F.when(F.col("_in"), 0.0).otherwise(F.col("w"))).select(*df.columns)


def outside_spans(events: DataFrame, spans: DataFrame, keys: Sequence[str], width: float, share: float = 0.5) -> DataFrame:
    """Different events (keys, ea, eb) of which less than `share` lies in spans (a, b); an event without length goes if a span holds it.

    Only series and times meet the spans; events come back by them alone, nulls included, with what else they hold.
    """
    events = events.distinct()
    at = [*keys, "ea", "eb"]
    pairs = overlap_join(events.select(*at).distinct(), spans.select(*keys, "a", "b"), keys, ("ea", "eb"), ("a", "b"), width)
    part = F.greatest(F.lit(0.0), F.least("eb", "b") - F.greatest("ea", "a"))
    full = pairs.groupBy(*at).agg(F.sum(part).alias("_in")).filter(F.col("_in") >= share * (F.col("eb") - F.col("ea")))
    return events.join(full.select(*at), at, "left_anti")  # a null series or time meets no span, so it stays


def near_another(events: DataFrame, others: DataFrame, keys: Sequence[str], t: str, u: str, within: float) -> DataFrame:
    """Events with one of others at most `within` away (a semi-join)."""
    o = others.select(*keys, F.col(u).alias("_u")).distinct().withColumn("_b", F.explode(F.array(*(_bucket(F.col("_u"), within) + k for k in (-1, 0, 1)))))
    e = events.withColumn("_b", _bucket(F.col(t), within))
    on = [e[k] == o[k] for k in keys] + [e["_b"] == o["_b"], F.abs(e[t] - o["_u"]) <= within]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return e.join(o, cond, "left_semi").drop("_b")


def uncovered_gaps(spans: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", least: float = 0.5) -> DataFrame:
    """(keys, gap_a, gap_b): holes of at least `least` between spans in order of a, the furthest end so far closing each."""
    order = Window.partitionBy(*keys).orderBy(a, b)
    reach = F.max(b).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("gap_a", reach).filter(F.col(a) - F.col("gap_a") >= least).select(*keys, "gap_a", F.col(a).alias("gap_b"))


def merged_runs(df: DataFrame, keys: Sequence[str], i: str, gap: float = 1.0) -> DataFrame:
    """(keys, run_a, run_b, n): islands of rows whose i follow one another at most `gap` apart."""
    order = Window.partitionBy(*keys).orderBy(i)
    new = F.coalesce((F.col(i) - F.lag(i).over(order) > gap).cast("int"), F.lit(1))
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(i).alias("run_a"), F.max(i).alias("run_b"), F.count(F.lit(1)).alias("n")).drop("_run")


def retimed(cues: DataFrame, pieces: DataFrame, keys: Sequence[str], end: float, frame: float, width: float = 30.0) -> DataFrame:
    """(keys, n, start, end) of cues (keys, n, start, end) moved by the linear pieces (t0, t1, x0, x1) of a time map.

    A cue is clipped to [0, end] and to each piece it overlaps, mapped, and its parts that touch (within a microsecond) joined; parts shorter than a frame go.
    """
    keys = list(keys)
    c = cues.select(*keys, "n", F.greatest(F.lit(0.0), "start").alias("_s"), F.least(F.lit(end), "end").alias("_e")).filter("_e > _s")
    met = overlap_join(c, pieces.select(*keys, "t0", "t1", "x0", "x1"), keys, ("_s", "_e"), ("x0", "x1"), width)
    lo, hi = F.greatest("x0", "_s"), F.least("x1", "_e")
    k = (F.col("t1") - F.col("t0")) / (F.col("x1") - F.col("x0"))
    parts = met.filter(hi > lo).select(*keys, "n", (F.col("t0") + (lo - F.col("x0")) * k).alias("pa"), (F.col("t0") + (hi - F.col("x0")) * k).alias("pb"))
    order = Window.partitionBy(*keys, "n").orderBy("pa", "pb")
    reach = F.max("pb").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("pa") - reach > 1e-6).cast("int"), F.lit(1))
    parts = parts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    joined = parts.groupBy(*keys, "n", "_run").agg(F.min("pa").alias("start"), F.max("pb").alias("end"))
    return joined.filter(F.col("end") - F.col("start") >= frame).drop("_run")


def map_pieces(nodes: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """(keys, t0, t1, x0, x1) between neighbouring nodes (t, shift in frames of rate): target span to source span; pieces that don't advance go."""
    order = Window.partitionBy(*keys).orderBy("t")
    x = F.col("t") + F.col("shift") / rate
    p = nodes.withColumn("_x", x).select(*keys, F.col("t").alias("t0"), F.lead("t").over(order).alias("t1"), F.col("_x").alias("x0"), F.lead("_x").over(order).alias("x1"))
    return p.filter("t1 > t0 and x1 > x0")
