"""Moving and ordered operators over series: smoothing, runs, density, cadence, silence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.vector import cosine, dot
from strandweave.operators.intervals import merged_runs

#: The first value, in order, of rows (o, w) whose cumulative weight reaches half the total; rows come sorted, weights positive.
_WMED = (
    "aggregate({rows}, struct(cast(0.0 as double) as c, cast(null as double) as v), "
    "(s, x) -> struct(s.c + x.w as c, if(s.v is null and s.c + x.w >= {half}, x.o, s.v) as v), s -> s.v)"
)


#: Rows that a stretch of a series has on the average where a series is cut to be numbered or joined.
STRETCH = 200_000


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "i") -> DataFrame:
    """df with out: the row's number, from 0, in its series by order, whose first column is a number.

    A series is cut to stretches of that column, each numbered on its own; what the stretches before hold, a row a stretch, is added. So no series is one task, but rows of one value are.
    """
    keys = list(keys)
    x = F.col(order[0])
    of = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / STRETCH)).alias("n"))
    ends = of.select(F.struct("lo", F.greatest(F.lit(1e-9), (F.col("hi") - F.col("lo")) / F.col("n")).alias("width"))).scalar()
    # nulls come first, as in the order
    cut = df.withColumn("_ends", ends).withColumn("_cut", F.coalesce(F.floor((x - F.col("_ends.lo")) / F.col("_ends.width")), F.lit(-1))).drop("_ends")
    sizes = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_cut").alias("_of_cut"), before.alias("_before"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(*order)) - 1)
    same = F.col("_cut") == F.col("_of_cut")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return own.join(sizes, same).select(*df.columns, (F.col("_own") + F.col("_before")).cast("int").alias(out))


def moving_weighted_median(df: DataFrame, keys: Sequence[str], rows: int, t: str = "t", o: str = "o", w: str = "w", out: str = "smooth", floor: float = 1e-6) -> DataFrame:
    """df with out: the weighted median of o over rows // 2 rows (at least one) on either side, weights at least `floor`."""
    half = max(1, rows // 2)
    around = Window.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)
    near = F.sort_array(F.collect_list(F.struct(F.col(o).cast("double").alias("o"), F.greatest(F.col(w).cast("double"), F.lit(floor)).alias("w"))).over(around))
    total = "aggregate(_near, cast(0.0 as double), (s, x) -> s + x.w) / 2"
    return df.withColumn("_near", near).withColumn("_half", F.expr(total)).withColumn(out, F.expr(_WMED.format(rows="_near", half="_half"))).drop("_near", "_half")


def moving_median(df: DataFrame, keys: Sequence[str], half: int, i: str, v: str, out: str) -> DataFrame:
    """df with out: the median of v over `half` rows on either side, nulls left out."""
    return df.withColumn(out, F.expr(f"percentile({v}, 0.5) over (partition by {', '.join(keys)} order by {i} rows between {half} preceding and {half} following)"))


def confident(df: DataFrame, keys: Sequence[str], share: float = 0.5) -> DataFrame:
    """Rows whose weight is at least `share` of their series' median positive weight."""
    gate = df.groupBy(*keys).agg(F.percentile(F.when(F.col("w") > 0, F.col("w")), 0.5).alias("_gate"))
    return df.join(gate, list(keys)).filter(F.col("w") >= share * F.col("_gate")).drop("_gate")


def coarse_trail(df: DataFrame, keys: Sequence[str], edge: float, half: int = 10, agree: float = 4.0) -> DataFrame:
    """(keys, t, trail): shifts smoothed over +-half nodes, nodes that disagree with that by more than `agree` (or lie within 2 of the window's edge) weighing nothing, smoothed again."""
    guarded = df.withColumn("w", F.when(F.abs("o") > edge - 2, 0.0).otherwise(F.col("w")))
    once = moving_weighted_median(guarded, keys, 2 * half, out="_once")
    kept = once.withColumn("w", F.when(F.abs(F.col("o") - F.col("_once")) <= agree, F.col("w")).otherwise(0.0))
    return moving_weighted_median(kept, keys, 2 * half, out="trail").select(*keys, "t", "trail")


def low_zones(match: DataFrame, keys: Sequence[str], half: int, low: float, bridge: int, least: int) -> DataFrame:
    """(keys, run_a, run_b, n): zones of rows (i, cos; null where unassigned) whose moving median cosine is under `low`, joined over at most `bridge` unassigned rows, at least `least` long."""
    smooth = moving_median(match, keys, half, "i", "cos", "_m").filter(F.col("cos").isNotNull() & (F.col("_m") < low))
    return merged_runs(smooth, keys, "i", bridge + 1).filter(F.col("run_b") - F.col("run_a") + 1 >= least)


def frozen_runs(frames: DataFrame, keys: Sequence[str], step: int = 8, apart: int = 16, same: float = 0.999, bridge: int = 24, least: int = 240) -> DataFrame:
    """(keys, run_a, run_b, n): runs of every step-th frame whose vector `apart` frames on is the same (cosine at least `same`), joined over `bridge` frames, at least `least` frames long."""
    a = frames.filter(F.col("frame") % step == 0).select(*keys, "frame", F.col("vec").alias("_a"))
    b = frames.select(*keys, (F.col("frame") - apart).alias("frame"), F.col("vec").alias("_b"))
    still = a.join(b, [*keys, "frame"]).filter(cosine(F.col("_a"), F.col("_b")) >= same).select(*keys, "frame")
    return merged_runs(still, keys, "frame", step + bridge).filter(F.col("run_b") + apart - F.col("run_a") >= least)


def chain_density(chain: DataFrame, rows: DataFrame, keys: Sequence[str], reach: int = 60, least: int = 3, jump: float = 20.0) -> DataFrame:
    """rows (i) with protected: at least `least` chain rows (i, off) within reach, before the first or after the last jump of off beyond `jump` (everywhere, if there is none)."""
    order = Window.partitionBy(*keys).orderBy("i")
    jumps = chain.withColumn("_j", F.abs(F.col("off") - F.lag("off").over(order)) > jump).withColumn("_p", F.lag("i").over(order)).filter("_j")
    ends = jumps.groupBy(*keys).agg(F.min("_p").alias("_first"), F.max("i").alias("_last"))
    both = rows.select(*keys, "i", F.lit(0).alias("_c")).unionByName(chain.select(*keys, "i", F.lit(1).alias("_c")))
    near = Window.partitionBy(*keys).orderBy("i").rangeBetween(-reach, reach)
    counted = both.withColumn("_n", F.sum("_c").over(near)).filter("_c = 0").join(ends, list(keys), "left")
    free = F.coalesce((F.col("i") <= F.col("_first")) | (F.col("i") >= F.col("_last")), F.lit(True))
    return counted.select(*keys, "i", ((F.col("_n") >= least) & free).alias("protected"))


def neighbour_similarity(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frames without vec, with sim: the dot product with the frame before (null for the first)."""
    order = Window.partitionBy(*keys).orderBy("frame")
    return frames.withColumn("sim", dot(F.col("vec"), F.lag("vec").over(order))).drop("vec")


def cadence_signature(frames: DataFrame, keys: Sequence[str], background: Sequence[int] = (3, 4, 6, 7)) -> DataFrame:
    """(keys, prominence, period): of the autocorrelation of neighbour dissimilarity, lag 5 or 10 over the mean of `background`, and the lag of 2..12 where it is largest."""
    x = neighbour_similarity(frames, keys).filter("sim is not null").withColumn("_x", 1 - F.col("sim"))
    mean = x.groupBy(*keys).agg(F.avg("_x").alias("_m"))
    x = x.join(mean, list(keys)).withColumn("_c", F.col("_x") - F.col("_m"))
    order = Window.partitionBy(*keys).orderBy("frame")
    lags = x.select(*keys, "_c", *(F.lead("_c", p).over(order).alias(f"_l{p}") if p else F.col("_c").alias("_l0") for p in range(13)))
    ac = lags.groupBy(*keys).agg(*(F.coalesce(F.sum(F.col("_c") * F.col(f"_l{p}")), F.lit(0.0)).alias(f"_a{p}") for p in range(13)))
    r = {p: F.col(f"_a{p}") / (F.col("_a0") + 1e-12) for p in range(13)}
    over = F.greatest(r[5], r[10]) - sum((r[p] for p in background), F.lit(0.0)) / len(background)
    best = F.array_position(F.array(*(r[p] for p in range(2, 13))), F.greatest(*(r[p] for p in range(2, 13)))) + 1
    return ac.select(*keys, over.alias("prominence"), best.cast("int").alias("period"))


def is_cadence(signature: DataFrame, rate: Column, n: Column, floor: float = 0.05) -> DataFrame:
    """signature with telecine: rate of 29 to 30.5, at least 1000 frames, period 5 with a prominence of at least `floor`."""
    return signature.withColumn("telecine", rate.between(29.0, 30.5) & (n >= 1000) & (F.col("period") == 5) & (F.col("prominence") >= floor))


def thinned(frames: DataFrame, keys: Sequence[str], group: int = 5) -> DataFrame:
    """(keys, frame, keep): of each aligned group of `group` frames that all have a predecessor, the one most similar to it isn't kept (the first of equals)."""
    sims = neighbour_similarity(frames, keys).withColumn("_g", F.floor(F.col("frame") / group))
    of = Window.partitionBy(*keys, "_g")
    first = F.row_number().over(of.orderBy(F.desc_nulls_last("sim"), "frame"))
    ranked = sims.withColumn("_r", first).withColumn("_n", F.count("sim").over(of))
    return ranked.select(*keys, "frame", (~((F.col("_n") >= group) & (F.col("_r") == 1))).alias("keep"))


def silent_runs(samples: DataFrame, keys: Sequence[str], value: str, block: int, quiet: float, least: int) -> DataFrame:
    """(keys, run_a, run_b, n): runs of at least `least` blocks of `block` samples (numbered i) whose root mean square is under `quiet`."""
    rms = samples.groupBy(*keys, F.floor(F.col("i") / block).alias("block")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return merged_runs(rms.filter(F.col("rms") < quiet), keys, "block").filter(F.col("n") >= least)


def fill_runs(dub: DataFrame, ref: DataFrame, keys: Sequence[str], value: str, block: int, quiet: float, least: int) -> DataFrame:
    """(keys, run_a, run_b, n): runs of at least `least` blocks in which dub is under `quiet` and ref isn't: what is filled from ref."""
    rms = lambda d, name: d.groupBy(*keys, F.floor(F.col("i") / block).alias("block")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias(name))
    both = rms(dub, "_d").join(rms(ref, "_r"), [*keys, "block"]).filter((F.col("_d") < quiet) & (F.col("_r") >= quiet))
    return merged_runs(both, keys, "block").filter(F.col("n") >= least)


def edge_silence(grid: DataFrame, keys: Sequence[str], duration: Column, least: float = 0.3) -> DataFrame:
    """(keys, head, tail): lengths of the grid (t, x) before x reaches 0 and after it passes the duration; shorter than `least` counts as none."""
    ends = grid.groupBy(*keys).agg(
        (F.max(F.when(F.col("x") < 0, F.col("t"))) - F.min("t")).alias("head"), (F.max("t") - F.min(F.when(F.col("x") > duration, F.col("t")))).alias("tail"))
    cut = lambda c: F.when(F.col(c) >= least, F.col(c)).otherwise(0.0).alias(c)
    return ends.select(*keys, cut("head"), cut("tail"))


def levels_at(cuts: DataFrame, points: DataFrame, keys: Sequence[str], window: float, buffer: float = 0.0) -> DataFrame:
    """cuts (keys, tc) with before and after: medians of o in the windows up to and from tc, `buffer` away from it."""
    from strandweave.operators.intervals import overlap_join

    far = window + buffer
    c = cuts.withColumn("_a", F.col("tc") - far).withColumn("_z", F.col("tc") + far)
    p = points.select(*keys, F.col("t").alias("_t"), F.col("t").alias("_t2"), F.col("o").alias("_o"))
    met = overlap_join(c, p, keys, ("_a", "_z"), ("_t", "_t2"), max(far, 1e-9))
    side = lambda cond: F.percentile(F.when(cond, F.col("_o")), 0.5)
    return met.groupBy(*cuts.columns).agg(
        side(F.col("_t") < F.col("tc") - buffer).alias("before"), side(F.col("_t") > F.col("tc") + buffer).alias("after"))


def step_curve(points: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg, level, support): median o of each segment between cuts (keys, tc); one without weight takes the level before it, the first ones the level after."""
    keys = list(keys)
    marks = cuts.select(*keys, F.col("tc").alias("t"), F.lit(1).alias("_c"), F.lit(None).cast("double").alias("o"), F.lit(None).cast("double").alias("w"))
    every = points.select(*keys, "t", F.lit(0).alias("_c"), F.col("o").cast("double").alias("o"), F.col("w").cast("double").alias("w")).unionByName(marks)
    order = Window.partitionBy(*keys).orderBy("t", "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segs = every.withColumn("seg", F.sum("_c").over(order)).filter("_c = 0")
    got = segs.groupBy(*keys, "seg").agg(F.percentile(F.when(F.col("w") > 0, F.col("o")), 0.5).alias("_l"), F.sum("w").alias("support"))
    so_far = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back, ahead = F.last("_l", True).over(so_far.orderBy("seg")), F.last("_l", True).over(so_far.orderBy(F.desc("seg")))
    return got.select(*keys, "seg", F.coalesce(back, ahead).alias("level"), "support")


def best_parabola(scores: Column, lags: Column) -> Column:
    """The lag of the largest score, moved by at most a bin to the top of the parabola through it and its neighbours."""
    k = F.array_position(scores, F.array_max(scores)).cast("int")
    y0, y1, y2 = F.get(scores, k - 2), F.get(scores, k - 1), F.get(scores, k)
    bend = y0 - 2 * y1 + y2
    move = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(0.5 * (y0 - y2), bend)))
    step = F.get(lags, F.lit(1)) - F.get(lags, F.lit(0))
    return F.get(lags, k - 1) + F.coalesce(F.when(bend < 0, move), F.lit(0.0)) * step
