"""Robust statistics and aggregates of anchor series: weighted medians, line fits, scales, quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "wmed") -> DataFrame:
    """(keys, out): the first value, in order, whose cumulative weight reaches half the total; the plain median if the total isn't positive.

    Equal values are summed before the shuffle that the ordered sums need, so a hot series of few different values stays small.
    """
    one = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.coalesce(F.col(weight), F.lit(0.0))).alias("_w"), F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy(*keys)
    cum = one.withColumn("_cw", F.sum("_w").over(up)).withColumn("_tw", F.sum("_w").over(all_))
    cum = cum.withColumn("_cn", F.sum("_n").over(up)).withColumn("_tn", F.sum("_n").over(all_))
    low, high = F.floor((F.col("_tn") + 1) / 2), F.floor(F.col("_tn") / 2) + 1
    return cum.groupBy(*keys).agg(
        F.when(F.max("_tw") > 0, F.min(F.when(F.col("_cw") >= F.col("_tw") / 2, F.col(value))))
        .otherwise((F.min(F.when(F.col("_cn") >= low, F.col(value))) + F.min(F.when(F.col("_cn") >= high, F.col(value)))) / 2).alias(out)
    )


def global_scale(df: DataFrame, keys: Sequence[str] = ("series",), bin_s: float = 25.0, least: int = 3) -> DataFrame:
    """(keys, slope, n_slopes): the weighted median of slopes between neighbouring bins' weighted medians.

    Bins are equal parts of [first t, last t), about bin_s long, at least two; those with `least` positive weights
    count; a slope weighs as its lighter bin.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    nb = F.greatest(F.lit(2), F.floor((F.col("_t1") - F.col("_t0")) / bin_s))
    ends = ends.filter("_t1 > _t0").withColumn("_nb", nb).withColumn("_step", (F.col("_t1") - F.col("_t0")) / nb)
    inside = df.filter("w > 0").join(ends, keys).filter("t < _t1")
    inside = inside.withColumn("_bin", F.least(F.floor((F.col("t") - F.col("_t0")) / F.col("_step")), F.col("_nb") - 1))
    weights = inside.groupBy(*keys, "_bin").agg(F.sum("w").alias("_bw"), F.count(F.lit(1)).alias("_bn"), F.max("_t0").alias("_t0"), F.max("_step").alias("_step")).filter(F.col("_bn") >= least)
    levels = weighted_median(inside, [*keys, "_bin"], "o", "w", "_level").join(weights, [*keys, "_bin"])
    levels = levels.withColumn("_mid", F.col("_t0") + (F.col("_bin") + 0.5) * F.col("_step"))
    after = Window.partitionBy(*keys).orderBy("_bin")
    slopes = levels.withColumn("_s", (F.lead("_level").over(after) - F.col("_level")) / (F.lead("_mid").over(after) - F.col("_mid")))
    slopes = slopes.withColumn("_sw", F.least(F.lead("_bw").over(after), F.col("_bw"))).filter("_s is not null")
    n = slopes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slopes"))
    return weighted_median(slopes, keys, "_s", "_sw", "slope").join(n, keys)


def guarded_trend(df: DataFrame, keys: Sequence[str], rate: float, bin_s: float = 25.0, max_percent: float = 15.0) -> DataFrame:
    """(keys, slope, level): global_scale with its level, both zero where the slope exceeds max_percent of the rate."""
    keys = list(keys)
    scale = global_scale(df, keys, bin_s)
    ok = F.abs(F.col("slope")) / F.lit(rate) * 100 <= max_percent
    rest = df.join(scale, keys).withColumn("_r", F.col("o") - F.col("slope") * F.col("t")).withColumn("_w", F.greatest(F.col("w"), F.lit(1e-6)))
    level = weighted_median(rest, keys, "_r", "_w", "level")
    return scale.join(level, keys).select(*keys, F.when(ok, F.col("slope")).otherwise(0.0).alias("slope"), F.when(ok, F.col("level")).otherwise(0.0).alias("level"))


def _moments(w: Column, t: Column, y: Column) -> list[Column]:
    return [F.sum(w).alias("_sw"), F.sum(w * t).alias("_st"), F.sum(w * y).alias("_sy"), F.sum(w * t * t).alias("_stt"), F.sum(w * t * y).alias("_sty")]


def _line() -> tuple[Column, Column]:
    sw, st, sy, stt, sty = (F.col(c) for c in ("_sw", "_st", "_sy", "_stt", "_sty"))
    a = F.coalesce(F.try_divide(sw * sty - st * sy, sw * stt - st * st), F.lit(0.0))
    return a, F.coalesce(F.try_divide(sy - a * st, sw), F.lit(0.0))


def robust_line(df: DataFrame, keys: Sequence[str], t: str = "t", y: str = "o", w: str = "w", passes: int = 2, width: float = 2.5) -> DataFrame:
    """(keys, a, b, spread) of y = a t + b by weighted least squares, each pass but the last weighing rows down by a Gaussian of their distance, `width` spreads wide.

    Times are taken from each series' weighted mean, so that large epochs lose no digits.
    """
    from strandweave.session import materialised

    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(w) * F.col(t)), F.sum(w)).alias("_tm"))
    rows = df.select(*keys, F.col(t).alias("_t"), F.col(y).alias("_y"), F.col(w).cast("double").alias("_w")).join(mean, keys)
    # stored once; each pass reads them twice, with the few numbers a series of the fit before
    rows = materialised(rows.withColumn("_t", F.col("_t") - F.col("_tm")))
    off = F.col("_y") - F.col("_a") * F.col("_t") - F.col("_b")
    weighed, fit = rows, None
    for k in range(passes):
        if k:
            g = F.exp(-0.5 * F.pow(F.try_divide(off, F.lit(width) * F.col("_spread")), 2))
            weighed = rows.join(fit.drop("_m"), keys).select(*rows.columns[:-2], (F.col("_w") * F.coalesce(g, F.lit(1.0))).alias("_w"), "_tm")
        a, b = _line()
        line = weighed.groupBy(*keys).agg(*_moments(F.col("_w"), F.col("_t"), F.col("_y")), F.max("_tm").alias("_m"))
        line = materialised(line.withColumn("_a", a).withColumn("_b", b).select(*keys, "_a", "_b", "_m"))
        spread = weighed.join(line, keys).groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(F.col("_w") * off * off), F.sum("_w"))).alias("_spread"))
        fit = materialised(line.join(spread, keys))
    return fit.select(*keys, F.col("_a").alias("a"), (F.col("_b") - F.col("_a") * F.col("_m")).alias("b"), F.col("_spread").alias("spread"))


def prefix_moments(df: DataFrame, keys: Sequence[str], t: str = "t", y: str = "o", w: str = "w") -> DataFrame:
    """df with running sums cw, ct, cy, ctt, cty of the weighted moments in order of t: a segment's line is a difference of two rows."""
    up = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w, t, y = F.col(w), F.col(t), F.col(y)
    parts = {"cw": w, "ct": w * t, "cy": w * y, "ctt": w * t * t, "cty": w * t * y}
    return df.select("*", *(F.sum(v).over(up).alias(k) for k, v in parts.items()))


def theil_sen(df: DataFrame, keys: Sequence[str], t: str = "t", y: str = "o", points: int = 20, apart: float = 1.0, limit: float | None = None) -> DataFrame:
    """(keys, slope, level): median slope over pairs of every (n div points)-th row more than `apart` in t, clipped to +-limit; median level of all rows.

    At most about 2 * points rows of a series are paired, whatever its length.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(t, y)
    ranked = df.select(*keys, F.col(t).alias("_t"), F.col(y).alias("_y"), (F.row_number().over(order) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    thin = ranked.filter(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / points)) == 0).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_t", "_y"))).alias("p"))
    pairs = F.expr(f"flatten(transform(p, (a, i) -> transform(filter(slice(p, i + 2, size(p)), b -> b._t > a._t + {apart}), b -> (b._y - a._y) / (b._t - a._t))))")
    slopes = thin.select(*keys, F.explode_outer(pairs).alias("_s")).groupBy(*keys).agg(F.coalesce(F.percentile("_s", 0.5), F.lit(0.0)).alias("slope"))
    if limit is not None:
        slopes = slopes.withColumn("slope", F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("slope"))))
    level = df.join(slopes, keys).groupBy(*keys).agg(F.percentile(F.col(y) - F.col("slope") * F.col(t), 0.5).alias("level"))
    return slopes.join(level, keys)


def match_metrics(match: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, slope, backward, median_cos, assigned, intro) of matches (keys, dub, ref or null, cos): slope of ref on dub, backward steps, median cosine, share assigned, dropped rows before the first match."""
    keys = list(keys)
    step = Window.partitionBy(*keys).orderBy("dub")
    hit = match.filter("ref is not null").withColumn("_back", (F.lag("ref").over(step) > F.col("ref")).cast("int"))
    every = match.groupBy(*keys).agg(F.min("dub").alias("_first"), F.count(F.lit(1)).alias("_n"))
    got = hit.groupBy(*keys).agg(F.regr_slope("ref", "dub").alias("slope"), F.coalesce(F.sum("_back"), F.lit(0)).alias("backward"), F.percentile("cos", 0.5).alias("median_cos"), F.count(F.lit(1)).alias("_m"), F.min("dub").alias("_hit"))
    return every.join(got, keys, "left").select(*keys, "slope", F.coalesce("backward", F.lit(0)).alias("backward"), "median_cos", (F.coalesce("_m", F.lit(0)) / F.col("_n")).alias("assigned"), (F.coalesce("_hit", F.col("_first")) - F.col("_first")).alias("intro"))


def excess_movement(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """(keys, excess): sum of absolute moves less the absolute sum of moves."""
    return df.groupBy(*keys).agg((F.sum(F.abs(F.col(v))) - F.abs(F.sum(v))).alias("excess"))


def layer_metrics(df: DataFrame, keys: Sequence[str], from_t: float = 30.0) -> DataFrame:
    """(keys, coverage, span, largest_step, path, net, drift, residual) of a series: share of weights of 0.5 and more, range, largest and total and net step of o, median |o| and median deviation from the median from from_t after the start."""
    keys = list(keys)
    step = Window.partitionBy(*keys).orderBy("t", "o")
    rows = df.withColumn("_d", F.col("o") - F.lag("o").over(step)).withColumn("_s", F.col("t") - F.min("t").over(Window.partitionBy(*keys)))
    late = F.when(F.col("_s") >= from_t, F.col("o"))
    first = rows.groupBy(*keys).agg(
        F.avg((F.col("w") >= 0.5).cast("double")).alias("coverage"), (F.max("o") - F.min("o")).alias("span"), F.max(F.abs("_d")).alias("largest_step"),
        F.sum(F.abs("_d")).alias("path"), F.sum("_d").alias("net"), F.percentile(F.abs(late), 0.5).alias("drift"), F.percentile(late, 0.5).alias("_med"))
    second = rows.join(first.select(*keys, "_med"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.when(F.col("_s") >= from_t, F.col("o")) - F.col("_med")), 0.5).alias("residual"))
    return first.drop("_med").join(second, keys)


def whitened(frames: DataFrame, reference: DataFrame, vec: str = "vec", eps: float = 1e-6) -> DataFrame:
    """frames with vec brought to the reference's mean 0 and (population) deviation 1 per dimension, then to length 1."""
    stats = reference.select(F.posexplode(vec).alias("_d", "_x")).groupBy("_d").agg(F.avg(F.col("_x").cast("double")).alias("m"), F.stddev_pop(F.col("_x").cast("double")).alias("s"))
    # one row: two numbers a dimension, whatever the number of frames
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("_d", "m", "s"))).alias("_stats"))
    z = F.zip_with(F.col(vec), F.col("_stats"), lambda x, p: (x.cast("double") - p["m"]) / (p["s"] + eps))
    from strandweave.functions.vector import unit

    return frames.withColumn("_stats", packed.scalar()).withColumn("_z", z).withColumn(vec, unit(F.col("_z"))).drop("_z", "_stats")


def z_normalised(frames: DataFrame, keys: Sequence[str], value: str = "value", eps: float = 1e-6) -> DataFrame:
    """frames with value less its mean over its sample deviation (plus eps), per keys."""
    from strandweave.session import materialised

    # two numbers a series, stored so that the planner sees how small they are: else each series' rows are sorted in one task to meet them
    stats = materialised(frames.groupBy(*keys).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s")))
    return frames.join(stats, list(keys)).withColumn(value, (F.col(value) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def phat_desync(lags: DataFrame, keys: Sequence[str], lag: str = "lag", far: float = 7.0, tight: float = 6.0, least: int = 5) -> DataFrame:
    """(keys, median_lag, mad, danger): danger where at least `least` windows agree (deviation under tight) on a lag beyond far."""
    keys = list(keys)
    med = lags.groupBy(*keys).agg(F.percentile(lag, 0.5).alias("median_lag"), F.count(lag).alias("_n"))
    mad = lags.join(med, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(lag) - F.col("median_lag")), 0.5).alias("mad"))
    return med.join(mad, keys).select(*keys, "median_lag", "mad", ((F.col("_n") >= least) & (F.abs("median_lag") > far) & (F.col("mad") < tight)).alias("danger"))


#: Equal parts that a series' values are counted in to find its median.
BINS = 1024


def medians(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(keys, parts): each part's median over the rows of keys, exactly: the mean of the middle two, nulls left out, nan above all numbers.

    F.percentile holds all different values of a series in one task. Here values are counted in BINS equal parts of their range; those of the one or two that hold the middle are counted by value and
    put in order, spilled where they crowd. df is read three times.
    """
    from strandweave.session import materialised

    keys, inf = list(keys), F.lit(float("inf"))
    wide = df.select(*keys, *(F.col(p).cast("double").alias(f"_p{i}") for i, p in enumerate(parts)))
    finite = lambda i: F.when(F.abs(f"_p{i}") < inf, F.col(f"_p{i}"))
    met = lambda a, b, on: a.join(b.select(*(F.col(c).alias(f"_of{c}") for c in on), *(c for c in b.columns if c not in on)), [a[c].eqNullSafe(F.col(f"_of{c}")) for c in on]).drop(*(f"_of{c}" for c in on))
    # a row a series, stored so that the planner sees how small it is
    of = materialised(wide.groupBy(*keys).agg(*(x for i in range(len(parts)) for x in (F.count(f"_p{i}").alias(f"_n{i}"), F.min(finite(i)).alias(f"_lo{i}"), F.max(finite(i)).alias(f"_hi{i}")))))
    each = F.array(*(F.struct(F.lit(i).alias("_i"), *(F.col(f"_{c}{i}").alias(f"_{c}") for c in ("p", "n", "lo", "hi"))) for i in range(len(parts))))
    v, lo, hi = F.col("_p"), F.col("_lo"), F.col("_hi")
    place = F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))
    part = F.when(F.isnan(v), BINS + 1).when(v == inf, BINS).when(v == -inf, -1).otherwise(F.least(F.floor(place * BINS), F.lit(BINS - 1)))
    rows = met(wide, of, keys).select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.*").filter("_p is not null").select(*keys, "_i", "_p", "_n", part.cast("int").alias("_bin"))
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    so_far = Window.partitionBy(*keys, "_i").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_i", "_bin").agg(F.count(F.lit(1)).alias("_m"), F.max("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_m").over(so_far), F.lit(0)))
    middle = materialised(sizes.filter((F.col("_before") <= high) & (F.col("_before") + F.col("_m") > low)).select(*keys, "_i", "_bin", "_before"))
    values = met(rows, middle, [*keys, "_i", "_bin"]).groupBy(*keys, "_i", "_bin", "_p").agg(F.count(F.lit(1)).alias("_m"), F.max("_n").alias("_n"), F.max("_before").alias("_before"))
    up = Window.partitionBy(*keys, "_i", "_bin").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda k: F.min(F.when(F.col("_to") > k, v))
    two = values.withColumn("_to", F.col("_before") + F.sum("_m").over(up)).groupBy(*keys, "_i").agg(first(low).alias("_a"), first(high).alias("_z"))
    two = two.select(*keys, "_i", F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_z")).alias("_v"))
    # a series without values has nulls
    every = two.unionByName(of.select(*keys, F.lit(None).cast("int").alias("_i"), F.lit(None).cast("double").alias("_v")))
    return every.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(p) for i, p in enumerate(parts)))


def consensus(boxes: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(keys, parts): each part's median over the rows of keys, rounded half to even and down to an even number. boxes are read three times."""
    from strandweave.functions.times import even

    return medians(boxes, keys, parts).select(*keys, *(even(F.col(p)).alias(p) for p in parts))
