"""The structure of a laid track: plateaus of constant lag, the points where one gives way to the next, and what they say of the reference's timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import interpolated, overlap_join, uncovered_gaps
from strandweave.session import materialised


def refined_jumps(boundaries: DataFrame, ref: DataFrame, dub: DataFrame, keys: Sequence[str], smooth: int) -> DataFrame:
    """(keys, k, frame) of boundaries (keys, k, lo, hi, lag_a, lag_b; all in frames): where in [lo, hi) dub stops being like ref lag_a later and begins to be like ref lag_b later.

    The likeness of bands (frame, bands) to the one less that to the other, smoothed over `smooth` frames; the point where its sum before less that after is largest, the first of equals.
    """
    keys = list(keys)
    at = boundaries.filter("hi > lo").select(*keys, "k", "lag_a", "lag_b", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("frame"))
    side = lambda d, by, name: d.select(*keys, F.col("frame").alias(by), F.col("bands").alias(name))
    met = at.withColumn("_fa", F.col("frame") + F.col("lag_a")).withColumn("_fb", F.col("frame") + F.col("lag_b"))
    met = met.join(side(dub, "frame", "_d"), [*keys, "frame"]).join(side(ref, "_fa", "_a"), [*keys, "_fa"]).join(side(ref, "_fb", "_b"), [*keys, "_fb"])
    mean = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.size(x)
    of = Window.partitionBy(*keys, "k")
    d = met.select(*keys, "k", "frame", (mean("_d", "_a") - mean("_d", "_b")).alias("_x"))
    half = smooth // 2
    d = d.withColumn("_x", F.sum("_x").over(of.orderBy("frame").rowsBetween(-half, smooth - 1 - half)) / smooth)
    score = 2 * F.sum("_x").over(of.orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("_x").over(of)
    return d.withColumn("_s", score).groupBy(*keys, "k").agg(F.max_by("frame", F.struct(F.col("_s"), -F.col("frame"))).alias("frame"))


def ranges(plateaus: DataFrame, starts: DataFrame, lengths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, k, a, b, lag) on the reference: plateau k (keys, k, lag) owns the laid track from its start (keys, k, at; 0 for the first, never before that of the one before) to the next one's or the end (keys, length), moved by its lag; those squeezed out go."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("k")
    rows = plateaus.select(*keys, "k", "lag").join(starts.select(*keys, "k", "at"), [*keys, "k"], "left").join(lengths.select(*keys, "length"), keys)
    first = F.row_number().over(order) == 1
    own = F.max(F.when(first, F.lit(0.0)).otherwise(F.coalesce("at", F.lit(0.0)))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_from", own)
    rows = rows.withColumn("_to", F.coalesce(F.lead("_from").over(order), "length"))
    got = rows.select(*keys, "k", F.greatest(F.lit(0.0), F.col("_from") + F.col("lag")).alias("a"), F.least(F.col("length"), F.col("_to") + F.col("lag")).alias("b"), "lag")
    return got.filter("b > a")


def offsets(ranges_: DataFrame, grid: DataFrame, keys: Sequence[str], rate: float, width: float = 60.0) -> DataFrame:
    """(keys, t, off0): on a grid (keys, t) the offset in frames of the range [a, b) that holds t, the later plateau's where several do; between ranges interpolated, held beyond them."""
    keys = list(keys)
    met = overlap_join(grid.select(*keys, "t", F.col("t").alias("_t2")), ranges_.select(*keys, "k", "a", "b", "lag"), keys, ("t", "_t2"), ("a", "b"), width, many=True).filter(F.col("t") < F.col("b"))
    known = materialised(met.groupBy(*keys, "t").agg((-F.max_by("lag", "k") * rate).alias("kv")))
    return interpolated(grid.select(*keys, "t"), known.withColumnRenamed("t", "kt"), keys, "t", out="off0")


def gaps(ranges_: DataFrame, lengths: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """(keys, gap_a, gap_b): stretches of the reference of at least `least` that no range covers, those at either end too."""
    keys = list(keys)
    ends = lengths.select(*keys, F.explode(F.array(F.lit(0.0), F.col("length"))).alias("a"))
    return uncovered_gaps(ranges_.select(*keys, "a", "b").unionByName(ends.withColumn("b", F.col("a"))), keys, least=least)


def handovers(ranges_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at): where each range but the first begins: there the lag steps."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    return ranges_.withColumn("_r", F.row_number().over(order)).filter("_r > 1").select(*keys, F.col("a").alias("at"))


def identity_pieces(lengths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, t0, t1, x0, x1): the time map of what lies on the reference's timeline already."""
    zero, end = F.lit(0.0), F.col("length").cast("double")
    return lengths.select(*keys, zero.alias("t0"), end.alias("t1"), zero.alias("x0"), end.alias("x1")).filter("t1 > 0")
