"""Time maps with cuts: the linear pieces of a laid curve, and several resamplings composed to one layout.

A cut (tc, delta, t_end, t_nxt) of negative delta leaves the hole [t_end, t_nxt] that the source has nothing for; one of positive delta joins
its two sides at tc. Between cuts a curve's nodes are joined by lines; towards a cut the last line goes on, at the ends of the timeline the shift is held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import interpolated, overlap_join


def segments(cuts: DataFrame, lengths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg, a, b, is_first, is_last): the stretches between a series' cuts, from the end of a hole (or the seam) to the beginning of the next; all series of lengths (keys, length)."""
    keys = list(keys)
    ends = cuts.select(*keys, "tc", F.when(F.col("delta") < 0, F.col("t_end")).otherwise(F.col("tc")).alias("_b"), F.when(F.col("delta") < 0, F.col("t_nxt")).otherwise(F.col("tc")).alias("_n"))
    last = lengths.select(*keys, F.lit(float("inf")).alias("tc"), F.col("length").cast("double").alias("_b"), F.lit(None).cast("double").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("tc", "_b", "_n")
    rows = ends.join(lengths.select(*keys), keys, "left_semi").unionByName(last)
    return rows.select(*keys, (F.row_number().over(order) - 1).alias("seg"), F.coalesce(F.lag("_n").over(order), F.lit(0.0)).alias("a"), F.col("_b").alias("b"), F.lag("_b").over(order).isNull().alias("is_first"), F.isnull("_n").alias("is_last"))


def in_segments(nodes: DataFrame, cuts: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """nodes with seg, the number of cuts (keys, tc) before each; a node on a cut belongs before it."""
    keys = list(keys)
    one = nodes.select(*keys, F.struct(*(F.col(c) for c in nodes.columns)).alias("_p"), F.col(t).cast("double").alias("_t"), F.lit(0).alias("_cut"))
    two = cuts.select(*keys, F.lit(None).cast(one.schema["_p"].dataType).alias("_p"), F.col("tc").cast("double").alias("_t"), F.lit(1).alias("_cut"))
    order = Window.partitionBy(*keys).orderBy("_t", "_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return one.unionByName(two).withColumn("seg", F.sum("_cut").over(order).cast("int")).filter("_cut = 0").select("_p.*", "seg")


def _line(p: Column, q: Column, t: Column) -> Column:
    """The shift at t on the line through nodes p and q (t, s); either's own where there is but one."""
    both = p["s"] + (q["s"] - p["s"]) * (t - p["t"]) / (q["t"] - p["t"])
    return F.when(p.isNull(), q["s"]).when(q.isNull() | (p["t"] == q["t"]), p["s"]).otherwise(both)


def cut_pieces(curve: DataFrame, cuts: DataFrame, lengths: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """(keys, t0, t1, x0, x1) of a curve (keys, t, shift in frames of rate; one row a t) with cuts (keys, tc, delta, t_end, t_nxt) on a timeline of length (keys, length).

    Pieces in which the source doesn't advance go; so do stretches without a node, or that holes leave nothing of.
    """
    keys = list(keys)
    at = [*keys, "seg"]
    parts = segments(cuts, lengths, keys).filter("b > a")
    order = Window.partitionBy(*at).orderBy("t")
    node = F.struct(F.col("t").cast("double").alias("t"), F.col("shift").cast("double").alias("s"))
    nodes = in_segments(curve.select(*keys, "t", "shift"), cuts, keys).withColumn("_n", node)
    nodes = nodes.withColumn("_next", F.lead("_n").over(order)).withColumn("_prev", F.lag("_n").over(order)).join(parts, at)
    near = lambda x: [F.max(F.when(F.col("t") <= F.col(x), F.col("_n"))).alias(f"_{x}p"), F.min(F.when(F.col("t") >= F.col(x), F.col("_n"))).alias(f"_{x}q")]
    ends = nodes.groupBy(*at, "a", "b", "is_first", "is_last").agg(F.min("_n").alias("_1"), F.min_by("_next", "t").alias("_2"), F.max("_n").alias("_z"), F.max_by("_prev", "t").alias("_y"), *near("a"), *near("b"))

    def shift(x: str) -> Column:
        c = F.col(x)
        inside = _line(F.col(f"_{x}p"), F.col(f"_{x}q"), c)
        before = F.when(F.col("is_first"), F.col("_1")["s"]).otherwise(_line(F.col("_1"), F.col("_2"), c))
        after = F.when(F.col("is_last"), F.col("_z")["s"]).otherwise(_line(F.col("_y"), F.col("_z"), c))
        return F.when(c < F.col("_1")["t"], before).when(c > F.col("_z")["t"], after).otherwise(inside)

    knots = nodes.filter("t > a and t < b").select(*at, F.col("t").cast("double").alias("t"), F.col("shift").cast("double").alias("s"))
    for x in "ab":
        knots = knots.unionByName(ends.select(*at, F.col(x).alias("t"), shift(x).alias("s")))
    pieces = knots.withColumn("_x", F.col("t") + F.col("s") / rate).select(*keys, F.col("t").alias("t0"), F.lead("t").over(order).alias("t1"), F.col("_x").alias("x0"), F.lead("_x").over(order).alias("x1"))
    return pieces.filter("t1 > t0 and x1 > x0")


def composed(grid: DataFrame, layers: Sequence[tuple[DataFrame, DataFrame, DataFrame]], keys: Sequence[str], unit: float, guard: float, width: float, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, cuts) of layers (curve, breaks, holes), outermost first, on a grid (keys, t): nodes (keys, t, shift in seconds), cuts as cut_pieces() takes them.

    A layer's output at t plays its input at t + curve(t) * unit; breaks (keys, at) and holes (keys, a, b) are on its own output axis, where its curve (keys, t, shift) steps and
    where it is silent. Their places on the final timeline are found by `rounds` fixed-point steps through the layers outside it. Nodes closer than
    `guard` to a break or a hole, or in one, go: the lines go on to the cut instead. A break in a hole is none of its own. width: about the distance of breaks, for the join's buckets.
    """
    keys = list(keys)
    place = grid.select(*keys, F.col("t").cast("double").alias("t")).withColumn("_at", F.col("t"))
    places = None

    for curve, breaks, holes in layers:
        ends = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("u")), F.struct(F.lit("b").alias("side"), F.col("b").alias("u"))))
        spans = breaks.select(*keys, F.col("at").cast("double").alias("a"), F.col("at").cast("double").alias("b"), F.lit(False).alias("is_hole"))
        spans = spans.unionByName(holes.select(*keys, F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.lit(True).alias("is_hole")))
        asked = spans.withColumn("_e", F.struct("a", "b", "is_hole")).select(*keys, "_e", ends.alias("_s")).select(*keys, "_e", "_s.side", "_s.u").distinct().withColumn("_t", F.col("u"))
        knots = place.select(*keys, F.col("t").alias("kt"), F.col("_at").alias("kv"))
        for _ in range(rounds if places is not None else 0):  # the outermost layer's axis is the final timeline
            asked = interpolated(asked, knots, keys, "_t", out="_p").withColumn("_t", F.col("u") - (F.col("_p") - F.col("_t"))).drop("_p")
        side = lambda s: F.max(F.when(F.col("side") == s, F.col("_t")))
        found = asked.groupBy(*keys, "_e").agg(side("a").alias("a"), side("b").alias("b")).select(*keys, "a", "b", F.col("_e.is_hole").alias("is_hole"))
        places = found if places is None else places.unionByName(found)
        moved = interpolated(place, curve.select(*keys, F.col("t").alias("kt"), F.col("shift").alias("kv")), keys, "_at", out="_s")
        place = moved.select(*keys, "t", (F.col("_at") + F.coalesce("_s", F.lit(0.0)) * unit).alias("_at"))
    holes = places.filter("is_hole and b > a").select(*keys, "a", "b").distinct()
    breaks = places.filter("not is_hole").select(*keys, F.col("a").alias("at"), F.col("a").alias("_at2")).distinct()
    free = overlap_join(breaks, holes, keys, ("at", "_at2"), ("a", "b"), width).select(*keys, "at").distinct()
    breaks_free = breaks.join(free, [*keys, "at"], "left_anti")
    # a hole and its guard are closed, a break's guard is open at its ends
    near = holes.select(*keys, (F.col("a") - guard).alias("_from"), (F.col("b") + guard).alias("_to"), F.lit(True).alias("_closed"))
    near = near.unionByName(breaks.select(*keys, (F.col("at") - guard).alias("_from"), (F.col("at") + guard).alias("_to"), F.lit(False).alias("_closed")))
    hit = overlap_join(place.select(*keys, "t", F.col("t").alias("_t2")), near, keys, ("t", "_t2"), ("_from", "_to"), width)
    hit = hit.filter("_closed or (t > _from and t < _to)").select(*keys, "t").distinct()
    nodes = place.join(hit, [*keys, "t"], "left_anti").select(*keys, "t", (F.col("_at") - F.col("t")).alias("shift"))
    cuts = holes.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("tc"), F.lit(-1.0).alias("delta"), F.col("a").alias("t_end"), F.col("b").alias("t_nxt"))
    seams = breaks_free.select(*keys, F.col("at").alias("tc"), F.lit(1.0).alias("delta"), F.col("at").alias("t_end"), F.col("at").alias("t_nxt"))
    return nodes, cuts.unionByName(seams)
