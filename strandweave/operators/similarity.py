"""Similarity joins of frame vectors: best match with separation, mutual nearest, within a band, assigned pairs.

Frames come as (series, frame, vec). The searching joins go by blocks: the reference's vectors are packed to
blocks of rows, each query block meets each reference block of its pair by an equi-join, and a task does one block product in
NumPy. What leaves a task is one row a query with its best and what the separation rule needs, never the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.vector import cosine
from strandweave.session import materialised

BLOCK = 2048
#: Ways that a pair's query blocks are dealt for the join, so that no pair is one key.
LANES = 16
#: Bytes of vectors of either side that a task compares.
TILE = 16 << 20


def packed_frames(frames: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(keys, block, frames, vecs, dim): every `block` frame numbers of a series in one row."""
    keys = list(keys)
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        ids = np.ascontiguousarray(t.column("frame").to_numpy(), np.int64)
        x = np.array(t.column("vec").to_pylist(), np.float64)
        row = {k: [t.column(k)[0].as_py()] for k in [*keys, "block"]} | {"frames": [ids.tobytes()], "vecs": [x.tobytes()], "dim": [x.shape[1]]}
        return pa.Table.from_arrays([pa.array(v, t.schema.field(k).type if k in t.schema.names else None) for k, v in row.items()], names=list(row))

    rows = frames.select(*keys, F.floor(F.col("frame") / block).cast("long").alias("block"), F.col("frame").cast("long").alias("frame"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.groupBy(*keys, "block").applyInArrow(pack, f"{kinds}, block long, frames binary, vecs binary, dim long")


def _blocks(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(row[f"{side}_vecs"], np.float64).reshape(-1, row["dim"])
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.frombuffer(row[f"{side}_frames"], np.int64), x / np.where(n > 0, n, 1)


def best_separated(dub: DataFrame, ref: DataFrame, keys: Sequence[str], thin: int = 8, apart: int = 80, least: float = 0.60, margin: float = 0.12, block: int = BLOCK) -> DataFrame:
    """(keys, dub, ref, cos, rest): for every thin-th dub frame its best of every thin-th ref frame, where the cosine exceeds `least` and that of the best one more than `apart` thinned rows away by more than `margin`. Ties go to the earlier frame.

    A block reports its best, and its best outside the zone of each of a few candidates can't be known before all
    blocks are in; so the blocks' bests are merged first, and a second pass over the blocks takes the runner-up.
    """
    keys = list(keys)
    pack = lambda d: packed_frames(d.filter(F.col("frame") % thin == 0).withColumn("frame", F.floor(F.col("frame") / thin)), keys, block)
    d = pack(dub).select(*keys, F.col("block").alias("d_block"), F.col("frames").alias("d_frames"), F.col("vecs").alias("d_vecs"), "dim")
    r = pack(ref).select(*keys, F.col("block").alias("r_block"), F.col("frames").alias("r_frames"), F.col("vecs").alias("r_vecs"))
    kinds = ", ".join(f"{k} {dub.schema[k].dataType.simpleString()}" for k in keys)
    d, r = materialised(d), materialised(r)
    # a pair alone is one key for all its blocks: dub's are dealt to lanes, and ref's go to each lane that is there
    last = d.agg(F.max("d_block")).first()[0]
    lanes = min(LANES, (last or 0) + 1)
    lane = F.pmod("d_block", F.lit(lanes)).cast("int").alias("lane")
    # merged: the planner sees ref's stored size, not the lanes that multiply it, and would broadcast it by way of the driver
    met = d.select("*", lane).join(r.select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")).hint("merge"), [*keys, "lane"]).drop("lane").repartition(*keys, "d_block", "r_block")

    def first(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (di, dx), (ri, rx) = _blocks(row, "d"), _blocks(row, "r")
                c = dx @ rx.T
                k = c.argmax(1)
                cols = [pa.array([row[x]] * len(di), batch.schema.field(x).type) for x in [*keys, "d_block"]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(di), pa.array(ri[k]), pa.array(c[np.arange(len(di)), k])], names=[*keys, "d_block", "dub", "ref", "cos"])

    order = Window.partitionBy(*keys, "dub").orderBy(F.desc("cos"), "ref")
    best = materialised(met.mapInArrow(first, f"{kinds}, d_block long, dub long, ref long, cos double").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r"))
    centres = best.groupBy(*keys, "d_block").agg(F.sort_array(F.collect_list(F.struct("dub", "ref"))).alias("centres"))

    def second(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (di, dx), (ri, rx) = _blocks(row, "d"), _blocks(row, "r")
                c = dx @ rx.T
                centre = np.array([x["ref"] for x in row["centres"]], np.int64)
                c[np.abs(ri[None, :] - centre[:, None]) <= apart] = -1.0
                cols = [pa.array([row[x]] * len(di), batch.schema.field(x).type) for x in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(di), pa.array(c.max(1))], names=[*keys, "dub", "rest"])

    rest = met.join(centres, [*keys, "d_block"]).mapInArrow(second, f"{kinds}, dub long, rest double").groupBy(*keys, "dub").agg(F.max("rest").alias("rest"))
    out = best.join(rest, [*keys, "dub"]).filter((F.col("cos") > least) & (F.col("cos") - F.col("rest") > margin))
    return out.select(*keys, (F.col("dub") * thin).alias("dub"), (F.col("ref") * thin).alias("ref"), "cos", "rest")


def nearest_both(dub: DataFrame, ref: DataFrame, keys: Sequence[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((keys, dub, ref, cos), (keys, ref, dub, cos)): for every frame of each side its best of the other, the earlier of equals.

    Tiles of blocks of one side meet tiles of the other once, and one product serves both ways: what is shuffled is a side's vectors times the other's tiles.
    """
    keys = list(keys)
    d, r = (materialised(packed_frames(x, keys, block)) for x in (dub, ref))
    n = max(x.agg(F.max("dim")).first()[0] or 1 for x in (d, r))
    tile = max(1, TILE // (block * n * 8))
    tiled = lambda x: x.withColumn("_tile", F.floor(F.col("block") / tile))
    tiles = lambda x, name: materialised(tiled(x).groupBy(*keys).agg(F.collect_set("_tile").alias(name)))
    l = tiled(d).join(tiles(r, "_to"), keys).withColumnRenamed("_tile", "_dt").withColumn("_rt", F.explode("_to")).drop("_to", "block")
    m = tiled(r).join(tiles(d, "_to"), keys).withColumnRenamed("_tile", "_rt").withColumn("_dt", F.explode("_to")).drop("_to", "block")
    kinds = ", ".join(f"{k} {dub.schema[k].dataType.simpleString()}" for k in keys)

    def run(a: pa.Table, z: pa.Table) -> pa.Table:
        if not len(a) or not len(z):
            return pa.table({**{k: a.column(k).slice(0, 0) for k in keys}, "back": pa.array([], pa.bool_()), "frame": pa.array([], pa.int64()), "best": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        read = lambda t: sorted((_blocks({f"x_{c}": v for c, v in x.items() if c in ("frames", "vecs")} | {"dim": x["dim"]}, "x") for x in t.to_pylist()), key=lambda b: b[0][0])
        ahead, back = [], {}
        others = read(z)
        for di, dx in read(a):
            best, of = np.full(len(di), -np.inf), np.zeros(len(di), np.int64)
            for k, (ri, rx) in enumerate(others):
                c = dx @ rx.T
                j, i, here = c.argmax(1), c.argmax(0), np.arange(len(di))
                better = c[here, j] > best
                best, of = np.where(better, c[here, j], best), np.where(better, ri[j], of)
                top, by = back.get(k, (np.full(len(ri), -np.inf), np.zeros(len(ri), np.int64)))
                now = c[i, np.arange(len(ri))]
                back[k] = np.where(now > top, now, top), np.where(now > top, di[i], by)
            ahead.append((di, of, best))
        ahead += [(ri, back[k][1], back[k][0]) for k, (ri, _) in enumerate(others)]
        frame, best, cos = (np.concatenate(x) for x in zip(*ahead))
        return pa.table({**{k: pa.array([a.column(k)[0].as_py()] * len(frame), a.schema.field(k).type) for k in keys}, "back": pa.array(np.arange(len(frame)) >= len(frame) - sum(len(ri) for ri, _ in others)), "frame": frame, "best": best, "cos": cos})

    at = [*keys, "_dt", "_rt"]
    met = l.groupBy(*at).cogroup(m.groupBy(*at)).applyInArrow(run, f"{kinds}, back boolean, frame long, best long, cos double")
    order = Window.partitionBy(*keys, "back", "frame").orderBy(F.desc("cos"), "best")
    met = materialised(met.withColumn("_r", F.row_number().over(order)).filter("_r = 1"))
    one = lambda back, a, b: met.filter(F.col("back") == back).select(*keys, F.col("frame").alias(a), F.col("best").alias(b), "cos")
    return one(False, "dub", "ref"), one(True, "ref", "dub")


def orientation(dub: DataFrame, mirrored: DataFrame, ref: DataFrame, keys: Sequence[str], ratio: float = 2.0, **rule) -> DataFrame:
    """(keys, plain, flipped, is_mirrored): numbers of separated matches of dub and of its mirrored form; mirrored if those are more than ratio times as many."""
    keys = list(keys)
    count = lambda d, name: best_separated(d, ref, keys, **rule).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = dub.select(*keys).distinct().join(count(dub, "plain"), keys, "left").join(count(mirrored, "flipped"), keys, "left").fillna(0, ["plain", "flipped"])
    return both.withColumn("is_mirrored", F.col("flipped") > ratio * F.greatest("plain", F.lit(1)))


def band_matches(dub: DataFrame, ref: DataFrame, keys: Sequence[str], offsets: DataFrame, margin: int) -> DataFrame:
    """(keys, dub, ref, cos) of all frames with |ref - (dub + off)| <= margin, off from (keys, dub, off): a range join dealt to buckets of the band's width."""
    keys, width = list(keys), 2 * margin + 1
    d = dub.select(*keys, F.col("frame").alias("dub"), F.col("vec").alias("_dv")).join(offsets, [*keys, "dub"]).withColumn("_c", F.col("dub") + F.col("off"))
    d = d.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_c") - margin) / width), F.floor((F.col("_c") + margin) / width))))
    r = ref.select(*keys, F.col("frame").alias("ref"), F.col("vec").alias("_rv")).withColumn("_b", F.floor(F.col("ref") / width))
    near = d.join(r, [*keys, "_b"]).filter(F.abs(F.col("ref") - F.col("_c")) <= margin)
    return near.select(*keys, "dub", "ref", cosine(F.col("_dv"), F.col("_rv")).alias("cos"))


def assigned_cosine(match: DataFrame, dub: DataFrame, ref: DataFrame, keys: Sequence[str]) -> DataFrame:
    """match (keys, dub, ref) with cos of the two frames; unassigned rows go."""
    keys = list(keys)
    m = match.filter("ref is not null").join(dub.select(*keys, F.col("frame").alias("dub"), F.col("vec").alias("_dv")), [*keys, "dub"])
    m = m.join(ref.select(*keys, F.col("frame").alias("ref"), F.col("vec").alias("_rv")), [*keys, "ref"])
    return m.withColumn("cos", cosine(F.col("_dv"), F.col("_rv"))).drop("_dv", "_rv")


def mutual_nearest(forward: DataFrame, backward: DataFrame, keys: Sequence[str], within: float) -> DataFrame:
    """Forward bests (keys, dub, ref, cos) whose ref's own best (keys, ref, dub) lies at most `within` from where it came."""
    keys = list(keys)
    b = backward.select(*keys, "ref", F.col("dub").alias("_back"))
    return forward.join(b, [*keys, "ref"]).filter(F.abs(F.col("_back") - F.col("dub")) <= within).drop("_back")
