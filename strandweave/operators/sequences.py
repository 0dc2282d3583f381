"""Sequence operators: recurrences run in Arrow-backed groups, one group a series or, where the work is large, a chunk.

Everything that a join, a window or an aggregate can say is said with those; only the recurrence itself is in the group's
function, on the arrays of one series (the short post-passes) or of one chunk of it (the alignments), so a long
pair is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators import kernels as K
from strandweave.operators.intervals import interpolated
from strandweave.operators.similarity import assigned_cosine, best_separated
from strandweave.operators.windows import chain_density
from strandweave.session import materialised


def by_series(df: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f on each series, which gets its rows sorted by their first column besides the keys; keys are put before its result."""
    keys = list(keys)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    order = next(c for c in df.columns if c not in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[keys].iloc[0].tolist()
        out = f(pdf.sort_values(order, kind="stable", ignore_index=True))
        for i, (k, v) in enumerate(zip(keys, own)):
            out.insert(i, k, v)
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def monotone_chain(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, dub, ref) of a longest chain of matches (dub, ref) whose ref doesn't decrease; of matches of one dub the first counts."""
    first = Window.partitionBy(*keys, "dub").orderBy("ref")
    one = pairs.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("dub", "ref", *keys)
    return by_series(one, keys, lambda p: p.iloc[K.longest_chain(p["ref"].to_numpy())][["dub", "ref"]].reset_index(drop=True), "dub long, ref long")


def coarse_offsets(dub: DataFrame, ref: DataFrame, keys: Sequence[str], least: int = 5, **rule) -> DataFrame:
    """(keys, dub, off): for each dub frame the offset to ref of the longest chain of separated matches, interpolated and cut to a whole number; 0 for pairs with fewer than `least`."""
    return chain_offsets(monotone_chain(best_separated(dub, ref, keys, **rule).select(*keys, "dub", "ref"), keys), dub, keys, least)


def chain_offsets(chain: DataFrame, dub: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """coarse_offsets of a chain (keys, dub, ref) that is there."""
    enough = chain.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    knots = chain.join(enough, list(keys)).select(*keys, F.col("dub").alias("kt"), (F.col("ref") - F.col("dub")).alias("kv"))
    got = interpolated(dub.select(*keys, F.col("frame").alias("dub")), knots, keys, "dub", out="off")
    return got.select(*keys, "dub", F.coalesce(F.col("off"), F.lit(0.0)).cast("long").alias("off"))


def windowed_chain(pairs: DataFrame, keys: Sequence[str], window: int = 8000, overlap: int = 2000, reach: int = 4000) -> DataFrame:
    """(keys, dub, ref): as monotone_chain, over windows of dub frames in which only refs within `reach` of the offset carried from the window before count."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        d, r = p["dub"].to_numpy(), p["ref"].to_numpy()
        seed, taken, step = None, {}, window - overlap
        # the windows that hold a row, whatever the numbers; those from below 0 on begin at 0
        low = np.maximum(0, -((window - 1 - d) // step))
        held = np.unique(np.concatenate([low + k for k in range(-(-window // step))])) if len(d) else low
        for a in (held[held * step <= d.max()] * step).tolist():
            m = (d >= a) & (d < a + window)
            if seed is not None:
                m &= np.abs(r - d - seed) <= reach
            if not m.any():
                continue
            at = np.flatnonzero(m)
            chain = at[K.longest_chain(r[at])]
            seed = float(np.median((r - d)[chain]))
            for i in chain.tolist():
                taken.setdefault(int(d[i]), int(r[i]))
        dd = np.array(sorted(taken), np.int64)
        rr = np.array([taken[x] for x in dd.tolist()], np.int64)
        keep = K.longest_chain(rr)
        return pd.DataFrame({"dub": dd[keep], "ref": rr[keep]})

    return by_series(pairs.select("dub", "ref", *keys), keys, run, "dub long, ref long")


def align_chunks(dub: DataFrame, ref: DataFrame, offsets: DataFrame, keys: Sequence[str], protected: DataFrame | None = None, chunk: int = 4000, overlap: int = 700, margin: int = 120,
                 costs: tuple[float, float, float] = (0.20, 0.02, 0.30), threshold: float | None = 0.30, flat: float | None = None, amerce: float = 0.0, least_rows: int = 50,
                 prior: tuple[float, float, float, int] | None = None, cosines: bool = False) -> DataFrame:
    """(keys, dub, ref): the ref frame of each dub frame; null where dropped; frames in chunks of fewer than least_rows ref rows are left out.

    Chunks of dub frames, overlapping, are aligned each to the ref frames between the least and the largest of the draft line (offsets)
    less and plus `margin`; a chunk is a group of its own. Where chunks overlap, the one whose
    edge is further away decides, the earlier of equals. costs: opening and extending a drop of ref, dropping dub; flat: one cost for both instead.
    prior (strength, low, high, frames): costs less each dub frame's least, and more the further a ref frame is from the draft line, as far as the best match, smoothed over so many
    dub frames of the chunk, falls from high to low: a path stays on the line where nothing matches, and is free where something does.
    cosines: with cos of the two frames. Vectors are shuffled once, to their chunks; all else goes by frames' numbers.
    """
    keys, step = list(keys), chunk - overlap
    columns = [*keys, "chunk"]
    lines = dub.select(*keys, F.col("frame").alias("dub")).join(offsets.select(*keys, "dub", F.col("off").cast("long").alias("off")), [*keys, "dub"])
    if protected is not None:
        lines = lines.join(protected.select(*keys, F.col("i").alias("dub"), "protected"), [*keys, "dub"], "left")
    else:
        lines = lines.withColumn("protected", F.lit(False))
    lines = materialised(lines)
    low = F.greatest(F.lit(0), F.floor((F.col("dub") - chunk) / step) + 1)
    in_chunks = F.explode(F.sequence(low, F.greatest(low, F.floor(F.col("dub") / step)))).alias("chunk")
    last = lines.groupBy(*keys).agg(F.max("dub").alias("_last"))
    each = lines.select("*", in_chunks).join(last, keys).filter((F.col("chunk") == 0) | (F.col("chunk") * step + overlap <= F.col("_last")))
    # a row a chunk, stored so that the planner sees how small it is
    reach = materialised(each.groupBy(*columns).agg(F.min(F.col("dub") + F.col("off")).alias("_lo"), F.max(F.col("dub") + F.col("off")).alias("_hi"), F.max("_last").alias("_last")))
    width = chunk + 2 * margin
    spans = reach.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_lo") - margin) / width), F.floor((F.col("_hi") + margin) / width))))
    r = ref.select(*keys, F.col("frame").alias("_f"), F.col("vec").alias("_v"), F.floor(F.col("frame") / width).alias("_b"))
    r = r.join(spans, [*keys, "_b"]).filter((F.col("_f") >= F.col("_lo") - margin) & (F.col("_f") <= F.col("_hi") + margin))
    d = dub.select(*keys, F.col("frame").alias("dub"), F.col("vec").alias("_v")).select("*", in_chunks).join(reach.select(*columns), columns)
    kinds = ", ".join(f"{k} {dub.schema[k].dataType.simpleString()}" for k in keys)
    none, zero, vec = F.lit(None).cast("array<double>").alias("_v"), F.lit(0).cast("long"), F.col("_v").cast("array<double>").alias("_v")
    side = lambda x, n, f, v, p=F.lit(False), o=zero, e=zero: x.select(*columns, F.lit(n).alias("_side"), F.col(f).cast("long").alias("_f"), v, p.alias("_p"), o.alias("_o"), e.cast("long").alias("_last"))
    both = side(d, 0, "dub", vec).unionByName(side(r, 1, "_f", vec))
    both = both.unionByName(side(each, 2, "dub", none, F.coalesce("protected", F.lit(False)), F.col("off"), F.col("_last")))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        own = {k: p[k].iloc[0] for k in keys}
        c = int(p["chunk"].iloc[0])
        side = p["_side"].to_numpy()
        q, rows, vectors = p[side == 2].sort_values("_f"), p[side == 1].sort_values("_f"), p[side == 0].sort_values("_f")
        empty = pd.DataFrame({**{k: pd.Series([], dtype=p[k].dtype) for k in keys}, "chunk": pd.Series([], dtype="int64"), "dub": pd.Series([], dtype="int64"), "ref": pd.Series([], dtype="Int64"), "depth": pd.Series([], dtype="int64"), "cos": pd.Series([], dtype="float64")})
        if len(rows) < least_rows or not len(q):
            return empty
        x, f = np.stack(rows["_v"]), q["_f"].to_numpy()
        y = np.stack(vectors["_v"])[np.searchsorted(vectors["_f"].to_numpy(), f)]  # the frames that have a draft line
        guard = q["_p"].to_numpy(bool)
        edge = c == 0 or int(f[-1]) == int(q["_last"].iloc[0])
        out = chunk_path(c, rows["_f"].to_numpy(), x, f, y, q["_o"].to_numpy(), costs, threshold, amerce, prior, flat, guard if edge and guard.any() else None, cosines)
        for i, k in enumerate(keys):
            out.insert(i, k, own[k])
        return out

    got = both.groupBy(*columns).applyInPandas(run, f"{kinds}, chunk long, dub long, ref long, depth long, cos double")
    best = Window.partitionBy(*keys, "dub").orderBy(F.desc("depth"), "chunk")
    return got.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*keys, "dub", "ref", *(["cos"] if cosines else []))


def chunk_path(c: int, frames: np.ndarray, x: np.ndarray, f: np.ndarray, y: np.ndarray, off: np.ndarray, costs: tuple, threshold: float | None, amerce: float, prior: tuple | None, flat: float | None = None, guard: np.ndarray | None = None, cosines: bool = True) -> pd.DataFrame:
    """(chunk, dub, ref, depth, cos) of chunk c: the path of dub's frames f (vectors y, draft line f + off) through ref's frames (vectors x)."""
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    cost = 1 - unit(x) @ unit(y).T
    if prior is not None:
        cost = K.with_prior(cost, frames[:, None] - (f + off)[None, :], *prior)
    got = K.flat_path(K.flat_alignment(cost, flat)) if flat is not None else K.path(K.drop_alignment(cost, *costs, threshold, guard, amerce, c == 0))
    out = pd.DataFrame({"chunk": c, "dub": f, "ref": pd.array(np.where(got >= 0, frames[np.maximum(got, 0)], 0), dtype="Int64").copy(), "depth": np.minimum(f - f[0], f[-1] - f), "cos": K.cosines(y, x[np.maximum(got, 0)]) if cosines else np.nan})
    out.loc[got < 0, "cos"] = np.nan
    out.loc[got < 0, "ref"] = pd.NA
    return out


#: Dub vectors that a task of align_described makes for its chunks.
GROUP = 8192


def align_described(dub: DataFrame, ref: DataFrame, lines: DataFrame, given: DataFrame, keys: Sequence[str], half: int, apart: int, describe: Callable, chunk: int, overlap: int, margin: int,
                    costs: tuple[float, float, float], threshold: float | None, amerce: float = 0.0, prior: tuple[float, float, float, int] | None = None, least_rows: int = 50) -> DataFrame:
    """(keys, dub, ref, cos): align_chunks of vectors number k, each made of the frames (keys, frame, bands) from k * apart to k * apart + 2 * half, on the draft line lines (keys, dub, off).

    Vectors are made where they are used, by describe(frames, bands, numbers, the series' row of given (keys, last, ...)) -> (numbers that are there, vectors); last is ref's last number. Frames are smaller, and go to the one or two groups
    of neighbouring chunks that use them, packed.
    """
    keys, step = list(keys), chunk - overlap
    at, per = [*keys, "_g"], max(1, GROUP // step)
    lines = materialised(lines.select(*keys, "dub", F.col("off").cast("long").alias("off")))
    low = F.greatest(F.lit(0), F.floor((F.col("dub") - chunk) / step) + 1)
    last = lines.groupBy(*keys).agg(F.max("dub").alias("_last"))
    each = lines.select("*", F.explode(F.sequence(low, F.greatest(low, F.floor(F.col("dub") / step)))).alias("chunk")).join(last, keys).filter((F.col("chunk") == 0) | (F.col("chunk") * step + overlap <= F.col("_last")))
    each = each.withColumn("_g", F.floor(F.col("chunk") / per))
    c = F.col("dub") + F.col("off")
    # a row a group, stored so that the planner sees how small it is
    groups = materialised(each.groupBy(*at).agg(F.min("dub").alias("_d0"), F.max("dub").alias("_d1"), (F.min(c) - margin).alias("_r0"), (F.max(c) + margin).alias("_r1")))
    width = GROUP * apart

    def packed(frames: DataFrame, n: int, a: str, z: str) -> DataFrame:
        """(keys, _g, _side, _f, _x): frames' numbers and bands as bytes, a row for those of one group that a batch holds."""
        spans = groups.select(*at, (F.col(a) * apart).alias("_a"), (F.col(z) * apart + 2 * half).alias("_z"))
        spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_z") / width))))
        f = frames.select(*keys, F.col("frame").cast("long").alias("frame"), F.col("bands").cast("array<double>").alias("bands"), F.floor(F.col("frame") / width).alias("_b"))
        f = f.join(spans, [*keys, "_b"]).filter(F.col("frame").between(F.col("_a"), F.col("_z"))).select(*at, "frame", "bands")
        kinds = ", ".join(f"{k} {f.schema[k].dataType.simpleString()}" for k in at)

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                t = pa.Table.from_batches([batch])
                group = t.select(at).to_pandas().groupby(at, dropna=False, sort=False).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
                number = t.column("frame").to_numpy()[order]
                x = t.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
                parts = [slice(i, j) for i, j in zip(first, [*first[1:], len(order)])]
                # a band after another: like follows like
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(order[first])) for k in at), pa.array([n] * len(parts), pa.int32()), pa.array([number[p].tobytes() for p in parts], pa.binary()), pa.array([x[p].T.tobytes() for p in parts], pa.binary())], names=[*at, "_side", "_f", "_x"])

        return f.mapInArrow(run, f"{kinds}, _side int, _f binary, _x binary")

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    what = F.struct(*(k for k in given.columns if k not in keys)).alias("_given")
    whole = given.select(*keys, what)
    frames = packed(dub, 0, "_d0", "_d1").unionByName(packed(ref, 1, "_r0", "_r1")).select("*", null("long", "chunk"), null("long", "dub"), null("long", "off"), null(whole.schema["_given"].dataType, "_given"))
    rest = lambda x, n, *more: x.select(*at, F.lit(n).alias("_side"), null("binary", "_f"), null("binary", "_x"), *more)
    both = frames.unionByName(rest(each, 2, "chunk", "dub", "off", null(whole.schema["_given"].dataType, "_given")))
    both = both.unionByName(rest(groups.join(whole, keys), 3, null("long", "chunk"), null("long", "dub"), null("long", "off"), "_given"))
    kinds = ", ".join(f"{k} {dub.schema[k].dataType.simpleString()}" for k in keys)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        side = p["_side"].to_numpy()
        q, about = p[side == 2].sort_values(["chunk", "dub"]), p["_given"][side == 3]
        done = [pd.DataFrame({"chunk": pd.Series([], dtype="int64"), "dub": pd.Series([], dtype="int64"), "ref": pd.Series([], dtype="Int64"), "depth": pd.Series([], dtype="int64"), "cos": pd.Series([], dtype="float64")})]
        if len(q) and len(about):

            def vectors(s: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                mine = p[side == s]
                f = [np.frombuffer(x, np.int64) for x in mine["_f"]]
                if not f:
                    return numbers[:0], np.empty((0, 0))
                x = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, len(n)).T for x, n in zip(mine["_x"], f)])
                f = np.concatenate(f)
                order = np.argsort(f, kind="stable")
                return describe(f[order], x[order], numbers, about.iloc[0])

            q = q.astype({"chunk": "int64", "dub": "int64", "off": "int64"})
            drawn = (q["dub"] + q["off"]).to_numpy()
            df_, d = vectors(0, np.unique(q["dub"].to_numpy()))
            rf, r = vectors(1, np.arange(max(0, drawn.min() - margin), min(drawn.max() + margin, about.iloc[0]["last"]) + 1))
            for c, own in q.groupby("chunk", sort=True):
                f, off = own["dub"].to_numpy(), own["off"].to_numpy()
                near = slice(*np.searchsorted(rf, ((f + off).min() - margin, (f + off).max() + margin + 1)))
                if len(rf[near]) >= least_rows:
                    done.append(chunk_path(int(c), rf[near], r[near], f, d[np.searchsorted(df_, f)], off, costs, threshold, amerce, prior))
        out = pd.concat(done[1:] or done)
        for i, k in enumerate(keys):
            out.insert(i, k, p[k].iloc[0])
        return out

    got = both.groupBy(*at).applyInPandas(run, f"{kinds}, chunk long, dub long, ref long, depth long, cos double")
    best = Window.partitionBy(*keys, "dub").orderBy(F.desc("depth"), "chunk")
    return got.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*keys, "dub", "ref", "cos")


def align(dub: DataFrame, ref: DataFrame, keys: Sequence[str], thin: int = 8, **how) -> DataFrame:
    """(keys, dub, ref, cos) of whole pairs: coarse offsets, chain density as protection, then align_chunks; cos is null where dropped."""
    chain = materialised(monotone_chain(best_separated(dub, ref, keys, thin=thin).select(*keys, "dub", "ref"), keys))
    off = chain_offsets(chain, dub, keys)
    dense = chain_density(chain.select(*keys, F.col("dub").alias("i"), (F.col("ref") - F.col("dub")).alias("off")), dub.select(*keys, F.col("frame").alias("i")), keys)
    match = materialised(align_chunks(dub, ref, off, keys, dense, **how))
    cos = assigned_cosine(match, dub, ref, keys).select(*keys, "dub", "cos")
    return match.join(cos, [*keys, "dub"], "left")


def tv_levels(df: DataFrame, keys: Sequence[str], strength: float = 1800.0) -> DataFrame:
    """(keys, t, o, level): o and its total-variation baseline, in order of t."""
    rows = df.select("t", "o", *keys)
    return by_series(rows, keys, lambda p: pd.DataFrame({"t": p["t"], "o": p["o"], "level": K.total_variation(p["o"].to_numpy(float), strength)}), "t double, o double, level double")


def cut_boundaries(df: DataFrame, keys: Sequence[str], strength: float = 1800.0, step: float = 8.0, outlier: float = 12.0, slope: float = 0.45, jitter: float = 6.0, confident: float = 0.5, jump: float = 0.5) -> DataFrame:
    """(keys, tc, delta, t_end, t_nxt): where the level of confident anchors (t, o detrended, w) steps by more than `step`.

    The baseline only says where segments end; a segment's level is the median of its own anchors without outliers, and
    a boundary counts if, within two anchors of it, one jump is sharper than slope and jitter allow.
    """
    base = tv_levels(df.filter(F.col("w") >= confident), keys, strength)
    order = Window.partitionBy(*keys).orderBy("t")
    new = F.coalesce((F.abs(F.col("level") - F.lag("level").over(order)) > jump).cast("int"), F.lit(0))
    rows = base.withColumn("_i", F.row_number().over(order)).withColumn("_seg", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rise = F.abs(F.lead("o").over(order) - F.col("o")) > slope * (F.lead("t").over(order) - F.col("t")) + jitter
    near = order.rowsBetween(-2, 2)
    rows = rows.withColumn("_sharp0", F.coalesce(rise, F.lit(False))).withColumn("_sharp", F.max("_sharp0").over(near)).withColumn("t_nxt", F.lead("t").over(order))
    middle = rows.groupBy(*keys, "_seg").agg(F.percentile("o", 0.5).alias("_mid"))
    rows = rows.join(middle, [*keys, "_seg"])
    kept = F.when(F.abs(F.col("o") - F.col("_mid")) <= outlier, F.col("o"))
    segs = rows.groupBy(*keys, "_seg").agg(F.coalesce(F.percentile(kept, 0.5), F.max("_mid")).alias("_level"), F.max("t").alias("t_end"), F.max_by("t_nxt", "t").alias("t_nxt"), F.max_by("_sharp", "t").alias("_sharp"))
    by = Window.partitionBy(*keys).orderBy("_seg")
    cuts = segs.withColumn("delta", F.lead("_level").over(by) - F.col("_level")).filter((F.abs("delta") > step) & F.col("_sharp"))
    return cuts.select(*keys, ((F.col("t_end") + F.col("t_nxt")) / 2).alias("tc"), "delta", "t_end", "t_nxt")


def fitted_curve(df: DataFrame, cuts: DataFrame, keys: Sequence[str], slope: float = 0.45, fits: float = 8.0, tolerance: float = 3.0, smooth: int = 8, confident: float = 0.5, outlier: float = 12.0) -> DataFrame:
    """(keys, t, curve): between cuts a robust line where it fits the confident anchors (90th percentile of residuals at most `fits`), else a polyline over their moving weighted medians. Each stretch is a group."""
    keys = list(keys)
    marks = cuts.select(*keys, F.col("tc").alias("t"), F.lit(1).alias("_c"), F.lit(0.0).alias("o"), F.lit(0.0).alias("w"))
    every = df.select(*keys, "t", F.lit(0).alias("_c"), F.col("o").cast("double").alias("o"), F.col("w").cast("double").alias("w")).unionByName(marks)
    order = Window.partitionBy(*keys).orderBy("t", F.desc("_c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a node at a cut belongs to the stretch before it
    stretch = F.sum("_c").over(order) - F.when(F.max(F.when(F.col("_c") == 1, F.col("t"))).over(order) == F.col("t"), 1).otherwise(0)
    rows = every.withColumn("stretch", stretch).filter("_c = 0").select("t", "o", "w", "stretch", *keys)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        t, o, w = (p[c].to_numpy(float) for c in "tow")
        good = w >= confident
        if good.any():
            good &= np.abs(o - np.median(o[good])) <= outlier
        if good.sum() < 2:
            return pd.DataFrame({"t": t, "curve": np.zeros(len(t))})
        tt, yy, ww = t[good], o[good], w[good]
        thin = np.arange(0, len(tt), max(1, len(tt) // 20))
        i, j = np.triu_indices(len(thin), 1)
        apart = tt[thin[j]] - tt[thin[i]]
        rises = ((yy[thin[j]] - yy[thin[i]])[apart > 1]) / apart[apart > 1]
        a = float(np.clip(np.median(rises) if len(rises) else 0.0, -slope, slope))
        b = float(np.median(yy - a * tt))
        if np.percentile(np.abs(yy - a * tt - b), 90) <= fits:
            return pd.DataFrame({"t": t, "curve": a * t + b})
        half = max(1, smooth // 2)
        level = np.array([K.weighted_median(yy[max(0, k - half) : k + half + 1], np.maximum(ww[max(0, k - half) : k + half + 1], 1e-6)) for k in range(len(yy))])
        keep = K.polyline(tt, level, tolerance)
        return pd.DataFrame({"t": t, "curve": np.interp(t, tt[keep], level[keep])})

    return by_series(rows, [*keys, "stretch"], run, "t double, curve double").drop("stretch")


def segmented(df: DataFrame, keys: Sequence[str], penalty: float = 700.0, least: int = 40, power: float = 3.0, slope: float = 0.3) -> DataFrame:
    """(keys, seg, t_lo, t_hi, a, b): the optimal partition of (t, o, w) into weighted lines (weights to `power`), slopes clipped."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        t, o, w = p["t"].to_numpy(float), p["o"].to_numpy(float), p["w"].to_numpy(float) ** power
        rows = []
        for k, (i, j) in enumerate(K.segments(t, o, w, penalty, least)):
            s, tm = w[i:j].sum(), np.average(t[i:j], weights=w[i:j]) if w[i:j].sum() > 0 else t[i:j].mean()
            var = (w[i:j] * (t[i:j] - tm) ** 2).sum()
            a = float(np.clip((w[i:j] * (t[i:j] - tm) * o[i:j]).sum() / var, -slope, slope)) if var > 1e-12 else 0.0
            b = float((w[i:j] * o[i:j]).sum() / s - a * tm) if s > 0 else 0.0
            rows.append((k, t[i], t[j - 1], a, b))
        return pd.DataFrame(rows, columns=["seg", "t_lo", "t_hi", "a", "b"])

    return by_series(df.select("t", "o", "w", *keys), keys, run, "seg long, t_lo double, t_hi double, a double, b double")


def line_steps(lines: DataFrame, keys: Sequence[str], least: float = 3.0) -> DataFrame:
    """(keys, tc, v): steps of at least `least` between neighbouring lines at the middle of their gap."""
    order = Window.partitionBy(*keys).orderBy("seg")
    n = {c: F.lead(c).over(order) for c in ("t_lo", "a", "b")}
    tc = (F.col("t_hi") + n["t_lo"]) / 2
    return lines.select(*keys, tc.alias("tc"), (n["a"] * tc + n["b"] - F.col("a") * tc - F.col("b")).alias("v")).filter(F.abs("v") >= least)


def warp_cuts(lines: DataFrame, keys: Sequence[str], least: float = 3.0, apart: float = 15.0) -> DataFrame:
    """(keys, tc, v): line_steps, of those nearer than `apart` the larger."""
    return merge_cuts(line_steps(lines, keys, least), keys, apart)


def merge_cuts(cuts: DataFrame, keys: Sequence[str], apart: float = 15.0) -> DataFrame:
    """Cuts (keys, tc, v) of which, one after another, those nearer than `apart` to the last kept give way to the larger."""
    return by_series(cuts.select("tc", "v", *keys), keys, lambda p: p.iloc[K.merged_cuts(p["tc"].to_numpy(), p["v"].to_numpy(), apart)][["tc", "v"]].reset_index(drop=True), "tc double, v double")


def simplified(df: DataFrame, keys: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """(keys, t, o): the vertices of a polyline within `tolerance` of every row."""
    return by_series(df.select("t", "o", *keys), keys, lambda p: p.iloc[K.polyline(p["t"].to_numpy(float), p["o"].to_numpy(float), tolerance)][["t", "o"]].reset_index(drop=True), "t double, o double")


def plateaus(lags: DataFrame, keys: Sequence[str], agree: float = 1.5, span: float = 40.0, join: float = 2.5, half: float = 20.0) -> DataFrame:
    """(keys, t0, t1, lag, n, conf) of windows (t, lag, conf) around t: runs whose lags agree with the run's own weighted median, neighbours with lags within `join` joined.

    Windows without a finite lag or confidence belong to none. A run counts if the centres of its first and its last window are `span` apart, so that the two share no sound.
    A series' windows, some every few seconds, are one group: each is judged by the median of those before it.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p[np.isfinite(p["lag"].to_numpy(float)) & (p["conf"].to_numpy(float) > 0)]
        t, lag, conf = (p[c].to_numpy(float) for c in ("t", "lag", "conf"))
        middle = lambda r: K.weighted_median(lag[r], conf[r])
        runs: list[list[int]] = []
        so_far = K.RunningMedian(lag, conf)
        for i in range(len(t)):
            if runs and abs(lag[i] - so_far.median()) <= agree:
                runs[-1].append(i)
            else:
                runs.append([i])
                so_far.clear()
            so_far.add(i)
        joined: list[list[int]] = []
        for r in runs:
            if t[r[-1]] - t[r[0]] < span:
                continue
            if joined and abs(middle(r) - middle(joined[-1])) <= join:
                joined[-1] += r
            else:
                joined.append(list(r))
        rows = [(t[r[0]] - half, t[r[-1]] + half, middle(r), len(r), conf[r].sum()) for r in joined]
        return pd.DataFrame(rows, columns=["t0", "t1", "lag", "n", "conf"])

    return by_series(lags.select("t", "lag", "conf", *keys), keys, run, "t0 double, t1 double, lag double, n long, conf double")
