"""Operator 11: hard negatives, by a distributed join over Voronoi cells.

The largest inner product is the smallest distance once each row has a component more that makes all rows equally long and anchors have 0 there
(lengths are in units of the longest row's). A bounded sample of rows gives the pivots; each row belongs to the cell of its nearest one, and is packed with
others of its cell, at about its distance from the pivot, in blocks of bounded size: a cell that a third of all rows share is many blocks.

What is wanted of an anchor is a slot: the first k rows of its label (or of others) with a score from `low` to `high`. Anchors are grouped by their nearest home, some of
the pivots, so many that a group is full. The sample's rows, then the blocks of the cells around its own home give each slot a score that k rows reach, so that every further
row must be within a shell of distances; by the triangle inequality that is, for each cell, a range of distances from its pivot. Blocks that overlap the
range of a group's slots are sent to it, no others, and joined exactly there, a bounded number of blocks a task; the tasks' first k are merged.

Rows with a null id, label, vector or component, with a non-finite component, or as long as 2^31 after scaling (their scores needn't fit
a long) take no part. Rows of another dimension than the anchor's aren't compared with it. Repeated rows are candidates each, but none of an anchor's own
id; of anchors that share an id the one of the smallest label, then vector, is served. Ties go to the smaller vec_id. Zero vectors take part. An empty
table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import stored, table

#: Bounds: rows and bytes of the sample, its rows that are pivots, bytes of a block's vectors, slots of a group, blocks that a task joins.
SAMPLE_ROWS, SAMPLE_BYTES, PIVOTS, BLOCK_BYTES, GROUP_SLOTS, TASK_BLOCKS = 2048, 16 << 20, 256, 1 << 20, 512, 64
#: Width of a ring of distances in a cell, and what rounding may add to a distance; distances are from 0 to 2.
RING, SLIP = 0.125, 1e-6
NONE, TOP = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BLOCK = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
_GROUP = pa.schema([("dim", pa.int32()), ("home", pa.int32()), ("sub", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("slots", pa.binary())])


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, dim) of the rows that take part: v is floor(scale * x) of each component, as doubles."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter("vec_id is not null and label is not null and e is not null").filter(f"forall(e, x -> x is not null and not isnan(x) and abs({scale} * x) < 2147483647D)")
    rows = rows.withColumn("v", F.transform("e", lambda x: F.floor(x * scale).cast("double")))
    return rows.filter("aggregate(v, 0D, (a, x) -> a + x * x) < 4.6e18").select("vec_id", "label", "v", F.size("v").alias("dim"))


@dataclass
class Space:
    """What tasks know of the rows of a dimension: the longest row's length, the pivots (lengthened), the sample (in order of ids)."""

    longest: float
    pivots: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    homes: int = 1  # the first so many pivots

    def home_of(self, to_pivots: np.ndarray) -> np.ndarray:
        return to_pivots[:, : self.homes].argmin(1).astype(np.int32)

    def lengthened(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        u = v / self.longest
        more = np.zeros(len(u)) if anchors else np.sqrt(np.maximum(0, 1 - (u * u).sum(1)))
        return np.column_stack([u, more])

    def to_pivots(self, u: np.ndarray) -> np.ndarray:
        d2 = (u * u).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * u @ self.pivots.T
        return np.sqrt(np.maximum(0, d2))

    def distance(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of an anchor (its length squared, in units) from rows of such a score."""
        with np.errstate(over="ignore", invalid="ignore"):
            d2 = norm2 + 1 - 2 * np.where(score == NONE, -np.inf, score / self.longest / self.longest)
        return np.sqrt(np.maximum(0, d2))


def spaces(rows: DataFrame, pivots: int, sample_rows: int) -> dict[int, Space]:
    """A Space for each dimension. The sample is of rows with the smallest hashes of id and vector; dimensions that it misses have one pivot, the origin."""
    stats = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("norm2")).collect()}
    if not stats:
        return {}
    n, widest = sum(r["n"] for r in stats.values()), max(1, *stats)
    take = max(16, min(sample_rows, SAMPLE_BYTES // (8 * widest)))
    h = F.xxhash64("vec_id", "v", F.lit(7))
    some = rows.filter(F.pmod(h, F.lit(max(1, n // (4 * take)))) == 0).orderBy(h, "vec_id", "label").limit(take).collect()
    out = {}
    for dim, r in stats.items():
        own = sorted((x for x in some if x["dim"] == dim), key=lambda x: x["vec_id"])
        space = Space(max(1.0, float(np.sqrt(r["norm2"])) * (1 + 1e-12)), np.zeros((1, dim + 1)), *(np.array([x[c] for x in own], np.int64) for c in ("vec_id", "label")), np.array([x["v"] for x in own], np.float64).reshape(len(own), dim))
        first = np.sort(np.unique(space.v, axis=0, return_index=True)[1])
        few = first[np.random.default_rng(dim).permutation(len(first))][: max(1, min(pivots, int(np.sqrt(r["n"]) / 2)))]
        if len(few):
            space.pivots = space.lengthened(space.v[few], False)
        out[dim] = space
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def packed_rows(t: pa.Table, dim: int, names: list[str]) -> list[bytes]:
    """Columns of longs, then the vectors as 32-bit numbers, as bytes."""
    v = t.column("v").combine_chunks()
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return [*(np.ascontiguousarray(t.column(c).to_numpy(), np.int64).tobytes() for c in names), matrix(v, dim).astype(np.int32).tobytes()]


def blocks_of(rows: DataFrame, known: Broadcast, block_bytes: int) -> DataFrame:
    """The rows, packed by cell, ring and, where those hold more than a block, a hash of the id."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in b.column("dim").unique().to_pylist():
                part = b.filter(pc.equal(b.column("dim"), dim))
                space = known.value[dim]
                for lo in range(0, part.num_rows, 4096):
                    own = part.slice(lo, 4096)
                    d = space.to_pivots(space.lengthened(matrix(own.column("v"), dim), False))
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("dim", "vec_id", "label", "v")), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["dim", "vec_id", "label", "v", "cell", "r"])

    placed = stored(rows.mapInArrow(assign, "dim int, vec_id long, label long, v array<double>, cell int, r double").withColumn("ring", F.floor(F.col("r") / RING).cast("int")), "negatives-cells")
    # a row a cell and ring: at most PIVOTS times 17 for each dimension
    held = placed.groupBy("dim", "cell", "ring").agg(F.count(F.lit(1)).alias("n"))
    salts = held.withColumn("salts", F.ceil(F.col("n") * F.col("dim") * 4 / block_bytes)).withColumn("salts", F.greatest("salts", F.lit(1)))
    salted = placed.join(F.broadcast(salts.drop("n")), ["dim", "cell", "ring"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        dim, cell, ring, salt = (k.as_py() for k in key)
        r = t.column("r").to_numpy()
        row = [dim, cell, (cell * 64 + ring) << 32 | salt, float(r.min()), float(r.max()), *packed_rows(t, dim, ["vec_id", "label"])]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

    packed = salted.groupBy("dim", "cell", "ring", "salt").applyInArrow(pack, "dim int, cell int, block long, near double, far double, ids binary, labels binary, vectors binary")
    return stored(packed, "negatives-blocks")


class Best:
    """The first k of each slot: highest scores, then smallest ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.score, self.id = k, np.full((slots, k), NONE), np.full((slots, k), TOP)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a column for each of ids, which ascend; NONE where a row isn't one for the slot."""
        who = np.flatnonzero(((scores >= self.score[:, -1:]) & (scores > NONE)).any(1))
        if not len(who):
            return
        s, k = scores[who], min(self.k, len(ids))
        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]
        over, same = s > least, s == least
        mask = over | (same & (same.cumsum(1) <= k - over.sum(1)[:, None]))  # k of each
        at = np.nonzero(mask)[1].reshape(len(who), k)
        all_s = np.concatenate([self.score[who], np.take_along_axis(s, at, 1)], 1)
        all_i = np.concatenate([self.id[who], ids[at]], 1)
        all_i[all_s == NONE] = TOP
        first = np.lexsort((all_i, ~all_s), axis=1)[:, : self.k]  # ~x is -x-1, defined for all longs
        self.score[who], self.id[who] = np.take_along_axis(all_s, first, 1), np.take_along_axis(all_i, first, 1)


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs."""
    if len(q) and len(x) and np.sqrt((q * q).sum(1).max()) * np.sqrt((x * x).sum(1).max()) < 2.0**52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T  # sums wrap on the way, but end within a long


class Slots:
    """A group's slots, opened."""

    def __init__(self, dim: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.tag, self.low, self.high = ids, labels, tag, low, high
        at, self.of = np.unique(ids, return_index=True)[1], np.unique(ids, return_inverse=True)[1].ravel()
        self.v = v[at]

    def scores(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool) -> np.ndarray:
        s = scores_of(self.v, x)[self.of]
        fits = (s >= self.low[:, None]) & (s <= self.high[:, None]) & ((self.labels[:, None] == labels) == same) & (self.ids[:, None] != ids)
        return np.where(fits, s, NONE)


_SLOTS_SQL = "dim int, anchor_id long, tag long, label long, v array<double>, low long, high long, home int"


def at_home(slots: DataFrame, known: Broadcast, k: int, same: bool) -> DataFrame:
    """slots with the cell of their anchor, `low` raised to a score that k rows of the sample reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in b.column("dim").unique().to_pylist():
                part = b.filter(pc.equal(b.column("dim"), dim))
                space = known.value[dim]
                for lo in range(0, part.num_rows, GROUP_SLOTS):
                    own = part.slice(lo, GROUP_SLOTS)
                    ids, labels, tag, low, high = (own.column(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "label", "tag", "low", "high"))
                    v = matrix(own.column("v"), dim)
                    best = Best(len(ids), k)
                    if len(space.ids):
                        best.offer(Slots(dim, ids, labels, v, tag, low, high).scores(space.ids, space.labels, space.v, same), space.ids)
                    home = space.home_of(space.to_pivots(space.lengthened(v, True)))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("dim", "anchor_id", "tag", "label", "v")), pa.array(np.maximum(low, best.score[:, -1])), own.column("high"), pa.array(home)], names=["dim", "anchor_id", "tag", "label", "v", "low", "high", "home"])

    return slots.mapInArrow(run, _SLOTS_SQL)


def ranges(slots: DataFrame, known: Broadcast) -> DataFrame:
    """(dim, home, cell, from_r, to_r): distances from the pivot of a cell around another home at which rows may serve a slot; at most PIVOTS squared a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in b.column("dim").unique().to_pylist():
                part = b.filter(pc.equal(b.column("dim"), dim))
                space, home = known.value[dim], part.column("home").to_numpy()
                hull: dict[int, list[np.ndarray]] = {}
                for lo in range(0, part.num_rows, GROUP_SLOTS):
                    own = part.slice(lo, GROUP_SLOTS)
                    u = space.lengthened(matrix(own.column("v"), dim), True)
                    d, norm2 = space.to_pivots(u), (u * u).sum(1)
                    most = space.distance(norm2, own.column("low").to_numpy()) + SLIP
                    least = space.distance(norm2, own.column("high").to_numpy()) - SLIP
                    near = np.maximum(d - most[:, None], least[:, None] - d)
                    far = d + most[:, None]
                    for h in np.unique(home[lo : lo + GROUP_SLOTS]):
                        mine = home[lo : lo + GROUP_SLOTS] == h
                        pair = [near[mine].min(0), far[mine].max(0)]
                        hull[h] = [np.minimum(hull[h][0], pair[0]), np.maximum(hull[h][1], pair[1])] if h in hull else pair
                around = space.home_of(space.to_pivots(space.pivots))
                for h, (near, far) in hull.items():
                    cell = np.flatnonzero(around != h).astype(np.int32)
                    m = len(cell)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, dim, np.int32)), pa.array(np.full(m, h, np.int32)), pa.array(cell), pa.array(near[cell] - SLIP), pa.array(far[cell] + SLIP)], names=["dim", "home", "cell", "near", "far"])

    found = slots.mapInArrow(run, "dim int, home int, cell int, near double, far double")
    return found.groupBy("dim", "home", "cell").agg(F.min("near").alias("from_r"), F.max("far").alias("to_r"))


def joined(slots: DataFrame, blocks: DataFrame, ranged: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, tag, vec_id, score): the first k of each slot and task, among the blocks that overlap the ranges (dim, home, cell, from_r, to_r) of the slots' home."""
    on = (F.col("b.dim") == F.col("h.dim")) & (F.col("b.cell") == F.col("h.cell")) & (F.col("far") >= F.col("from_r")) & (F.col("near") <= F.col("to_r"))
    reach = F.broadcast(ranged).alias("h")
    serving = blocks.select("dim", "cell", "near", "far").alias("b").join(reach, on).groupBy(F.col("h.dim").alias("dim"), "home").agg(F.count(F.lit(1)).alias("n"))
    held = slots.groupBy("dim", "home").agg(F.count(F.lit(1)).alias("slots"))
    # a row a home cell: at most PIVOTS a dimension
    deal = stored(serving.join(held, ["dim", "home"]).select("dim", "home", F.ceil(F.col("n") / TASK_BLOCKS).alias("chunks"), F.ceil(F.col("slots") / GROUP_SLOTS).alias("subs")), "negatives-deal")
    dealt = slots.join(F.broadcast(deal), ["dim", "home"]).withColumn("sub", F.pmod(F.xxhash64("anchor_id", F.lit(3)), F.col("subs")).cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        dim, home, sub = (x.as_py() for x in key)
        more = np.stack([t.column(c).to_numpy() for c in ("tag", "low", "high")]).astype(np.int64).tobytes()
        row = [dim, home, sub, *packed_rows(t, dim, ["anchor_id", "label"]), more]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _GROUP)], schema=_GROUP)

    none = F.lit(None).cast("binary").alias("slots")
    groups = dealt.groupBy("dim", "home", "sub").applyInArrow(pack, "dim int, home int, sub int, ids binary, labels binary, vectors binary, slots binary")
    groups = groups.join(F.broadcast(deal.select("dim", "home", "chunks")), ["dim", "home"])
    groups = groups.select("dim", "home", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(-1).cast("long").alias("block"), "ids", "labels", "vectors", "slots")
    sent = blocks.alias("b").join(reach, on).select("b.*", "home").join(F.broadcast(deal), ["dim", "home"])
    sent = sent.select("dim", "home", F.explode(F.sequence(F.lit(0), F.col("subs").cast("int") - 1)).alias("sub"), F.pmod(F.xxhash64("block"), F.col("chunks")).alias("chunk"), "block", "ids", "labels", "vectors", none)
    keys = ["dim", "home", "sub", "chunk"]
    rows = groups.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, best, key = None, None, None

        def done() -> pa.RecordBatch:
            real = best.score > NONE
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(a, k)[real.ravel()]) for a in (slots.ids, slots.tag)] + [pa.array(best.id[real]), pa.array(best.score[real])], names=["anchor_id", "tag", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                v = np.frombuffer(row["vectors"], np.int32).reshape(len(ids), row["dim"]).astype(np.float64)
                if row["slots"] is not None:
                    if best is not None:
                        yield done()
                    key = [row[c] for c in keys]
                    slots = Slots(row["dim"], ids, labels, v, *np.frombuffer(row["slots"], np.int64).reshape(3, -1))
                    best = Best(len(slots.ids), k)
                elif key == [row[c] for c in keys]:
                    wide = max(1, (1 << 20) // len(slots.ids))
                    for lo in range(0, len(ids), wide):
                        to = slice(lo, lo + wide)
                        best.offer(slots.scores(ids[to], labels[to], v[to], same), ids[to])
        if best is not None:
            yield done()

    return rows.mapInArrow(run, "anchor_id long, tag long, vec_id long, score long")


def first_rows(slots: DataFrame, blocks: DataFrame, known: Broadcast, k: int, same: bool) -> DataFrame:
    """(anchor_id, tag, rank, vec_id, score): the first k rows for each slot (dim, anchor_id, tag, label, v, low, high), stored."""
    slots = stored(at_home(slots, known, k, same), "negatives-slots")
    around = [(dim, int(h), cell, -1.0, 9.0) for dim, space in known.value.items() for cell, h in enumerate(space.home_of(space.to_pivots(space.pivots)))]
    own = slots.sparkSession.createDataFrame(around, "dim int, home int, cell int, from_r double, to_r double").join(slots.select("dim", "home").distinct(), ["dim", "home"], "left_semi")
    near = stored(joined(slots, blocks, own, k, same), "negatives-near")
    reached = near.withColumn("rank", _rank()).filter(F.col("rank") == k).select(F.col("anchor_id").alias("a"), F.col("tag").alias("t"), F.col("score").alias("reached"))
    raised = slots.join(reached, (F.col("anchor_id") == F.col("a")) & (F.col("tag") == F.col("t")), "left").withColumn("low", F.greatest("low", F.coalesce("reached", "low"))).drop("a", "t", "reached")
    raised = stored(raised, "negatives-raised")
    far = joined(raised, blocks, stored(ranges(raised, known), "negatives-ranges"), k, same)
    return stored(near.unionByName(far).withColumn("rank", _rank()).filter(F.col("rank") <= k).select("anchor_id", "tag", "rank", "vec_id", "score"), "negatives-first")


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))


def mined(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, block_bytes: int = BLOCK_BYTES, group_slots: int = GROUP_SLOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors and rows as whole_numbers() gives them: for each anchor and each of its
    first `positives` rows of its label, the first `negatives` rows of other labels whose score is from low to high percent of the positive's."""
    spark = rows.sparkSession
    rows = stored(rows, "negatives-rows")
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "v"))
    asked = anchors.withColumn("of_id", one).filter("of_id = 1").select("dim", F.col("vec_id").alias("anchor_id"), "label", "v")
    asked = stored(asked.join(F.broadcast(rows.select("dim").distinct()), "dim"), "negatives-anchors")
    by_dim = spaces(rows, pivots, sample_rows)
    for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        by_dim[r["dim"]].homes = max(1, min(len(by_dim[r["dim"]].pivots), r["n"] * positives // group_slots))
    known = spark.sparkContext.broadcast(by_dim)
    blocks = blocks_of(rows, known, block_bytes)
    everything = asked.select("dim", "anchor_id", F.lit(0).cast("long").alias("tag"), "label", "v", F.lit(NONE + 1).cast("long").alias("low"), F.lit(TOP).cast("long").alias("high"))
    liked = first_rows(everything, blocks, known, positives, True).select(F.col("anchor_id").alias("p_anchor"), F.col("rank").cast("long").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = asked.join(liked, F.col("anchor_id") == F.col("p_anchor"))
    wanted = wanted.select("dim", "anchor_id", "tag", "label", "v", (-_share(-F.col("positive_score"), low)).alias("low"), _share(F.col("positive_score"), high).alias("high")).filter("low <= high")
    found = first_rows(wanted, blocks, known, negatives, False)
    out = found.join(liked.withColumnRenamed("tag", "p_tag"), (F.col("anchor_id") == F.col("p_anchor")) & (F.col("tag") == F.col("p_tag")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _share(x: Column, percent: int) -> Column:
    """floor(x * percent / 100), without overflow."""
    rest = F.pmod(x, F.lit(100).cast("long"))
    return F.floor((x - rest).cast("decimal(20,0)") / 100).cast("long") * percent + F.floor(rest * percent / 100).cast("long")


def op11_hard_negatives(spark, sf_dir):
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows.filter("vec_id % 100 = 0"), rows)


#: Each anchor with all rows, as SQL says it; the operator's own plan has no such join.
OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
