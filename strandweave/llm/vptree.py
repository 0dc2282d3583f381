"""Operator 7: nearest neighbours by vantage-point trees, one per shard.

A node holds a vantage point and the ranges of distance from it that its inner and outer halves span. A query
first goes down to its own leaf of each tree, which gives a first radius; then the tree is walked once for the whole
block of queries, a half being left out for those whose distance to its range exceeds the radius (the
triangle inequality). `slack` stretches that distance before the comparison: 1 leaves out nothing that could be
nearer (exact search), more prunes sooner. Each shard returns its k best per query; those are merged.

Every row is indexed. Distances are Euclidean in doubles (infinite beyond their range, and last); ties go to the smaller vec_id. Rows null, zero or holding null or
non-finite components take no part, rows of another dimension than the query's aren't compared with it, rows that
share vec_id are candidates each, but not for a query of that vec_id; a repeated
query row gives one result, and of queries that share vec_id but not the vector the smallest vector is searched. An empty table gives no rows; other
columns of the tables, whatever their names, aren't read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import stored, table
from strandweave.llm.vectors import Layout, each_meeting, indexed, packed, unpacked, usable

LEAF, NOBODY = 32, np.iinfo(np.int64).max


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, of differences divided by their largest component."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = q[:, None, :] - x[None, :, :]
        s = (d * d).sum(-1)
        out = np.sqrt(s)
        odd = ~((s > 1e-280) & (s < np.inf))
        if odd.any():
            d = d[odd]
            big = np.abs(d).max(-1, initial=0.0)
            by = np.where((big > 0) & (big < np.inf), big, 1.0)
            d = d / by[:, None]
            out[odd] = by * np.sqrt((d * d).sum(-1))
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, list]:
    """(order, nodes): nodes are (start, end) of a leaf, or (vantage row, split, inner range, outer range, inner node, outer node)."""
    order, nodes = np.arange(len(x)), []

    def grow(a: int, b: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if b - a <= LEAF:
            nodes[at] = (a, b)
            return at
        far = a + int(distances(x[order[a]][None], x[order[a:b]])[0].argmax())
        order[a], order[far] = order[far], order[a]
        d = distances(x[order[a]][None], x[order[a + 1 : b]])[0]
        by = d.argsort(kind="stable")
        order[a + 1 : b] = order[a + 1 : b][by]
        d = d[by]
        half = len(d) // 2
        nodes[at] = (int(order[a]), float(d[half - 1] + d[half]) / 2, (d[0], d[half - 1]), (d[half], d[-1]), grow(a + 1, a + 1 + half), grow(a + 1 + half, b))
        return at

    if len(x):
        grow(0, len(x))
    return order, nodes


class Search:
    """The k nearest of a shard for a block of queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, order: np.ndarray, nodes: list, q: np.ndarray, q_ids: np.ndarray, k: int, slack: float):
        self.x, self.ids, self.order, self.nodes, self.q, self.q_ids, self.k, self.slack = x, ids, order, nodes, q, q_ids, k, slack
        self.best = np.full((len(q), k), np.inf)
        self.found = np.full((len(q), k), NOBODY)
        self.seen = np.full(len(q), -1)
        if nodes:
            self.descend(0, np.arange(len(q)))
            self.walk(0, np.arange(len(q)))

    def offer(self, who: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        own = ids[None, :] == self.q_ids[who][:, None]
        d = np.where(own, np.inf, d)
        nearer = (d <= self.best[who, -1:]).any(1)
        who, d, own = who[nearer], d[nearer], own[nearer]
        if len(who):
            all_d = np.concatenate([self.best[who], d], 1)
            all_i = np.concatenate([self.found[who], np.where(own, NOBODY, ids[None, :])], 1)
            first = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
            self.best[who], self.found[who] = np.take_along_axis(all_d, first, 1), np.take_along_axis(all_i, first, 1)

    def descend(self, node: int, who: np.ndarray) -> None:
        """Each query to its own leaf; only leaves are offered, the walk offers all else."""
        if not len(who):
            return
        n = self.nodes[node]
        if len(n) == 2:
            rows = self.order[n[0] : n[1]]
            self.offer(who, distances(self.q[who], self.x[rows]), self.ids[rows])
            self.seen[who] = node
            return
        inner = distances(self.q[who], self.x[n[0]][None])[:, 0] <= n[1]
        self.descend(n[4], who[inner])
        self.descend(n[5], who[~inner])

    def walk(self, node: int, who: np.ndarray) -> None:
        n = self.nodes[node]
        if len(n) == 2:
            who = who[self.seen[who] != node]
            if len(who):
                rows = self.order[n[0] : n[1]]
                self.offer(who, distances(self.q[who], self.x[rows]), self.ids[rows])
            return
        d = distances(self.q[who], self.x[n[0]][None])
        self.offer(who, d, self.ids[n[0] : n[0] + 1])
        d = d[:, 0]
        for (low, high), child in ((n[2], n[4]), (n[3], n[5])):
            with np.errstate(invalid="ignore"):
                # distances beyond the range of doubles bound nothing
                bound = np.maximum(low - d if low < np.inf else -np.inf, np.where(d < np.inf, d, -np.inf) - high)
                near = who[~(bound * self.slack > self.best[who, -1] * (1 + 1e-12) + 1e-300)]
            if len(near):
                self.walk(child, near)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, slack: float = 1.0, least_shards: int = 8, shard_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each query, both (vec_id, embedding).

    Shards and blocks are bounded by bytes, or by shard_rows and block_rows where given.
    """
    rows = usable(rows)
    queries = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    n, dim = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    at = Layout(n, queries.count(), dim or 1, least_shards, shard_rows, block_rows)
    blocks = packed(queries, "block", at.blocks)
    index = stored(indexed(packed(rows, "shard", at.shards), lambda shard, x, _: pickle.dumps(build(x))), "vptree-index")

    def opened(row: dict) -> tuple:
        ids, _, x = unpacked(row)
        return ids, x, *pickle.loads(row["index"])

    def search(shard: tuple, row: dict) -> pa.RecordBatch:
        ids, x, order, nodes = shard
        q_ids, _, q = unpacked(row)
        out = [Search(x, ids, order, nodes, q[i : i + 512], q_ids[i : i + 512], k, slack) for i in range(0, len(q), 512)]
        best, found = np.concatenate([s.best for s in out]), np.concatenate([s.found for s in out])
        real = found < NOBODY
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, k)[real.ravel()]), pa.array(found[real]), pa.array(best[real])], names=["query_id", "vec_id", "score"])

    found = each_meeting(index, blocks, at, opened, search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.filter("vec_id % 100 = 0"), rows)
