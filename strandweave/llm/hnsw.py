"""Operator 8: embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

In each shard, near-identical vectors hang under a leader, with counts: a dense group is a few leaders however large it is. The shard
builds a graph of its leaders: each has a level drawn geometrically, and each layer links its members to near but mutually
diverse neighbours, found by beam search in what is built already. Every vector then queries every shard, in blocks: down the
layers to entry points, then a beam on the ground layer. A leader that is found and its members are counted at once where the triangle
inequality on angles puts all of them within the bound, and compared by cosine in doubles where it doesn't decide. A query whose
whole beam may have links is compared with all leaders of the shard, in blocks of queries.

The beam's width is set by audits against full scans. When a shard is built, queries are planted at the bound's edge around
its own rows, so each has a link, and the beam widens until they are found. In each block `AUDITS` queries drawn at random are
audited as well, on leaders other than their own, by query and by link, and the block is searched again with a wider beam if too few of their links were found (at the
widest, all leaders are compared). All audits' first counts make `audited_recall`.

Links are counted in the task and reduced to a star forest block by block, so that a dense group never becomes rows of pairs, in
memory neither; components are joined over all shards and blocks. Cost: vectors times shards, and a group's square only where
it is too loose to hang under leaders but all within the bound.

Equal vectors are one node with a count. Vectors null, zero or holding null or non-finite components, and ids that are null, have no links and are
components of their own. Of rows that share vec_id but not the vector, the smallest vector stands for that id; repeated rows give repeated results.
Vectors of different dimensions don't link. An empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import stored, table
from strandweave.llm.components import components
from strandweave.llm.vectors import Layout, each_meeting, indexed, packed, unpacked, usable

M, M_GROUND, BUILD_BEAM = 12, 24, 48
#: Cosine to its leader that a row needs to hang under it.
TIGHT = 0.98
#: Queries of a block, and planted ones of a shard, whose links are audited against a full scan.
AUDITS = 64
#: Angles closer than this to a bound are decided by exact cosines: single precision is off by less.
SLIP = 4e-3


class Graph:
    """Layers of links between unit vectors; layer k holds rows `members[k]` and an adjacency `links[k]` by row (-1: none)."""

    def __init__(self, x: np.ndarray, seed: int):
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(M)).astype(int), 8)
        top = 0
        while (level > top).sum() > 32:
            top += 1
        self.links: list[np.ndarray] = [None] * (top + 1)
        self.members = [np.flatnonzero(level >= k) for k in range(top + 1)]
        for k in range(top, -1, -1):
            self.links[k] = self._layer(x, k, M_GROUND if k == 0 else M)

    def _layer(self, x: np.ndarray, k: int, m: int) -> np.ndarray:
        links = np.full((len(x), m), -1, np.int32)
        rows = self.members[k]
        done = min(len(rows), 256)
        self._attach(x, links, rows[:done], np.empty((done, 0), np.int64), m)
        while done < len(rows):
            batch = rows[done : done + min(done, 2048)]
            entries = self.entries(x, x[batch], k) if k + 1 < len(self.links) else np.repeat(rows[None, :1], len(batch), 0)
            # an entry that isn't in yet is of no use; one that is always gives a way in
            ready = np.zeros(len(x), bool)
            ready[rows[:done]] = True
            entries = np.concatenate([np.where(ready[entries], entries, rows[0]), np.repeat(rows[None, : min(done, 4)], len(batch), 0)], 1)
            found, _ = beam(x, links, x[batch], entries, BUILD_BEAM)
            self._attach(x, links, batch, found, m)
            done += len(batch)
        return self._adopt(links, rows)

    @staticmethod
    def _adopt(links: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A link from a neighbour to each row that none leads to, in added columns."""
        led = np.zeros(len(links), bool)
        led[links[links >= 0]] = True
        free: dict[int, int] = {}
        more: list[tuple[int, int, int]] = []
        for v in rows[~led[rows]]:
            near = [int(u) for u in links[v] if u >= 0]
            if near:
                u = min(near, key=lambda u: free.get(u, 0))
                more.append((u, free.get(u, 0), int(v)))
                free[u] = free.get(u, 0) + 1
        added = np.full((len(links), max(free.values(), default=0)), -1, np.int32)
        for u, k, v in more:
            added[u, k] = v
        return np.concatenate([links, added], 1)

    @staticmethod
    def _attach(x: np.ndarray, links: np.ndarray, batch: np.ndarray, found: np.ndarray, m: int) -> None:
        """Links the batch to what was found and to each other, both ways."""
        own = x[batch] @ x[batch].T
        np.fill_diagonal(own, -2)
        near = np.argsort(-own, axis=1, kind="stable")[:, : min(m, len(batch) - 1)]
        candidates = np.concatenate([found, batch[near]], 1)
        links[batch] = _diverse(x, batch, candidates, m)
        a = np.repeat(batch, m)
        b = links[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        touched, start, count = np.unique(b, return_index=True, return_counts=True)
        for lo in range(0, len(touched), 2048):
            t, s, c = touched[lo : lo + 2048], start[lo : lo + 2048], count[lo : lo + 2048]
            # a popular row gets many at once: the nearest of them are enough
            wide = int(min(c.max(), 4 * m))
            back = np.full((len(t), wide), -1, np.int64)
            for i in np.flatnonzero(c > wide):
                them = a[s[i] : s[i] + c[i]]
                back[i] = them[np.argsort(-(x[them] @ x[t[i]]), kind="stable")[:wide]]
            fits = c <= wide
            col = np.arange(wide)[None, :]
            take = (col < c[:, None]) & fits[:, None]
            back[take] = a[(s[:, None] + col)[take]]
            links[t] = _diverse(x, t, np.concatenate([links[t].astype(np.int64), back], 1), m)

    def entries(self, x: np.ndarray, q: np.ndarray, ground: int = 0, width: int = 6) -> np.ndarray:
        """Rows of the layer above `ground` near each query, by way of the layers above."""
        top = len(self.links) - 1
        best = np.argsort(-(q @ x[self.members[top]].T), axis=1, kind="stable")[:, :width]
        at = self.members[top][best]
        for k in range(top - 1, ground, -1):
            at, _ = beam(x, self.links[k], q, at, width * 2)
            at = np.where(at[:, :width] >= 0, at[:, :width], at[:, :1])
        return at


def _diverse(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates, up to m: the nearest ones that are nearer to the row than to one taken before, then the nearest others."""
    out = np.full((len(rows), m), -1, np.int32)
    for lo in range(0, len(rows), 512):
        r, c = rows[lo : lo + 512], candidates[lo : lo + 512]
        c = np.sort(c, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == r[:, None]] = -1
        sims = np.where(c >= 0, np.matmul(x[c], x[r][:, :, None])[:, :, 0], -2)
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * m]
        c, sims = np.take_along_axis(c, best, 1), np.take_along_axis(sims, best, 1)
        them = x[c]
        among = np.matmul(them, them.transpose(0, 2, 1))
        taken = np.zeros(c.shape, bool)
        nearest = np.full(c.shape, -2.0, np.float32)  # to what is taken
        for j in range(c.shape[1]):
            yes = (c[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (taken.sum(1) < m)
            taken[:, j] = yes
            nearest[yes] = np.maximum(nearest[yes], among[yes, :, j])
        rank = np.argsort(np.where(taken, 0, np.where(c >= 0, 1, 2)), axis=1, kind="stable")[:, :m]
        got = np.take_along_axis(c, rank, 1)
        out[lo : lo + 512, : got.shape[1]] = got
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(rows, similarities) of up to `width` rows near each query, best first (-1: none), by beam search from its entries."""
    rows_out = np.full((len(q), width), -1, np.int64)
    sims_out = np.full((len(q), width), -2.0, np.float32)
    step = max(1, min(1024, (64 << 20) // max(1, len(x))))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        live = np.arange(len(part))
        visited = np.zeros((len(part), len(x)), bool)
        rows = np.full((len(part), width), -1, np.int64)
        sims = np.full((len(part), width), -2.0, np.float32)
        spent = np.ones((len(part), width), bool)
        fresh = entries[lo : lo + step].astype(np.int64)
        while len(live):
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            ok = (fresh >= 0) & ~visited[live[:, None], fresh]
            fresh = np.where(ok, fresh, -1)
            new = np.where(ok, np.matmul(x[fresh], part[live][:, :, None])[:, :, 0], -2)
            i, j = np.nonzero(ok)
            visited[live[i], fresh[i, j]] = True
            all_r, all_s = np.concatenate([rows[live], fresh], 1), np.concatenate([sims[live], new], 1)
            all_p = np.concatenate([spent[live], ~ok], 1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            rows[live], sims[live] = np.take_along_axis(all_r, best, 1), np.take_along_axis(all_s, best, 1)
            spent[live] = np.take_along_axis(all_p, best, 1)
            waits = ~spent[live]
            pick = waits & (np.cumsum(waits, axis=1) <= expand)
            going = pick.any(1)
            live, pick = live[going], pick[going]
            if not len(live):
                break
            at = np.full((len(live), expand), -1, np.int64)
            i, j = np.nonzero(pick)
            at[i, np.cumsum(pick, axis=1)[i, j] - 1] = rows[live[i], j]
            spent[live[i], j] = True
            fresh = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1).astype(np.int64)
        rows_out[lo : lo + step], sims_out[lo : lo + step] = rows, sims
    return rows_out, sims_out


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the links (a, b) join, one a node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        now = root.copy()
        np.minimum.at(now, root[u], low)
        np.minimum.at(now, root[v], low)
        while (now != now[now]).any():
            now = now[now]
        if (now == root).all():
            break
        root = now
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def led(x: np.ndarray, weight: np.ndarray, tight: float = TIGHT, rounds: int = 8) -> np.ndarray:
    """The leader (a row, itself maybe) of each row of unit vectors; a row's similarity to another leader is at least `tight`.

    In each round leaders meet by the signs of random projections; the weightiest of a bucket takes those near enough, with their rows
    that are near enough too. What is missed stays apart, at the price of time alone.
    """
    n = len(x)
    lead, rng = np.arange(n), np.random.default_rng(n)
    bits = max(1, min(30, int(np.log2(max(n, 2)))))
    for _ in range(rounds):
        heads = np.flatnonzero(lead == np.arange(n))
        mass = np.bincount(lead, weight, n)[heads]
        code = (x[heads] @ rng.normal(size=(x.shape[1], bits)).astype(np.float32) > 0) @ (1 << np.arange(bits))
        order = np.lexsort((heads, -mass, code))
        first = np.r_[True, code[order][1:] != code[order][:-1]]
        winner = np.empty(n, np.int64)
        winner[heads[order]] = heads[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        new = winner[lead]
        near = (new != lead) & (_dots(x, np.arange(n), new) >= tight)
        moved = near[lead]  # with its head; what the new head doesn't reach is on its own again
        lead = np.where(near & moved, new, np.where(moved, np.arange(n), lead))
    return lead


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 65536) -> np.ndarray:
    return np.concatenate([np.empty(0, x.dtype), *(np.einsum("ij,ij->i", x[a[i : i + step]], x[b[i : i + step]]) for i in range(0, len(a), step))])


class Index:
    """A shard's leaders, their members and reach, the graph of the leaders, and the beam's width with the audit that set it."""

    def __init__(self, unit: np.ndarray, copies: np.ndarray, least: float, width: int, recall: float, seed: int):
        lead = led(unit, copies)
        self.leaders, self.group = np.unique(lead, return_inverse=True)
        self.order = np.argsort(self.group, kind="stable")
        self.ends = np.cumsum(np.bincount(self.group, minlength=len(self.leaders)))
        self.weight = np.bincount(self.group, copies, len(self.leaders))
        to_lead = np.arccos(np.clip(_dots(unit, np.arange(len(unit)), lead), -1, 1))
        self.reach = np.zeros(len(self.leaders))
        np.maximum.at(self.reach, self.group, np.where(lead == np.arange(len(lead)), 0, to_lead))
        x = unit[self.leaders]
        self.graph = Graph(x, seed)
        self.floor = self.floors(least)
        self.width, self.audit = self._widened(x, least, width, recall, seed)

    def floors(self, least: float) -> np.ndarray:
        """For each leader the similarity below which none of its rows can link."""
        return np.cos(np.minimum(np.arccos(least) + self.reach + SLIP, np.pi)).astype(np.float32)

    def _widened(self, x: np.ndarray, least: float, width: int, recall: float, seed: int) -> tuple[int, tuple[int, int]]:
        rng = np.random.default_rng(seed)
        near = x[rng.permutation(len(x))[:AUDITS]].astype(np.float64)
        away = rng.normal(size=near.shape)
        away -= (away * near).sum(1, keepdims=True) * near
        away /= np.linalg.norm(away, axis=1, keepdims=True) + 1e-300
        cos = min(1.0, least + 0.002)
        planted = (cos * near + np.sqrt(1 - cos * cos) * away).astype(np.float32)
        true = planted @ x.T >= self.floor
        first = None
        while True:
            hit = self.found(x, planted, width) & true
            first = first or (int(hit.sum()), int(true.sum()))
            if width >= len(x) or enough(hit, true, recall):
                return width, first
            width *= 4

    def found(self, x: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
        """Which leaders a beam of that width sees, for a few queries."""
        rows, _ = self.searched(x, q, width)
        seen = np.zeros((len(q), len(x)), bool)
        i, j = np.nonzero(rows >= 0)
        seen[i, rows[i, j]] = True
        return seen

    def searched(self, x: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entries = self.graph.entries(x, q) if len(self.graph.links) > 1 else np.repeat(self.graph.members[0][None, :6], len(q), 0)
        return beam(x, self.graph.links[0], q, entries, min(width, len(x)))


def enough(hit: np.ndarray, true: np.ndarray, recall: float) -> bool:
    """By query, so that a dense group hides no single link, and by link, so that single ones don't hide a dense group's."""
    each, of = hit.sum(1), true.sum(1)
    some = of > 0
    return (each[some] / of[some]).sum() >= recall * some.sum() - 1e-9 and each.sum() >= recall * of.sum() - 1e-9


def hits_of(index: Index, x: np.ndarray, q: np.ndarray, own: np.ndarray, width: int, recall: float) -> tuple[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], tuple[int, int, int]]:
    """Chunks of (query, leader, similarity) that may hold links, each pair once, and (hits of the first beams, links, hits of the last) of the block's audit; x: the leaders' vectors; own: each query's own group (-1: none)."""
    step = max(1, (8 << 20) // max(1, len(x)))
    drawn = np.sort(np.random.default_rng(len(q)).permutation(len(q))[:AUDITS])
    true = np.concatenate([q[drawn[i : i + step]] @ x.T >= index.floor for i in range(0, len(drawn), step)])
    true[np.flatnonzero(own[drawn] >= 0), own[drawn][own[drawn] >= 0]] = False
    first, last, links = None, 0, int(true.sum())
    while width < len(x):
        rows, sims = index.searched(x, q, width)
        full = sims[:, -1] >= index.floor.min()
        hit = np.zeros_like(true)
        i, j = np.nonzero(rows[drawn] >= 0)
        hit[i, rows[drawn][i, j]] = True
        hit[full[drawn]] = True
        hit &= true
        first = first if first is not None else int(hit.sum())
        last = int(hit.sum())
        if enough(hit, true, recall):
            break
        width *= 4
    else:
        rows, sims, full, last = np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.float32), np.ones(len(q), bool), links

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ok = (rows >= 0) & (sims >= index.floor[rows]) & ~full[:, None]
        i, j = np.nonzero(ok)
        yield i, rows[i, j], sims[i, j]
        whole = np.flatnonzero(full)
        for lo in range(0, len(whole), step):
            s = q[whole[lo : lo + step]] @ x.T
            i, j = np.nonzero(s >= index.floor)
            yield whole[lo + i], j, s[i, j]

    return chunks(), (last if first is None else first, links, last)


class Forest:
    """Links, reduced to at most one a node whenever some have gathered."""

    def __init__(self) -> None:
        self.a, self.b, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > 1 << 20:
            self.reduced()

    def reduced(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        a, b = star_forest(np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))
        self.a, self.b, self.held = [a], [b], 0
        return a, b


def links_of(index: Index, leaders: np.ndarray, rows: tuple, q_rows: tuple, least: float, recall: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[int, int, int]]:
    """For a block of queries: links to each of the shard's rows but itself, counted with copies; a star forest that joins them; the audit. rows, q_rows: (ids, copies, vectors)."""
    ids, copies, x = rows
    q_ids, _, q = q_rows
    by_id = np.argsort(ids, kind="stable")
    at = by_id[np.minimum(np.searchsorted(ids, q_ids, sorter=by_id), len(ids) - 1)]
    own = np.where(ids[at] == q_ids, at, -1)
    own_group = np.where(own >= 0, index.group[own], -1)
    x, q = _scaled(x), _scaled(q)
    x_norm, q_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    size = np.diff(index.ends, prepend=0)
    links, forest, bound = np.zeros(len(q)), Forest(), np.arccos(least)
    chunks, audit = hits_of(index, leaders, _unit(q), own_group, index.width, recall)
    for i, j, s in chunks:
        angle = np.arccos(np.clip(s.astype(np.float64), -1, 1))
        sure = (size[j] > 1) & (angle + index.reach[j] <= bound - SLIP)
        links += np.bincount(i[sure], index.weight[j[sure]] - np.where(own_group[i[sure]] == j[sure], copies[own[i[sure]]], 0), len(q))
        forest.add(q_ids[i[sure]], ids[index.leaders[j[sure]]])

        one = np.flatnonzero(size[j] == 1)
        for lo in range(0, len(one), 65536):
            a, b = i[one[lo : lo + 65536]], index.leaders[j[one[lo : lo + 65536]]]
            real = (_cosines(q, x, q_norm, x_norm, a, b) >= least) & (own[a] != b)
            links += np.bincount(a[real], copies[b[real]], len(q))
            forest.add(q_ids[a[real]], ids[b[real]])

        open_ = np.flatnonzero((size[j] > 1) & ~sure)
        open_ = open_[np.argsort(j[open_], kind="stable")]
        for part in np.split(open_, np.flatnonzero(np.diff(j[open_])) + 1) if len(open_) else ():
            group = j[part[0]]
            members = index.order[index.ends[group] - size[group] : index.ends[group]]
            wide = min(len(members), 4096)
            for lo in range(0, len(part), max(1, (1 << 20) // wide)):
                a = i[part[lo : lo + max(1, (1 << 20) // wide)]]
                for m in range(0, len(members), wide):
                    b = members[m : m + wide]
                    cosine = q[a] @ x[b].T / (q_norm[a][:, None] * x_norm[b])
                    k, m_ = np.nonzero(np.abs(cosine - least) < 1e-9)  # at the bound, as the pair is measured from its other side
                    cosine[k, m_] = _cosines(q, x, q_norm, x_norm, a[k], b[m_])
                    real = (cosine >= least) & (own[a][:, None] != b)
                    links += np.bincount(a, real @ copies[b], len(q))
                    # a group's rows are joined by their leader: one link to any of them is enough
                    some = real.any(1)
                    forest.add(q_ids[a[some]], ids[b[real[some].argmax(1)]])
    return links.astype(np.int64), forest.reduced(), audit


def near_duplicates(embeddings: DataFrame, least: float = 0.9, width: int = 32, recall: float = 0.99, least_shards: int = 4, shard_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall, final_recall) of each row: links are pairs of cosine at least `least`, a bound below TIGHT.

    audited_recall is the share of the audited links that the first, narrowest beams found, over all shards and blocks (null: no vectors or no links), final_recall that which the blocks' last, widened ones found.
    """
    if not -1 < least < TIGHT:
        raise ValueError(f"least must be below {TIGHT}")
    rows = usable(embeddings).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    nodes = stored(rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")), "hnsw-nodes")
    n, dim = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    at = Layout(n, n, dim or 1, least_shards, shard_rows, block_rows)
    index = stored(indexed(packed(nodes, "shard", at.shards, "copies"), lambda k, x, copies: pickle.dumps(Index(_unit(x), copies, least, width, recall, k))), "hnsw-index")

    def opened(row: dict) -> list:
        shard, mine = unpacked(row), pickle.loads(row["index"])
        ids = shard[0]
        hung = np.flatnonzero(mine.leaders[mine.group] != np.arange(len(ids)))
        return [shard, mine, _unit(shard[2][mine.leaders]), (ids[hung], ids[mine.leaders[mine.group[hung]]]), mine.audit]

    def search(held: list, block: dict) -> pa.RecordBatch:
        shard, mine, leaders, hung, planted = held
        q_rows = unpacked(block)
        links, (node, root), audit = links_of(mine, leaders, shard, q_rows, least, recall)
        if hung is not None:  # what hangs under the shard's leaders, said with a task's first block: any task may be the only one with a block of this dimension
            node, root = np.concatenate([node, hung[0]]), np.concatenate([root, hung[1]])
        held[3], held[4] = None, (0, 0)
        some = links > 0
        counted = [q_rows[0][some], np.zeros(some.sum(), np.int64), links[some]]
        audited = [[planted[0] + audit[0], audit[2]], [planted[1] + audit[1], audit[1]], [0, 0]]
        cols = [np.concatenate(c) for c in zip(counted, (node, root, np.zeros(len(node), np.int64)), audited)]
        kind = np.repeat(["count", "link", "audit", "final"], [some.sum(), len(node), 1, 1])
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), *(pa.array(c.astype(np.int64)) for c in cols)], names=["kind", "a", "b", "n"])

    found = stored(each_meeting(index, packed(nodes, "block", at.blocks, "copies"), at, opened, search, "kind string, a long, b long, n long"), "hnsw-links")
    audits = {r["kind"]: (r["hits"], r["links"]) for r in found.filter("kind in ('audit', 'final')").groupBy("kind").agg(F.sum("a").alias("hits"), F.sum("b").alias("links")).collect()}
    counts = found.filter("kind = 'count'").groupBy(F.col("a").alias("c_id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("kind = 'link'"))
    # the smallest id of a node is its vec_id, and roots are the smallest of those
    known = nodes.join(counts, nodes.vec_id == counts.c_id, "left").join(roots, nodes.vec_id == roots.node, "left")
    known = known.select(F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "vec_id").alias("root"))
    by_id = rows.join(known, F.col("embedding") == F.col("e")).select(F.col("vec_id").alias("k_id"), "n", "root")
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = every.join(by_id, F.col("vec_id") == F.col("k_id"), "left")
    component = F.coalesce("root", "vec_id")
    recalled = [F.lit(hits / links if links else None).cast("double").alias(name) for name, (hits, links) in (("audited_recall", audits.get("audit", (0, 0))), ("final_recall", audits.get("final", (0, 0))))]
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), *recalled)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one: no cosine changes, no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _cosines(q: np.ndarray, x: np.ndarray, q_norm: np.ndarray, x_norm: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs, the same from either side."""
    return np.einsum("ij,ij->i", q[a], x[b]) / (q_norm[a] * x_norm[b])


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    y = x / big
    return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)


def op8_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
