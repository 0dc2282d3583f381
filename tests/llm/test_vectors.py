"""Vector operators against brute force."""

import numpy as np
import pytest

from strandweave.llm import hnsw, vptree
from strandweave.llm.components import components


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    x = [*(centres[i % 6] + rng.normal(size=16) * 0.1 for i in range(120)), *rng.normal(size=(200, 16))]
    x = [v.astype(np.float32).tolist() for v in x] + [x[0].astype(np.float32).tolist()] * 5  # ties
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [2.0, 1.0]]
    data = [(i, v, "extra", 0) for i, v in enumerate([*x, *odd])] + [(3, x[3], "again", 0), (None, x[4], "no id", 0)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, dim string, shard int").repartition(3)


@pytest.fixture(scope="module")
def good(rows):
    found = {r.vec_id: np.array(r.embedding, float) for r in rows.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    return {k: v for k, v in found.items() if len(v) == 16}


@pytest.mark.parametrize("slack", [1.0, 1.3])
def test_nearest(rows, good, slack):
    got = {}
    for r in vptree.nearest(rows.filter("vec_id % 10 = 0"), rows, slack=slack, least_shards=3, block_rows=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hits = {}, 0
    for q in (k for k in good if k % 10 == 0):
        # repeated rows of an id are candidates each
        d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), k) for k, v in [*good.items(), (3, good[3])] if k != q)[:10]
        want[q] = [(i + 1, k, s) for i, (s, k) in enumerate(d)]
        hits += len({x[1] for x in got[q]} & {x[1] for x in want[q]})
    got = {k: sorted(v) for k, v in got.items() if k in want}
    assert set(got) == set(want)
    if slack == 1.0:
        assert {k: [x[:2] for x in v] for k, v in got.items()} == {k: [x[:2] for x in v] for k, v in want.items()}
        assert max(abs(a[2] - b[2]) for k in want for a, b in zip(got[k], want[k])) < 1e-12
    else:
        assert hits >= 0.9 * 10 * len(want)


def roots_of(linked):
    """The smallest row that each reaches."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(1))
        if (low == root).all():
            return root
        root = low


def test_near_duplicates(rows, good):
    got = {r.vec_id: r for r in hnsw.near_duplicates(rows, least_shards=3, block_rows=64).collect()}
    ids = sorted(good)
    x = np.array([good[k] for k in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    root = roots_of(linked)
    for i, k in enumerate(ids):
        assert (got[k].n_links, got[k].component_id) == (int(linked[i].sum()), ids[root[i]])
    for k in set(got) - set(ids) - {None}:
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept


def unit(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def links_by_scan(q, x, least=0.9):
    return q.astype(float) @ x.astype(float).T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1) >= least


def searched(x, least=0.9, index=None, width=32):
    """n_links and the star forest of a shard that queries itself."""
    ids, copies = np.arange(len(x)) * 3, np.ones(len(x), np.int64)
    index = index or hnsw.Index(unit(x), copies, least, width, 0.99, 0)
    rows = (ids, copies, x.astype(float))
    return hnsw.links_of(index, unit(x)[index.leaders], rows, rows, least, 0.99)


def groups_of(case, rng):
    noise = rng.normal(size=(5000, 48))
    if case == "pairs":  # 79 single pairs in 5,000 vectors
        noise[3000:3079] = unit(noise[:79]) + 0.03 * rng.normal(size=(79, 48))
    elif case == "dense":  # a tight group of 2,000
        noise[:2000] = unit(noise[:1]) + 0.01 * rng.normal(size=(2000, 48))
    elif case == "loose":  # one around the bound, too loose for leaders
        noise[:1000] = unit(noise[:1]) + 0.05 * rng.normal(size=(1000, 48))
    return noise


@pytest.mark.parametrize("case", ["pairs", "dense", "loose"])
def test_links_of_groups(case):
    x = groups_of(case, np.random.default_rng(5))
    true = links_by_scan(x, x)
    np.fill_diagonal(true, False)
    assert true.sum() >= 79
    links, (node, root), _ = searched(x)
    if case == "dense":
        index = hnsw.Index(unit(x), np.ones(len(x), np.int64), 0.9, 32, 0.99, 0)
        assert len(index.leaders) <= 3000 + 40 and index.reach.max() <= np.arccos(hnsw.TIGHT) + 1e-6
    assert (links == true.sum(1)).mean() >= (0.99 if case == "loose" else 0.999) and links.sum() >= 0.99 * true.sum()
    assert len(node) < len(x) and len(set(node)) == len(node)
    got = np.arange(len(x))
    got[node // 3] = root // 3
    assert (got == roots_of(true)).mean() >= (0.99 if case == "loose" else 0.999)


class Blind:
    """A graph without links, whose searches end where they start."""

    def __init__(self, n, start):
        self.links, self.members, self.start = [np.full((n, 1), -1, np.int32)] * 2, [np.arange(n)] * 2, start

    def entries(self, x, q):
        return self.start(len(q))


def test_audits_widen_a_bad_graph(monkeypatch):
    """Planted queries have a link each, so a graph that finds nothing is searched wider and wider, till all is compared."""
    x = groups_of("pairs", np.random.default_rng(6))[2500:3500]
    x[:30] = x[900:930] + 0.01
    true = links_by_scan(x, x)
    np.fill_diagonal(true, False)
    monkeypatch.setattr(hnsw, "Graph", lambda x, seed: Blind(len(x), lambda n: np.zeros((n, 1), np.int64)))
    index = hnsw.Index(unit(x), np.ones(len(x), np.int64), 0.9, 32, 0.99, 0)
    assert index.width >= len(index.leaders) and index.audit[0] < 0.1 * index.audit[1] and index.audit[1] >= 64
    assert (searched(x, index=index)[0] == true.sum(1)).all()


def test_block_audit_ignores_the_own_group():
    """A graph that gives each query its own row alone: the block's audit sees the missing links."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 48))
    x[500:] = unit(x[:500]) + 0.05 * rng.normal(size=(500, 48))
    true = links_by_scan(x, x)
    np.fill_diagonal(true, False)
    index = hnsw.Index(unit(x), np.ones(1000, np.int64), 0.9, 32, 0.99, 0)
    assert len(index.leaders) == 1000
    index.graph, index.width = Blind(1000, lambda n: np.arange(n)[:, None]), 32
    links, _, (hits, of, last) = searched(x, index=index)
    assert (links == true.sum(1)).all() and hits == 0 < of == last


def test_exact_copies_and_counts(spark):
    rng = np.random.default_rng(8)
    x = [rng.normal(size=8).tolist()] * 30 + [rng.normal(size=8).tolist() for _ in range(5)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(0, x[0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(rows, least=0.97).collect()}
    assert all(got[i] == (29, 0, i == 0) for i in range(30))


def test_few_vectors_of_a_second_dimension(spark):
    """Two near ones of another dimension are linked, whichever block they fall in."""
    rng = np.random.default_rng(4)
    x = [rng.normal(size=8).tolist() for _ in range(40)] + [[1.0, 2.0, 3.0], [1.0, 2.0, 3.001], [1.0, 2.0, 3.002]]
    for shift in range(4):
        rows = spark.createDataFrame([(i + 1000 * shift, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {r.vec_id - 1000 * shift: (r.n_links, r.component_id - 1000 * shift) for r in hnsw.near_duplicates(rows, least_shards=1, block_rows=8).collect()}
        assert [got[i] for i in (40, 41, 42)] == [(2, 40)] * 3


def test_long_vectors_and_bytes(spark):
    """Shards are bounded by bytes: a dimension of 2,048 makes more of them."""
    assert hnsw.Layout(1_000_000, 1000, 2048, 8).shards == 245 and hnsw.Layout(1_000_000, 1000, 64, 8).shards == 8
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 2048))
    x[30:40] = x[:10] + 0.01 * rng.normal(size=(10, 2048))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in hnsw.near_duplicates(rows).collect()}
    assert all(got[i].component_id == got[i + 30].component_id == i and got[i].n_links == 1 for i in range(10))
    near = {r.query_id: r.vec_id for r in vptree.nearest(rows.filter("vec_id < 10"), rows, k=1).collect()}
    assert near == {i: i + 30 for i in range(10)}


def test_of_nothing(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([(5, None)], 'vec_id long, embedding array<float>')).first()[:4] == (5, 0, 5, True)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(none, none).count() == 0
    assert hnsw.near_duplicates(none).count() == 0  # empty tables


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(100, 100), (150, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 200)}}


def test_nearest_of_extremes(spark):
    """Finite rows take part whatever their size: squares that leave the range of doubles lose none."""
    x = {0: (1e200, 1e200), 1: (2e200, -2e200), 2: (1e160, 1e160), 3: (1.0, 1.0), 4: (0.0, 1e-200), 100: (3.0, 1e-200), 5: (1.7e308, -1.7e308), 6: (-1.7e308, 1.7e308), 200: (2e-200, 1e-200)}
    rows = spark.createDataFrame([(k, list(v)) for k, v in x.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(rows.filter("vec_id % 100 = 0"), rows, least_shards=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 100, 200):
        want = sorted((np.hypot(x[q][0] - v[0], x[q][1] - v[1]), k) for k, v in x.items() if k != q)
        assert [k for _, k, _ in sorted(got[q])] == [k for _, k in want]
        assert np.allclose([s for *_, s in sorted(got[q])], [s for s, _ in want], rtol=1e-12, atol=0)


def test_links_of_extremes(spark):
    """Five vectors of one direction and sizes from 1e-200 to 2e200 are all linked, and each counts the others; so are copies and near copies."""
    rows = [(i, [s * 3.0, s * 4.0]) for i, s in enumerate((1e200, 2e200, 1e-200, 2e-200, 1.0))] + [(9, [-4e300, 3e300])]
    got = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least_shards=2).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(5)] == [(4, 0)] * 5 and got[9].n_links == 0


def test_links_are_symmetric(rows):
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(rows, least_shards=3, block_rows=16).collect()}
    again = {r.vec_id: r.n_links for r in hnsw.near_duplicates(rows, least_shards=1, block_rows=500).collect()}
    assert sum(got.values()) % 2 == 0 and got == again


def left(spark):
    from pathlib import Path

    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).iterdir() if p.is_dir() and any(f.name.startswith("part-") for f in p.rglob("*"))}


def test_scopes_remove_what_is_written(spark, rows):
    from strandweave.session import scratch

    before = left(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "a long, b long")
    with scratch(spark):
        assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
        with scratch(spark):
            assert hnsw.near_duplicates(rows, least_shards=3).count() and vptree.nearest(rows, rows, least_shards=2).count()
        assert left(spark) > before
    assert left(spark) == before
