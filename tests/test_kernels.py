"""Recurrences against definitions and brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.operators import kernels as K

values = st.lists(st.floats(-50, 50), min_size=2, max_size=40).map(np.array)


@given(values, st.floats(0.01, 20))
@settings(max_examples=150, deadline=None)
def test_total_variation_certificate(y, strength):
    x = K.total_variation(y, strength)
    u = np.cumsum(y - x)
    assert abs(u[-1]) < 1e-6
    assert (np.abs(u) <= strength + 1e-6).all()
    for k in np.flatnonzero(np.abs(np.diff(x)) > 1e-7):
        assert abs(abs(u[k]) - strength) < 1e-5


@given(st.lists(st.integers(0, 9), max_size=25))
@settings(max_examples=150, deadline=None)
def test_longest_chain(a):
    chain = K.longest_chain(np.array(a, np.int64))
    assert (np.diff(np.array(a)[chain]) >= 0).all() and (np.diff(chain) > 0).all()
    best = []
    for i, v in enumerate(a):
        best.append(1 + max((best[j] for j in range(i) if a[j] <= v), default=0))
    assert len(chain) == max(best, default=0)


def tables(c, open_, extend, drop, threshold, protected, amerce, free):
    n, m = c.shape
    match, skip = np.full((n, m), np.inf), np.full((n, m), np.inf)
    match[:, 0] = c[:, 0]
    best = lambda i, k: min(match[i, k], skip[i, k]) if i >= 0 else np.inf
    for i in range(n):
        for k in range(m):
            if k:
                held = threshold is not None and (c[:, k].min() <= threshold or (protected is not None and protected[k]))
                late = c[i, k] + k * drop if free and not (protected is not None and protected[:k].any()) else np.inf
                match[i, k] = min(c[i, k] + best(i - 1, k - 1), c[i, k] + best(i, k - 1) + amerce, c[i, k] + best(i - 1, k) + amerce, (np.inf if held else drop) + best(i, k - 1), late)
                if i:
                    skip[i, k] = min(match[i - 1, k] + open_, skip[i - 1, k] + extend)
    return match, skip


@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 10_000), st.booleans(), st.booleans(), st.booleans(), st.booleans())
@settings(max_examples=200, deadline=None)
def test_drop_alignment_tables(n, m, seed, guard, mask, amerce, free):
    rng = np.random.default_rng(seed)
    c = rng.random((n, m))
    how = (0.2, 0.02, 0.3, 0.3 if guard else None, rng.random(m) < 0.3 if mask else None, 0.04 if amerce else 0.0, free)
    a = K.drop_alignment(c, *how)
    match, skip = tables(c, *how)
    assert np.allclose(a.match, match) and np.allclose(a.skip, skip)
    rows = K.path(a)
    assert (np.diff(rows[rows >= 0]) >= 0).all()


def test_no_protection_is_the_guard():
    c = np.random.default_rng(3).random((9, 12))
    a, b = (K.drop_alignment(c, 0.2, 0.02, 0.3, 0.3, p) for p in (None, np.zeros(12, bool)))
    assert (a.match == b.match).all() and (K.path(a) == K.path(b)).all()


def test_excision_is_found():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(200, 16)), 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dub = np.concatenate([x[:80], x[110:]])
    rows = K.path(K.drop_alignment(1 - x @ dub.T, 0.2, 0.02, 0.3, 0.3))
    assert (rows[:79] == np.arange(79)).mean() > 0.95 and (rows[82:] == np.arange(112, 200)).mean() > 0.95


@given(values, st.floats(0.1, 10))
@settings(max_examples=100, deadline=None)
def test_polyline_stays_near(y, tolerance):
    t = np.arange(len(y), dtype=float)
    k = K.polyline(t, y, tolerance)
    assert k[0] == 0 and k[-1] == len(y) - 1
    assert (np.abs(np.interp(t, t[k], y[k]) - y) <= tolerance + 1e-9).all()


def test_segments_and_caps():
    t = np.arange(60.0)
    y = np.where(t < 30, 0.1 * t, 9 - 0.05 * t)
    assert K.segments(t, y, np.ones(60), 1.0, 5) == [(0, 30), (30, 60)]
    capped = K.rate_capped(t, np.where(t < 30, 0.0, 10.0), 1.0)
    assert (np.abs(np.diff(capped)) <= 1 + 1e-9).all()


def test_merged_cuts_compare_with_the_last_kept():
    assert list(K.merged_cuts(np.array([0.0, 10.0, 20.0]), np.array([1.0, 5.0, 3.0]), 15.0)) == [1]
