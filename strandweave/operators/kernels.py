"""Recurrences on NumPy arrays: small helpers for the grouped operators of `sequences`. No Spark here.

Conventions of the dynamic programs: rows are reference frames, columns dub frames; moves are tried in the order
diagonal, horizontal, vertical, drop of the dub frame, (late) start, and only a strictly better one replaces another; between the
two states at a cell the match wins ties.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

DIAGONAL, HORIZONTAL, VERTICAL, DROP, START, LATE = range(6)


def longest_chain(values: np.ndarray) -> np.ndarray:
    """Positions of a longest non-decreasing subsequence (patience piles)."""
    tops: list[float] = []
    at: list[int] = []
    before = np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        k = bisect_right(tops, v)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1], np.int64)


class Alignment:
    """Tables of a drop alignment: match and reference-drop costs, and the moves that made them."""

    def __init__(self, match, skip, move, extended, n_rows, n_cols):
        self.match, self.skip, self.move, self.extended, self.n_rows, self.n_cols = match, skip, move, extended, n_rows, n_cols

    @property
    def cost(self) -> float:
        return float(np.minimum(self.match[:, -1], self.skip[:, -1]).min())


def drop_alignment(cost: np.ndarray, open_: float, extend: float, drop: float, threshold: float | None = None, protected: np.ndarray | None = None, amerce: float = 0.0, free_start: bool = False) -> Alignment:
    """Alignment with affine reference drops and flat dub drops, by anti-diagonals.

    threshold: a column whose least cost is at most this may not be dropped; protected: nor may these (which also rules out a late start past one of them);
    amerce: added to both warping moves; free_start: a path may begin at a later column, having dropped those before.
    """
    n, m = cost.shape
    inf = np.inf
    match, skip = np.full((n, m), inf), np.full((n, m), inf)
    move = np.full((n, m), START, np.int8)
    extended = np.zeros((n, m), bool)
    dropping = np.full(m, float(drop))
    if threshold is not None:
        dropping[cost.min(0) <= threshold] = inf
        if protected is not None:
            dropping[protected] = inf
    late = np.full(m, inf)
    if free_start:
        late = np.arange(m) * float(drop)
        if protected is not None and protected.any():
            late[np.flatnonzero(protected)[0] + 1 :] = inf
    match[:, 0] = cost[:, 0]
    for s in range(1, n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n - 1, s - 1) + 1)  # column 0 is done
        k = s - i
        c = cost[i, k]
        left = np.minimum(match[i, k - 1], skip[i, k - 1])
        up_i = np.maximum(i - 1, 0)
        no_row = i == 0
        diagonal = np.where(no_row, inf, np.minimum(match[up_i, k - 1], skip[up_i, k - 1]))
        above = np.where(no_row, inf, np.minimum(match[up_i, k], skip[up_i, k]))
        tried = np.stack([c + diagonal, c + left + amerce, c + above + amerce, dropping[k] + left, np.where(k > 0, c + late[k], inf)])
        best = tried.argmin(0)  # the first of equals
        match[i, k] = tried[best, np.arange(len(i))]
        move[i, k] = np.where(best == 4, LATE, best)
        opened, longer = match[up_i, k] + open_, skip[up_i, k] + extend
        skip[i, k] = np.where(no_row, inf, np.minimum(opened, longer))
        extended[i, k] = ~no_row & (longer < opened)
    return Alignment(match, skip, move, extended, n, m)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that of b, summed from the first dimension on as functions.vector.cosine does; nan where a side is zero."""
    ab = aa = bb = np.zeros(len(a))
    for k in range(a.shape[1]):
        ab, aa, bb = ab + a[:, k] * b[:, k], aa + a[:, k] * a[:, k], bb + b[:, k] * b[:, k]
    n = np.sqrt(aa) * np.sqrt(bb)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, ab / n, np.nan)


def with_prior(cost: np.ndarray, off_line: np.ndarray, strength: float, low: float, high: float, frames: int) -> np.ndarray:
    """Costs less each column's least, plus strength times the distance from the draft line, by how weak the columns around match: fully below `low`, not at all above `high`."""
    least = cost.min(0)
    signal = 1 - least
    if len(signal) > frames:
        signal = np.convolve(signal, np.full(frames, 1 / frames), "same")
    weak = np.clip((high - signal) / (high - low), 0, 1)
    return cost - least + strength * weak * np.abs(off_line)


def flat_alignment(cost: np.ndarray, drop: float) -> Alignment:
    """Alignment with one flat cost for dropping a frame of either side."""
    n, m = cost.shape
    inf = np.inf
    match = np.full((n, m), inf)
    move = np.full((n, m), START, np.int8)
    match[:, 0] = cost[:, 0]
    for s in range(1, n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n - 1, s - 1) + 1)
        k = s - i
        c, up_i, no_row = cost[i, k], np.maximum(i - 1, 0), i == 0
        diagonal, above, left = np.where(no_row, inf, match[up_i, k - 1]), np.where(no_row, inf, match[up_i, k]), match[i, k - 1]
        tried = np.stack([c + diagonal, c + left, c + above, drop + left, drop + above])
        best = tried.argmin(0)
        match[i, k] = tried[best, np.arange(len(i))]
        move[i, k] = best
    return Alignment(match, np.full((n, m), inf), move, np.zeros((n, m), bool), n, m)


def flat_path(a: Alignment, first_row: int = 0) -> np.ndarray:
    """Row of each column (-1: dropped) of the cheapest path of a flat alignment; the first column is always assigned."""
    rows = np.full(a.n_cols, -1, np.int64)
    i, k = int(a.match[:, -1].argmin()), a.n_cols - 1
    while k > 0:
        step = a.move[i, k]
        if step in (DIAGONAL, HORIZONTAL, VERTICAL):
            rows[k] = max(rows[k], i)
        i, k = i - (step in (DIAGONAL, VERTICAL, 4)), k - (step in (DIAGONAL, HORIZONTAL, DROP))
    rows[0] = i
    return np.where(rows >= 0, rows + first_row, -1)


def path(a: Alignment, first_row: int = 0) -> np.ndarray:
    """Row of each column (-1: dropped) of the cheapest path; where a column meets several rows, the lowest."""
    rows = np.full(a.n_cols, -1, np.int64)
    i = int(np.minimum(a.match[:, -1], a.skip[:, -1]).argmin())
    k, skipping, started = a.n_cols - 1, a.skip[i, -1] < a.match[i, -1], False
    while k > 0 and not started:
        if skipping:
            skipping = bool(a.extended[i, k])
            i -= 1
            continue
        step = a.move[i, k]
        if step != DROP:
            rows[k] = i
        if step == LATE:
            started = True
            break
        i, k = i - (step in (DIAGONAL, VERTICAL)), k - (step in (DIAGONAL, HORIZONTAL, DROP))
        skipping = bool(a.skip[i, k] < a.match[i, k])
    if not started and not skipping:
        rows[0] = i
    return np.where(rows >= 0, rows + first_row, -1)


def total_variation(y: np.ndarray, strength: float) -> np.ndarray:
    """argmin of half the squared distance to y plus strength times the total variation.

    Forward pass over the derivative of the cost-to-go, a piecewise linear function kept as knots in two ends of an array; clipped to +-strength, it gives each
    value's bounds, and the backward pass clips (dynamic programming over value functions).
    """
    n = len(y)
    if n < 2 or strength <= 0:
        return np.array(y, float)
    x, slope, level = np.empty(2 * n + 2), np.empty(2 * n + 2), np.empty(2 * n + 2)
    low, high = np.empty(n - 1), np.empty(n - 1)
    lo, hi = n, n + 1
    low[0], high[0] = y[0] - strength, y[0] + strength
    x[lo], slope[lo], level[lo] = low[0], 1.0, -y[0] + strength
    x[hi], slope[hi], level[hi] = high[0], -1.0, y[0] + strength
    first, rest, last = (1.0, -y[1] - strength), 1.0, (-1.0, y[1] - strength)
    for k in range(1, n - 1):
        a, b = first
        j = lo
        while j <= hi and a * x[j] + b <= -strength:
            a, b, j = a + slope[j], b + level[j], j + 1
        c, d = last
        t = hi
        while t >= j and -(c * x[t] + d) >= strength:
            c, d, t = c + slope[t], d + level[t], t - 1
        lo, hi = j - 1, t + 1
        low[k], high[k] = (-strength - b) / a, (strength + d) / -c
        x[lo], slope[lo], level[lo] = low[k], a, b + strength
        x[hi], slope[hi], level[hi] = high[k], c, d + strength
        first, last = (1.0, -y[k + 1] - strength), (-1.0, y[k + 1] - strength)
    a, b = first
    j = lo
    while j <= hi and a * x[j] + b <= 0:
        a, b, j = a + slope[j], b + level[j], j + 1
    out = np.empty(n)
    out[-1] = -b / a
    for k in range(n - 2, -1, -1):
        out[k] = min(max(out[k + 1], low[k]), high[k])
    return out


#: Rows of a block of earlier cuts, and blocks of a group, that `segments` rules out by one bound.
_BLOCK, _GROUP = 128, 64


def segments(t: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, least: int) -> list[tuple[int, int]]:
    """Optimal partition into weighted least-squares lines of at least `least` rows (the first may be shorter), each costing `penalty`.

    A line's error is never less than that of its parts together. So no earlier cut i of a block that ends at b gives row j less than min(best[i] + error(i, b)) + penalty + error(b, j), and the
    block goes unread where that exceeds what a known cut gives; groups of blocks likewise. `least` rows at a time, as they don't hang on one another.
    """
    n = len(t)
    if n == 0:
        return []
    t = t - t.mean()
    sums = np.stack([np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * t, w * y, w * t * t, w * t * y, w * y * y)], 1)

    def error(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s, st, sy, stt, sty, syy = np.moveaxis(sums[j] - sums[i], -1, 0)
        det = s * stt - st * st
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(det > 1e-12, (s * sty - st * sy) / det, 0.0)
            level = np.where(s > 0, (sy - slope * st) / s, 0.0)
        return np.maximum(syy - slope * sty - level * sy, 0.0)

    best, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    first = np.arange(1, min(n, max(least, 1) - 1) + 1)
    best[first] = best[0] + penalty + error(np.zeros(1, np.int64), first)
    # more than what rounding of the sums moves a bound by; with weights below zero it is none
    slack = np.inf if (w < 0).any() else 1e-3 * abs(penalty) + 1e-9 * sums[-1, 5]
    step, low, low_group = max(least, 1), [], []
    for p in range(step, n + 1, step):
        j = np.arange(p, min(p + step, n + 1))
        done = max(0, (p - least + 1) // _BLOCK)  # blocks whose cuts all rows of j may take
        while len(low) < done:
            b = (len(low) + 1) * _BLOCK - 1
            low.append((best[b - _BLOCK + 1 : b + 1] + error(np.arange(b - _BLOCK + 1, b + 1), b)).min())
            if len(low) % _GROUP == 0:
                ends = np.arange(len(low) - _GROUP + 1, len(low) + 1) * _BLOCK - 1
                low_group.append((np.array(low[-_GROUP:]) + error(ends, b)).min())
        given = np.unique(cut[max(0, p - step) : p])
        given = given[given <= p - least]
        bound = (best[given, None] + penalty + error(given[:, None], j)).min(0) + slack if len(given) else np.full(len(j), np.inf)
        groups = np.arange(len(low_group))
        ends = (groups + 1) * _GROUP * _BLOCK - 1
        open_ = ~(np.array(low_group)[:, None] + penalty + error(ends[:, None], j) > bound).all(1) if len(groups) else np.zeros(0, bool)
        blocks = np.concatenate([(groups[open_, None] * _GROUP + np.arange(_GROUP)).ravel(), np.arange(len(groups) * _GROUP, done)])
        ends = (blocks + 1) * _BLOCK - 1
        if len(blocks):
            blocks = blocks[~(np.array([low[k] for k in blocks])[:, None] + penalty + error(ends[:, None], j) > bound).all(1)]
        i = np.concatenate([(blocks[:, None] * _BLOCK + np.arange(_BLOCK)).ravel(), np.arange(done * _BLOCK, max(j[-1] - least, 0) + 1)])
        left, least_of = np.full(len(j), np.inf), np.zeros(len(j), np.int64)
        for at in range(0, len(i), 8 * _BLOCK * _GROUP):  # bounded, should nothing be ruled out
            part = i[at : at + 8 * _BLOCK * _GROUP, None]
            total = np.where(part <= np.maximum(j - least, 0), best[part] + penalty + error(part, j), np.inf)
            k = total.argmin(0)
            now = total[k, np.arange(len(j))]
            less = (now < left) | (np.isnan(now) & ~np.isnan(left))
            left, least_of = np.where(less, now, left), np.where(less, part[k, 0], least_of)
        best[j], cut[j] = left, least_of
    out, j = [], n
    while j > 0:
        out.append((int(cut[j]), j))
        j = int(cut[j])
    return out[::-1]


def polyline(t: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions kept so that the polyline through them stays within `tolerance` of every point (the furthest point splits)."""
    keep = {0, len(t) - 1}
    spans = [(0, len(t) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        rise = 0.0 if t[b] == t[a] else (y[b] - y[a]) / (t[b] - t[a])
        off = np.abs(y[a : b + 1] - y[a] - rise * (t[a : b + 1] - t[a]))
        k = a + int(off.argmax())
        if off[k - a] > tolerance:
            keep.add(k)
            spans += [(a, k), (k, b)]
    return np.array(sorted(keep), np.int64)


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    if not len(x):
        return 0.0
    order = np.argsort(x, kind="stable")
    c = np.cumsum(w[order])
    return float(x[order][np.searchsorted(c, c[-1] / 2)]) if c[-1] > 0 else float(np.median(x))


class RunningMedian:
    """weighted_median() of the rows added so far, row after row, of x with positive weights w: sums of weights by rank in a binary indexed tree.

    The tree adds in another order, so a sum that is half of the total but for rounding counts as half, where weighted_median() goes by the rounded sum.
    """

    def __init__(self, x: np.ndarray, w: np.ndarray) -> None:
        self.x, self.w, self.n = x, w.tolist(), len(x)
        self.order = np.argsort(x, kind="stable")
        rank = np.empty(self.n, np.int64)
        rank[self.order] = np.arange(self.n)
        self.rank, self.top = rank.tolist(), 1 << max(0, self.n.bit_length() - 1)
        self.tree = [0.0] * (self.n + 1)
        self.rows: list[int] = []
        self.total = 0.0

    def clear(self) -> None:
        for i in self.rows:
            k = self.rank[i] + 1
            while k <= self.n and self.tree[k]:
                self.tree[k] = 0.0
                k += k & -k
        self.rows, self.total = [], 0.0

    def add(self, i: int) -> None:
        k, v = self.rank[i] + 1, self.w[i]
        self.rows.append(i)
        self.total += v
        while k <= self.n:
            self.tree[k] += v
            k += k & -k

    def median(self) -> float:
        # sums within a rounding of half the total are half of it
        half, at, step, low = self.total / 2 * (1 - 1e-12), 0, self.top, 0.0
        while step:
            to = at + step
            if to <= self.n and low + self.tree[to] < half:
                at, low = to, low + self.tree[to]
            step >>= 1
        return float(self.x[self.order[min(at, self.n - 1)]])


def smoothed(y: np.ndarray, sigma: float) -> np.ndarray:
    """y under a Gaussian of sigma rows cut at 4 sigma, its ends held. What of the kernel lies beyond both ends is one weight each, and long kernels go by Fourier transforms."""
    n, reach = len(y), int(4 * sigma + 0.5)
    near = min(reach, n)
    kernel = np.exp(-0.5 * (np.arange(-near, near + 1) / sigma) ** 2)
    beyond = 0.0
    if reach > near:  # each side's rest, by the middle of its rows
        steps = np.linspace(near + 0.5, reach + 0.5, 100_001) if reach - near > 100_000 else np.arange(near + 0.5, reach + 1.0)
        middle = (steps[:-1] + steps[1:]) / 2
        beyond = float((np.exp(-0.5 * (middle / sigma) ** 2) * np.diff(steps)).sum())
    padded = np.pad(y, near, mode="edge")
    if len(kernel) * n <= 50_000_000:
        inside = np.convolve(padded, kernel, "valid")
    else:
        size = 1 << (len(padded) + len(kernel) - 1).bit_length()
        level = float(y.mean())  # less the mean, fewer digits are lost
        inside = np.fft.irfft(np.fft.rfft(padded - level, size) * np.fft.rfft(kernel, size), size)[2 * near : 2 * near + n] + level * kernel.sum()
    return (inside + beyond * (y[0] + y[-1])) / (kernel.sum() + 2 * beyond)


def rate_capped(t: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """y with no step faster than `rate` in t: forwards from the first value, then backwards from the last."""
    out = y.astype(float).copy()
    for order in (range(1, len(y)), range(len(y) - 2, -1, -1)):
        for i in order:
            j = i - 1 if order.step > 0 else i + 1
            room = rate * abs(t[i] - t[j])
            out[i] = min(max(out[i], out[j] - room), out[j] + room)
    return out


def merged_cuts(t: np.ndarray, v: np.ndarray, apart: float) -> np.ndarray:
    """Positions of cuts kept, in order of t: one nearer than `apart` to the last kept replaces it if larger, else goes."""
    kept: list[int] = []
    for i in np.argsort(t, kind="stable"):
        if kept and t[i] - t[kept[-1]] < apart:
            if abs(v[i]) > abs(v[kept[-1]]):
                kept[-1] = int(i)
        else:
            kept.append(int(i))
    return np.array(kept, np.int64)
