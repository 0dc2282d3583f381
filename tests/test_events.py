"""Events found from envelopes, the prior of an alignment, and classes of cuts against counts."""

import numpy as np
import pytest

from strandweave.operators import events, kernels, sequences


def table(spark, x, s="a", name="vec"):
    return spark.createDataFrame([(s, i, [float(c) for c in v]) for i, v in enumerate(x)], f"s string, frame long, {name} array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_prior_against_loops():
    rng = np.random.default_rng(1)
    cost, off = rng.uniform(size=(30, 25)), rng.integers(-9, 9, (30, 25))
    got = kernels.with_prior(cost, off, 2.0, 0.2, 0.9, 8)
    for k in range(25):
        near = [1 - cost[:, j].min() if 0 <= j < 25 else 0.0 for j in range(k - 4, k + 4)]
        weak = min(1, max(0, (0.9 - sum(near) / 8) / 0.7))
        assert np.allclose(got[:, k], cost[:, k] - cost[:, k].min() + 2.0 * weak * np.abs(off[:, k]))


def test_a_blind_zone_stays_on_the_line(spark):
    """Where nothing matches for 120 frames the path keeps to the line; with costs less each frame's least and no prior it wanders."""
    rng = np.random.default_rng(8)
    ref = unit(rng.normal(size=(400, 24)))
    dub = ref.copy()
    dub[140:260] = unit(rng.normal(size=(120, 24)))
    d, r = table(spark, dub), table(spark, ref)
    line = d.selectExpr("s", "frame as dub", "cast(0 as long) as off")
    how = {"chunk": 200, "overlap": 60, "margin": 30, "costs": (0.20, 0.02, 0.20), "threshold": 0.15, "amerce": 0.04}
    off = {}
    for prior in ((0.0, 0.2, 0.95, 40), (2.0, 0.2, 0.95, 40)):
        got = {x.dub: x.ref for x in sequences.align_chunks(d, r, line, ["s"], prior=prior, **how).collect()}
        off[prior[0]] = max(abs(got[k] - k) for k in range(165, 235) if got[k] is not None)
        assert all(got[k] == k for k in range(0, 110))
    assert off[0.0] > 2 and off[2.0] <= 1


def smooth(rng, n, bands):
    x = rng.normal(size=(n + 6, bands))
    return sum(x[k : n + k] for k in range(7)) / 7


@pytest.fixture(scope="module")
def envelopes(spark):
    """Half an hour would do; 240 s at 4 a second: one dub with 12 s of something else put in, one without 12 s, one that is the reference."""
    rng = np.random.default_rng(3)
    rate, n = 4, 960
    ref = smooth(rng, n, 8)
    dubs = {"in": np.concatenate([ref[:480], smooth(rng, 48, 8), ref[480:]]), "out": np.concatenate([ref[:480], ref[528:]]), "same": ref + 0.01 * rng.normal(size=ref.shape)}
    make = lambda rows: spark.createDataFrame(rows, "s string, frame long, bands array<double>")
    return make([(s, i, v.tolist()) for s in dubs for i, v in enumerate(ref)]), make([(s, i, v.tolist()) for s in dubs for i, v in enumerate(dubs[s])])


def test_two_scales(envelopes):
    ref, dub = envelopes
    found, curve = events.at_two_scales(ref, dub, ["s"], 4.0, short=3.0, long=6.0)
    got = {}
    for r in found.collect():
        got.setdefault(r.s, []).append((r.kind, r.tc, r.v, r.length))
    assert set(got) == {"in", "out"} and all(len(v) == 1 for v in got.values()), got
    kind, tc, v, _ = got["out"][0]
    assert kind == "excision" and abs(tc - 126) <= 8 and abs(abs(v) * 0.041708 - 12) <= 1
    kind, tc, _, length = got["in"][0]
    assert kind == "insertion" and abs(tc - 120) <= 8 and length >= 80 * 0.041708
    flat = [abs(r.shift) for r in curve.collect() if r.s == "same"]
    assert max(flat) < 3


def test_classified_against_counts(spark):
    rng = np.random.default_rng(9)
    match, cuts = [], []
    for s in range(30):
        ref = np.sort(rng.choice(200 if s % 3 else 50, size=160, replace=s % 2 == 0 or s % 3 == 0))
        match += [(s, d, int(r) if rng.random() < 0.9 else None) for d, r in enumerate(ref)]
        cuts += [(s, float(t), float(rng.normal() * 100), float(t), float(t + rng.integers(0, 8))) for t in rng.uniform(0, 95 if s % 3 else 20, 4)]
    got = {(r.s, round(r.tc, 6)): (r.kind, r.v, r.length) for r in events.classified(spark.createDataFrame(cuts, "s long, tc double, delta double, t_end double, t_nxt double"), spark.createDataFrame(match, "s long, dub long, ref long"), ["s"], 0.5, 20.0, 0.04).collect()}
    want = {}
    for s, tc, delta, a, b in cuts:
        refs = [r for k, _, r in match if k == s and r is not None]
        i = int(np.ceil(round(a / 0.5, 9)))
        j = max(int(np.ceil(round(b / 0.5, 9))), i + 1)
        gone = sum(f not in refs and min(refs) <= f <= max(refs) for f in range(i, j)) / (j - i)
        n = sum(i <= r < j for r in refs)
        length = max(0.5, (n - (j - i)) * 0.5)
        if gone >= 0.15 and abs(delta) >= 20:
            want[s, round(tc, 6)] = ("excision", delta, None)
        elif n / (j - i) >= 2 and length >= 0.8:
            want[s, round(tc, 6)] = ("insertion", None, length)
    assert got == want and {k for k, _, _ in got.values()} == {"excision", "insertion"}


def test_descriptors_made_in_their_chunks(spark, monkeypatch):
    """As from descriptors made before, with missing frames, groups of two chunks and a longer dub: frames are shuffled, descriptors aren't."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sequences, "GROUP", 100)
    rng = np.random.default_rng(4)
    x = smooth(rng, 900, 4)
    gone = {*range(300, 345), *rng.choice(900, 60).tolist()}
    made = lambda rows: spark.createDataFrame(rows, "s string, frame long, bands array<double>")
    ref, dub = made([("a", i, v.tolist()) for i, v in enumerate(x) if i not in gone]), made([("a", i + 16 * (i > 400), v.tolist()) for i, v in enumerate(np.concatenate([x, x[:40]]))])
    r, d = (events.descriptors(e, ["s"], 4.0, 3.0, 0.5, 6) for e in (ref, dub))
    assert all(sorted(map(tuple, events.numbers(e, ["s"], 12, 2).collect())) == sorted(map(tuple, v.select("s", "frame").collect())) for e, v in ((ref, r), (dub, d)))
    of = events.means(r, ["s"]).first()
    white = lambda v: v.withColumn("vec", F.zip_with(F.zip_with("vec", F.array(*map(F.lit, of["mean"])), lambda a, m: a - m), F.array(*map(F.lit, of["deviation"])), lambda a, s: a / (s + 1e-6)))
    last = r.agg(F.max("frame")).first()[0]
    line = d.select("s", F.col("frame").alias("dub"), (F.least("frame", F.lit(last)) - F.col("frame")).alias("off"))
    how = {"chunk": 60, "overlap": 20, "margin": 30, "costs": (0.20, 0.02, 0.20), "threshold": 0.15, "amerce": 0.04, "prior": (2.0, 0.20, 0.40, 40)}
    want = sequences.align_chunks(white(d), white(r), line, ["s"], cosines=True, **how).collect()

    def describe(f, x, n, given):
        from strandweave.operators import signal

        there, vec = signal.described(f.astype(float), x, n * 2 + 12, 12, 6)
        return (there - 12) // 2, (vec - np.asarray(given["mean"])) / (np.asarray(given["deviation"]) + 1e-6)

    given = spark.createDataFrame([("a", last, of["mean"], of["deviation"])], "s string, last long, mean array<double>, deviation array<double>")
    got = sequences.align_described(dub, ref, line, given, ["s"], 12, 2, describe, **how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr) and len(want) > 400
