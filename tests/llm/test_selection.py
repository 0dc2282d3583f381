"""Hard negatives, best-fit packing and importance resampling against brute force."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strandweave.llm import best_fit, hard_negatives, importance
from strandweave.llm.word_bpe import word_bpe
from tests.llm.test_text import AWKWARD, library


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    words = "the of and Thin erou hath was reed Onti scum über née 日本 a1b2 it's don't x²".split()
    texts = AWKWARD + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    rows = [(i, t, "n", i, False) for i, t in enumerate(texts)] + [(20, texts[20], "n", 1, True), (21, "another text", "n", 2, True), (None, texts[30], "n", 3, False), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, ids long, target boolean").repartition(5)  # clashing names


def by_best_fit(lengths, window):
    """The rooms left by plain best fit, decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else window
        bisect.insort(rooms, room - n)
    return rooms


@pytest.mark.parametrize("window", [7, 16, 50, 128])
def test_plan_is_best_fit(window):
    rnd = random.Random(window)
    for _ in range(60):
        lengths = [rnd.randint(1, window) if rnd.random() < 0.7 else rnd.choice([1, 2, window // 2, window]) for _ in range(rnd.randint(0, 300))]
        runs = best_fit.plan(Counter(lengths), window)
        assert len(runs) <= 2 * window * (math.log2(window) + 2)
        placed, seen = {}, Counter()
        for length, first, last, each, sequence, offset in runs:
            assert first == seen[length]
            seen[length] = last
            for k in range(last - first):
                placed.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        assert seen == Counter(lengths)
        ends = [0] * len(placed)
        for s, pieces in placed.items():
            for at, n in sorted(pieces):
                assert at == ends[s]  # gapless from 0
                ends[s] += n
        assert sorted(window - e for e in ends) == by_best_fit(lengths, window)


def test_word_bpe_is_the_librarys():
    t, own, rnd = library("word_bpe_49k.json"), word_bpe("word_bpe_49k.json"), random.Random(4)
    odd = ["it's He'll 'S 's'd don't I'M", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|x", "é. È! ñandú?) œuvre; x²). ½ª ≠ .̸ ΑΣ. ΟΔΟΣ,", "a\r\nb\x0bc\x85d e\x1cf\x01g", "İstanbul. ß. ÀÉ: Ⱥ ×÷", "1234,5'678", "🙂.🙂 hi🙂.", "x" * 9000, "aaaa" * 500 + "!" * 300, "\n \t lead", "&lt;p&gt;--==__..."]
    letters = list("abcdefghijklmnopqrstuvwxyzéèüñ") + list("'.,-!?  \n\t019_")
    texts = [x or "" for x in AWKWARD] + odd + [a + b for a in odd for b in odd if len(a + b) < 200] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 300))) for _ in range(3000)]
    got = own.encode(texts)
    assert [np.frombuffer(x, own.kind).tolist() for x in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("window", "tokenizer"), [(4096, "word_bpe_49k.json"), (64, "word_bpe_49k.json"), (100, "byte_bpe_50k.json")])
def test_best_fit(docs, window, tokenizer):
    t = library(tokenizer)
    pieces = best_fit.best_fit(docs, window, tokenizer).collect()
    want, lengths = Counter(), []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), window)):
            want[r.doc_id, k, a, tuple(ids[a : a + window])] += 1
            lengths.append(len(ids[a : a + window]))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in pieces) == want
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(window - e for e in ends.values()) == by_best_fit(lengths, window)
    digests = Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in best_fit.best_fit_digests(docs, window, tokenizer).collect())
    assert digests == Counter((r.doc_id, r.piece, r.start, zlib.crc32(r.ids)) for r in pieces)


def test_best_fit_of_nothing(spark):
    assert best_fit.best_fit(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words_of(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " " for c in text or "")
    return fold.split(" ")


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 37, 25), (3, 500, 100)])
def test_resampled(spark, docs, longest, buckets, percent):
    target = spark.createDataFrame([("The thin, thin hath",), (None,), ("née 日本 was Was",), ("",)], "text string")
    runs = {}

    def features(text):
        w = [x for x in words_of(text) if x]
        return len(w), Counter(" ".join(w[i : i + j]) for j in range(1, longest + 1) for i in range(len(w) - j + 1))

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    rows = [(r.doc_id, *features(r.text)) for r in docs.collect()]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        for x, n in f.items():
            s[bucket(x)] += n
    for r in target.collect():
        for x, n in features(r.text)[1].items():
            t[bucket(x)] += n
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    scored = []
    for doc_id, n, f in rows:
        weight = sum(k * gain[bucket(x)] for x, k in f.items())
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    want = Counter((*x[:4], None) for x in scored)
    for k, x in enumerate(able[: len(able) * percent // 100]):
        want[*x[:4], None] -= 1
        want[*x[:4], k + 1] += 1
    got = importance.resampled(docs, target, longest, buckets, percent=percent)
    assert Counter(tuple(r) for r in got.collect()) == +want, runs


@pytest.mark.parametrize("longest", [1, 2])
def test_resampled_in_many_blocks(spark, docs, longest, monkeypatch):
    """Blocks of a few documents each give the rows that one block gives."""
    target = spark.createDataFrame([("The thin hath née was reed",)], "text string")
    whole = Counter(tuple(r) for r in importance.resampled(docs.coalesce(1), target, longest, 300).collect())
    monkeypatch.setattr(importance, "BLOCK_BYTES", 900)
    monkeypatch.setattr(importance, "SLICE_BYTES", 400)
    assert importance.cut(docs.coalesce(1).selectExpr("doc_id", "coalesce(text, '') as text", "false as target")).select("block").distinct().count() > 10
    assert Counter(tuple(r) for r in importance.resampled(docs.coalesce(1), target, longest, 300).collect()) == whole


def test_resampled_of_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, docs.select("text")).count() == 0
    assert importance.resampled(docs, none.select("text"), percent=50).filter("rank is not null").count() > 0


def mined_by_hand(rows, positives, negatives):
    """rows: (id, label, whole numbers); Python's integers."""
    anchors = {}
    for i, label, v in rows:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = Counter()
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            for k, x in enumerate(fits):
                out[a, p, k + 1, x[1], -s, -x[0]] += 1
    return out


@pytest.mark.parametrize(("size", "pivots", "sample", "slots"), [(1, 256, 2048, 512), (1, 9, 16, 20), (1e6, 4, 32, 40)])
def test_hard_negatives(spark, size, pivots, sample, slots):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    x = [size * (centres[i % 5] + rng.normal(size=8) * (0.02 if i < 200 else 0.6)) for i in range(500)]
    x = [[float(np.float32(c)) for c in v] for v in x]
    data = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(x)]
    data += [(500 + i, x[7], i % 3) for i in range(250)]  # copies, and ties
    data += [(750, None, 1), (760, x[1], None), (770, [float("nan")] * 8, 1), (780, [None] * 8, 1), (790, [float("inf")] * 8, 1), (800, [0.0] * 8, 2), (810, [1.0, 2.0], 1), (811, [1.0, 2.0], 1), (812, [1.0, 1.0], 0)]
    data += [(820, [], 1), (None, x[2], 1), (10, x[11], 0), (3, x[3], data[3][2]), (900, [3e30] * 8, 1)]
    rows = spark.createDataFrame([(*r, "x", 1) for r in data], "vec_id long, embedding array<float>, label int, dim string, cell int").repartition(4)
    whole = hard_negatives.whole_numbers(rows)
    kept = [(r.vec_id, r.label, [int(c) for c in r.v]) for r in whole.collect()]
    assert {k for k, _, _ in kept} == {i for i, v, label in data if i is not None and i not in {750, 760, 770, 780, 790, 900}}
    assert all(v == [math.floor(256 * c) for c in dict((i, e) for i, e, _ in data)[i]] for i, _, v in kept if i not in {3, 10})
    got = hard_negatives.mined(whole.filter("vec_id % 10 = 0"), whole, 3, 6, pivots=pivots, sample_rows=sample, block_bytes=1500, group_slots=slots)
    assert Counter(tuple(r) for r in got.collect()) == mined_by_hand(kept, 3, 6)


def test_hard_negatives_of_nothing(spark):
    none = hard_negatives.whole_numbers(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert hard_negatives.mined(none, none).count() == 0
