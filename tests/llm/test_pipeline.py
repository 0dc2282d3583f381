"""The pipeline's stages against brute force on what each was given."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandweave.llm import quality, simhash, toxicity
from strandweave.llm.common import scratch, stored
from strandweave.session import shared_folder
from tests.llm.test_text import library, one_apart, roots

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def deduped(docs):
    """Texts of documents (id, key, text), in order, without lines equal to an earlier one, or of five words or more and a word from one."""
    seen, by_size, out = set(), {}, {}
    for d, key, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        left = []
        for line in text.split("\n"):
            words = line.split(" ")
            if line:
                near = len(words) >= 5 and any(one_apart(words, v) for n in (-1, 0, 1) for v in by_size.get(len(words) + n, ()))
                if line in seen or near:
                    if line not in seen:
                        seen.add(line)
                        by_size.setdefault(len(words), []).append(words)
                    continue
                seen.add(line)
                if len(words) >= 5:
                    by_size.setdefault(len(words), []).append(words)
            left.append(line)
        out[d, key] = "\n".join(left)
    return out


def plain_hits(lexicon, folded):
    """Lexicon.hits without an automaton: every term tried at every place."""
    best = {}
    for term, w in lexicon.weights.items():
        at = folded.find(term)
        while at >= 0:
            if w > best.get(at, 0.0):
                best[at] = w
            at = folded.find(term, at + 1)
    for phrase in lexicon.exceptions:
        at = folded.find(phrase)
        while at >= 0:
            for k in [k for k in best if at <= k < at + len(phrase) - 1]:  # its last space begins the next word
                del best[k]
            at = folded.find(phrase, at + 1)
    return sum(best.values())


def test_lexicon_against_plain_search():
    rnd = random.Random(1)
    words = ["ab", "abc", "abcd", "abcde", "b", "bcd", "can", "trash"]
    for _ in range(300):
        terms = {rnd.choice([f" {w} ", f" {w}"]): rnd.randint(1, 9) / 2 for w in rnd.sample(words, 4)}
        lexicon = toxicity.Lexicon(terms, [f" {rnd.choice(words)} {rnd.choice(words)} " for _ in range(2)])
        text = toxicity.folded(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))))
        assert abs(lexicon.hits(text) - plain_hits(lexicon, text)) < 1e-12


def test_features_against_plain_zstandard():
    import zstandard

    rnd = random.Random(2)
    blocks = [" ".join(rnd.choice("the river ran past old walls".split()) for _ in range(80)).encode() for _ in range(80)]
    good, bad = quality.dictionary(blocks), quality.dictionary([b[::-1] for b in blocks])
    for text in ("", "the river", "x" * 5000, " ".join(rnd.choice("the river ran é".split()) for _ in range(900))):
        raw = text.encode()
        parts = [raw[i : i + 1024] for i in range(0, len(raw), 1024)] or [b""]
        size = lambda d, b: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
        g, h = [size(good, b) for b in parts], [size(bad, b) for b in parts]
        want = [(sum(h) - sum(g)) / (sum(h) + sum(g)), min((y - x) / (y + x) for x, y in zip(g, h)), (len(raw) - sum(g)) / (len(raw) + sum(g))]
        assert quality.features(text, good, bad) == pytest.approx(want)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the operators' own names."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    odd = [(None, base[0][1], None, None, None), (None, None, "en", None, 0), (5000, None, None, "s", None), (5001, "", "en", "s", 0), base[3], base[3], (base[4][0], "other text of a shared id", "en", "s", 3), (5002, "long word " * 9000, "en", "s", 90_000), (5003, base[5][1], "en", "s", 1)]
    rows = [(*r, "row", i, 0.5, "key") for i, r in enumerate([*base, *odd])]
    rows[-4] = rows[-5]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, k int, score double, doc_key string").repartition(4)


def test_stages(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for given in (docs, awkward):
        columns, kept = given.columns, given
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        rules = {"toxicity": (toxicity, lambda s: s < 0.5), "quality": (quality, lambda s: s >= 0.5)}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            new = stored(stage(spark, kept, SF), f"test-{name}")
            assert new.columns == columns
            before, after = ([tuple(r) for r in d.collect()] for d in (kept, new))
            if name in rules:
                of, keep = rules[name]
                scorer = of.fit(kept, labels)
                want = [r for r in before if keep(scorer([r[1] or ""])[0])]
                assert sorted(after, key=repr) == sorted(want, key=repr)
            else:
                key = {r[0]: r[1] for r in kept.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect()}
                if name == "line_dedup":
                    texts = deduped({(r[0], key[r[1] or ""], r[1] or "") for r in before})
                    made = {r: texts[r[0], key[r[1] or ""]] for r in before}
                    want = [(r[0], made[r], r[2], r[3], len(made[r]), *r[5:]) for r in before]
                    assert sorted(after, key=repr) == sorted(want, key=repr)
                else:
                    documents = sorted({(r[0] is not None, r[0] or 0, key[r[1] or ""], r[1] or "") for r in before})
                    fp = {t: simhash.fingerprint(t, 5) for *_, t in documents}
                    nodes = sorted(set(fp.values()))
                    root = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and bin(a ^ b).count("1") <= 2])
                    first = {}
                    for d in documents:
                        first.setdefault(root[fp[d[3]]], d)
                    assert sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in after)) == sorted((has, d, t) for has, d, _, t in first.values())
                    assert set(after) <= set(before)
            kept = new
        pieces = corpus_pipeline.packing_stage(spark, kept, SF).collect()
        held_once(pieces, [(r.doc_id, r.text or "") for r in kept.collect()])
    assert {p.doc_id for p in corpus_pipeline.run(spark, SF).collect()} <= {r.doc_id for r in docs.collect()}


def held_once(pieces, docs):
    """Each id of each document in one piece, and sequences full to the last."""
    t = library("byte_bpe_50k.json")
    want = sorted(((-1 if d is None else d), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*t.encode(x, add_special_tokens=False).ids, 1]))) for d, x in docs if len(x) < 2000)
    whole = sorted(((-1 if p.doc_id is None else p.doc_id), p.ids_crc32) for p in pieces if p.length == p.doc_tokens)
    cut = [d for d, _ in want] and {(-1 if p.doc_id is None else p.doc_id) for p in pieces if p.length < p.doc_tokens}
    assert {x for x in want if x[0] not in cut} <= set(whole)
    at = {}
    for p in pieces:
        at.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(at) == list(range(len(at)))
    for k, parts in at.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or k == max(at)


def test_stages_of_nothing(spark, awkward):
    none = awkward.filter("doc_id = -7")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_scorers_on_awkward_rows(spark, awkward):
    """Fitted scorers: a score each, whatever is null or repeated, none of nothing; two fits score alike."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for of in (quality, toxicity):
        one, two = of.fit(docs, labels), of.fit(docs.repartition(7), labels)
        got = quality.score_texts(awkward, one).collect()
        assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
        texts = [r.text or "" for r in docs.collect()]
        assert one(texts).tolist() == two(texts).tolist()
        assert quality.score_texts(awkward.filter("doc_id = -7"), one).count() == 0


def test_scratch_is_removed(spark):
    """What a stage stores on its way goes, what is kept stays."""
    with scratch(spark):
        gone = stored(spark.range(3).toDF("a"), "gone")
        kept = stored(gone, "kept", keep=True)
    folder = shared_folder(spark).removeprefix("file:")
    names = {x.split("-")[0] for d, sub, _ in os.walk(folder) for x in sub}
    assert kept.count() == 3 and "kept" in names and "gone" not in names
