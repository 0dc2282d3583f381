"""Operators on texts against brute force, the tokenizers library, and exact round trips."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import bpe, chat, line_dedup, packing, quality, simhash, token_counts, toxicity

AWKWARD = [None, "", " ", "\n\n", "a", "<|endoftext|>x<|endoftext|>", "don't  stop\t\tit's", "é́ß日本😀", "x" * 9000, "ab " * 4000, "\x1c \x85 \xa0", "<|startoftext|>A B"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    words = "the of and thin erou hath was reed Onti scum über née".split()
    texts = AWKWARD + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200))) for _ in range(40)]
    rows = [(i, t, "n", i) for i, t in enumerate(texts)] + [(20, texts[20], "n", 1), (21, "another text", "n", 2), (None, "no id", "n", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, doc_key string, ids long").repartition(5)  # clashing names


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library(name):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("long_chars", [1 << 18, 700])
def test_bpe_is_the_librarys(docs, long_chars):
    t = library("byte_bpe_50k.json")
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in bpe.encode_documents(docs, long_chars=long_chars, digests=True).collect()], want)
    texts = {(r.doc_id, r.decoded) for r in bpe.encode_documents(docs, long_chars=long_chars).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in docs.collect()}


def test_bpe_of_mixed_pieces():
    t, b, rnd = library("byte_bpe_50k.json"), bpe.byte_bpe("byte_bpe_50k.json"), random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "!", "<|endoftext|>", "\x1c", "\x85", "\xa0", "日本", "😀", "́", "\x00", "A" * 30, " the"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        assert b.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_tree_of_long_words():
    t, b, rnd = library("byte_bpe_50k.json"), bpe.byte_bpe("byte_bpe_50k.json"), random.Random(3)
    for text in ("ab" * 6000, "a" * 9000, "".join(rnd.choice("abcdefghij") for _ in range(20_000)), "é日" * 4000, " " * 9000 + "x"):
        assert b.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def long_texts(rnd):
    """Texts of several leaves: prose, runs of white space and signs, mixed scripts, special tokens, and stretches without spaces between them."""
    alphabet = ["a", "the ", " ", "  ", "\n", "\t", "'s", "é", "12", "!?", "\x1c", "\xa0", "日本", "😀", "word ", " erou hath", "<|endoftext|>"]
    yield " ".join(rnd.choice("the of and thin erou hath was reed Onti scum über née".split()) for _ in range(9000))
    yield "".join(rnd.choice(alphabet) for _ in range(30_000))
    yield "".join(rnd.choice(alphabet[:-1]) for _ in range(30_000))
    yield "x " * 3000 + "ab" * 7000 + " and then" * 2000 + "\n" * 5000 + "end" + "é日" * 4000 + " the end" * 900
    yield " " * 20_000 + "\t\n" * 3000 + "a b" * 5000


def test_joins_of_long_texts(spark):
    """Long texts go by halves that are joined, in a task and over tasks, and give the library's ids."""
    t, b = library("byte_bpe_50k.json"), bpe.byte_bpe("byte_bpe_50k.json")
    texts = list(long_texts(random.Random(8)))
    for text in texts:
        before = b.joins
        assert b.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
        assert "<|" in text or "ab" * 9 in text or " " * 5000 in text or b.joins - before >= len(text) // bpe.LEAF // 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(df, long_chars=5000).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_a_join_anywhere():
    t, b, rnd = library("byte_bpe_50k.json"), bpe.byte_bpe("byte_bpe_50k.json"), random.Random(9)
    ids = lambda x: np.array(t.encode(x, add_special_tokens=False).ids, b.kind)
    for text in long_texts(rnd):
        text = text.replace("<|endoftext|>", " ")
        for _ in range(25):
            a = rnd.randrange(max(1, len(text) - 800))
            part = text[a : a + rnd.randint(2, 800)]
            cut = rnd.randrange(len(part) + 1)
            assert b.join_texts(ids(part[:cut]), part[:cut], ids(part[cut:]), part[cut:]).tolist() == ids(part).tolist(), (part, cut)


def test_bpe_of_nothing(nothing):
    assert bpe.encode_documents(nothing).count() == 0 and bpe.encode_documents(nothing, digests=True).count() == 0


def test_token_counts_are_the_librarys(docs, nothing):
    t = library("word_bpe_49k.json")
    want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    same([tuple(r) for r in token_counts.count_tokens(docs, batch_bytes=4000).collect()], want)
    assert token_counts.count_tokens(nothing).count() == 0


def test_token_counts_of_mixed_pieces():
    t, own, rnd = library("word_bpe_49k.json"), token_counts.lengths("word_bpe_49k.json"), random.Random(4)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "é", "12", "!", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", "日本", "Σ", "İ", "́"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    assert own.count(texts, 1024) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_packing_holds_every_id_once(docs, nothing):
    t = library("byte_bpe_50k.json")
    sizes = {}
    for r in docs.collect():
        sizes.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces = packing.pack(docs, window=64).collect()
    by_sequence = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and any(p.doc_tokens == len(d) and d[p.start : p.start + p.length] == ids for d in sizes[p.doc_id])
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(by_sequence)
    assert sum(p.length for p in pieces) == sum(len(d) for ds in sizes.values() for d in ds)
    for p, q in zip(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), sorted(packing.pack_digests(docs, window=64).collect(), key=lambda p: (p.sequence_id, p.offset))):
        assert q.ids_crc32 == zlib.crc32(p.ids)
    assert packing.pack(nothing).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowded", [2, 64])
def test_simhash_components(spark, nothing, crowded):
    rnd = random.Random(7)
    base = rnd.getrandbits(64)
    near = [base ^ sum(1 << b for b in rnd.sample(range(12), rnd.randint(0, 5))) for _ in range(60)]
    fps = [*near, *(rnd.getrandbits(64) for _ in range(60)), 0, 3, 12, (1 << 64) - 1, (1 << 64) - 2]
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded).collect()}
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    true = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bits(a, b) <= 2}
    assert got <= true
    assert roots(signed, got) == roots(signed, true)


def test_simhash_broadcasts_no_exploded_rows(spark, monkeypatch, tmp_path):
    """The planner takes rows exploded to 33 cells and 65 neighbours to be as small as the fingerprints that they come from."""
    written = []
    monkeypatch.setattr(simhash, "stored", lambda df, name, keep=False: written.append(df) or df)
    spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long").write.parquet(f"{tmp_path}/fp")
    got = simhash.links(spark.read.parquet(f"{tmp_path}/fp"), 1)
    for df in [*written, got]:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_simhash_documents(docs, nothing):
    rows = docs.filter("doc_id is not null").collect()
    fp = {(r.doc_id, r.text): plain_fingerprint(r.text or "") for r in rows}
    keys = sorted({(f, d) for (d, _), f in fp.items()})
    nodes = sorted({f for f, _ in keys})
    root = roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for f, d in keys:
        least[root[f]] = min(d, least.get(root[f], d))
    want = [(r.doc_id, fp[r.doc_id, r.text], least[root[fp[r.doc_id, r.text]]]) for r in rows]
    got = simhash.near_duplicates(docs.filter("doc_id is not null")).collect()
    same([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], want)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


@pytest.mark.parametrize("words", [3, 5])
def test_simhash_keeps_one_document_of_each_group(spark, words):
    """Null and shared ids, repeated rows, ties, and columns with the operator's own names, against plain components."""
    rnd = random.Random(17)
    text = lambda n: " ".join(rnd.choice("abcdefghij") for _ in range(n))
    a, b = text(300), text(300)
    rows = [(5, a), (None, a), (None, b), (None, text(80)), (7, b + " j"), (7, text(50)), (7, text(50)), (3, ""), (4, None), (None, " "), (9, a), (9, a), (2, text(40)), (2, text(40))]
    df = spark.createDataFrame([(*r, i % 2 == 0, i, "f") for i, r in enumerate(rows)], "doc_id long, text string, has boolean, _first int, fp string").repartition(3)
    documents = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    fp = {t: simhash.fingerprint(t, words) for _, _, t in documents}
    nodes = sorted(set(fp.values()))
    root = roots(nodes, [(x, y) for x in nodes for y in nodes if x < y and bin(x ^ y).count("1") <= 2])
    key = {t: df.select(F.xxhash64(F.lit(t))).first()[0] for t in fp}
    want = {}
    for has, d, t in documents:
        want[root[fp[t]]] = min(want.get(root[fp[t]], (True, 1 << 60, 0, "")), (has, d, key[t], t))
    got = simhash.keep_first(df, words)
    assert got.columns == df.columns
    same([(r.doc_id, r.text or "") for r in got.collect()], [(d if has else None, t) for has, d, _, t in want.values()])
    whole = {(*rows[i], i % 2 == 0, i, "f") for i in range(len(rows))}
    assert {tuple(r) for r in got.collect()} <= whole


def test_simhash_of_null_ids(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (None, "x y z"), (6, "a b c d")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    same([(r.doc_id, r.component_id) for r in got.collect()], [(None, 4), (4, 4), (None, None), (6, 4)])


def units_of(text, least, most):
    for i, line in enumerate(text.split("\n")):
        words = line.split(" ")
        for w in [words] if len(line) < most else [words[j : j + most] for j in range(0, len(words), most)]:
            yield i, w


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("least, most", [(5, 16), (3, 8)])
def test_line_dedup(spark, least, most):
    rnd = random.Random(11)
    line = lambda: " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9)))
    rows = [(None if i == 7 else i, "\n".join(line() for _ in range(rnd.randint(0, 6)))) for i in range(50)]
    long = " ".join(rnd.choice("abcdefgh") for _ in range(60))
    rows += [(3, rows[3][1]), (5, "x y z w v u\na b c d a b"), (100, None), (101, ""), (102, long), (103, long + " zz"), (104, "a a b a a\na a a b a")]
    df = spark.createDataFrame([(*r, "kept as it is") for r in rows], "doc_id long, text string, place string")
    keys = {(r[0], r[1]): r[2] for r in df.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    seen, want = [], {}
    for d, key, text in sorted(((d, k, t) for (d, t), k in keys.items()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        left, exact, near = [], 0, 0
        for i, w in units_of(text, least, most):
            if len(w) >= least:
                is_exact, is_near = w in seen, any(one_apart(w, s) for s in seen)
                seen += [] if is_exact else [w]
                exact, near = exact + is_exact, near + (is_near and not is_exact)
                if is_exact or is_near:
                    continue
            left.append((i, " ".join(w)))
        new = "".join(("" if j == 0 else " " if left[j - 1][0] == i else "\n") + b for j, (i, b) in enumerate(left))
        want[d, text] = (new, exact, near)
    got = line_dedup.dedup_lines(df, least, most).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.text): (r.new_text, r.n_exact, r.n_near) for r in got} == want
    new = line_dedup.rewrite(df, least, most)
    assert new.columns == df.columns
    same([(r.doc_id, r.text, r.place) for r in new.collect()], [(d, want[d, t or ""][0], "kept as it is") for d, t in rows])


def test_line_dedup_of_short_lines(spark, nothing):
    """Equal ones go however short (or without spaces); near ones only from min_words on; empty lines stay."""
    rows = [(1, "Les.\n\na b c d e\n頁の行"), (2, "Les.\n\nLes!\na b c d\n頁の行"), (3, "a b c d\na b c d x\na b c"), (4, "Les.\n\na b c d e\n頁の行")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.new_text, r.n_units, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(df, short_lines=True).collect()}
    assert got == {1: (rows[0][1], 3, 0, 0), 2: ("\nLes!\na b c d", 4, 2, 0), 3: ("a b c", 3, 1, 1), 4: ("", 3, 3, 0)}
    assert {r.doc_id: r.text for r in line_dedup.rewrite(df, short_lines=True).collect()} == {k: v[0] for k, v in got.items()}
    assert line_dedup.dedup_lines(nothing, short_lines=True).count() == 0


def test_line_dedup_query_and_stage_take_short_lines(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [x for r in corpus_pipeline.line_dedup_stage(spark, docs, sf).collect() for x in r.text.split("\n") if x]
    assert len(seen) == len(set(seen))
    assert sum(r.n_chars for r in line_dedup.op9_line_dedup(spark, sf).collect()) == sum(r.n_chars for r in corpus_pipeline.line_dedup_stage(spark, docs, sf).collect())


@pytest.mark.parametrize("text_words", [1, 6, 256])
def test_line_dedup_of_whole_lines(spark, monkeypatch, text_words):
    """However long a line, one word set, put in or left out anywhere is near; held to the edit distance of whole lines."""
    monkeypatch.setattr(line_dedup, "TEXT_WORDS", text_words)
    rnd = random.Random(12)
    lines = [[rnd.choice("ab") for _ in range(rnd.randint(5, 8))] for _ in range(60)]
    for n in (254, 255, 256, 257, 300, 700):
        base = [rnd.choice("abcdefgh") for _ in range(n)]
        at = rnd.randrange(n)
        lines += [base, ["new", *base], base[1:], base[:-1], [*base, "new"], base[:at] + base[at + 1 :], [*base[:at], "new", *base[at + 1 :]]]
        lines += [["new", "new", *base], ["other", "x", *base[2:]], ["y", *base[1:], "z"], list(reversed(base))]
    # only the later of two is there: base itself isn't
    base = [rnd.choice("abcdefgh") for _ in range(400)]
    lines += [[*base[:9], *base[10:]], [*base[:9], "one", *base[10:]], [*base[:9], "two", *base[10:]]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    want = {i: "" if any(w == v or one_apart(w, v) for v in lines[:i]) else " ".join(w) for i, w in enumerate(lines)}
    assert {r.doc_id: r.new_text for r in line_dedup.dedup_lines(df, short_lines=True).collect()} == want


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_chat_escapes_are_exact():
    rnd = random.Random(0)
    bits = ["<", "|", "im_start", "|>", "\\", "<|im_end|>", "[INST]", "</s>", "\n", "a", "<\\|im_end|>", "<s>", "[", "/INST]"]
    for _ in range(20_000):
        t, u = ("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8))) for _ in range(2))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
        out, mask = chat.render([("user", t), ("assistant", u), ("odd\nrole\\", t)])
        assert chat.read_back(out) == [("user", t), ("assistant", u), ("odd\nrole\\", t)]
        assert [chat.unescape(out[a:b]) for a, b in mask] == [u]


def test_chat_folds_a_log(spark):
    log = [
        (1, 0, "message", "user", "hi", None), (1, 1, "start", "assistant", None, None), (1, 3, "delta", None, "lo", None), (1, 2, "delta", None, "hel", None), (1, 4, "regenerate", None, None, None), (1, 5, "delta", None, "hey", None),
        (2, 0, None, "user", "a", None), (2, 1, "message", "assistant", "b", None), (2, 2, "message", "user", "c", None), (2, 3, "edit", None, "A", 0), (2, 4, "message", "assistant", None, None),
        (3, 0, "edit", None, "nothing to edit", None), (None, 0, "message", None, "x", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, event string, role string, text string, target int").repartition(3)
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_log(df).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "hey")], 2: [("user", "A"), ("assistant", "")], None: [("user", "x")]}
    assert chat.format_log(df.filter("conv_id = 9")).count() == 0


def test_chat_ties_clashes_and_repeats(spark):
    """Events of one sequence go by event, role, text and target, in any order of the rows; columns with the operator's names aren't read; repeated rows count each."""
    log = [(1, 0, "message", "user", "a", None), (1, 1, "message", "user", "b", None), (1, 2, "edit", None, "x", 1), (1, 2, "edit", None, "x", 0), (2, 0, "message", "user", "r", None), (2, 0, "message", "user", "r", None), (None, 5, None, None, None, None), (None, 4, "start", "assistant", None, None)]
    schema = "conv_id long, seq long, event string, role string, text string, target int, formatted string, loss_mask int"
    for rows in (log, log[::-1]):
        df = spark.createDataFrame([(*r, "no", 1) for r in rows], schema).repartition(2)
        got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_log(df).collect()}
        # targets 0 then 1: the edit of message 0 drops message 1, so the edit of 1 finds none
        assert got == {1: [("user", "x")], 2: [("user", "r"), ("user", "r")], None: [("assistant", ""), ("user", "")]}


def test_chat_log_of_turns(spark):
    """A log with drafts, edits, regenerations and deltas folds back to the turns that it was made of."""
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "é日😀x"), (1, 2, "assistant", ""), (1, 2, "user", None), (1, 3, "system", "a"), (1, 4, None, "b"), (2, 5, "assistant", None), (None, 0, "user", "<|im_end|>"), (1, 4, None, "b")]
    log = chat.as_log(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4))
    assert {r.event for r in log.collect()} == {"message", "start", "delta", "edit", "regenerate"} and log.count() == 5 * 3 + 2 * 6
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_log(log).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "é日😀x"), ("assistant", ""), ("user", ""), ("system", "a"), ("user", "b"), ("user", "b")], 2: [("assistant", "")], None: [("user", "<|im_end|>")]}


def test_chat_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in chat.op4_chat_formatting(spark, sf).collect()}
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(convs)
    for k, turns in convs.items():
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def labelled(spark, good, bad, column):
    rows = [(i, (bad if i % 5 == 0 else good)(random.Random(i))) for i in range(400)] + [(900, None), (901, ""), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, bad int")
    return docs, labels.select("doc_id", (F.col("bad") if column == "toxic" else 1 - F.col("bad")).alias(column))


def prose(rnd):
    return " ".join(rnd.choice("the river ran past old stone walls and over green fields until it met wide quiet water".split()) for _ in range(80))


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, prose, lambda rnd: " | ".join(f"{rnd.randint(0, 9999)}!!" for _ in range(60)), "quality")
    got = quality.predictions(docs, quality.fit(docs, labels), 3, 1).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400 and r.doc_id != 5]
    assert held and np.mean([r.predicted == (r.doc_id % 5 != 0) for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity_on_held_out_rows(spark):
    def rude(rnd):
        words = prose(rnd).split()
        for _ in range(3):
            words.insert(rnd.randrange(len(words)), rnd.choice(["gloomhead", "gl00mhead", "gloоmhead", "Snarkwit", "5narkwit!"]))
        return " ".join(words)

    docs, labels = labelled(spark, prose, rude, "toxic")
    got = toxicity.predictions(docs, toxicity.fit(docs, labels), 5, 0).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400 and r.doc_id != 5]
    assert held and np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id in (900, 901))


def test_exception_phrases_cancel_hits():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " trash": 2.0}, [" trash can "])
    assert lexicon.hits(toxicity.folded("Take the trash can, you TR4SH")) == 3.0
    assert toxicity.folded("TrÁsh́ ѕсum​s") == " trash scums "


@pytest.mark.parametrize("of", [quality, toxicity])
def test_without_labels(spark, docs, nothing, of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scorer = of.fit(docs, none)
    got = quality.score_texts(docs, scorer).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5 if of is quality else 0.0}
    assert quality.score_texts(nothing, scorer).count() == 0
    assert quality.keep_scored(docs, scorer, lambda s: s < 0.6).columns == docs.columns
    json.dumps([r.score for r in got])


def test_one_rule_for_lines_of_any_length(spark):
    """Lines of 1 to 7 words: equal to an earlier one, or one word apart from it with that word a fifth of the shorter one's words at most."""
    rnd = random.Random(11)
    lines = [[" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(12)] for _ in range(40)]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.rewrite(docs, short_lines=True).collect()}
    seen = []
    for i, x in enumerate(lines):
        kept = []
        for line in x:
            words = line.split(" ")
            near = any(o == words or (one_apart(o, words) and 1 - 1 / min(len(o), len(words)) >= 0.8) for o in seen)
            kept += [] if near else [line]
            seen.append(words)
        assert got[i] == "\n".join(kept)
