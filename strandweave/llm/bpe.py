"""Operator 5: BPE encoding and decoding, by tree concatenation.

A text longer than `LEAF` characters is halved anywhere, down to leaves; the leaves are encoded, and at each join a window around it is encoded
again. The window grows until it starts and ends before a space that a non-space follows, which no alternative of the tokenizer's
splitting pattern crosses, and its first token is the left side's and its last token the right side's there: then both sides agree outside
it, and the ids are those of the whole text exactly.

Text between two such places that stays long (no space for thousands of characters) is cut out first, and its pre-tokens found by the library; a
long pre-token is halved in the same way, with windows of tokens: a BPE sequence is the right one if each pair of
neighbours is, so sides that agree in one token on either side of the window make the whole exact.

Texts longer than `long_chars` are cut to pieces anywhere, dealt out over tasks, and joined by document in the same tree; all others
are encoded where they are read. Null text counts as empty, null ids are encoded like any; repeated rows give repeated results, an empty table
none; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import id_and_text, in_slices

#: Characters for which both libraries' splitting patterns have the same classes: Latin letters, digits, signs, plain white space.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
_NOT_SAFE = re.compile(r" [\s\x00-\x1f\x7f-\xa0]| $")
#: A place where a text may always be cut: before a space that a plain non-space follows.
_SAFE = re.compile("(?= [!-~])")
LEAF = 2048
LONG_UNIT = 4096
#: Characters around a join that are encoded again first.
REACH = 64
CACHE_ENTRIES = 300_000


class ByteBpe:
    """One tokenizer of a worker: whole texts to little-endian unsigned 16- or 32-bit ids, and back."""

    def __init__(self, name: str):
        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(P.path(name))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.spaced: dict[str, bytes] = {}
        self.joins = 0
        self.quick = self._quick(name)

    def _quick(self, name: str):
        """The same vocabulary as ranks, if there is one: much faster on short units, and equal on the characters above."""
        import public_tokenizers as P
        import tiktoken

        try:
            lines = open(P.path(name.removesuffix(".json") + ".tiktoken"), "rb").read().splitlines()
        except OSError:
            return None
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("units", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    # -- encoding ------------------------------------------------------------------------------------------
    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text."""
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                ids = [np.array([self.specials[p]], self.kind) if k % 2 else self._ordinary(p) for k, p in enumerate(parts) if p]
                return np.concatenate(ids) if ids else np.empty(0, self.kind)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens."""
        if len(text) > 2 * LEAF and max(map(len, text.split(" "))) <= LONG_UNIT:
            half = len(text) // 2
            return self.join_texts(self._ordinary(text[:half]), text[:half], self._ordinary(text[half:]), text[half:])
        return self._leaf(text)

    def join_texts(self, left: np.ndarray, a: str, right: np.ndarray, b: str) -> np.ndarray:
        """Ids of the text a + b, from those of its two sides; what either says away from the join stays."""
        if not a or not b:
            return right if not a else left
        self.joins += 1
        reach, lens = REACH, self.strings.lens
        while True:
            start, end = _safe_before(a, reach), _safe_after(b, reach)
            keep = len(left) - _tokens(lens[left[::-1]], len(a[start:].encode()))
            drop = _tokens(lens[right], len(b[:end].encode()))
            window = self._leaf(a[start:] + b[:end])
            if (start == 0 or window[0] == left[keep]) and (end == len(b) or window[-1] == right[drop - 1]):
                return np.concatenate([left[:keep], window, right[drop:]])
            reach *= 2

    def _leaf(self, text: str) -> np.ndarray:
        if self.quick is not None and not _OTHER.search(text) and (len(text) <= LONG_UNIT or max(map(len, text.split(" "))) <= LONG_UNIT):
            return np.array(self.quick.encode_ordinary(text), self.kind)
        units = safe_units(text)
        got = self.spaced
        if len(got) > CACHE_ENTRIES:
            got.clear()
        first, rest = self._unit(units[0]), units[1:]
        for u in set(rest).difference(got):
            got[u] = self._unit(" " + u) if len(u) <= LONG_UNIT else b""
        if len(text) > LONG_UNIT and any(len(u) > LONG_UNIT for u in rest):
            out = b"".join([first, *(got[u] if len(u) <= LONG_UNIT else self._unit(" " + u) for u in rest)])
            for u in rest:
                if len(u) > LONG_UNIT:
                    got.pop(u, None)
        else:
            out = b"".join([first, *map(got.__getitem__, rest)])
        return np.frombuffer(out, self.kind)

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if len(unit) > LONG_UNIT:
            ids = self._long(unit)
        elif self.quick is not None and not _OTHER.search(unit):
            ids = self.quick.encode_ordinary(unit)
        else:
            ids = self.tok.encode(unit, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def _long(self, unit: str) -> list[int]:
        ids: list[int] = []
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(unit):
            ids += self.tree(word)
        return ids

    def tree(self, word: str) -> list[int]:
        """One pre-token, in the vocabulary's own letters, by halves."""
        if len(word) <= LEAF:
            return [t.id for t in self.tok.model.tokenize(word)]
        half = len(word) // 2
        return self.join(self.tree(word[:half]), self.tree(word[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the two sides' letters together: encodes growing windows around the join until both sides agree."""
        letters = self.tok.id_to_token
        reach = 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = [t.id for t in self.tok.model.tokenize("".join(map(letters, left[a:] + right[:b])))]
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            reach *= 2

    # -- decoding ------------------------------------------------------------------------------------------
    @functools.cached_property
    def strings(self) -> Strings:
        """The bytes that each token stands for."""
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        tokens = [self.tok.id_to_token(i) for i in range(self.size)]
        return Strings([t.encode() if i in self.specials.values() else bytes(byte_of[c] for c in t) for i, t in enumerate(tokens)])

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included, as the library's byte-level decoder gives it."""
        return self.strings.joined(ids).decode("utf-8", "replace")


class Strings:
    """Byte strings by number, joined for an array of numbers without a loop over them."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.lens = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def joined(self, ids: np.ndarray) -> bytes:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        if not len(ids):
            return b""
        at = np.repeat(self.starts[ids] - (ends - lens), lens)
        at += np.arange(len(at))
        return self.blob[at].tobytes()


def byte_letters() -> str:
    """The printable letter of each byte in a byte-level vocabulary: itself where printable, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


def safe_units(text: str) -> list[str]:
    """The text cut before each space that a plain non-space follows; all units but the first lack that space."""
    units = text.split(" ")
    if _NOT_SAFE.search(text):
        kept = [units[0]]
        for u in units[1:]:
            if not u or u[0].isspace() or u[0] < "!" or "\x7e" < u[0] < "\xa1":
                kept[-1] += " " + u
            else:
                kept.append(u)
        return kept
    return units


def _safe_before(text: str, reach: int) -> int:
    """The last safe place at least `reach` characters before the end, or the start."""
    at = text.rfind(" ", 0, max(0, len(text) - reach))
    while at > 0 and not _SAFE.match(text, at):
        at = text.rfind(" ", 0, at)
    return max(at, 0)


def _safe_after(text: str, reach: int) -> int:
    """The first safe place at least `reach` characters after the start, or the end."""
    found = _SAFE.search(text, reach)
    return found.start() if found else len(text)


def _tokens(lens: np.ndarray, n: int) -> int:
    """How many tokens from the first on stand for n bytes: a token has one at least, so no more than n are looked at."""
    return int(np.searchsorted(np.cumsum(lens[:n]), n)) + 1 if n else 0


@functools.cache
def byte_bpe(name: str) -> ByteBpe:
    return ByteBpe(name)


@functools.cache
def _decimals(size: int) -> Strings:
    return Strings([b"%d," % i for i in range(size)])


def digest(ids: np.ndarray, size: int = 1 << 16) -> str:
    """SHA-256 of the decimal ids, joined by commas."""
    return hashlib.sha256(_decimals(size).joined(ids)[:-1]).hexdigest()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _rows(doc_ids: list, ids: list[np.ndarray], bpe: ByteBpe, digests: bool) -> pa.RecordBatch:
    n = [len(x) for x in ids]
    if digests:
        cols = [doc_ids, n, [digest(x, bpe.size) for x in ids], [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _DIGEST.types)], schema=_DIGEST)
    cols = [doc_ids, n, [x.astype("<u4").tobytes() for x in ids], [bpe.decode(x) for x in ids]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT.types)], schema=_OUT)


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", long_chars: int = 1 << 18, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each whole text; ids as little-endian unsigned 32-bit numbers.

    digests: ids_sha256 (decimal ids joined by commas) and decoded_sha256 in place of ids and decoded.
    """
    docs = id_and_text(docs)
    kind = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in in_slices(batches, "text"):
            yield _rows(batch.column("doc_id").to_pylist(), [bpe.encode(t) for t in batch.column("text").to_pylist()], bpe, digests)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.string()), ("piece", pa.int64()), ("kind", pa.string()), ("text", pa.string())])
        for batch in in_slices(batches, "text", 1):
            doc, text = batch.column("doc_id")[0].as_py(), batch.column("text")[0].as_py()
            key = hashlib.md5(text.encode()).hexdigest()
            rows = [(doc, key, k, kind, p) for k, (kind, p) in enumerate(pieces_of(text, byte_bpe(tokenizer)))]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256]), schema.types)], schema=schema)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in in_slices(batches, "text"):
            ids = [np.array(bpe.tree(t), bpe.kind) if k == "word" else bpe.encode(t) for k, t in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist())]
            yield batch.append_column("ids", pa.array([x.tobytes() for x in ids], pa.binary()))

    def together(t: pa.Table) -> pa.Table:
        bpe = byte_bpe(tokenizer)
        t = t.sort_by("piece")
        parts = zip(t.column("kind").to_pylist(), (np.frombuffer(x, bpe.kind) for x in t.column("ids").to_pylist()), t.column("text").to_pylist())
        joins = {"word": lambda x, y: (np.array(bpe.join(x[0].tolist(), y[0].tolist()), bpe.kind), ""), "text": lambda x, y: (bpe.join_texts(x[0], x[1], y[0], y[1]), x[1] + y[1])}
        out, run, of = [np.empty(0, bpe.kind)], [], "end"
        for kind, ids, text in [*parts, ("end", out[0], "")]:
            if kind != of:
                while len(run) > 1:  # the tree's upper levels
                    run = [joins[of](run[i], run[i + 1]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
                out += [x for x, _ in run]
                run, of = [], kind
            if kind in joins:
                run.append((ids, text))
            else:
                out.append(ids)
        return pa.Table.from_batches([_rows([t.column("doc_id")[0].as_py()], [np.concatenate(out)], bpe, digests)])

    short = docs.filter(F.length("text") <= long_chars).mapInArrow(whole, kind)
    pieces = docs.filter(F.length("text") > long_chars)
    copies = pieces.groupBy("doc_id", F.md5(F.col("text").cast("binary")).alias("doc_key")).agg(F.count(F.lit(1)).alias("copies"))
    pieces = pieces.dropDuplicates(["doc_id", "text"]).mapInArrow(cut, "doc_id long, doc_key string, piece long, kind string, text string")
    done = (
        pieces.repartition("doc_id", "doc_key", "piece")
        .mapInArrow(leaves, "doc_id long, doc_key string, piece long, kind string, text string, ids binary")
        .groupBy("doc_id", "doc_key").applyInArrow(_keyed(together), kind + ", doc_key string")
    )
    c = copies.select(F.col("doc_id").alias("c_id"), F.col("doc_key").alias("c_key"), "copies")
    done = done.join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("doc_key") == F.col("c_key")))
    done = done.select(*short.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*short.columns)
    return short.unionByName(done)


def _keyed(f):
    def g(t: pa.Table) -> pa.Table:
        return f(t).append_column("doc_key", pa.array([t.column("doc_key")[0].as_py()], pa.string()))

    return g


def pieces_of(text: str, bpe: ByteBpe, size: int = 1 << 15) -> Iterator[tuple[str, str]]:
    """("text", part) for cuts of a stretch anywhere, ("word", letters) for cuts of one long pre-token; neighbours of a kind belong together unless ("end", "") is between. ("whole", text) stands for itself."""
    parts = bpe.special.split(text) if bpe.special is not None else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield "whole", part
            continue
        held: list[str] = []
        for i, u in enumerate(safe_units(part)):
            u = " " + u if i else u
            if len(u) <= LONG_UNIT:
                held.append(u)
                continue
            yield from _stretch("".join(held), size)
            held = []
            for word, (a, b) in bpe.tok.pre_tokenizer.pre_tokenize_str(u):
                if len(word) > LEAF:
                    for j in range(0, len(word), size):
                        yield "word", word[j : j + size]
                    yield "end", ""
                else:
                    yield "whole", u[a:b]
        yield from _stretch("".join(held), size)


def _stretch(text: str, size: int) -> Iterator[tuple[str, str]]:
    for j in range(0, len(text), size):
        yield "text", text[j : j + size]
    yield "end", ""


def op5_bpe_encode_decode(spark, sf_dir):
    from strandweave.llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
