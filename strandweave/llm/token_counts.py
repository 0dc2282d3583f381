"""Operator 10: token counts, by batch encoding in Arrow functions that return lengths only.

Texts are cut at spaces, tabs and line feeds: the tokenizer drops white space, and neither its normaliser
nor its splitting pattern reaches across those. Batches hold about as many bytes each, whatever the rows;
in a batch the library encodes each different piece once, and a piece seen before by this worker not at all.
Pieces longer than `long_piece` (no white space for thousands of characters) are encoded and not kept.

Null text counts as empty (0 bytes, 0 tokens); null ids are counted like any; repeated rows give repeated results, an empty table none; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import id_and_text, in_slices, table

CACHE_ENTRIES = 400_000
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class Lengths:
    """Token counts of whole texts, with one tokenizer of a worker."""

    def __init__(self, name: str):
        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(P.path(name))
        self.tok.no_truncation()
        self.tok.no_padding()
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str], long_piece: int) -> list[int]:
        """A count for each text, in one call of the library for all their new pieces."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*(p for p, _ in cut)).difference(self.known))
        got = [len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        known = self.known
        known.update(zip(new, got))
        out = [sum(map(known.__getitem__, p)) + n for p, n in cut]
        for p in new:
            if len(p) > long_piece:
                del known[p]
        return out

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pieces between white space, and the number of special tokens outside them."""
        n = 0
        if self.special is not None and "<|" in text:
            text, n = self.special.subn(" ", text)
        return text.replace("\n", " ").replace("\t", " ").split(" "), n


@functools.cache
def lengths(name: str) -> Lengths:
    return Lengths(name)


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", batch_bytes: int = 1 << 20, long_piece: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each whole text, as the library encodes it without added special tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(tokenizer)
        for batch in in_slices(batches, "text", batch_bytes):
            texts = batch.column("text").to_pylist()
            cols = [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(own.count(texts, long_piece), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=_COUNTS)

    return id_and_text(docs).mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long")


def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)
