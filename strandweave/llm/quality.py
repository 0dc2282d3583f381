"""Operator 1: quality classifier, by compression.

Two zstandard dictionaries are built from blocks of good and of bad labelled texts. A text is cut to blocks,
each compressed with either dictionary; the size under the bad one less that under the good one, over their
sum, is the normalised difference. The score is that of the whole text and the least of any of its blocks, with the same difference of the
plain size and the good one (which tells repetition, whatever dictionary), calibrated by a logistic regression on labelled rows that gave no dictionary. Nothing
else of a text, its length neither, goes into its score.

Fitting takes a bounded sample: `per_class` labelled documents of each class by smallest hash of the id for the calibration, as many again for
the dictionaries, and of all blocks of their whole texts `blocks` a class by smallest hash of the block. Ids labelled both ways give no sample; where rows
share an id but not the text, the smallest text counts, so two runs fit the same model. Scoring takes every whole text. Where a class has no labelled row, every
score is 0.5. Null and empty texts score as one empty block; null ids are scored like any, but not learned from. Repeated rows give repeated results, an empty table none; other
columns, whatever their names, aren't read, and `keep_scored` hands them on as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import bounded_sample, fold, id_and_text, in_slices, stored, table
from strandweave.llm.logistic import Logistic, class_weights

BLOCK = 1024
DICTIONARY = 112_640
LEVEL = 3


def _blocks(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the blocks themselves where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def features(text: str, good: bytes, bad: bytes) -> list[float]:
    """Normalised differences of sizes: bad and good dictionary over the whole text, the least of that of a block, and the plain text and the good dictionary."""
    blocks, a, b = _blocks(text), _compressor(good), _compressor(bad)
    n, g, h = np.array([(len(x), len(a.compress(x)), len(b.compress(x))) for x in blocks]).T
    return [_difference(h.sum(), g.sum()), _difference(h, g).min(), _difference(n.sum(), g.sum())]


def _difference(x, y):
    return (x - y) / (x + y)


Scorer = Callable[[list[str]], np.ndarray]


def labelled(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the labelled ids outside the fold held_out; ids labelled both ways are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    rows = rows.filter(fold(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return rows.filter("label = most").drop("most")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = 1500, blocks: int = 12_000) -> Scorer:
    """A scorer fitted on labelled rows outside the fold held_out."""
    rows = labelled(labels, "quality", modulus, held_out)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return _no_labels
    sample = bounded_sample(rows, "label", 2 * per_class).withColumn("calibrates", F.xxhash64("doc_id", F.lit(1)) % 2 == 0)
    # two ids and flags for each of at most 4 * per_class documents
    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label", "calibrates").agg(F.min("text").alias("text"))
    texts = stored(texts, "quality-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            for label, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                made = _blocks(t)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(made), pa.int32()), pa.array(made, pa.binary())], names=["label", "block"])

    cuts = texts.filter("not calibrates").mapInArrow(cut, "label int, block binary").distinct()
    taken = [cuts.filter(F.col("label") == k).orderBy(F.xxhash64("block"), "block").limit(blocks) for k in (0, 1)]
    found = taken[0].unionByName(taken[1]).collect()
    blocks_of = {k: sorted(bytes(r.block) for r in found if r.label == k) for k in (0, 1)}
    if not all(blocks_of.values()):
        return _no_labels
    good, bad = dictionary(blocks_of[1]), dictionary(blocks_of[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            x = [features(t, good, bad) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = texts.filter("calibrates").mapInArrow(measure, "doc_id long, label int, x array<double>").orderBy("doc_id").collect()
    if len({r.label for r in found}) < 2:
        return _no_labels
    x, y = np.array([r.x for r in found]), np.array([r.label for r in found], float)
    model = Logistic(x, y, class_weights(y, counts))

    def score(texts: list[str]) -> np.ndarray:
        return model(np.array([features(t, good, bad) for t in texts]))

    return score


def _no_labels(texts: list[str]) -> np.ndarray:
    return np.full(len(texts), 0.5)


def score_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, doc_key, score) of each row; doc_key is the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(scorer(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "doc_key", "score"])

    keyed = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, doc_key long, score double")


def keep_scored(docs: DataFrame, scorer: Scorer, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns as they are, whose text's score the predicate keeps; nothing is shuffled."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep(scorer(texts)), pa.bool_()))

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, scorer: Scorer, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    return score_texts(docs, scorer).select("doc_id", (fold(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, fit(docs, table(spark, sf_dir, "labels")), 3, 1)
