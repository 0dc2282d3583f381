"""Operator 6: SimHash near-dedup, by segment-popcount embedding.

A fingerprint's 64 bits fall into 16 segments; their bit counts are a point in a grid of 16 dimensions. Two
fingerprints that differ in d bits are at most d apart in Manhattan distance there, so those within 2 share
a grid cell of the two balls of radius 1. Each different fingerprint goes to the 33 cells of its ball; pairs
that meet in a cell are verified by the exact number of differing bits.

A crowded cell (more than `crowded` fingerprints, as a large group of near copies makes) is not paired: its
fingerprints are dealt once more, to the 65 fingerprints within one bit of each. Any two within 2 bits share
one of those, and all that share one are within 2 bits, so a star to the smallest of each such group joins the
same components, with no pair left out and none emitted beyond the group's size.

Null text is empty. A text of fewer than `words` words is one shingle; without words the fingerprint is zero.
Equal fingerprints are one node, whatever the number of documents. Repeated rows give repeated results. A null doc_id takes part like any other:
its row is linked, has the component's smallest id that isn't null, and null if there is none. An empty table gives no rows; other columns, whatever their
names, aren't read, and `keep_first` hands them on as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import id_and_text, in_slices, stored, table
from strandweave.llm.components import components

_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
SEGMENTS = 16


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, each set if set in over half of the hashes of the text's shingles."""
    import xxhash

    found = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    shingles = map(" ".join, zip(*(found[i : n + i] for i in range(words)))) if len(found) >= words else [" ".join(found)]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((h(s, 42) for s in shingles), np.uint64, n)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, doc_key, fp): the hash of the text, and the fingerprint as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(fps)], names=["doc_id", "doc_key", "fp"])

    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("doc_key"), "text").mapInArrow(hashed, "doc_id long, doc_key long, fp long")


def links(fps: DataFrame, crowded: int = 64) -> DataFrame:
    """(a, b) of different fingerprints (column fp, no repeats) that join all those within 2 bits of each other."""
    count = [f"cast(bit_count(shiftrightunsigned(fp, {4 * i}) & 15) as bigint)" for i in range(SEGMENTS)]
    point = " + ".join(f"shiftleft({c}, {3 * i})" for i, c in enumerate(count))
    up = ", ".join(f"if({c} < 4, {1 << 3 * i}L, null)" for i, c in enumerate(count))
    down = ", ".join(f"if({c} > 0, {-(1 << 3 * i)}L, null)" for i, c in enumerate(count))
    # fingerprints are few bytes and their cells many: dealt out before they are made, whatever few partitions they come in (by fp itself the plan would drop it)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = fps.repartition(parts, F.xxhash64("fp")).select("fp", F.expr(point).alias("point"), F.expr(f"explode(array(0L, {up}, {down}))").alias("step")).filter("step is not null")
    keys = keys.select("fp", F.expr("point + step").alias("cell"))
    cells = keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # merged: the planner sees the size of fps, not the rows that it was just exploded to, and would broadcast them by way of the driver
    met = stored(keys.join(cells.hint("merge"), "cell"), "simhash-cells")

    few = met.filter(F.col("n") <= crowded).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    within = "filter(slice(f, i + 2, size(f)), y -> bit_count(f[i] ^ y) <= 2)"
    few = few.select(F.expr(f"inline(flatten(transform(sequence(0, size(f) - 1), i -> transform({within}, y -> struct(f[i] as a, y as b)))))"))

    many = met.filter(F.col("n") > crowded).select("fp").distinct()
    near = ", ".join(["fp", *(f"fp ^ shiftleft(1L, {i})" for i in range(64))])
    many = many.select("fp", F.expr(f"explode(array({near}))").alias("centre"))
    least = many.groupBy("centre").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").drop("top")
    many = many.join(least.hint("merge"), "centre").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return few.unionByName(many).distinct()


def _rooted(fps: DataFrame, crowded: int, least: Column) -> DataFrame:
    """(f, component): for each fingerprint of fps the smallest `least` that it reaches over links of at most 2 bits."""
    nodes = fps.groupBy("fp").agg(F.min(least).alias("least"))
    found = components(links(nodes.select("fp"), crowded))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return stored(rooted.join(smallest, "root").select(F.col("fp").alias("f"), "component"), "simhash-roots")


def near_duplicates(docs: DataFrame, words: int = 3, crowded: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id reachable over links of at most 2 bits."""
    fps = stored(fingerprints(docs, words), "simhash-fp")
    by_fp = _rooted(fps, crowded, F.col("doc_id"))
    return fps.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", "fp", F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 3, crowded: int = 64) -> DataFrame:
    """The rows of docs, all columns as they are, of which one document of each component stays.

    A document is an id with a text (rows that share both are one and of them that of the smallest hash of all its columns stays; rows that share the id alone are different ones). The one of the smallest
    id stays, null ids first, then that of the smallest hash of the text.
    """
    fps = stored(fingerprints(docs, words), "simhash-fp")
    document = F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_key").alias("key"))
    first = _rooted(fps, crowded, document).select("component.*").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = [F.col("doc_id").isNotNull().alias("has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")]
    # the text is shuffled once: the join deals rows by the keys that repeats are dropped by
    kept = docs.select(row, *own).join(first, ["has", "id", "key"]).groupBy("has", "id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
