"""Operator 2: packing, by concatenate and cut.

All token ids, in the order of the input's partitions and their rows, form one stream, cut every
`window` ids. Each task encodes its rows and writes them with their place in the partition; partition totals
are summed in two levels (blocks of partitions, then blocks) to give each partition's place in the stream,
so no task and no driver sees more than a number a partition. A document that crosses a window's edge leaves
a boundary record on either side: each piece says where it starts in its document and in its sequence.

Null text is empty: such a document is its end token alone. Null ids and repeated rows are packed each. An empty table
gives no rows; other columns, whatever their names, aren't read. Only the last sequence is short, so padding is below one window in all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.bpe import byte_bpe
from strandweave.llm.common import id_and_text, in_slices, stored, table

#: Partitions whose totals one task sums.
BLOCK = 1024
_PLACED = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def place(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """First pass: (part, before, doc_id, n, ids): each document's ids and how many its partition has before it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, before = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        last = np.array([end], bpe.kind)
        for batch in in_slices(batches, "text"):
            ids = [np.concatenate([bpe.encode(t), last]) for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            places = before + np.cumsum(n) - n
            before += int(n.sum())
            cols = [pa.array(np.full(len(n), part)), pa.array(places), batch.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=_PLACED)

    return id_and_text(docs).mapInArrow(encode, "part long, before long, doc_id long, n long, ids binary")


def partition_starts(placed: DataFrame) -> DataFrame:
    """Second pass: (part, start): ids in all partitions before, by prefix sums over partition totals."""
    block = F.expr(f"part div {BLOCK}")
    totals = placed.groupBy("part").agg(F.sum("n").alias("total")).withColumn("block", block)
    inside = F.sum("total").over(Window.partitionBy("block").orderBy("part")) - F.col("total")
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total"))
    ahead = F.sum("total").over(Window.orderBy("block")) - F.col("total")
    blocks = blocks.select(F.col("block").alias("b"), ahead.alias("ahead"))
    return totals.withColumn("inside", inside).join(blocks, F.col("block") == F.col("b")).select(F.col("part").alias("p"), (F.col("inside") + F.col("ahead")).alias("start"))


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = "byte_bpe_50k.json", end: int = 1) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece; ids as little-endian unsigned 32-bit numbers."""
    return _cut(docs, window, tokenizer, end, False)


def pack_digests(docs: DataFrame, window: int = 2048, tokenizer: str = "byte_bpe_50k.json", end: int = 1) -> DataFrame:
    """As pack(), with ids_crc32 in place of ids."""
    return _cut(docs, window, tokenizer, end, True)


def _cut(docs: DataFrame, window: int, tokenizer: str, end: int, digests: bool) -> DataFrame:
    placed = stored(place(docs, tokenizer, end), "packing")
    starts = stored(partition_starts(placed.select("part", "n")), "packing-starts")
    ids_type = pa.int64() if digests else pa.binary()
    names = ["doc_id", "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = byte_bpe(tokenizer).kind
        for batch in in_slices(batches, "ids"):
            at = np.array(batch.column("at"), np.int64)
            n = np.array(batch.column("n"), np.int64)
            first, last = at // window, (at + n - 1) // window
            row = np.repeat(np.arange(len(n)), last - first + 1)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            begin = np.maximum(sequence * window, at[row])
            stop = np.minimum((sequence + 1) * window, at[row] + n[row])
            ids = [np.frombuffer(x, kind).astype("<u4") for x in batch.column("ids").to_pylist()]
            cuts = [ids[r][a:b] for r, a, b in zip(row.tolist(), (begin - at[row]).tolist(), (stop - at[row]).tolist())]
            made = pa.array([zlib.crc32(x) for x in cuts] if digests else [x.tobytes() for x in cuts], ids_type)
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(begin - at[row]), pa.array(stop - begin), made, pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    # a number for each partition of the scan, two longs each: proven small beside the documents of that partition
    at = placed.join(F.broadcast(starts), F.col("part") == F.col("p")).select("doc_id", "n", "ids", (F.col("before") + F.col("start")).alias("at"))
    return at.mapInArrow(cut, f"doc_id long, start long, length long, {names[3]} {'long' if digests else 'binary'}, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark, sf_dir):
    return pack_digests(table(spark, sf_dir, "documents"))
