"""Operator 12: packing by best fit, decreasing, with a segment tree over remaining capacities.

Documents are cut into pieces only where they exceed a sequence. Packing by best fit, decreasing, looks at lengths alone, and there are no
more lengths than a sequence has tokens, so it is done on the number of pieces of each length, exactly and for the whole corpus at once: longest first, each
piece goes to the open sequence with the tightest room that holds it, found in a segment tree with a leaf for each room. As many pieces of a length as go the
same way are placed by one look: where a sequence of room r is tightest for length l, best fit puts r div l of them there before it turns to
the next, as r - l, r - 2l, ... are tighter still. What is left of a room is below half of it, so a run of like sequences is met
at most log2(window) + 1 times, and each length makes at most two new runs: the plan has at most 2 * window * (log2(window) + 2) rows, whatever the corpus.

Pieces get their place among those of their length from counts by scan partition, prefix-summed over partitions, so a length
that a third of all pieces share is no task's own; the plan's row for length and place says sequence and offset.

Null text is empty: such a document is its end token alone. Null ids and repeated rows are packed each. An empty table
gives no rows; other columns, whatever their names, aren't read. Ties between pieces of a length go by scan order, which changes
neither the number of sequences nor their lengths.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import id_and_text, in_slices, stored, table
from strandweave.llm.word_bpe import encoder

_PLAN = pa.schema([(name, pa.int64()) for name in ("length", "first", "last", "a_sequence", "sequence", "offset")])


class Rooms:
    """Open sequences by room: runs of neighbouring numbers, and a segment tree that says which rooms have any."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def mark(self, room: int, value: int) -> None:
        at = room + self.leaves
        self.some[at] = value
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def put(self, room: int, first: int, n: int) -> None:
        if not n or not room:
            return
        held = self.runs.setdefault(room, deque())
        if not held:
            self.mark(room, 1)
        held.append((first, n))

    def take(self, room: int) -> tuple[int, int]:
        held = self.runs[room]
        out = held.popleft()
        if not held:
            self.mark(room, 0)
        return out

    def tightest(self, length: int) -> int | None:
        """The least room of at least length, in logarithmic time."""
        at = length + self.leaves
        if self.some[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:  # the nearest subtree to the right that has any; then down its left side
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, a_sequence, sequence, offset): pieces first <= place < last of a length, a_sequence of them in each from `sequence` on, the earliest at offset."""
    rooms, out, made = Rooms(window), [], 0
    for length in sorted(counts, reverse=True):
        place, n = 0, counts[length]
        while n:
            room = rooms.tightest(length)
            if room is None:
                room, first, there = window, made, -(-n // (window // length))
                made += there
            else:
                first, there = rooms.take(room)
            each = room // length
            full, over = min(there, n // each), 0
            if full:
                out.append((length, place, place + full * each, each, first, window - room))
                rooms.put(room - each * length, first, full)
                place, n = place + full * each, n - full * each
            if full < there and n and n < each:  # the last ones, in one sequence
                over = 1
                out.append((length, place, place + n, n, first + full, window - room))
                rooms.put(room - n * length, first + full, 1)
                n = 0
            rooms.put(room, first + full + over, there - full - over)
    return out


def pieces(docs: DataFrame, window: int, tokenizer: str, end: int, digests: bool) -> DataFrame:
    """(part, at, doc_id, piece, start, length, ids or ids_crc32): at counts the pieces of a length in their scan partition."""
    made = ("ids_crc32", "long", pa.int64()) if digests else ("ids", "binary", pa.binary())
    schema = pa.schema([*((name, pa.int64()) for name in ("part", "at", "doc_id", "piece", "start", "length")), (made[0], made[2])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, kind = encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        last = np.array([end], kind).tobytes()
        for batch in in_slices(batches, "text", 1 << 20):
            of, piece, start, length, at, cuts = [], [], [], [], [], []
            for row, x in enumerate(encode(batch.column("text").to_pylist())):
                ids = np.frombuffer(x + last, kind)
                for k, a in enumerate(range(0, len(ids), window)):
                    own = ids[a : a + window].astype("<u4")
                    of.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(len(own))
                    at.append(int(seen[len(own)]))
                    cuts.append(zlib.crc32(own) if digests else own.tobytes())
                    seen[len(own)] += 1
            cols = [pa.array(np.full(len(of), part)), pa.array(at), batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece), pa.array(start), pa.array(length), pa.array(cuts, made[2])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return id_and_text(docs).mapInArrow(run, f"part long, at long, doc_id long, piece long, start long, length long, {made[0]} {made[1]}")


def planned(totals: DataFrame, window: int) -> DataFrame:
    """The plan of (length, n), one row a length and so no more than window of them."""

    def run(t: pa.Table) -> pa.Table:
        rows = plan(dict(zip(t.column("length").to_pylist(), t.column("n").to_pylist())), window)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], schema=_PLAN)

    return totals.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, ", ".join(f"{f.name} long" for f in _PLAN))


def best_fit(docs: DataFrame, window: int = 4096, tokenizer: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of each piece; ids as little-endian unsigned 32-bit numbers."""
    return _packed(docs, window, tokenizer, end, False)


def best_fit_digests(docs: DataFrame, window: int = 4096, tokenizer: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """As best_fit(), with ids_crc32 in place of ids."""
    return _packed(docs, window, tokenizer, end, True)


def _packed(docs: DataFrame, window: int, tokenizer: str, end: int, digests: bool) -> DataFrame:
    cut = stored(pieces(docs, window, tokenizer, end, digests), "best-fit-pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "best-fit-counts")
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = counts.select(F.col("part").alias("in_part"), F.col("length").alias("of_length"), ahead.alias("ahead"))
    runs = stored(planned(counts.groupBy("length").agg(F.sum("n").alias("n")), window), "best-fit-plan")
    by_length = np.array([tuple(r) for r in runs.orderBy("length", "first").collect()], np.int64).reshape(-1, len(_PLAN))  # bounded by the window, as said above
    sent = docs.sparkSession.sparkContext.broadcast(by_length)
    value = "ids_crc32" if digests else "ids"
    names = ["doc_id", "piece", "start", "length", value, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, each, sequence, offset = sent.value.T
        key = length * (1 << 48) + first
        for b in batches:
            if not b.num_rows:
                continue
            own, place = b.column("length").to_numpy(), b.column("place").to_numpy()
            at = np.searchsorted(key, own * (1 << 48) + place, "right") - 1
            k = place - first[at]
            cols = [*(b.column(n) for n in names[:5]), pa.array(sequence[at] + k // each[at]), pa.array(offset[at] + k % each[at] * own)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    placed = cut.join(starts, (F.col("part") == F.col("in_part")) & (F.col("length") == F.col("of_length"))).select(*names[:5], (F.col("at") + F.col("ahead")).alias("place"))
    return placed.mapInArrow(run, f"doc_id long, piece long, start long, length long, {value} {'long' if digests else 'binary'}, sequence_id long, offset long")


def op12_best_fit_packing(spark, sf_dir):
    return best_fit_digests(table(spark, sf_dir, "documents")).withColumn("piece", F.col("piece").cast("int"))
