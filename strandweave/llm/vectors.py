"""Vectors in shards and query blocks: what the two nearest-neighbour operators share.

Rows are dealt evenly to shards by a hash of the id, whatever their values, so no cluster makes a shard large. A shard holds at
most `SHARD_BYTES` of vectors, whatever their dimension, and is one row with its packed vectors, from which its index is built.
Queries are packed in blocks and the blocks dealt to parts of about a shard's size. One task takes one shard and one part: it reads
the shard's index once and keeps it while the part's blocks stream by. So an index is sent once a part, not once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

USABLE = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
#: Bounds of a shard's and of a block's vectors, counted as doubles.
SHARD_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
_PACKED = "dim int, {} int, ids binary, extra binary, vectors binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part: no nulls, no non-finite components, not zero; floats stay floats, all else is doubles."""
    of = embeddings.schema["embedding"].dataType
    kind = "array<float>" if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.filter("vec_id is not null").filter(USABLE).withColumn("dim", F.size("embedding"))


def packed(rows: DataFrame, key: str, parts: int, extra: str | None = None) -> DataFrame:
    """(dim, key, ids, extra, vectors): rows packed by dimension and a hash of the id modulo parts; extra is a long column, or zeros."""
    kind = np.float32 if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    schema = pa.schema([("dim", pa.int32()), (key, pa.int32()), ("ids", pa.binary()), ("extra", pa.binary()), ("vectors", pa.binary())])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids = np.ascontiguousarray(t.column("vec_id").to_numpy())
        more = np.ascontiguousarray(t.column("extra").to_numpy())
        x = t.column("embedding").combine_chunks()
        x = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy()
        row = [t.column("dim")[0].as_py(), t.column(key)[0].as_py(), ids.tobytes(), more.tobytes(), np.ascontiguousarray(x, kind).tobytes()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    part = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(parts)).cast("int")
    rows = rows.select("dim", part.alias(key), "vec_id", (F.col(extra) if extra else F.lit(0)).cast("long").alias("extra"), "embedding")
    return rows.groupBy("dim", key).applyInArrow(pack, _PACKED.format(key))


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, extra, vectors (as doubles) of a packed row."""
    ids = np.frombuffer(row["ids"], np.int64)
    kind = np.float32 if len(row["vectors"]) == 4 * row["dim"] * len(ids) else np.float64
    return ids, np.frombuffer(row["extra"], np.int64), np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"]).astype(np.float64)


def indexed(shards: DataFrame, build: Callable[[int, np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """shards with an index made by build(shard, vectors, extra)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                _, extra, x = unpacked(row)
                yield one.append_column("index", pa.array([build(row["shard"], x, extra)], pa.binary()))

    return shards.mapInArrow(run, _PACKED.format("shard") + ", index binary")


class Layout:
    """How many shards, blocks and parts a table of n rows of at most dim components makes."""

    def __init__(self, n: int, queries: int, dim: int, least_shards: int, shard_rows: int | None = None, block_rows: int | None = None):
        shard_rows = shard_rows or max(1, SHARD_BYTES // (8 * max(dim, 1)))
        block_rows = block_rows or max(1, BLOCK_BYTES // (8 * max(dim, 1)))
        self.shards = max(least_shards, -(-n // shard_rows))
        self.blocks = max(1, -(-queries // block_rows))
        # a part has as many queries as a shard has rows, or a block's at least
        self.parts = max(1, min(self.blocks, -(-queries // max(block_rows, n // self.shards))))


def each_meeting(index: DataFrame, blocks: DataFrame, at: Layout, opened: Callable[[dict], tuple], search: Callable[[tuple, dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What search(opened(shard row), block row) gives for each shard and each query block of its dimension; opened also for shards that no block meets."""
    none = F.lit(None).cast("binary").alias("index")
    here = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(at.parts - 1))).alias("part"), F.lit(-1).alias("block"), "ids", "extra", "vectors", "index")
    sent = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(at.shards - 1))).alias("shard"), (F.col("block") % at.parts).alias("part"), "block", "ids", "extra", "vectors", none)
    task = F.col("shard") * at.parts + F.col("part")
    rows = here.unionByName(sent).repartitionById(at.shards * at.parts, task.cast("int")).sortWithinPartitions("dim", "shard", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["index"] is not None:
                    held, key = opened(row), (row["dim"], row["shard"], row["part"])
                elif key == (row["dim"], row["shard"], row["part"]):  # else no row of this shard has the block's dimension
                    yield search(held, row)

    return rows.mapInArrow(run, schema)
