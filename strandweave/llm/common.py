"""Helpers shared by the training-data operators: tables, shared storage, label folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import scratch, stored  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold by which labels are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, null text as empty; other columns can't clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def arrow_schema(fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def in_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about max_bytes of text, so that work and memory go by bytes, not rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def bounded_sample(rows: DataFrame, label: str, per_class: int, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """At most per_class rows (doc_id, label) of each class, those of the smallest id hash: the same rows in any order of the input."""
    parts = [
        rows.filter(F.col(label) == c).select("doc_id", label).distinct()
        .orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(per_class)
        for c in classes
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MapArrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
