"""Bounded runs of streams: rows put where a stream reads them, and what an available-now run of it leaves.

Everything goes through the folder that executors share (spark.checkpoint.dir); in local sessions without that setting, a temporary one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from strandweave.session import scratch_path


def as_stream(rows: DataFrame) -> DataFrame:
    """A streaming DataFrame over the rows, written once as Parquet."""
    spark = rows.sparkSession
    path = scratch_path(spark, "stream-in")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def in_turn(parts: Sequence[DataFrame]) -> DataFrame:
    """A streaming DataFrame that gives one part after another, each as one file and micro-batch."""
    spark, path = parts[0].sparkSession, scratch_path(parts[0].sparkSession, "stream-in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream appends until all there is has been read; a batch that is tried again replaces its own folder."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"stream-{name}-marks")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True)
    query = query.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*").select(*stream.columns)
