"""Results that are kept: tables published whole, by version, and rows kept by key, computed again where they are missing, stale or damaged.

A published table is a folder a version and a pointer, a small file that is replaced in one rename, so readers see all of one version or all of the next. Rows by key lie in
batches, one an addition; a published table of what each key should be (its stamp, batch with its columns, number of rows and their digest) says which of them count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.session import materialised

POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that path's pointer names."""
    at, files = _hadoop(spark, f"{path}/{POINTER}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return f"{path}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def publish(rows: DataFrame, path: str) -> str:
    """Writes rows as a new version under path, then makes it the current one; a write that fails leaves the one before as it was. The new version's folder."""
    spark, name = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    draft, files = _hadoop(spark, f"{path}/{POINTER}-{name}")
    out = files.create(draft)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), how)
    return f"{path}/{name}"


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version's rows; it stays that version however often others are published, until retire() removes it."""
    folder = current(spark, path)
    return None if folder is None else spark.read.parquet(folder)


def retire(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes versions other than the current one and the `keep` latest before it; for when nobody reads them. The names removed."""
    at, files = _hadoop(spark, path)
    now = (current(spark, path) or "").rpartition("/")[2]
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v-")), reverse=True)
    gone = [name for _, name in found if name != now][keep:]
    for name in gone:
        files.delete(_hadoop(spark, f"{path}/{name}")[0], True)
    return gone


def _digest(columns: list[str]):
    return F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest")


def _kept(spark: SparkSession, path: str, told: DataFrame) -> DataFrame | None:
    """The rows of told's (key, batch) that can be read, with _batch; unreadable files are passed over, the digests tell."""
    batches = {r["batch"]: r["columns"] for r in told.select("batch", "columns").distinct().collect()}  # one an addition
    there = [f"{path}/data/{b}" for b in batches if _hadoop(spark, f"{path}/data/{b}/_SUCCESS")[1].exists(_hadoop(spark, f"{path}/data/{b}/_SUCCESS")[0])]
    if not there:
        return None
    # a damaged file can't say its own columns; all batches have the same
    schema = T.StructType.fromJson(json.loads(next(iter(batches.values()))))
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(*there)
    return rows.join(told.select("key", F.col("batch").alias("_batch")), ["key", "_batch"], "left_semi")


def load_or_compute(wanted: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of all wanted keys (key, stamp): those kept under path whose stamp, number and digest are right as they are, all others by compute((key, stamp)), which gives rows (key, ...) and whose
    results are kept from then on. Keys that compute gives nothing for are kept as such."""
    spark = wanted.sparkSession
    wanted = materialised(wanted.select("key", "stamp").distinct())
    told = published(spark, f"{path}/told")
    rows = None if told is None else _kept(spark, path, told)
    if told is None:
        todo, valid = wanted, None
    else:
        columns = [] if rows is None else [c for c in rows.columns if c != "_batch"]
        have = told.select("key", F.lit(0).cast("long").alias("got"), F.lit(0).cast("decimal(38,0)").alias("have")).limit(0)
        if rows is not None:
            have = rows.groupBy("key").agg(F.count(F.lit(1)).alias("got"), _digest(columns).alias("have"))
        sound = told.join(have, "key", "left").filter((F.coalesce("got", F.lit(0)) == F.col("n")) & (F.coalesce("have", F.lit(0)) == F.col("digest")))
        valid = materialised(sound.join(wanted, ["key", "stamp"], "left_semi").select(*told.columns))
        todo = materialised(wanted.join(valid, ["key", "stamp"], "left_anti"))
    if not todo.isEmpty():
        batch = uuid.uuid4().hex
        compute(todo).withColumn("_batch", F.lit(batch)).write.parquet(f"{path}/data/{batch}")
        made = spark.read.parquet(f"{path}/data/{batch}")
        sums = made.groupBy("key").agg(F.count(F.lit(1)).alias("n"), _digest([c for c in made.columns if c != "_batch"]))
        new = todo.join(sums, "key", "left").select("key", "stamp", F.lit(batch).alias("batch"), F.lit(made.schema.json()).alias("columns"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("digest", F.lit(0)).cast("decimal(38,0)").alias("digest"))
        # what is told of keys that weren't asked for stays
        others = None if told is None else told.join(todo.select("key"), "key", "left_anti")
        publish(new if others is None else others.unionByName(new), f"{path}/told")
    told = published(spark, f"{path}/told")
    if told is None:  # nothing was wanted of an empty store
        return compute(wanted)
    rows = _kept(spark, path, told)
    return rows.join(wanted, "key", "left_semi").drop("_batch")
