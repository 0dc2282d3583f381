"""A Spark session with the settings this library is meant for, and storage in the folder that its executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "strandweave", **settings: str) -> SparkSession:
    """The running session, or a new one; UTC, adaptive plans with skew handling. Settings are given with _ for the dots."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("_", "."): str(v) for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; in local sessions without that setting, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


#: What was written, by the scopes that are open, innermost last; the first ends with the program.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=([],))


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored() and materialised() write inside is removed at its end: for callers who have then written what they made of it."""
    scopes = _SCOPES.get()
    before = _SCOPES.set((*scopes, []))
    try:
        yield
    finally:
        made = _SCOPES.get()[-1]
        _SCOPES.reset(before)
        _remove(spark, made)


@atexit.register
def _at_end() -> None:
    running = SparkSession.getActiveSession()
    if running is not None and running.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _remove(running, _SCOPES.get()[0])


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder's name in the shared folder. What is put there lasts as long as the innermost scratch() around the call, with keep as the one around that, and no longer than the program."""
    scopes, path = _SCOPES.get(), f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes[max(0, len(scopes) - 1 - keep)].append(path)
    return path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written as Parquet to a scratch_path() and read again: compact, columnar, cut lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from here on: what several later steps use isn't computed for each, and lost executors cost no more than a step."""
    return stored(df, "step")
