"""Stores: one version or the next, never half of one; only what is missing, stale or damaged is computed again."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandweave.sources import store


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    assert store.published(spark, path) is None
    store.publish(spark.range(5), path)
    reader = store.published(spark, path)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.publish(broken, path)
    assert rows_of(store.published(spark, path)) == [(i,) for i in range(5)]
    store.publish(spark.range(7), path)
    assert reader.count() == 5 and store.published(spark, path).count() == 7  # who reads the old version goes on
    assert store.retire(spark, path, keep=0) and store.published(spark, path).count() == 7
    assert len([p for p in (tmp_path / "maps").iterdir() if p.is_dir()]) == 1


def test_only_what_is_not_sound_is_computed(spark, tmp_path):
    path, asked = f"file://{tmp_path}/features", []

    def compute(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        made = keys.filter("key <> 'none'").select("key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), F.col("stamp"))
        return made.withColumn("value", F.length("key") * F.col("i") * 1.5)

    keys = lambda *k: spark.createDataFrame(k, "key string, stamp long")
    first = rows_of(store.load_or_compute(keys(("a", 1), ("b", 1), ("none", 1)), path, compute))
    assert asked == [["a", "b", "none"]] and len(first) == 6
    assert rows_of(store.load_or_compute(keys(("a", 1), ("none", 1), ("a", 1)), path, compute)) == first[:3] and len(asked) == 1
    got = rows_of(store.load_or_compute(keys(("a", 1), ("b", 2), ("c", 1)), path, compute))
    assert asked[1:] == [["b", "c"]] and {(k, s) for k, _, s, _ in got} == {("a", 1), ("b", 2), ("c", 1)} and len(got) == 9
    # one damaged file: its keys are computed again, the others are read
    batches = sorted((Path(tmp_path) / "features/data").iterdir(), key=lambda p: p.stat().st_mtime)
    for part in batches[0].glob("part-*.parquet"):
        part.write_bytes(part.read_bytes()[:40])
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert rows_of(store.load_or_compute(keys(("a", 1), ("b", 2), ("c", 1)), path, compute)) == got and asked[2:] == [["a"]]
    assert rows_of(store.load_or_compute(keys(("a", 1), ("b", 2), ("c", 1)), path, compute)) == got and len(asked) == 3
    assert store.load_or_compute(keys(), path, compute).count() == 0 and len(asked) == 3
