"""Files as DataFrames: text of any Unicode encoding, catalogues, sidecars, checkpoints, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEDIA = ("mkv", "mp4", "avi", "mov", "m4v", "ts", "webm", "mka", "m4a", "flac", "wav", "ac3", "eac3", "aac", "mp3", "ogg", "opus")


def decoded(content: Column) -> Column:
    """Bytes as text by their byte-order mark: UTF-32 before UTF-16 before UTF-8, which also holds without one."""
    mark = F.hex(F.substring(content, 1, 4))
    rest = lambda k: F.substring(content, k, 2_147_483_647)
    return (
        F.when(mark == "FFFE0000", F.decode(_swapped(rest(5)), "UTF-32"))
        .when(mark == "0000FEFF", F.decode(rest(5), "UTF-32"))
        .when(mark.startswith("FFFE"), F.decode(rest(3), "UTF-16LE")).when(mark.startswith("FEFF"), F.decode(rest(3), "UTF-16BE"))
        .when(mark.startswith("EFBBBF"), F.decode(rest(4), "UTF-8")).otherwise(F.decode(content, "UTF-8"))
    )


def _swapped(content: Column) -> Column:
    """Little-endian 32-bit units turned to big-endian ones."""
    quads = F.regexp_replace(F.hex(content), "(..)(..)(..)(..)", "$4$3$2$1")
    return F.unhex(quads)


def read_texts(spark: SparkSession, path: str, suffixes: Sequence[str] = ("vtt", "ass", "srt")) -> DataFrame:
    """(doc, text) of the text files under path with one of the suffixes, whatever its case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    return kept.select(F.col("path").alias("doc"), decoded(F.col("content")).alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, dir, name, length, modified) of all files under path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", "modified")


def catalogue(files: DataFrame, outputs: DataFrame, media: Sequence[str] = MEDIA, mark: str = "ref") -> DataFrame:
    """(dir, n_files, reference, n_done) of folders with media, those named with _ first left out: the one file whose name holds `mark` is the reference, unless there are several; files with an output (stem, or stem__aN) are done."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    m = files.withColumn("_stem", stem).filter(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*media) & ~F.col("dir").rlike("(^|/)_[^/]*$"))
    done = outputs.select(F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"__a\d+$", "").alias("_stem")).distinct().withColumn("_done", F.lit(1))
    is_ref = F.lower("name").contains(mark)
    got = m.join(done, "_stem", "left").groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(is_ref).alias("_n"), F.min(F.when(is_ref, F.col("name"))).alias("_ref"), F.count("_done").alias("n_done"))
    return got.select("dir", "n_files", F.when(F.col("_n") == 1, F.col("_ref")).alias("reference"), "n_done")


def sidecars(videos: DataFrame, files: DataFrame, suffixes: Sequence[str] = ("vtt", "ass", "srt")) -> DataFrame:
    """(dir, video, name): text files whose name begins with a video's stem and a dot."""
    v = videos.select("dir", F.col("name").alias("video"), F.regexp_replace("name", r"\.[^.]*$", "").alias("_stem"))
    t = files.filter(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*suffixes)).select("dir", "name")
    return v.join(t, "dir").filter(F.startswith("name", F.concat("_stem", F.lit(".")))).select("dir", "video", "name")


def candidate_catalogues(folders: DataFrame) -> DataFrame:
    """(root, name, series, videos) of folders that hold folders with media (rows of catalogue()), by the folder above; those named with _ first are left out, and a folder directly at the top stands for itself."""
    up = F.regexp_extract("dir", "^(.*)/[^/]*$", 1)
    root = F.when(up == "", F.col("dir")).otherwise(up)
    got = folders.withColumn("root", root).groupBy("root").agg(F.count(F.lit(1)).alias("series"), F.sum("n_files").alias("videos")).filter("videos > 0")
    return got.withColumn("name", F.regexp_extract("root", "([^/]*)$", 1)).filter(~F.col("name").startswith("_")).select("root", "name", "series", "videos")


def summarised(values: Column) -> Column:
    """An array as what a record keeps of it: JSON of its number of values and their median (null if it has none)."""
    v = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    n = F.size(v)
    middle = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    return F.to_json(F.struct(n.alias("n"), middle.alias("median")), {"ignoreNullFields": "false"})


def content_key(name: Column, size: Column, modified: Column, *more: Column) -> Column:
    """The key by which results are kept: name, size and time, and what else they depend on."""
    return F.concat_ws("|", name, size.cast("string"), modified.cast("string"), *more)


def save_checkpoint(rows: DataFrame, path: str, version: int) -> None:
    """Rows (key, ...) kept under path by stage version; refuses to keep nothing."""
    if rows.isEmpty():
        raise ValueError("an empty result isn't kept")
    rows.withColumn("version", F.lit(version)).write.mode("overwrite").partitionBy("version").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, keys: DataFrame, version: int) -> DataFrame:
    """Kept rows of the given version and keys (a partition is read, then joined)."""
    return spark.read.parquet(path).filter(F.col("version") == version).join(keys.select("key").distinct(), "key", "left_semi").drop("version")


def without_outputs(sources: DataFrame, outputs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sources that have no output yet."""
    return sources.join(outputs.select(*on).distinct(), list(on), "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def restored_queue(rows: DataFrame) -> DataFrame:
    """Persisted jobs (seq, status, ...) after a restart: running ones are queued again, rows without a known status go."""
    known = ("queued", "paused", "running", "done", "failed", "cancelled")
    return rows.filter(F.col("status").isin(*known)).withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def fitted_blocks(grid: DataFrame, audio: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, block, samples): audio blocks brought to the grid's: those beyond it go, missing ones and missing ends are zeros."""
    j = grid.join(audio, [*keys, "block"], "left")
    zeros = F.array_repeat(F.lit(0.0), size)
    return j.select(*keys, "block", F.slice(F.concat(F.coalesce(F.col("samples").cast("array<double>"), F.expr("cast(array() as array<double>)")), zeros), 1, size).alias("samples"))


def write_texts(docs: DataFrame, path: str) -> None:
    """One row a document, (doc, text), as text files partitioned by document."""
    docs.select("doc", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def write_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
