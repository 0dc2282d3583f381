"""Sidecars carried over to the reference's timeline, with a report row for each: a file that can't be read is an error in its row, not the job's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators import cues as C
from strandweave.operators.intervals import retimed
from strandweave.session import materialised
from strandweave.sources.files import decoded

REASONS = {"drawing": "dropped_drawings", "empty": "dropped_empty", "duplicate": "dropped_duplicates"}


def malformed(content: Column) -> Column:
    """Whether bytes aren't text in the encoding that their byte-order mark names, UTF-8 without one."""
    h = F.hex(content)
    mark = F.substring(h, 1, 8)
    length = F.octet_length(content)
    wide, swapped = h, F.regexp_replace(h, "(..)(..)", "$2$1")
    units = lambda x: F.regexp_replace(F.regexp_replace(x, "(....)", "$1 "), "D[89AB].. D[C-F].. ", "")  # noqa: E731  what is left of a surrogate has no partner
    lone = lambda x: (length % 2 != 0) | units(x).rlike("(^| )D[89A-F].. ")
    return (
        F.when(mark.isin("FFFE0000", "0000FEFF"), length % 4 != 0)
        .when(mark.startswith("FFFE"), lone(swapped)).when(mark.startswith("FEFF"), lone(wide))
        .otherwise(~F.is_valid_utf8(content.cast("string")))
    )


def transferred(sidecars: DataFrame, pieces: DataFrame, videos: DataFrame, keys: Sequence[str], frame: float) -> tuple[DataFrame, DataFrame]:
    """(texts, report) of sidecars (keys, doc, suffix, content), doc being one file's own name, by the time maps (keys, t0, t1, x0, x1) of their videos (keys, start, length).

    texts: (doc, text), SubRip, of the files that can be read. report: (keys, doc, error, cues_in, cues_out, dropped_drawings, dropped_empty, dropped_duplicates, dropped_settings) of every file;
    counts are 0 where error says why it wasn't carried over: no reader for its suffix, bytes that aren't text, no header. Times are less the video's start; what lies beyond its length goes.
    """
    keys = list(keys)
    suffix = F.lower("suffix")
    text = F.when(~malformed(F.col("content")), decoded(F.col("content")))
    headed = F.coalesce(F.regexp_replace("_text", "^﻿+", "").startswith("WEBVTT"), F.lit(False))
    files = sidecars.select(*keys, "doc", suffix.alias("_suffix"), F.when(suffix.isin("vtt", "ass"), text).alias("_text"))
    error = F.when(~F.col("_suffix").isin("vtt", "ass"), F.concat(F.lit("no reader for ."), "_suffix")).when(F.col("_text").isNull(), "not text in its encoding").when((F.col("_suffix") == "vtt") & ~headed, "no WEBVTT header")
    files = materialised(files.withColumn("error", error))
    good = files.filter("error is null").select(*keys, "doc", "_suffix", F.col("_text").alias("text"))
    columns = ["doc", "n", "start", "end", "payload", "settings"]
    vtt = C.neutral(C.read_vtt(good.filter("_suffix = 'vtt'").select("doc", "text")).select(*columns))
    ass = C.read_ass(good.filter("_suffix = 'ass'").select("doc", "text")).withColumn("settings", F.lit(""))
    cues = materialised(C.cleaned(vtt.select(*columns).unionByName(ass.select(*columns)), ["doc"]))
    told = cues.groupBy("doc").agg(F.count(F.lit(1)).alias("cues_in"), *(F.count_if(F.col("reason") == r).alias(name) for r, name in REASONS.items()), F.count_if(F.col("settings") != "").alias("dropped_settings"))
    of = good.select(*keys, "doc").join(videos.select(*keys, F.col("start").alias("_begin"), F.col("length").alias("_length")), keys)
    kept = cues.filter("reason is null").join(of.drop(*keys), "doc")
    clipped = kept.select("doc", "n", (F.col("start") - F.col("_begin")).alias("start"), F.least(F.col("end") - F.col("_begin"), "_length").alias("end"))
    moved = materialised(retimed(clipped, of.join(pieces, keys).select("doc", "t0", "t1", "x0", "x1"), ["doc"], float("inf"), frame))
    texts = C.write_srt(moved.join(kept.select("doc", "n", "payload"), ["doc", "n"]), ["doc"])
    out = moved.groupBy("doc").agg(F.count(F.lit(1)).alias("cues_out"))
    counts = ["cues_in", "cues_out", *REASONS.values(), "dropped_settings"]
    report = files.select(*keys, "doc", "error").join(told, "doc", "left").join(out, "doc", "left").select(*keys, "doc", "error", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))
    return texts, report
