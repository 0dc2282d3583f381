"""Cue documents: readers and writers of the text formats, cleaning, naming of outputs.

Documents come as (doc, text); readers split them to lines and find blocks with windows over one document's lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import cuetext, times

_TIMING = r"^\s*(?:\d+:)?\d{2}:\d{2}\.\d{3}\s+-->\s+(?:\d+:)?\d{2}:\d{2}\.\d{3}"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, i, line): without a byte-order mark, line ends of any kind."""
    text = F.regexp_replace(F.regexp_replace("text", "^﻿+", ""), "\r\n?", "\n")
    return docs.select("doc", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))


def read_vtt(docs: DataFrame) -> DataFrame:
    """(doc, n, start, end, payload, settings, ident) of WebVTT documents. A blank line ends a block, and so does a timing line if the block has one; blocks without timing in their first two lines aren't cues. Fails on documents without the header."""
    bad = F.when(~F.regexp_replace("text", "^﻿+", "").startswith("WEBVTT"), F.raise_error(F.concat(F.lit("no WEBVTT header: "), F.col("doc").cast("string"))))
    lines = lines_of(docs.filter(F.coalesce(bad.cast("string"), F.lit("")) == ""))
    order = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank, timing = F.trim(F.regexp_replace("line", r"\s", "")) == "", F.col("line").rlike(_TIMING)
    lines = lines.withColumn("_blank", blank).withColumn("_timing", timing).withColumn("_block", F.sum(F.col("_blank").cast("int")).over(order)).filter("not _blank")
    inside = Window.partitionBy("doc", "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("_part", F.greatest(F.lit(1), F.sum(F.col("_timing").cast("int")).over(inside)))
    chunks = lines.groupBy("doc", "_block", "_part").agg(F.sort_array(F.collect_list(F.struct("i", "line", "_timing"))).alias("c"))
    at = F.array_position(F.transform("c", lambda x: x["_timing"]), True).cast("int")
    cue = chunks.withColumn("_at", at).filter("_at in (1, 2)").withColumn("_line", F.element_at("c", F.col("_at"))["line"])
    stamp = r"^\s*([\d:.]+)\s+-->\s+([\d:.]+)(.*)$"
    n = F.row_number().over(Window.partitionBy("doc").orderBy("_first")) - 1
    cue = cue.withColumn("_first", F.element_at("c", 1)["i"])
    return cue.select(
        "doc", n.alias("n"), times.parse_stamp(F.regexp_extract("_line", stamp, 1)).alias("start"), times.parse_stamp(F.regexp_extract("_line", stamp, 2)).alias("end"),
        F.transform(F.slice("c", F.col("_at") + 1, F.size("c")), lambda x: x["line"]).alias("payload"), F.trim(F.regexp_extract("_line", stamp, 3)).alias("settings"),
        F.when(F.col("_at") == 2, F.element_at("c", 1)["line"]).otherwise("").alias("ident"))


def read_ass(docs: DataFrame) -> DataFrame:
    """(doc, n, start, end, payload, styled) of the dialogue events of ASS documents, by the last format line before them; the text field keeps its commas."""
    lines = lines_of(docs).withColumn("line", F.trim("line"))
    order = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.when(F.col("line").startswith("[") & F.col("line").endswith("]"), F.lower("line")), True).over(order)
    kind = F.lower(F.trim(F.substring_index("line", ":", 1)))
    rest = F.expr("substring(line, position(':' in line) + 1)")
    events = lines.withColumn("_s", section).filter("_s = '[events]' and line like '%:%'").withColumn("_kind", kind).withColumn("_rest", rest)
    fields = F.last(F.when(F.col("_kind") == "format", F.transform(F.split("_rest", ","), lambda x: F.lower(F.trim(x)))), True).over(order)
    said = events.withColumn("_f", fields).filter("_kind = 'dialogue'").withColumn("_v", F.expr("split(_rest, ',', size(_f))")).filter("size(_v) = size(_f)")
    get = lambda name: F.element_at("_v", F.array_position("_f", name).cast("int"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("i")) - 1
    got = said.select("doc", n.alias("n"), times.parse_stamp(get("start")).alias("start"), times.parse_stamp(get("end")).alias("end"), cuetext.plain_events(get("text")).alias("p"))
    return got.select("doc", "n", "start", "end", "p.payload", "p.styled")


def neutral(cues: DataFrame) -> DataFrame:
    """Cues with payload lines in common markup only."""
    flat = cues.select("*", F.posexplode_outer("payload").alias("_k", "_x"))
    back = [c for c in cues.columns if c != "payload"]
    return flat.withColumn("_x", cuetext.neutral(F.col("_x"))).groupBy(*back).agg(F.sort_array(F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_k", "_x")))).alias("_p")).select(*back, F.transform("_p", lambda x: x["_x"]).alias("payload"))


def cleaned(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cues with reason: drawing, empty, duplicate (of an earlier one's times and payload), or null for those to keep."""
    same = Window.partitionBy(*keys, "start", "end", "payload", "_shown").orderBy("n")
    shown = ~cuetext.is_drawing(F.col("payload")) & cuetext.has_text(F.col("payload"))
    marked = cues.withColumn("_shown", shown).withColumn("_r", F.row_number().over(same))
    reason = F.when(cuetext.is_drawing(F.col("payload")), "drawing").when(~F.col("_shown"), "empty").when(F.col("_r") > 1, "duplicate")
    return marked.withColumn("reason", reason).drop("_shown", "_r")


def removal_counts(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = lambda r: F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"dropped_{r}s" if r != "empty" else "dropped_empty")
    return marked.groupBy(*keys).agg(n("drawing"), n("empty"), n("duplicate"))


def write_srt(cues: DataFrame, keys: Sequence[str], order: Sequence[str] = ("start", "n")) -> DataFrame:
    """(keys, text): SubRip documents, cues numbered anew in order, those without text left out."""
    lines = F.filter("payload", lambda x: F.trim(x) != "")
    shown = cues.withColumn("_l", lines).filter(F.size("_l") > 0)
    shown = shown.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    block = F.concat_ws("\n", F.col("_k").cast("string"), F.concat(times.srt_stamp(F.col("start")), F.lit(" --> "), times.srt_stamp(F.col("end"))), F.array_join("_l", "\n"), F.lit(""))
    blocks = shown.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", block.alias("b")))).alias("_b"))
    return blocks.select(*keys, F.array_join(F.transform("_b", lambda x: x["b"]), "\n").alias("text"))


def write_vtt(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, text): WebVTT documents; cues in order of n, with ident and settings if they have those columns."""
    has = set(cues.columns)
    settings = F.when(F.col("settings") != "", F.concat(F.lit(" "), "settings")).otherwise("") if "settings" in has else F.lit("")
    ident = F.when(F.col("ident") != "", F.concat(F.col("ident"), F.lit("\n"))).otherwise("") if "ident" in has else F.lit("")
    head = F.concat(ident, times.vtt_stamp(F.col("start")), F.lit(" --> "), times.vtt_stamp(F.col("end")), settings)
    block = F.concat_ws("\n", F.concat_ws("\n", F.array(head), F.col("payload")), F.lit(""))
    blocks = cues.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))).alias("_b"))
    return blocks.select(*keys, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("_b", lambda x: x["b"]), "\n")).alias("text"))


def output_stems(files: DataFrame, media: Sequence[str]) -> DataFrame:
    """files (dir, name, track) with stem: the name without extension, the extension added where the folder has another media file of that stem (whatever the case), and the track if it isn't the first."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    named = files.withColumn("_stem", stem).withColumn("_ext", suffix)
    of = named.filter(F.col("_ext").isin(*media)).groupBy("dir", F.lower("_stem").alias("_key")).agg(F.count_distinct(F.lower("name")).alias("_n"))
    got = named.withColumn("_key", F.lower("_stem")).join(of, ["dir", "_key"], "left")
    full = F.concat("_stem", F.when(F.col("_n") > 1, F.concat(F.lit("__"), "_ext")).otherwise(""), F.when(F.col("track") > 0, F.concat(F.lit("__a"), F.col("track").cast("string"))).otherwise(""))
    return got.select("dir", "name", "track", full.alias("stem"))


def colliding(stems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, stem, n): output names, without case, that more than one file would have."""
    return stems.groupBy(*keys, F.lower("stem").alias("stem")).agg(F.count_distinct("dir", "name", "track").alias("n")).filter("n > 1")


def verdict(metrics: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """metrics with arrays critical and warnings: the names of the rules (severity, name, condition) that hold."""
    of = lambda kind: F.array_compact(F.array(*(F.when(cond, F.lit(name)) for severity, name, cond in rules if severity == kind), F.lit(None).cast("string")))
    return metrics.withColumn("critical", of("critical")).withColumn("warnings", of("warning"))
