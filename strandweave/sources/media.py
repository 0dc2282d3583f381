"""Media metadata from a prober's JSON reports (path, report): one pass of from_json, then columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.times import parse_duration, parse_rate

REPORT = (
    "struct<format: struct<duration: string, start_time: string>, streams: array<struct<index: int, codec_type: string, codec_name: string, channels: int, channel_layout: string, "
    "width: int, height: int, r_frame_rate: string, avg_frame_rate: string, nb_frames: string, duration: string, start_time: string, "
    "tags: struct<language: string, title: string, DURATION: string>, disposition: struct<attached_pic: int, `default`: int>>>>"
)


def _streams(kind: str) -> Column:
    real = lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0
    of = F.filter("r.streams", lambda s: F.coalesce(s["codec_type"] == kind, F.lit(False)))
    return F.filter(of, real) if kind == "video" else of


def passports(reports: DataFrame, track: int = 0) -> DataFrame:
    """(path, duration, rate, width, height, frames, channels, layout, n_audio, has_video, av_delay, video_start) of each report.

    Durations come from the video stream, else its tag, else the container. Channels are 2 where unknown. The delay is the video's start less the chosen audio track's, 0 if either is
    missing; video_start is the video's start less the earliest. A report that can't be read counts as having video, and nothing else is known of it.
    """
    r = reports.select("path", F.from_json("report", REPORT).alias("r"))
    r = r.withColumn("v", F.get(_streams("video"), F.lit(0))).withColumn("a", F.get(_streams("audio"), F.lit(track)))
    number = lambda c: F.col(c).try_cast("double")
    earliest = F.array_min(F.transform("r.streams", lambda s: s["start_time"].try_cast("double")))
    rate = F.coalesce(parse_rate(F.col("v.avg_frame_rate")), parse_rate(F.col("v.r_frame_rate")))
    duration = F.coalesce(number("v.duration"), parse_duration(F.col("v.tags.DURATION")), number("r.format.duration"))
    return r.select(
        "path", duration.alias("duration"), rate.alias("rate"), F.col("v.width").alias("width"), F.col("v.height").alias("height"),
        F.coalesce(F.col("v.nb_frames").try_cast("bigint"), F.bround(duration * rate).cast("bigint")).alias("frames"),
        F.coalesce("a.channels", F.lit(2)).alias("channels"), F.col("a.channel_layout").alias("layout"), F.coalesce(F.size(_streams("audio")), F.lit(0)).alias("n_audio"),
        (F.col("r.streams").isNull() | F.col("v").isNotNull()).alias("has_video"),
        F.coalesce(number("v.start_time") - number("a.start_time"), F.lit(0.0)).alias("av_delay"), F.coalesce(number("v.start_time") - earliest, F.lit(0.0)).alias("video_start"))


def audio_tracks(reports: DataFrame) -> DataFrame:
    """(path, track, codec, channels, layout, language, title, is_default) of each audio stream."""
    r = reports.select("path", F.from_json("report", REPORT).alias("r"))
    s = r.select("path", F.posexplode(_streams("audio")).alias("track", "s"))
    return s.select("path", "track", F.col("s.codec_name").alias("codec"), F.coalesce("s.channels", F.lit(2)).alias("channels"), F.col("s.channel_layout").alias("layout"), F.col("s.tags.language").alias("language"), F.col("s.tags.title").alias("title"), (F.coalesce("s.disposition.default", F.lit(0)) == 1).alias("is_default"))


def delay_filter(delay: Column, least: float = 0.001) -> Column:
    """What a decoder does about a delay: trims the head where positive, pads where negative, nothing within `least`."""
    return F.when(delay > least, F.concat(F.lit("atrim=start="), F.format_number(delay, 3), F.lit(",asetpts=PTS-STARTPTS"))).when(delay < -least, F.concat(F.lit("adelay="), F.bround(-delay * 1000).cast("bigint").cast("string"), F.lit(":all=1"))).otherwise("")


def packet_axis(packets: DataFrame, slack: float = 1.5) -> DataFrame:
    """(path, axis, uneven): sorted packet times (path, pts as text), null if any isn't a number; uneven where a time is more than `slack` steps off the best even grid."""
    t = packets.withColumn("_t", F.col("pts").try_cast("double"))
    got = t.groupBy("path").agg(F.count_if(F.col("_t").isNull()).alias("_bad"), F.sort_array(F.collect_list("_t")).alias("_a"))
    n = F.size("_a")
    step = (F.element_at("_a", -1) - F.element_at("_a", 1)) / (n - 1)
    off = F.array_max(F.transform("_a", lambda x, i: F.abs(x - F.element_at("_a", 1) - i * step))) / step
    return got.select("path", F.when(F.col("_bad") == 0, F.col("_a")).alias("axis"), ((F.col("_bad") == 0) & (n > 2) & F.coalesce(off > slack, F.lit(False))).alias("uneven"))
