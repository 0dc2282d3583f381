"""Rates, durations and time stamps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rate(s: Column) -> Column:
    """A number or a ratio a/b as a double, if finite and positive; null otherwise."""
    parts = F.split(F.trim(s), "/")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    value = F.when(F.size(parts) == 1, a).when(F.size(parts) == 2, F.try_divide(a, b))
    return F.when((value > 0) & (value < float("inf")) & ~F.isnan(value), value)


def parse_duration(s: Column) -> Column:
    """H:M:S, M:S or seconds, in seconds; null if it is none of these."""
    parts = F.split(F.trim(s), ":")
    n = F.size(parts)
    get = lambda k: F.get(parts, n - k).try_cast("double")
    return F.when(n == 1, get(1)).when(n == 2, get(2) * 60 + get(1)).when(n == 3, get(3) * 3600 + get(2) * 60 + get(1))


def _stamp(seconds: Column, mark: str) -> Column:
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_stamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded half to even; negative times count as zero."""
    return _stamp(seconds, ",")


def vtt_stamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, likewise."""
    return _stamp(seconds, ".")


def parse_stamp(s: Column) -> Column:
    """[H:]MM:SS with a fraction of any number of digits after . or , in seconds; null if it isn't one."""
    shape = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d+))?\s*$"
    part = lambda k: F.regexp_extract(s, shape, k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).try_cast("double"), F.lit(0.0))
    fraction = F.when(part(4) == "", 0.0).otherwise(part(4).try_cast("double") / F.pow(F.lit(10.0), F.length(part(4))))
    return F.when(s.rlike(shape), number(1) * 3600 + number(2) * 60 + number(3) + fraction)


def minutes(seconds: Column) -> Column:
    """M:SS, cut to whole seconds."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def even(v: Column) -> Column:
    """Rounded half to even, then down to an even number."""
    r = F.bround(v).cast("bigint")
    return r - F.pmod(r, F.lit(2))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("double") / 1e6
