"""Windows with watermarks: levels per time window, silences as sessions, grid nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_levels(events: DataFrame, keys: Sequence[str], late: str = "1 hour", length: str = "1 day", slide: str | None = None) -> DataFrame:
    """(keys, start, n, weight, mean) of events (ts, o, w) by window of event time; rows later than the watermark go."""
    of = F.window("ts", length, slide) if slide else F.window("ts", length)
    got = events.withWatermark("ts", late).groupBy(*keys, of.alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), (F.sum(F.col("o") * F.col("w")) / F.sum("w")).alias("mean"))
    return got.select(*keys, F.col("_w.start").alias("start"), "n", "weight", "mean")


def sessions(events: DataFrame, keys: Sequence[str], gap: str, late: str = "1 hour") -> DataFrame:
    """(keys, start, end, n): runs of events no further than gap apart; end is the last event's time plus gap."""
    got = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def quiet_sessions(samples: DataFrame, keys: Sequence[str], quiet: float, gap: str, late: str = "1 hour") -> DataFrame:
    """Silences as sessions of samples (ts, v) under `quiet`."""
    return sessions(samples.filter(F.abs("v") < quiet), keys, gap, late)
