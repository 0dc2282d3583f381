"""Decoding in tasks: pictures to frame features and fingerprints, sound files to blocks.

Media decoding proper is left to whatever produces raw rows: grey frames as (series, frame, t, w, h, grey) with
one byte a pixel, and WAV files, which need no decoder. Each row or file is one task's work; nothing passes the driver.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed kernels of the two feature maps: a second derivative in both directions, and a horizontal difference.
LAPLACE = np.array([[-1, 2, -1], [2, -4, 2], [-1, 2, -1]], float)
ACROSS = np.array([[0, 0, 0], [0, 1, -1], [0, 0, 0]], float)


def high_pass(grey: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The picture under a 3 x 3 kernel, edges repeated."""
    p = np.pad(grey.astype(float), 1, mode="edge")
    v = np.lib.stride_tricks.sliding_window_view(p, (3, 3))
    return np.einsum("yxij,ij->yx", v, kernel)


def feature(grey: np.ndarray, limit: float = 3.0) -> np.ndarray:
    """Both maps clipped to +-limit, each of length 1, together of length 1."""
    maps = [np.clip(high_pass(grey, k), -limit, limit).ravel() for k in (LAPLACE, ACROSS)]
    return np.concatenate([m / max(np.linalg.norm(m), 1e-12) for m in maps]) / np.sqrt(2)


def frame_features(frames: DataFrame, keys: Sequence[str], expected: DataFrame | None = None, share: float = 0.9) -> DataFrame:
    """(keys, frame, t, vec) of grey frames. expected (keys, n): a series with fewer than share of n frames fails the job rather than being taken for whole."""
    keys = list(keys)
    if expected is not None:
        got = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_got")).join(expected.select(*keys, F.col("n").alias("_n")), keys)
        short = F.when(F.col("_got") < share * F.col("_n"), F.raise_error(F.concat(F.lit("incomplete series: "), F.col("_got").cast("string"), F.lit(" frames"))))
        frames = frames.join(got.withColumn("_ok", F.coalesce(short.cast("string"), F.lit(""))).select(*keys, "_ok"), keys).filter("_ok = ''").drop("_ok")
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts):
        for p in parts:
            vec = [feature(np.frombuffer(g, np.uint8).reshape(h, w)).astype(np.float32) for g, w, h in zip(p["grey"], p["w"], p["h"])]
            yield p[[*keys, "frame", "t"]].assign(vec=vec)

    return frames.mapInPandas(run, f"{kinds}, frame long, t double, vec array<float>")


#: Fixed weights of red, green and blue in luma.
LUMA = np.array([0.299, 0.587, 0.114])


def fingerprints(frames: DataFrame, keys: Sequence[str], zones: int = 6) -> DataFrame:
    """(keys, frame, zones, p10, p50, p90, novelty) of colour frames (w, h, rgb: three bytes a pixel): means of red, green and blue of each horizontal zone, from the top, luma's quantiles, and its mean absolute difference to the frame before (0 for the first, or after one of another size)."""
    keys = list(keys)
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    before = F.lag("rgb").over(Window.partitionBy(*keys).orderBy("frame"))

    def run(parts):
        for p in parts:
            rows = []
            for now, last, w, h in zip(p["rgb"], p["_before"], p["w"], p["h"]):
                x = np.frombuffer(now, np.uint8).reshape(h, w, 3).astype(float)
                luma = (x @ LUMA).ravel()
                new = np.abs(luma - np.frombuffer(last, np.uint8).reshape(-1, 3) @ LUMA).mean() if last is not None and len(last) == len(now) else 0.0
                rows.append(([float(v) for z in np.array_split(x, zones) for v in z.mean((0, 1))], *np.percentile(luma, (10, 50, 90)), new))
            yield p[[*keys, "frame"]].assign(**dict(zip(("zones", "p10", "p50", "p90", "novelty"), map(list, zip(*rows)))) if rows else {})

    return frames.select(*keys, "frame", "w", "h", "rgb", before.alias("_before")).mapInPandas(run, f"{kinds}, frame long, zones array<double>, p10 double, p50 double, p90 double, novelty double")


def read_wav(spark: SparkSession, path: str, block: int = 44_100) -> DataFrame:
    """(track, block, rate, samples) of 16-bit WAV files under path: channels averaged, in the range of 16-bit numbers, `block` samples a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(parts):
        for p in parts:
            for name, content in zip(p["path"], p["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    rate, channels, k = w.getframerate(), w.getnchannels(), 0
                    while raw := w.readframes(block):
                        x = np.frombuffer(raw, "<i2").reshape(-1, channels).mean(1)
                        yield pd.DataFrame({"track": [name], "block": [k], "rate": [rate], "samples": [x]})
                        k += 1

    return files.mapInPandas(run, "track string, block long, rate int, samples array<double>")


def wav_parts(blocks: DataFrame, keys: Sequence[str], rate: int, every: int = 600) -> DataFrame:
    """(keys, part, content): 16-bit mono WAV files of `every` blocks each, in order of block (samples in the range of 16-bit numbers, clipped). A part is a task's work, so a long track is many."""
    keys = list(keys)
    kinds = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    row = F.sort_array(F.collect_list(F.struct("block", F.col("samples").cast("array<double>").alias("samples"))))
    parts = blocks.withColumn("part", F.floor(F.col("block") / every)).groupBy(*keys, "part").agg(F.flatten(F.transform(row, lambda b: b["samples"])).alias("samples"))

    def content(samples) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.clip(np.round(np.asarray(samples)), -32_768, 32_767).astype("<i2").tobytes())
        return out.getvalue()

    def run(batches):
        for p in batches:
            yield p[[*keys, "part"]].assign(content=[content(x) for x in p["samples"]])

    return parts.mapInPandas(run, f"{kinds}, part long, content binary")


def resampled_mono(blocks: DataFrame, keys: Sequence[str], every: int) -> DataFrame:
    """Blocks at one `every`-th of the rate, full scale 1: each output sample the mean of `every` input ones (blocks hold a multiple of it)."""
    thin = f"transform(sequence(0, size(samples) div {every} - 1), k -> aggregate(slice(samples, k * {every} + 1, {every}), cast(0.0 as double), (s, x) -> s + x) / {every} / 32768)"
    return blocks.filter(F.size("samples") >= every).select(*keys, "block", F.expr(thin).alias("samples"))
