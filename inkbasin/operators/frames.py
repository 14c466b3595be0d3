"""Frames and scenes: which moments of a recording to keep. The pictures themselves are read elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_times(duration: Column, interval: float, most: int = 500) -> Column:
    """Every interval seconds from 0, before the end, at most so many."""
    n = F.least(F.ceil(duration / interval), F.lit(most)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(float(interval)))).otherwise(F.array().cast("array<double>"))


def with_floor(times: Column, duration: Column, least: int = 8, longer: float = 600, interval: float = 45) -> Column:
    """Few scenes in a long recording: a moment every 45 seconds besides."""
    few = (F.size(times) < least) & (duration > longer)
    return F.when(few, F.array_sort(F.array_union(times, sample_times(duration, interval, 1 << 20)))).otherwise(times)


def with_breaker(times: Column, over: int = 60, target: int = 35) -> Column:
    """Too many scenes: so many evenly spaced ones."""
    n = F.size(times)
    return F.when(n > over, F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.get(times, F.floor(i * n / target).cast("int")))).otherwise(times)


def capped(times: Column, extra: int = 5, most: int = 35) -> Column:
    return F.slice(times, F.lit(1), F.greatest(F.least(F.size(times) + extra, F.lit(most)), F.lit(1)))


def kept_by_change(values: Column, least: float) -> Column:
    """Of values in order, those that differ by more than `least` from the last one kept; the first is kept."""
    none = F.array().cast("array<double>")
    return F.aggregate(values, none, lambda kept, v: F.when((F.size(kept) == 0) | (F.abs(v - F.get(kept, F.size(kept) - 1)) > least), F.array_append(kept, v)).otherwise(kept))


def similarity(a: Column, b: Column) -> Column:
    """1 less the mean difference of two pictures in grey levels; 0 if they differ in size or are empty."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(1.0) - total / (F.lit(255.0) * F.size(a))).otherwise(0.0)


def kept_by_similarity(frames: Column, most: float = 0.85) -> Column:
    """Of frames (pixels, in order), those less similar than `most` to the last one kept; the first is kept."""
    return F.aggregate(frames, F.slice(frames, 1, 0), lambda kept, f: F.when((F.size(kept) == 0) | (similarity(F.get(kept, F.size(kept) - 1)["pixels"], f["pixels"]) < most), F.array_append(kept, f)).otherwise(kept))


def per_minute(frames: DataFrame, by: str, seconds: str, most: int) -> DataFrame:
    """At most so many frames of each minute, the earliest."""
    w = Window.partitionBy(by, F.floor(F.col(seconds) / 60)).orderBy(seconds)
    return frames.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def chunks(frames: DataFrame, by: str, order: str, size: int = 10) -> DataFrame:
    """frames with the number of their request, so many in each."""
    return frames.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def scene_times(log: Column) -> Column:
    """Moments in the log of a scene filter."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:\s*([0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
