"""Overlapping time windows, counted from each machine's first row.

Window ``k`` covers ``[t_first + k * step, + size)``.  Instead of testing every row against
every window, each row computes the range of ``k`` it belongs to and is repeated for those
(twice at 50 % overlap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.plans.blocks import dense_number
from loadline.plans.staging import small_table
from loadline.profiles import PROFILES, with_profile

MAX_WINDOWS = 1000
WINDOW_KEYS = ["machine", "k"]


def window_settings(stats: DataFrame, profiles=PROFILES, size_seconds: float | None = None,
                    overlap: float | None = None) -> DataFrame:
    """Per machine: size and step in us, first time, last window number, min rows, rate."""
    s = with_profile(stats, "window_seconds", "overlap", profiles=profiles)
    size = F.lit(float(size_seconds)) if size_seconds else F.col("window_seconds")
    share = F.lit(float(overlap)) if overlap is not None else F.col("overlap")
    step = size * (1.0 - share)
    span = (F.unix_micros("t_last") - F.unix_micros("t_first")) / 1e6
    last_k = F.least(
        F.floor(span / step), F.greatest(F.lit(0), F.ceil((span - share * size) / step)))
    return small_table(s.select(
        "machine", F.unix_micros("t_first").alias("t0_us"),
        F.round(size * 1e6).cast("bigint").alias("size_us"),
        F.round(step * 1e6).cast("bigint").alias("step_us"),
        last_k.cast("bigint").alias("last_k"),
        F.greatest(F.lit(2), F.floor(size * F.col("sample_rate") * 0.5)).cast("bigint").alias("min_rows"),
        "sample_rate"), "window-settings")


def window_rows(readings: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per (reading, window it lies in), with the settings of its machine."""
    joined = readings.join(settings, "machine")
    offset = F.unix_micros("timestamp") - F.col("t0_us")
    low = F.greatest(F.lit(0), F.floor((offset - F.col("size_us")) / F.col("step_us")) + 1)
    high = F.least(F.col("last_k"), F.floor(offset / F.col("step_us")))
    numbers = F.when(high >= low, F.sequence(low.cast("bigint"), high.cast("bigint")))
    return joined.withColumn("k", F.explode(numbers))


def group_windows(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregate window rows by window and drop windows with too few rows."""
    grouped = rows.groupBy(*WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("row_idx").alias("start_row"), F.max("row_idx").alias("end_row"),
        *[F.first(c).alias(c) for c in ("t0_us", "size_us", "step_us", "min_rows", "sample_rate")],
        *aggregates)
    kept = grouped.filter("n_samples >= min_rows")
    start = F.col("t0_us") + F.col("k") * F.col("step_us")
    return kept.withColumns({
        "start_time": F.timestamp_micros(start),
        "end_time": F.timestamp_micros(start + F.col("size_us")),
        "centre_time": F.timestamp_millis(F.floor((start + F.col("size_us") / 2) / 1000).cast("bigint")),
    }).drop("t0_us", "size_us", "step_us", "min_rows")


def number_windows(windows: DataFrame) -> DataFrame:
    """Renumber the kept windows 0, 1, ... per machine; dropped ones leave no gap."""
    return (dense_number(windows, ["machine"], "k", "window_index").drop("k")
            .withColumn("window_index", F.col("window_index").cast("int")))


def generate_windows(readings: DataFrame, settings: DataFrame) -> DataFrame:
    return number_windows(group_windows(window_rows(readings, settings))).select(
        "machine", "window_index", "start_time", "end_time", "centre_time",
        "n_samples", "start_row", "end_row")


def thin_windows(windows: DataFrame, limit: int = MAX_WINDOWS) -> DataFrame:
    """Every k-th window, k = n // limit, where a machine has more than ``limit``.

    A display option: the analysis itself never drops windows.
    """
    total = small_table(windows.groupBy("machine").agg((F.max("window_index") + 1).alias("_n")))
    step = F.when(F.col("_n") > limit, F.expr(f"_n div {limit}")).otherwise(F.lit(1))
    return (windows.join(total, "machine")
            .filter(F.pmod(F.col("window_index"), step) == 0).drop("_n"))


def last_full_window(windows: DataFrame, min_samples: int = 8) -> DataFrame:
    """Last window with enough samples per machine; the last one if none has."""
    full = F.max(F.when(F.col("n_samples") >= min_samples, F.col("window_index")))
    return windows.groupBy("machine").agg(
        F.coalesce(full, F.max("window_index")).alias("last_full_index"))
