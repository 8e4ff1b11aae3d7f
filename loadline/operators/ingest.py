"""From raw text rows to clean readings.

Raw rows carry ``machine`` and ``row_idx`` (file order) plus the canonical text columns.
Columns that a log lacks are replaced by constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.functions.display import clock_label
from loadline.functions.parsing import clock_seconds, current, grid_frequency, iso_timestamp
from loadline.plans.blocks import carry_scan, number_rows, previous
from loadline.plans.staging import stage

READING_COLUMNS = [
    "machine", "row_idx", "timestamp", "timestamp_str", "i1", "i2", "i3", "i_avg", "frequency"]
HALF_HOUR = 1800.0


def _seconds_after(base: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(base) + F.round(seconds * 1e6).cast("bigint"))


def wrapping_clock(df: DataFrame, base_time: str, text: str = "timestamp_str") -> DataFrame:
    """Monotonic times from an ``MM:SS.f`` clock in row order.

    A drop of more than half an hour is a new hour; smaller jumps back are kept.  An
    unreadable clock has no time and so no window (``count_bad_clocks`` counts such rows), and the
    next row is compared with the last readable one.
    """
    seconds = df.withColumn("_sec", clock_seconds(text))
    readable = carry_scan(seconds, ["machine"], "row_idx", lasts={"_last": F.col("_sec")}, name="readable")
    with_prev = previous(readable, ["machine"], "row_idx", _prev="_last")
    dropped = F.when(F.col("_sec") < F.col("_prev") - HALF_HOUR, 1).otherwise(0).cast("bigint")
    scanned = carry_scan(with_prev, ["machine"], "row_idx", sums={"_hours": dropped}, name="clock")
    total = F.col("_hours") * 3600.0 + F.col("_sec")
    return (scanned.withColumn("timestamp", _seconds_after(F.lit(base_time).cast("timestamp"), total))
            .drop("_sec", "_last", "_prev", "_hours"))


def iso_with_fallback(df: DataFrame, base_time: str, text: str = "timestamp_str",
                      file_keys: tuple[str, ...] = ("machine",), file_row: str = "row_idx") -> DataFrame:
    """ISO times; a bad one becomes the file's first good time plus its row number in s."""
    parsed = df.withColumn("_ts", iso_timestamp(text))
    first_good = stage(
        parsed.filter("_ts is not null").groupBy(*file_keys)
        .agg(F.min_by("_ts", file_row).alias("_base")), "first-time")
    joined = parsed.join(first_good, [*file_keys], "left")
    base = F.coalesce("_base", F.lit(base_time).cast("timestamp"))
    guess = _seconds_after(base, F.col(file_row).cast("double"))
    return joined.withColumn("timestamp", F.coalesce("_ts", guess)).drop("_ts", "_base")


def iso_dropping_bad(df: DataFrame, text: str = "timestamp_str") -> DataFrame:
    return df.withColumn("timestamp", iso_timestamp(text)).filter("timestamp is not null")


def count_bad_times(df: DataFrame, text: str = "timestamp_str") -> DataFrame:
    return df.groupBy("machine").agg(
        F.count_if(iso_timestamp(text).isNull()).alias("bad_rows"),
        F.count(F.lit(1)).alias("rows"))


def count_bad_clocks(df: DataFrame, text: str = "timestamp_str") -> DataFrame:
    """Rows per machine whose ``MM:SS.f`` clock can't be read."""
    return df.groupBy("machine").agg(
        F.count_if(clock_seconds(text).isNull()).alias("bad_rows"), F.count(F.lit(1)).alias("rows"))


def synthetic_time(df: DataFrame, base_time: str) -> DataFrame:
    """No time column: one sample per second from the base time."""
    ts = _seconds_after(F.lit(base_time).cast("timestamp"), F.col("row_idx").cast("double"))
    return df.withColumn("timestamp", ts).withColumn("timestamp_str", clock_label("timestamp"))


def numeric_columns(df: DataFrame, i_avg_from_sensor: bool = False) -> DataFrame:
    have = set(df.columns)
    typed = {c: current(c) if c in have else F.lit(0.0) for c in ("i1", "i2", "i3")}
    typed["frequency"] = grid_frequency("frequency") if "frequency" in have else F.lit(50.0)
    if i_avg_from_sensor and "i_avg_src" in have:
        typed["i_avg"] = current("i_avg_src")
    out = df.withColumns(typed)
    if "i_avg" not in typed:
        out = out.withColumn("i_avg", (F.col("i1") + F.col("i2") + F.col("i3")) / 3.0)
    return out


def sort_by_time(df: DataFrame) -> DataFrame:
    """Order by time (file order on ties) and renumber from 0."""
    return number_rows(df.withColumnRenamed("row_idx", "_src_row"), ["machine"],
                       ["timestamp", "_src_row"]).drop("_src_row")


def clean(raw: DataFrame, profile, file_keys: tuple[str, ...] = ("machine",),
          file_row: str = "row_idx") -> DataFrame:
    """Raw text rows of one profile to the fixed reading columns."""
    if "timestamp_str" not in raw.columns:
        timed = synthetic_time(raw, profile.base_time)
    elif profile.time_mode == "wrapping_clock":
        timed = wrapping_clock(raw, profile.base_time)
    elif profile.time_mode == "iso_fallback":
        timed = iso_with_fallback(raw, profile.base_time, file_keys=file_keys, file_row=file_row)
    else:
        timed = iso_dropping_bad(raw)
    typed = numeric_columns(timed, profile.i_avg_from_sensor)
    typed = typed.select(*READING_COLUMNS)
    return sort_by_time(typed).select(*READING_COLUMNS) if profile.sort_by_time else typed
