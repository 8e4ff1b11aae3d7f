"""Views of a session: first hours, context around a moment, previews, thinned overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.plans.staging import small_table

SECONDS_PER_HOUR = 3600


def first_hours(readings: DataFrame, stats: DataFrame, hours: float | None = None) -> DataFrame:
    """Rows of the first ``hours``; by default 4, or fewer full hours in a short session."""
    full = F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("sample_rate") * SECONDS_PER_HOUR)))
    chosen = F.lit(float(hours)) if hours is not None else F.least(F.lit(4), full)
    limits = stats.select(
        "machine", F.floor(chosen * F.col("sample_rate") * SECONDS_PER_HOUR).alias("_rows"))
    return readings.join(limits, "machine").filter("row_idx < _rows").drop("_rows")


def around(readings: DataFrame, centre: Column, seconds: float = 60.0) -> DataFrame:
    """Rows within ``seconds`` of one moment, both ends included: a plain pushed-down filter."""
    span = F.make_dt_interval(secs=F.lit(seconds))
    return readings.filter(F.col("timestamp").between(centre - span, centre + span))


def context_rows(readings: DataFrame, centres: DataFrame, seconds: float) -> DataFrame:
    """Rows within ``seconds`` of each of many ``centre_time``s (columns machine, centre_id).

    Time is cut into cells as wide as the context; a centre is sent to the three cells it
    can reach and meets the rows of that cell in an equi-join.
    """
    cell_us = max(1, int(seconds * 1e6))
    reach = F.lit(int(seconds * 1e6))
    cell = F.floor(F.unix_micros("timestamp") / cell_us)
    centre_cell = F.floor(F.unix_micros("centre_time") / cell_us)
    near = centres.withColumn("_cell", F.explode(F.array(centre_cell - 1, centre_cell, centre_cell + 1)))
    distance = F.abs(F.unix_micros("timestamp") - F.unix_micros("centre_time"))
    return (readings.withColumn("_cell", cell).join(near, ["machine", "_cell"])
            .filter(distance <= reach).drop("_cell"))


def window_context(readings: DataFrame, windows: DataFrame, sizes: float = 3.0) -> DataFrame:
    """Rows from ``sizes`` window lengths before a chosen window to as many after it.

    Time is cut into cells as wide as the machine's longest context, so a window meets the rows of at most two cells.
    """
    length = F.unix_micros("end_time") - F.unix_micros("start_time")
    reach = windows.select(
        "machine", "window_index",
        ((F.unix_micros("start_time") - length * sizes)).cast("bigint").alias("_from"),
        ((F.unix_micros("end_time") + length * sizes)).cast("bigint").alias("_to"))
    widest = reach.groupBy("machine").agg(F.max(F.col("_to") - F.col("_from")).alias("_cell_us"))
    sized = reach.join(widest, "machine")
    cells = F.explode(F.sequence(F.floor(F.col("_from") / F.col("_cell_us")), F.floor(F.col("_to") / F.col("_cell_us"))))
    at = F.unix_micros("timestamp")
    return (readings.join(widest, "machine").withColumn("_cell", F.floor(at / F.col("_cell_us"))).drop("_cell_us")
            .join(sized.withColumn("_cell", cells).drop("_cell_us"), ["machine", "_cell"])
            .filter(F.unix_micros("timestamp").between(F.col("_from"), F.col("_to")))
            .drop("_cell", "_from", "_to"))


def row_range_with_context(readings: DataFrame, start: int, end: int, look_back: int) -> DataFrame:
    """Rows ``[start - look_back, end)``; ``in_range`` marks those of the range itself."""
    return (readings.filter((F.col("row_idx") >= max(0, start - look_back)) & (F.col("row_idx") < end))
            .withColumn("in_range", F.col("row_idx") >= start))


def trim_context(rows: DataFrame) -> DataFrame:
    return rows.filter("in_range").drop("in_range")


def thin_rows(readings: DataFrame, stats: DataFrame, target: int = 2000) -> DataFrame:
    """Every k-th row per machine, k = max(1, n // target)."""
    step = stats.select("machine", F.greatest(F.lit(1).cast("bigint"), F.expr(f"n div {target}")).alias("_step"))
    return (readings.join(step, "machine")
            .filter(F.pmod(F.col("row_idx"), F.col("_step")) == 0).drop("_step"))


def preview(readings: DataFrame, rows: int) -> DataFrame:
    return readings.filter(F.col("row_idx") < rows)


def tick_rows(windows: DataFrame, picks: int = 8) -> DataFrame:
    """Evenly spaced windows from first to last (at most ``picks``) for axis labels."""
    n = F.col("_n")
    total = windows.groupBy("machine").agg((F.max("window_index") + 1).alias("_n"))
    k = F.least(F.lit(picks), n)
    chosen = F.when(n > 1, F.array_distinct(F.transform(
        F.sequence(F.lit(0), k - 1), lambda i: F.rint(i * (n - 1) / (k - 1)).cast("int"))))
    ticks = small_table(total.select("machine", F.explode(chosen).alias("window_index")))
    return windows.join(ticks, ["machine", "window_index"])
