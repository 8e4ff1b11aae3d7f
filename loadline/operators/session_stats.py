"""One row per machine: size, time span, sample rate, current range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.plans.blocks import median_of_counts, previous, ranged_counts
from loadline.plans.staging import small_table


def machine_stats(readings: DataFrame) -> DataFrame:
    """n, t_first, t_last (in row order), sample_rate, min / max i_avg per machine.

    The rate is 1 / exact median time step (1.0 for fewer than two rows or a step <= 0).
    """
    steps = previous(readings, ["machine"], "row_idx", _prev="timestamp").withColumn(
        "_step", F.unix_micros("timestamp") - F.unix_micros("_prev"))
    by_step = ranged_counts(steps.groupBy("machine", "_step").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("timestamp", "row_idx").alias("_first"), F.min("row_idx").alias("_lo"),
        F.max_by("timestamp", "row_idx").alias("_last"), F.max("row_idx").alias("_hi"),
        F.min("i_avg").alias("_min"), F.max("i_avg").alias("_max")), ["machine"], "_step")
    whole = by_step.groupBy("machine").agg(
        F.sum("_n").alias("n"),
        F.min_by("_first", "_lo").alias("t_first"), F.max_by("_last", "_hi").alias("t_last"),
        F.min("_min").alias("min_i_avg"), F.max("_max").alias("max_i_avg"))
    middle = median_of_counts(by_step, ["machine"], "_step", "_n", "_median")
    return small_table(
        whole.join(middle, "machine", "left")
        .withColumn("sample_rate", F.when(F.col("_median") > 0, 1e6 / F.col("_median")).otherwise(1.0)).drop("_median"),
        "machine-stats")


def session_overview(stats: DataFrame) -> DataFrame:
    return stats.select(
        "machine", F.col("n").alias("total_samples"),
        (F.col("n") / (F.col("sample_rate") * 3600.0)).alias("duration_hours"),
        "sample_rate", "min_i_avg", "max_i_avg")
