"""Per-cycle features, summaries and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.functions.display import job_name_table
from loadline.plans.blocks import assign_intervals, exact_median
from loadline.plans.staging import small_table, stage
from loadline.profiles import PROFILES, with_profile

KEYS = ["machine"]
GREEN_FEATURES = ["log_duration", "mean_green", "max_green", "std_green", "green_fraction", "amber_fraction"]
RUN_FEATURES = ["duration_s", "mean_iavg", "max_iavg", "std_iavg", "mean_i1", "mean_i23", "log_duration"]


def labelled_samples(readings: DataFrame, intervals: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Readings + state_label, cycle_id, cycle_pos, job_type.

    Outside cycles: -1, NULL, -1.  Under the non-RED rule a single-sample cycle has a job
    type but no id.  ``jobs`` maps (machine, cycle_id) to job_type; a miss is -1.
    """
    spans = intervals
    if jobs is not None:
        known = jobs.select(*KEYS, F.col("cycle_id").alias("_key"), "job_type")
        # Spans outside cycles get distinct keys, so they do not meet in one task as NULLs.
        spans = (spans.withColumn("_key", F.coalesce("cycle_id", -1 - F.col("start")))
                 .join(known, [*KEYS, "_key"], "left").drop("_key"))
    else:
        spans = spans.withColumn("job_type", F.lit(None).cast("int"))
    wanted = ["state_label", "cycle_id", "cycle_start", "cycle_end", "cycle_rule", "job_type"]
    held = assign_intervals(readings, spans, KEYS, "row_idx", "start", "end", wanted)
    held = with_exprs(held, _none="cycle_id is null or (cycle_rule = 'non_red' and cycle_end = cycle_start)")
    return with_exprs(
        held,
        cycle_pos="""case when _none then null when cycle_end = cycle_start then 0D
                     else (row_idx - cycle_start) / (cycle_end - cycle_start) end""",
        cycle_id="case when _none then -1 else int(cycle_id) end",
        job_type="coalesce(job_type, -1)",
    ).drop("_none", "cycle_start", "cycle_end", "cycle_rule")


def cycle_samples(readings: DataFrame, intervals: DataFrame) -> DataFrame:
    """Only the samples inside cycles, with cycle_id and smoothed label."""
    spans = intervals.filter("cycle_id is not null")
    held = assign_intervals(readings, spans, KEYS, "row_idx", "start", "end", ["state_label", "cycle_id", "cycle_rule"])
    return held.filter("cycle_id is not null")


def green_cycle_features(samples: DataFrame) -> DataFrame:
    """Cycles between REDs: load while GREEN (0 if there is none) and state shares."""
    green = F.when(F.col("state_label") == 2, F.col("i_avg"))
    return (samples.filter("cycle_rule = 'non_red'").groupBy(*KEYS, "cycle_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.avg(green), F.lit(0.0)).alias("mean_green"),
        F.coalesce(F.max(green), F.lit(0.0)).alias("max_green"),
        F.coalesce(F.stddev_pop(green), F.lit(0.0)).alias("std_green"),
        F.avg(F.expr("case when state_label = 2 then 1D else 0D end")).alias("green_fraction"),
        F.avg(F.expr("case when state_label = 1 then 1D else 0D end")).alias("amber_fraction"))
        .withColumn("log_duration", F.log1p(F.col("_n")))
        .withColumn("duration_s", F.col("_n").cast("double"))
        .select(*KEYS, "cycle_id", "duration_s", *GREEN_FEATURES))


def run_cycle_features(samples: DataFrame) -> DataFrame:
    """GREEN-run cycles: load over the whole run."""
    return (samples.filter("cycle_rule = 'green_runs'").groupBy(*KEYS, "cycle_id").agg(
        F.count(F.lit(1)).cast("double").alias("duration_s"),
        F.avg("i_avg").alias("mean_iavg"), F.max("i_avg").alias("max_iavg"),
        F.stddev_pop("i_avg").alias("std_iavg"), F.avg("i1").alias("mean_i1"),
        F.avg((F.col("i2") + F.col("i3")) / 2.0).alias("mean_i23"))
        .withColumn("log_duration", F.log10(F.col("duration_s") + 1.0))
        .select(*KEYS, "cycle_id", *RUN_FEATURES))


def cycle_summary(stats: DataFrame, cycles: DataFrame) -> DataFrame:
    """Count, mean, population std and median of cycle durations; zeros without cycles."""
    spread = cycles.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_cycles"), F.avg("duration_s").alias("mean_duration"),
        F.stddev_pop("duration_s").alias("std_duration"))
    middle = exact_median(cycles, KEYS, "duration_s", "median_duration")
    joined = stats.select("machine").join(spread.join(middle, KEYS), KEYS, "left")
    return with_exprs(joined, n_cycles="coalesce(n_cycles, 0)", mean_duration="coalesce(mean_duration, 0D)",
                      std_duration="coalesce(std_duration, 0D)", median_duration="coalesce(median_duration, 0D)")


def job_summary(cycles: DataFrame, load: str = "mean_iavg") -> DataFrame:
    """Cycles, median duration and mean load per job cluster."""
    keys = [*KEYS, "job_type"]
    size = cycles.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), F.avg(load).alias("mean_load"))
    return size.join(exact_median(cycles, keys, "duration_s", "median_duration"), keys)


def hours_of(log_duration: str) -> Column:
    """Hours of a duration given as log1p of its seconds."""
    return F.expm1(F.col(log_duration)) / 3600.0


def named_jobs(jobs: DataFrame, profiles=PROFILES) -> DataFrame:
    """Jobs with the name of their type, by the number of types: the profile's, or the number of cycles if less."""
    sized = with_profile(jobs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")), "job_types", "extra_job_name", profiles=profiles)
    kinds = with_exprs(sized, job_types="int(least(job_types, _n))").drop("_n")
    return (jobs.join(small_table(kinds, "job-kinds"), KEYS)
            .join(job_name_table(jobs.sparkSession), ["extra_job_name", "job_types", "job_type"], "left").drop("extra_job_name", "job_types"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins between each key's minimum and maximum (empty bins are absent)."""
    df = stage(df.select(*keys, value).filter(F.col(value).isNotNull()), "histogram")
    ends = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    placed = df.join(ends, keys).withColumn("bin", F.expr(f"""
        case when {value} is null then null when _hi = _lo then 0
             else least({bins - 1}, cast(floor(({value} - _lo) / (_hi - _lo) * {bins}) as int)) end"""))
    return (placed.filter("bin is not null").groupBy(*keys, "bin")
            .agg(F.count(F.lit(1)).alias("samples"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .withColumn("bin_start", F.expr(f"_lo + bin * (_hi - _lo) / {bins}")).drop("_lo", "_hi"))
