"""Window validation: grid frequency, current range, phase balance, energy floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.functions.display import phase_spread
from loadline.profiles import PROFILES, with_profile

THRESHOLDS = ["freq_target_hz", "freq_tolerance_hz", "freq_valid_fraction",
              "min_current_floor", "max_phase_imbalance", "valid_window_fraction"]
VALIDATION_COLUMNS = ["is_valid", "freq_ok", "range_ok", "phase_ok", "energy_ok",
                      "freq_valid_pct", "avg_freq", "validation_imbalance", "avg_i_avg",
                      "failure_reason"]
PHASES = ("i1", "i2", "i3")


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def quality_aggregates() -> list[Column]:
    """Needs the frequency target and tolerance columns on the window rows."""
    f = _number("frequency")
    in_band = F.abs(f - F.col("freq_target_hz")) <= F.col("freq_tolerance_hz")
    sane = [F.bool_and((_number(c) >= 0) & (F.col(c) < float("inf"))) for c in PHASES]
    loaded = [F.max(_number(c)) > 0.01 for c in PHASES]
    return [
        F.avg(F.when(in_band, 1.0).when(~in_band, 0.0)).alias("_in_band"),
        F.avg(f).alias("_avg_freq"),
        F.coalesce(sane[0] & sane[1] & sane[2], F.lit(False)).alias("_sane"),
        F.coalesce(loaded[0] | loaded[1] | loaded[2], F.lit(False)).alias("_loaded"),
        *[F.avg(_number(c)).alias(f"_mean_{c}") for c in PHASES],
        F.avg(_number("i_avg")).alias("_mean_i_avg"),
    ]


def validation_columns(windows: DataFrame, profiles=PROFILES, overrides: DataFrame | None = None) -> DataFrame:
    """Turn the quality aggregates into checks, percentages and a reason text."""
    w = with_profile(windows, *THRESHOLDS[2:5], profiles=profiles, overrides=overrides)
    w = w.withColumn("validation_imbalance", phase_spread("_mean_i1", "_mean_i2", "_mean_i3"))
    w = with_exprs(
        w, avg_freq="coalesce(_avg_freq, 50D)", freq_valid_pct="_in_band * 100D", avg_i_avg="_mean_i_avg",
        freq_ok="coalesce(_in_band * 100D / 100D >= freq_valid_fraction, false)",
        range_ok="_sane and _loaded", phase_ok="validation_imbalance <= max_phase_imbalance",
        energy_ok="_mean_i_avg >= min_current_floor")
    # Wording of the reasons.
    w = with_exprs(w, is_valid="freq_ok and range_ok and phase_ok and energy_ok", failure_reason="""
        coalesce(nullif(concat_ws('; ',
          case when not freq_ok then format_string('Grid freq %.2f Hz out of band', avg_freq) end,
          case when not range_ok then 'Current values out of valid range or all-zero' end,
          case when not phase_ok then format_string(
            'Phase imbalance CV=%.2f > %.2f', validation_imbalance, max_phase_imbalance) end,
          case when not energy_ok then format_string(
            'Mean i_avg %.3f A < floor %.3f A', avg_i_avg, min_current_floor) end), ''), 'OK')""")
    return w.drop("_in_band", "_avg_freq", "_sane", "_loaded", "_mean_i1", "_mean_i2", "_mean_i3",
                  "_mean_i_avg", "freq_valid_fraction", "min_current_floor", "max_phase_imbalance")


def dataset_verdict(machines: DataFrame, validated: DataFrame, profiles=PROFILES) -> DataFrame:
    """One row per machine of ``machines``; a machine without windows is not valid."""
    per_machine = validated.groupBy("machine").agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if("is_valid").alias("valid_windows"),
        F.avg("avg_freq").alias("avg_freq"),
        F.avg("validation_imbalance").alias("avg_phase_imbalance"),
        F.avg("avg_i_avg").alias("avg_i_avg"))
    v = with_profile(machines.select("machine").join(per_machine, "machine", "left"),
                     "valid_window_fraction", profiles=profiles)
    zero = F.lit(0).cast("bigint")
    pct = F.when(F.col("total_windows") > 0, F.col("valid_windows") / F.col("total_windows") * 100.0).otherwise(0.0)
    return v.select(
        "machine", (pct / 100.0 >= F.col("valid_window_fraction")).alias("is_dataset_valid"),
        F.coalesce("total_windows", zero).alias("total_windows"),
        F.coalesce("valid_windows", zero).alias("valid_windows"), pct.alias("valid_pct"),
        F.coalesce("avg_freq", F.lit(50.0)).alias("avg_freq"),
        F.coalesce("avg_phase_imbalance", F.lit(0.0)).alias("avg_phase_imbalance"),
        F.coalesce("avg_i_avg", F.lit(0.0)).alias("avg_i_avg"))
