"""Machine profiles: every constant that differs between machine kinds, as data.

A reading belongs to a ``machine``; the part of its name before the first ``_`` is the
profile (``furnace_17`` uses ``furnace``).  Adding a machine kind means adding a row.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RED, AMBER, GREEN = "RED", "AMBER", "GREEN"
STATES = (RED, AMBER, GREEN)
STATE_CODES = {RED: 0, AMBER: 1, GREEN: 2}


@dataclass(frozen=True)
class Profile:
    profile: str
    # loading
    time_mode: str            # wrapping_clock | iso_fallback | iso_drop
    base_time: str
    sort_by_time: bool
    i_avg_from_sensor: bool
    # windows and spectra
    window_seconds: float
    default_window_seconds: float
    overlap: float
    channels: str             # comma separated
    has_phase_imbalance: bool
    # window validation
    freq_target_hz: float
    freq_tolerance_hz: float
    freq_valid_fraction: float
    min_current_floor: float
    max_phase_imbalance: float
    valid_window_fraction: float
    # window rules
    red_max_rms: float
    red_max_variance: float | None
    green_min_rms: float
    green_min_thd: float
    green_min_variance: float
    green_min_imbalance: float | None
    intensity_cut: float
    dominant_factor: float
    dominant_confidence: float
    state_red: str
    state_amber: str
    state_green: str
    # sample labels, cycles, jobs
    label_red_max: float
    label_red_inclusive: bool
    label_green_min: float
    label_min_run: int
    merge_rule: str           # simultaneous | leftmost
    cycle_rule: str           # non_red | green_runs
    job_types: int
    job_features: str         # comma separated
    extra_job_name: str
    # model
    look_back: int
    model_channels: str


# Thresholds, names and sizes that decide results.
FURNACE = Profile(
    profile="furnace", time_mode="wrapping_clock", base_time="2024-01-01 00:00:00",
    sort_by_time=False, i_avg_from_sensor=False,
    window_seconds=60.0, default_window_seconds=60.0, overlap=0.5,
    channels="i1,i2,i3,i_avg", has_phase_imbalance=True,
    freq_target_hz=50.0, freq_tolerance_hz=0.5, freq_valid_fraction=0.90,
    min_current_floor=0.05, max_phase_imbalance=0.80, valid_window_fraction=0.80,
    red_max_rms=2.0, red_max_variance=1.0, green_min_rms=12.0, green_min_thd=0.15,
    green_min_variance=5.0, green_min_imbalance=0.20, intensity_cut=0.5,
    dominant_factor=1.2, dominant_confidence=0.8,
    state_red="Idle", state_amber="No Load", state_green="Load",
    label_red_max=2.0, label_red_inclusive=True, label_green_min=12.0, label_min_run=10,
    merge_rule="simultaneous", cycle_rule="non_red", job_types=3,
    job_features="log_duration,mean_green,max_green,std_green,green_fraction,amber_fraction",
    extra_job_name="Job", look_back=120, model_channels="i1,i2,i3,i_avg",
)
CONVEYER = replace(
    FURNACE,
    profile="conveyer", time_mode="iso_fallback", base_time="2026-01-01 00:00:00",
    sort_by_time=True, window_seconds=3.0,
    min_current_floor=0.05, max_phase_imbalance=1.50,
    red_max_rms=0.10, red_max_variance=None, green_min_rms=0.35, green_min_thd=0.05,
    green_min_variance=0.002, green_min_imbalance=0.15, intensity_cut=0.3,
    dominant_factor=1.10, dominant_confidence=0.85,
    state_red="HALT", state_amber="IDLE", state_green="RUNNING",
    label_red_max=0.10, label_red_inclusive=False, label_green_min=0.35, label_min_run=3,
    merge_rule="leftmost", cycle_rule="green_runs", job_types=2,
    job_features="log_duration,mean_iavg,std_iavg,mean_i23",
    extra_job_name="Mode", look_back=30,
)
ROBO = replace(
    CONVEYER,
    profile="robo", i_avg_from_sensor=True,
    window_seconds=30.0, default_window_seconds=30.0,
    channels="i1,i_avg", has_phase_imbalance=False,
    min_current_floor=0.01, max_phase_imbalance=2.00,
    red_max_rms=0.085, green_min_rms=0.115, green_min_variance=0.0005,
    green_min_imbalance=None,
    state_red="STANDBY", state_amber="IDLE", state_green="ACTIVE",
    label_red_max=0.085, label_green_min=0.115,
    job_features="log_duration,mean_iavg,std_iavg,mean_i1", model_channels="i1,i_avg",
)
MILLING = replace(
    CONVEYER,
    profile="milling", time_mode="iso_drop",
    window_seconds=20.0, default_window_seconds=30.0,
    min_current_floor=0.05, max_phase_imbalance=0.80,
    red_max_rms=1.0, green_min_rms=3.0, green_min_thd=0.05,
    green_min_variance=0.05, green_min_imbalance=0.15,
    state_red="Idle", state_amber="No Load", state_green="Cutting",
    label_red_max=1.0, label_green_min=3.0, label_min_run=5, job_types=3,
)
PROFILES = (FURNACE, CONVEYER, ROBO, MILLING)

_SPARK_TYPES = {"str": T.StringType(), "bool": T.BooleanType(), "int": T.IntegerType()}
SCHEMA = T.StructType([
    T.StructField(name, _SPARK_TYPES.get(f.type, T.DoubleType()))
    for name, f in Profile.__dataclass_fields__.items()
])
_ARROW = pa.schema([
    (f.name, {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(),
              "double": pa.float64()}[f.dataType.simpleString()]) for f in SCHEMA])


def profile_of(machine: Column | str = "machine") -> Column:
    return F.substring_index(machine, "_", 1)


def profile_table(spark: SparkSession, profiles=PROFILES) -> DataFrame:
    """Profiles as a local relation (Arrow input), so its exact size is known."""
    rows = [asdict(p) for p in profiles]
    return spark.createDataFrame(pa.Table.from_pylist(rows, _ARROW), SCHEMA)


def override(profiles=PROFILES, **per_profile: dict) -> tuple[Profile, ...]:
    """Defaults merged with user values: ``override(furnace={"red_max_rms": 3.0})``."""
    return tuple(replace(p, **per_profile.get(p.profile, {})) for p in profiles)


def with_profile(df: DataFrame, *columns: str, profiles=PROFILES,
                 overrides: DataFrame | None = None) -> DataFrame:
    """Attach profile columns to every row of ``df`` by its machine; an unknown machine fails.

    The profile table is literal configuration, a handful of rows whose exact size
    Catalyst knows, so the join is a broadcast without a hint.  ``overrides`` holds one
    row per machine with replacement values; NULL keeps the profile's value.
    """
    table = profile_table(df.sparkSession, profiles).select(
        F.col("profile").alias("_profile"), *columns)
    missing = F.raise_error(F.concat(F.lit("no profile for machine "), F.coalesce("machine", F.lit("NULL"))))
    out = df.join(table, profile_of() == F.col("_profile"), "left")
    out = out.filter(F.when(F.col("_profile").isNull(), missing.cast("boolean")).otherwise(True)).drop("_profile")
    if overrides is not None:
        changed = [c for c in overrides.columns if c in columns]
        out = out.join(
            overrides.select("machine", *[F.col(c).alias(f"_new_{c}") for c in changed]),
            "machine", "left")
        out = out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in changed})
        out = out.drop(*[f"_new_{c}" for c in changed])
    return out
