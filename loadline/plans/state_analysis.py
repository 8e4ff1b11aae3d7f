"""The window analysis from readings to smoothed states, as one chain of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loadline.operators.classify import classify
from loadline.operators.features import FEATURE_COLUMNS, feature_row, time_aggregates, with_phase_imbalance
from loadline.operators.quality import THRESHOLDS, VALIDATION_COLUMNS, quality_aggregates, validation_columns
from loadline.operators.session_stats import machine_stats
from loadline.operators.spectral import (
    channel_signals, signal, with_spectral_features, with_spectrum)
from loadline.operators.states import MIN_CONSECUTIVE, hysteresis
from loadline.operators.windows import (
    group_windows, number_windows, window_rows, window_settings)
from loadline.profiles import PROFILES, with_profile

WINDOW_COLUMNS = ["machine", "window_index", "start_time", "end_time", "centre_time",
                  "n_samples", "start_row", "end_row"]


def settings_of(readings: DataFrame, profiles=PROFILES, **window) -> DataFrame:
    return window_settings(machine_stats(readings), profiles, **window)


def time_features(readings: DataFrame, profiles=PROFILES, settings: DataFrame | None = None) -> DataFrame:
    settings = settings or settings_of(readings, profiles)
    windows = group_windows(window_rows(readings, settings), *time_aggregates())
    return with_phase_imbalance(number_windows(windows), profiles)


def validated_windows(readings: DataFrame, profiles=PROFILES, overrides: DataFrame | None = None,
                      settings: DataFrame | None = None) -> DataFrame:
    settings = settings or settings_of(readings, profiles)
    rows = with_profile(window_rows(readings, settings), *THRESHOLDS[:2], profiles=profiles, overrides=overrides)
    windows = validation_columns(group_windows(rows, *quality_aggregates()), profiles, overrides)
    return number_windows(windows).select(
        "machine", "window_index", *VALIDATION_COLUMNS)


def channel_spectra(readings: DataFrame, profiles=PROFILES, channels=("i1", "i2", "i3", "i_avg"),
                    settings: DataFrame | None = None) -> DataFrame:
    """Magnitudes per window and channel (windows already numbered)."""
    settings = settings or settings_of(readings, profiles)
    signals = [signal(c).alias(f"signal_{c}") for c in channels]
    windows = number_windows(group_windows(window_rows(readings, settings), *signals))
    return with_spectrum(channel_signals(windows, channels, profiles))


def _avg_spectrum(windows: DataFrame) -> DataFrame:
    """Spectral struct of the i_avg signal."""
    spectra = with_spectrum(windows.withColumnRenamed("signal_i_avg", "signal"))
    return with_spectral_features(spectra).drop("magnitudes")


def window_features(readings: DataFrame, profiles=PROFILES, settings: DataFrame | None = None) -> DataFrame:
    """The 20 features of every window; the spectrum is that of i_avg."""
    settings = settings or settings_of(readings, profiles)
    windows = group_windows(
        window_rows(readings, settings), *time_aggregates(), signal("i_avg").alias("signal_i_avg"))
    featured = number_windows(feature_row(_avg_spectrum(windows)))
    return with_phase_imbalance(featured, profiles).select(*WINDOW_COLUMNS, *FEATURE_COLUMNS)


def analyse(readings: DataFrame, profiles=PROFILES, overrides: DataFrame | None = None,
            min_consecutive: int = MIN_CONSECUTIVE, settings: DataFrame | None = None) -> DataFrame:
    """Windows -> spectrum -> validation -> features -> rules -> hysteresis.

    Features, checks and spectrum of a window come from one aggregation of its rows.
    """
    settings = settings or settings_of(readings, profiles)
    rows = with_profile(window_rows(readings, settings), *THRESHOLDS[:2], profiles=profiles, overrides=overrides)
    windows = group_windows(
        rows, *time_aggregates(), *quality_aggregates(), signal("i_avg").alias("signal_i_avg"))
    windows = validation_columns(feature_row(_avg_spectrum(windows)), profiles, overrides)
    windows = classify(with_phase_imbalance(number_windows(windows), profiles), profiles, overrides)
    return hysteresis(windows, ["machine"], min_consecutive=min_consecutive).select(
        *WINDOW_COLUMNS, *VALIDATION_COLUMNS, *FEATURE_COLUMNS,
        "state", "confidence", "reason", "scores", "smoothed_state")
