"""Time-domain features of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.functions.display import phase_spread
from loadline.profiles import PROFILES, with_profile

CHANNELS = ("i1", "i2", "i3", "i_avg")
TIME_FEATURES = (
    [f"rms_{c}" for c in CHANNELS] + [f"variance_{c}" for c in CHANNELS]
    + [f"peak_to_peak_{c}" for c in CHANNELS[:3]])
SPECTRAL_FEATURES = [
    "fundamental_freq", "fundamental_energy", "harmonic2_energy", "harmonic3_energy",
    "total_energy", "high_freq_energy", "thd", "high_freq_ratio"]
FEATURE_COLUMNS = TIME_FEATURES + ["phase_imbalance"] + SPECTRAL_FEATURES


def time_aggregates() -> list[Column]:
    """RMS, population variance and range; all partially aggregated before the shuffle."""
    rms = [F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in CHANNELS]
    var = [F.var_pop(c).alias(f"variance_{c}") for c in CHANNELS]
    p2p = [(F.max(c) - F.min(c)).alias(f"peak_to_peak_{c}") for c in CHANNELS[:3]]
    return [*rms, *var, *p2p]


def with_phase_imbalance(windows: DataFrame, profiles=PROFILES) -> DataFrame:
    """Spread of the three phase RMS values; 0 for single-phase machines."""
    spread = phase_spread("rms_i1", "rms_i2", "rms_i3")
    return (with_profile(windows, "has_phase_imbalance", profiles=profiles)
            .withColumn("phase_imbalance", F.when(F.col("has_phase_imbalance"), spread).otherwise(0.0))
            .drop("has_phase_imbalance"))


def feature_row(windows: DataFrame) -> DataFrame:
    """The flat 20-column feature row from time features and a ``spectral`` struct.

    Energies are squared magnitudes of the i_avg spectrum.
    """
    return with_exprs(
        windows,
        fundamental_freq="spectral.fundamental_freq",
        fundamental_energy="spectral.fundamental_mag * spectral.fundamental_mag",
        harmonic2_energy="spectral.harmonic2_mag * spectral.harmonic2_mag",
        harmonic3_energy="spectral.harmonic3_mag * spectral.harmonic3_mag",
        total_energy="spectral.total_energy", high_freq_energy="spectral.high_freq_energy",
        thd="spectral.thd",
        high_freq_ratio="""case when spectral.total_energy > 1e-9D
                           then spectral.high_freq_energy / spectral.total_energy else 0D end""",
    ).drop("spectral")
