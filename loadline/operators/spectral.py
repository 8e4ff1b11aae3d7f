"""Amplitude spectra of window signals and their scalar features.

Spark partitions and groups the samples; inside a task numpy transforms all signals of
one length in an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadline.functions.columns import with_exprs
from loadline.profiles import PROFILES, with_profile

MIN_SAMPLES = 4
HARMONIC_TOLERANCE_HZ = 0.05
SILENT = 1e-18


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def amplitude_spectrum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Mean removed, symmetric Hann window, one-sided magnitudes scaled by 2 / n."""
    for signals in batches:
        lengths = signals.map(len).to_numpy()
        out = np.empty(len(signals), dtype=object)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n < MIN_SAMPLES:
                out[at] = [np.zeros(1)] * len(at)
                continue
            x = np.stack(signals.to_numpy()[at]).astype(float)
            x = (x - x.mean(axis=1, keepdims=True)) * np.hanning(n)
            magnitudes = np.abs(np.fft.rfft(x)) * (2.0 / n)
            for i, row in zip(at, magnitudes):
                out[i] = row
        yield pd.Series(out)


def signal(channel: str) -> Column:
    """Aggregate: the window's samples of one channel in row order."""
    return F.sort_array(F.collect_list(F.struct("row_idx", channel))).getField(channel)


def with_spectral_features(spectra: DataFrame, out: str = "spectral") -> DataFrame:
    """Struct of fundamental, harmonics, energies and distortion from ``magnitudes``.

    The fundamental is the first largest bin above 0.  A silent signal (no energy but
    rounding noise) has the first bin, as an all-zero spectrum does.  A harmonic is the
    nearest bin to a multiple of the fundamental, if within the tolerance.
    """
    def harmonic(order: int) -> str:
        nearest = f"least({order} * _peak, _last)"
        return f"""case when {order} * _peak <= _last or abs({nearest} * _df - _f0 * {order}) <= {HARMONIC_TOLERANCE_HZ}D
                   then coalesce(try_element_at(magnitudes, {nearest} + 1), 0D) else 0D end"""

    s = with_exprs(
        spectra, _last="size(magnitudes) - 1", _df="1D / (n_samples * (1D / sample_rate))",
        _energy="aggregate(magnitudes, 0D, (a, m) -> a + m * m)", _quarter="cast(n_samples div 4 as int)")
    s = with_exprs(s, _high="""aggregate(
        slice(magnitudes, case when _quarter * _df > sample_rate / 4D then _quarter else _quarter + 1 end + 1,
              size(magnitudes)), 0D, (a, m) -> a + m * m)""")
    s = with_exprs(s, _peak=f"""cast(case when n_samples < {MIN_SAMPLES} then 0 when _energy < {SILENT}D then 1
        else array_position(slice(magnitudes, 2, greatest(_last, 1)),
                            array_max(slice(magnitudes, 2, greatest(_last, 1)))) end as int)""")
    s = with_exprs(
        s, _f0="_peak * _df",
        _m1=f"case when n_samples >= {MIN_SAMPLES} then element_at(magnitudes, _peak + 1) else 0D end")
    s = with_exprs(
        s, _m2=f"case when n_samples >= {MIN_SAMPLES} then {harmonic(2)} else 0D end",
        _m3=f"case when n_samples >= {MIN_SAMPLES} then {harmonic(3)} else 0D end")
    s = with_exprs(s, **{out: """named_struct(
        'fundamental_freq', _f0, 'fundamental_mag', _m1, 'harmonic2_mag', _m2, 'harmonic3_mag', _m3,
        'total_energy', _energy, 'high_freq_energy', _high,
        'thd', case when _m1 > 1e-9D then sqrt(_m2 * _m2 + _m3 * _m3) / _m1 else 0D end)"""})
    return s.drop("_last", "_df", "_quarter", "_energy", "_high", "_peak", "_f0", "_m1", "_m2", "_m3")


def channel_signals(windows: DataFrame, channels=("i1", "i2", "i3", "i_avg"), profiles=PROFILES) -> DataFrame:
    """Long form: one row per window and channel the machine's profile has."""
    entries = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"signal_{c}").alias("signal"))
                        for c in channels])
    wide = with_profile(windows, "channels", profiles=profiles)
    used = F.filter(entries, lambda e: F.array_contains(F.split("channels", ","), e.channel))
    return (wide.withColumn("_e", F.explode(used)).select("*", "_e.*")
            .drop("_e", "channels", *[f"signal_{c}" for c in channels]))


def with_spectrum(signals: DataFrame) -> DataFrame:
    """Adds ``magnitudes`` to rows with ``signal``; signals too short for one are sent empty."""
    sent = F.expr(f"case when n_samples >= {MIN_SAMPLES} then signal else array() end")
    return signals.withColumn("magnitudes", amplitude_spectrum(sent)).drop("signal")


def spectrum_bins(spectra: DataFrame) -> DataFrame:
    """One row per (window, channel, bin) with its frequency."""
    return (spectra.filter(F.col("n_samples") >= MIN_SAMPLES)
            .select("machine", "window_index", "channel", "n_samples", "sample_rate",
                    F.posexplode("magnitudes").alias("bin", "magnitude"))
            .withColumn("freq_hz", F.col("bin") * F.col("sample_rate") / F.col("n_samples"))
            .select("machine", "window_index", "channel", "n_samples", "bin", "freq_hz", "magnitude"))


def spectral_features(spectra: DataFrame) -> DataFrame:
    return with_spectral_features(spectra).select(
        "machine", "window_index", "channel", "n_samples", "spectral.*")
