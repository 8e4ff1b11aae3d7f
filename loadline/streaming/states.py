"""The state logic on Structured Streaming.

Sample states are stateless.  Window states come from a watermarked sliding-window
aggregation; the smoothed states follow from the table of window states, with a small
state per machine (current state, candidate, streak).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from loadline.operators.classify import classify, sample_states
from loadline.operators.features import feature_row, time_aggregates, with_phase_imbalance
from loadline.operators.quality import THRESHOLDS, quality_aggregates, validation_columns
from loadline.operators.spectral import signal, with_spectral_features, with_spectrum
from loadline.operators.states import MIN_CONSECUTIVE
from loadline.plans.staging import new_path
from loadline.profiles import PROFILES, RED, profile_of, with_profile

RESULT = "machine string, end_time timestamp, state string, confidence double, smoothed_state string, changed boolean"
STATE = "current string, candidate string, streak int"


def stream_sample_states(stream: DataFrame, profiles=PROFILES) -> DataFrame:
    return sample_states(stream, profiles)


def stream_windows(stream: DataFrame, profile, delay: str = "10 seconds", start: str = "0 seconds",
                   sample_rate: float = 1.0, profiles=PROFILES) -> DataFrame:
    """Validated and classified sliding windows of one machine kind.

    Windows start at multiples of the step from the epoch plus ``start``; rows later than
    the watermark are dropped, and a window appears once the watermark passes its end.
    """
    size = int(profile.window_seconds * 1e6)
    step = int(profile.window_seconds * (1 - profile.overlap) * 1e6)
    mine = with_profile(stream.filter(profile_of() == profile.profile), *THRESHOLDS[:2], profiles=profiles)
    grouped = (
        mine.withWatermark("timestamp", delay)
        .groupBy("machine", F.window("timestamp", f"{size} microseconds", f"{step} microseconds", start))
        .agg(F.count(F.lit(1)).alias("n_samples"), *time_aggregates(), *quality_aggregates(),
             signal("i_avg").alias("signal")))
    least = max(2, int(profile.window_seconds * sample_rate * 0.5))
    windows = grouped.filter(F.col("n_samples") >= least).withColumns({
        "start_time": F.col("window.start"), "end_time": F.col("window.end"),
        "sample_rate": F.lit(sample_rate)}).drop("window")
    windows = feature_row(with_spectral_features(with_spectrum(windows)).drop("magnitudes"))
    windows = with_phase_imbalance(validation_columns(windows, profiles), profiles)
    return classify(windows, profiles).select(
        "machine", "start_time", "end_time", "n_samples", "rms_i_avg", "is_valid", "state", "confidence")


def stream_all_windows(stream: DataFrame, profiles=PROFILES, **options) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [stream_windows(stream, p, profiles=profiles, **options) for p in profiles])


def stream_hysteresis(windows: DataFrame, min_consecutive: int = MIN_CONSECUTIVE, initial: str = RED) -> DataFrame:
    """Smoothed state after every window, and whether it changed there.

    Within a micro-batch a machine's windows are taken in time order; across batches the
    state continues where it was.
    """
    n = max(1, min_consecutive)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, candidate, streak = state.get if state.exists else (initial, initial, 0)
        batch = pd.concat(list(frames)).sort_values("end_time", ignore_index=True)
        smoothed, changed = [], []
        for raw in batch["state"]:
            streak = streak + 1 if raw == candidate else 1
            candidate = raw
            flip = streak >= n and raw != current
            current = raw if flip else current
            smoothed.append(current)
            changed.append(flip)
        state.update((current, candidate, min(streak, n)))
        yield batch.assign(smoothed_state=smoothed, changed=changed)

    return (windows.select("machine", "end_time", "state", "confidence").groupBy("machine")
            .applyInPandasWithState(update, RESULT, STATE, "append", GroupStateTimeout.NoTimeout))


def smoothed(raw: pd.Series, current: str, candidate: str, streak: int, needed: int) -> tuple[np.ndarray, int]:
    """The accepted state after each of some states in order, and how often the last of them has come in a row."""
    codes, names = pd.factorize(np.concatenate([[current, candidate], raw.to_numpy(object)]), use_na_sentinel=False)
    own, at = codes[2:], np.arange(len(raw))
    first = own != codes[1:-1]
    start = np.maximum.accumulate(np.where(first, at, -1))
    in_row = np.where(start < 0, at + 1 + streak, at - start + 1)
    accepted = np.maximum.accumulate(np.where(in_row >= needed, at, -1))
    return names[np.where(accepted < 0, codes[0], own[accepted])], int(in_row[-1])


class _Hysteresis(StatefulProcessor):
    """Takes one machine's windows of a micro-batch in the order of their ends.

    The aggregation before hands on a window in the batch in which the watermark passes its end and drops what comes later, so
    the windows of a batch end after those of all batches before.  Three values a machine are all that is kept.
    """

    def __init__(self, needed: int, initial: str) -> None:
        self.needed, self.initial = needed, initial

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", STATE)

    def handleInputRows(self, key, rows, timerValues):
        current, candidate, streak = self.now.get() if self.now.exists() else (self.initial, self.initial, 0)
        batch = pd.concat(list(rows)).sort_values("end_time", ignore_index=True)
        states, streak = smoothed(batch["state"], current, candidate, streak, self.needed)
        self.now.update((states[-1], batch["state"].iloc[-1], min(streak, self.needed)))
        yield batch.assign(machine=key[0], smoothed_state=states, changed=states != np.concatenate([[current], states[:-1]]))[
            ["machine", "end_time", "state", "confidence", "smoothed_state", "changed"]]

    def close(self) -> None:
        pass


def stream_smoothed_windows(stream: DataFrame, profiles=PROFILES, min_consecutive: int = MIN_CONSECUTIVE, initial: str = RED, **options) -> DataFrame:
    """From readings to smoothed window states in one query: windows, checks, rules, then hysteresis by machine.

    Needs the RocksDB state store (``run_to_table(..., provider=ROCKSDB)``).
    """
    windows = stream_all_windows(stream, profiles, **options).select("machine", "end_time", "state", "confidence")
    return windows.groupBy("machine").transformWithStateInPandas(
        _Hysteresis(max(1, min_consecutive), initial), RESULT, "Append", "None")


def stream_transitions(smoothed: DataFrame) -> DataFrame:
    return smoothed.filter("changed").select("machine", "end_time", F.col("smoothed_state").alias("state"), "confidence")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, name: str, provider: str | None = None) -> DataFrame:
    """Process all available input into a parquet table and read it, with another state store if named."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if provider:
        spark.conf.set(key, provider)
    try:
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{path}-progress").option("path", path)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(path)


def as_stream(spark: SparkSession, table: DataFrame, name: str, files_per_batch: int | None = None,
              order: Column | str = "timestamp") -> DataFrame:
    """A written copy of ``table`` as a file stream."""
    path = new_path(spark, name)
    table.repartitionByRange(4, order).write.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
