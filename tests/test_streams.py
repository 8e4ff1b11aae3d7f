"""Streams over several micro-batches equal the batch result."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

import loops
from loadline.plans.staging import new_path
from loadline.profiles import CONVEYER
from loadline.streaming import states as streaming
from test_sequences import state_logs


def test_hysteresis_state_survives_batches(spark):
    logs = state_logs(4, 6)
    path = new_path(spark, "stream-test")
    rows = [(m, i, s, 0.5) for m, v in logs.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "machine string, at bigint, state string, confidence double").select(
        "machine", F.timestamp_seconds("at").alias("end_time"), "state", "confidence")
    for low in range(0, 200, 11):      # one file and so one batch per 11 windows, oldest first
        part = df.filter(f"unix_seconds(end_time) between {low} and {low + 10}")
        if not part.isEmpty():
            part.coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.01)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {}
    for r in streaming.run_to_table(streaming.stream_hysteresis(stream), "stream-out").orderBy("machine", "end_time").collect():
        got.setdefault(r.machine, []).append(r.smoothed_state)
    assert got == {m: loops.smooth_states(v, 3, "RED") for m, v in logs.items()}


def test_readings_to_smoothed_windows_in_one_query(spark):
    """Small batches with rows out of order and one that is too late, against the loop over the windows in order."""
    rng = random.Random(8)
    path = new_path(spark, "one-query")
    shape = "machine string, row_idx bigint, timestamp timestamp, i1 double, i2 double, i3 double, i_avg double, frequency double"
    base, n = 1_704_067_200, 240
    rows = []
    for at in range(n):
        load = rng.choice([0.02, 0.2, 0.6]) if at % 7 == 0 else (rows[-1][3] if rows else 0.02)
        rows.append(("conveyer", at, base + at, load, load, load, load, 50.0))
    held = [rows[i:i + 60] for i in range(0, n, 60)]
    for part in held:
        rng.shuffle(part)
    held[3].append(("conveyer", 999, base + 2, 90.0, 90.0, 90.0, 90.0, 50.0))  # its windows were closed long before
    for part in held:
        df = spark.createDataFrame(part, shape.replace("timestamp timestamp", "at bigint")).withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
        df.select("machine", "row_idx", "timestamp", "i1", "i2", "i3", "i_avg", "frequency").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = streaming.run_to_table(streaming.stream_smoothed_windows(stream, (CONVEYER,)), "one-query-out", provider=streaming.ROCKSDB).orderBy("end_time").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ends = [r.end_time.timestamp() - base for r in out]
    assert ends == sorted(set(ends)) and ends[-1] <= n - 1 - 10 and ends[-1] > n - 14
    states = [r.state for r in out]
    assert len(set(states)) == 3
    smoothed = loops.smooth_states(states, 3, "RED")
    assert [r.smoothed_state for r in out] == smoothed
    assert [r.changed for r in out] == [a != b for a, b in zip(["RED", *smoothed], smoothed)]


class _Handle:
    """State of one machine that counts how often it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_batch_of_windows_asks_its_state_a_few_times():
    for machine, states in state_logs(4, 6).items():
        handle, got = _Handle(), []
        task = streaming._Hysteresis(3, "RED")
        task.init(handle)
        for low in range(0, len(states), 37):
            some = list(range(low, min(len(states), low + 37)))
            frame = pd.DataFrame({"end_time": pd.to_datetime(some, unit="s"), "state": [states[i] for i in some], "confidence": 0.5}).sample(frac=1, random_state=low)
            before = handle.calls
            got += [r for part in task.handleInputRows((machine,), iter([frame[:5], frame[5:]]), None) for r in part.itertuples()]
            assert handle.calls - before <= 3
        want = loops.smooth_states(states, 3, "RED")
        assert [r.smoothed_state for r in got] == want
        assert [r.changed for r in got] == [a != b for a, b in zip(["RED", *want], want)]
