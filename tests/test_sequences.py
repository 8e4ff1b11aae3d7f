"""Ordered operators against loops on random logs, in one block and in many."""

import random

from pyspark.sql import functions as F

import loops
from loadline.operators import slices, states, windows
from loadline.operators.session_stats import machine_stats
from loadline.plans.blocks import assign_intervals, carry_scan, number_rows, over_neighbours
from loadline.plans.state_analysis import settings_of


def state_logs(seed, count=40):
    rng = random.Random(seed)
    return {f"m{i}": [s for _ in range(rng.randint(1, 30))
                      for s in [rng.choice(["RED", "AMBER", "GREEN"])] * rng.choice([1, 1, 2, 3, 4, 8])]
            for i in range(count)}


def frame(spark, logs):
    return spark.createDataFrame([(m, i, s, float(i % 7)) for m, v in logs.items() for i, s in enumerate(v)],
                                 "machine string, window_index int, state string, confidence double")


def test_hysteresis_and_runs(spark, blocks):
    logs = state_logs(1)
    df = frame(spark, logs)
    for n, initial in ((3, None), (2, "RED"), (1, None)):
        out = states.hysteresis(df, ["machine"], min_consecutive=n, initial=initial)
        got = {}
        for r in out.orderBy("machine", "window_index").collect():
            got.setdefault(r.machine, []).append(r.smoothed_state)
        assert got == {m: loops.smooth_states(v, n, initial) for m, v in logs.items()}
    runs = states.run_table(df, ["machine"], "window_index", "state").orderBy("machine", "run_id")
    got = {}
    for r in runs.collect():
        assert r.run_id == len(got.setdefault(r.machine, []))
        got[r.machine].append((r.value, r.start, r.end))
    assert got == {m: loops.runs_of(v) for m, v in logs.items()}


def test_windows_with_gaps(spark, blocks):
    rng, logs = random.Random(5), {}
    for profile, size in (("furnace", 60), ("conveyer", 3), ("robo", 30), ("milling", 20)):
        for i in range(4):
            t, times = 0.0, []
            for _ in range(rng.randint(1, 200)):
                times.append(t)
                t += rng.choice([1, 1, 1, 1, 1, 1, 2, 37, 400]) if i else 1
            logs[f"{profile}_{i}"] = (size, times)
    rows = spark.createDataFrame(
        [(m, i, int(t * 1e6), 1.0) for m, (_, times) in logs.items() for i, t in enumerate(times)],
        "machine string, row_idx bigint, us bigint, i_avg double").withColumn("timestamp", F.timestamp_micros("us"))
    rate = {r.machine: r.sample_rate for r in machine_stats(rows).collect()}
    found = windows.generate_windows(rows, settings_of(rows)).orderBy("machine", "window_index").collect()
    got = {m: [] for m in logs}
    for w in found:
        assert w.window_index == len(got[w.machine])
        got[w.machine].append((w.start_time.timestamp(), w.start_row, w.end_row, w.n_samples))
    assert got == {m: loops.windows_of(times, size, 0.5, max(2, int(size * rate[m] * 0.5)))
                   for m, (size, times) in logs.items()}


def test_scan_neighbours_numbers_and_intervals(spark, blocks):
    rng = random.Random(3)
    n = 333
    values = [rng.randint(0, 9) for _ in range(n)]
    df = spark.createDataFrame([("a", i, v, rng.random()) for i, v in enumerate(values)],
                               "machine string, row_idx bigint, v bigint, z double")
    out = carry_scan(df, ["machine"], "row_idx", sums={"s": F.col("v")},
                     lasts={"big": F.when(F.col("v") > 8, F.col("row_idx"))})
    out = over_neighbours(out, ["machine"], "row_idx",
                          lambda w: [{"p": F.lag("v", 3).over(w), "q": F.lead("v", 2).over(w)}],
                          before=3, after=2).orderBy("row_idx").collect()
    assert [r.s for r in out] == [sum(values[:i + 1]) for i in range(n)]
    assert [r.big for r in out] == [max((j for j in range(i + 1) if values[j] > 8), default=None) for i in range(n)]
    assert [r.p for r in out] == [None] * 3 + values[:-3]
    assert [r.q for r in out] == values[2:] + [None] * 2

    numbered = number_rows(df, ["machine"], ["z", "row_idx"], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in numbered] == list(range(n))
    assert [r.z for r in numbered] == sorted(r.z for r in numbered)

    spans = [(3, 3), (10, 120), (121, 121), (200, 280)]
    held = assign_intervals(
        df, spark.createDataFrame([("a", s, e, i) for i, (s, e) in enumerate(spans)],
                                  "machine string, start bigint, end bigint, no int"),
        ["machine"], "row_idx", "start", "end", ["no"]).orderBy("row_idx").collect()
    assert [r.no for r in held] == [next((k for k, (s, e) in enumerate(spans) if s <= i <= e), None) for i in range(n)]


def test_context_join_matches_all_pairs(spark):
    rng = random.Random(8)
    times = sorted(rng.sample(range(3000), 400))
    rows = spark.createDataFrame([("a", t) for t in times], "machine string, s bigint").select(
        "machine", F.timestamp_seconds("s").alias("timestamp"), "s")
    centres = rows.filter("s % 5 = 0").select("machine", F.col("s").alias("centre"), F.col("timestamp").alias("centre_time"))
    got = {(r.centre, r.s) for r in slices.context_rows(rows, centres, 60).collect()}
    assert got == {(c, t) for c in times if c % 5 == 0 for t in times if abs(c - t) <= 60}
