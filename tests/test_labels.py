"""Label smoothing and cycles against sample-by-sample loops on random logs."""

import random

import pytest
from pyspark.sql import functions as F

import loops
from loadline.operators.labels import (
    cycles_between_reds, cycles_of_green_runs, numbered_cycles, smooth_leftmost, smooth_simultaneous)
from loadline.operators.states import run_table
from loadline.plans.staging import stage


def random_logs(seed, count, name):
    rng = random.Random(seed)
    logs = {}
    for i in range(count):
        labels = []
        style = i % 4
        for _ in range(rng.randint(1, 40)):
            n = rng.randint(1, 3) if style == 0 else rng.choice([1, 1, 2, 3, 4, 5, 7, 9, 14])
            if style == 3:
                n = rng.choice([1, 2, 3, 4, 5, 6, 8, 10])
            labels += [rng.randint(0, 2)] * n
        if style == 2:   # ramps, where the boundary run is open
            labels = [v for v, a, b in loops.runs_of(labels) for v in [v] * (b - a + 1)]
        logs[f"{name}_{i}"] = labels
    return logs


def run_frame(spark, logs, min_run):
    rows = [(m, i, v) for m, labels in logs.items() for i, v in enumerate(labels)]
    df = spark.createDataFrame(rows, "machine string, row_idx bigint, raw_label int")
    runs = run_table(df, ["machine"], "row_idx", "raw_label")
    stats = df.groupBy("machine").agg(F.count("*").alias("n"))
    return stage(runs.withColumn("label_min_run", F.lit(min_run))), stage(stats)


def expand(runs):
    out = {}
    for r in sorted(runs.collect(), key=lambda r: (r.machine, r.start)):
        out.setdefault(r.machine, [])
        assert len(out[r.machine]) == r.start
        out[r.machine] += [r.value] * r.len
    return out


@pytest.mark.parametrize("min_run", [2, 3, 5])
def test_leftmost_merge(spark, blocks, min_run):
    logs = random_logs(min_run, 250, "conveyer")
    logs |= {"conveyer_a": [1], "conveyer_b": [1, 2], "conveyer_c": [0, 1, 1, 2, 2, 2, 2, 2],
             "conveyer_d": [0] * 6 + [1] + [2] * 5 + [1] + [0] * 9, "conveyer_e": [0] * 4 + [1] + [2] * 9}
    runs, stats = run_frame(spark, logs, min_run)
    got = expand(smooth_leftmost(runs, stats))
    assert got == {m: loops.merge_leftmost(v, min_run) for m, v in logs.items()}


@pytest.mark.parametrize("min_run", [3, 10])
def test_simultaneous_merge(spark, blocks, min_run):
    logs = random_logs(min_run + 50, 80, "furnace")
    runs, _ = run_frame(spark, logs, min_run)
    got = expand(smooth_simultaneous(runs))
    assert got == {m: loops.merge_together(v, min_run) for m, v in logs.items()}


def test_cycles(spark, blocks):
    logs = random_logs(9, 80, "furnace")
    logs["furnace_gold"] = [1, 1, 0, 1, 2, 1, 0, 1, 1]
    runs, _ = run_frame(spark, logs, 3)
    for detect, loop in ((cycles_between_reds, loops.cycles_between_reds),
                         (cycles_of_green_runs, lambda v: loops.cycles_of_green(v, 3))):
        _, cycles = detect(runs)
        got = {m: [] for m in logs}
        for c in sorted(numbered_cycles(cycles).collect(), key=lambda c: (c.machine, c.cycle_id)):
            assert c.cycle_id == len(got[c.machine])
            got[c.machine].append((c.cycle_start, c.cycle_end))
        assert got == {m: loop(v) for m, v in logs.items()}
