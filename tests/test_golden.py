"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from loadline.functions import display, parsing
from loadline.operators import classify, ingest, lookback, spectral, states, windows
from loadline.operators.session_stats import machine_stats
from loadline.plans.state_analysis import settings_of
from loadline.operators.ingest import wrapping_clock
from loadline.operators.metrics import multi_task_loss
from loadline.profiles import FURNACE, PROFILES, override, profile_table, with_profile


def readings(spark, machine, values, start=0, frequency=50.0):
    rows = [(machine, i, float(v), frequency) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "machine string, row_idx bigint, v double, frequency double")
    return df.select("machine", "row_idx", F.timestamp_seconds(F.col("row_idx") + start).alias("timestamp"),
                     *[F.col("v").alias(c) for c in ("i1", "i2", "i3", "i_avg")], "frequency")


def test_profiles_are_a_broadcast_local_relation(spark):
    table = profile_table(spark)
    assert table.count() == 4
    plan = spark.range(10).join(table.filter("profile = 'robo'"), F.col("id") == F.col("label_min_run"))
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_override_replaces_only_given_values():
    changed = override(furnace={"red_max_rms": 3.0})
    assert changed[0].red_max_rms == 3.0 and changed[0].green_min_rms == FURNACE.green_min_rms
    assert changed[1:] == PROFILES[1:]


def test_clock_and_numbers(spark):
    df = spark.createDataFrame([("32:32.1", " 1.5 ", "nan"), ("12.5", "-2", "x"), ("bad", "1.5f", None)],
                               "t string, a string, b string")
    rows = df.select(parsing.clock_seconds("t"), parsing.current("a"), parsing.grid_frequency("b")).collect()
    assert [tuple(r) for r in rows] == [(1952.1, 1.5, 50.0), (12.5, 0.0, 50.0), (None, 0.0, 50.0)]


@pytest.mark.parametrize("clock, expected", [
    (["59:50.0", "00:10.0", "00:20.0"], [3590, 3610, 3620]),
    (["40:00.0", "20:00.0"], [2400, 1200]),          # a drop of 20 minutes is no new hour
    (["59:59.0", "00:00.0", "59:59.0", "00:01.0"], [3599, 3600, 7199, 7201]),
])
def test_clock_wrap(spark, blocks, clock, expected):
    df = spark.createDataFrame([("furnace", i, t) for i, t in enumerate(clock)],
                               "machine string, row_idx bigint, timestamp_str string")
    out = ingest.wrapping_clock(df, "1970-01-01 00:00:00").orderBy("row_idx")
    assert [r[0] for r in out.select(F.unix_seconds("timestamp")).collect()] == expected


def test_header_names():
    names = [" Time Stamp", "I_1", "i2 ", "I3", "I_Avg", "Freq", "note"]
    assert [parsing.canonical_name(n, True) for n in names] == [
        "timestamp_str", "i1", "i2", "i3", "i_avg_src", "frequency", None]
    assert parsing.canonical_name("my time", False) is None


def test_hysteresis_example(spark, blocks):
    raw = ["GREEN"] * 3 + ["AMBER", "GREEN"] + ["AMBER"] * 3
    df = spark.createDataFrame([("m", i, s) for i, s in enumerate(raw)], "machine string, window_index int, state string")
    for initial, expected in ((None, ["GREEN"] * 7 + ["AMBER"]),
                              ("AMBER", ["AMBER"] * 2 + ["GREEN"] * 5 + ["AMBER"])):
        out = states.hysteresis(df, ["machine"], initial=initial).orderBy("window_index").collect()
        assert [r.smoothed_state for r in out] == expected


def test_window_count_and_short_windows(spark, blocks):
    rows = readings(spark, "furnace", range(301)).unionByName(readings(spark, "conveyer", range(7)))
    found = windows.generate_windows(rows, settings_of(rows)).orderBy("window_index").collect()
    furnace = [w for w in found if w.machine == "furnace"]
    assert [w.start_row for w in furnace] == list(range(0, 300, 30))
    assert [w.window_index for w in furnace] == list(range(10))
    assert min(w.n_samples for w in found) >= 2


def test_sample_rate_is_one_over_the_median_step(spark, blocks):
    rows = readings(spark, "robo", range(5)).withColumn(
        "timestamp", F.timestamp_millis(F.col("row_idx") * 500 + F.when(F.col("row_idx") == 4, 90_000).otherwise(0)))
    single = readings(spark, "milling", [1.0])
    got = {r.machine: r.sample_rate for r in machine_stats(rows.unionByName(single)).collect()}
    assert got == {"robo": 2.0, "milling": 1.0}


def spectrum_of(spark, values):
    df = spark.createDataFrame([("furnace", 0, "i_avg", len(values), 1.0, [float(v) for v in values])],
                               "machine string, window_index int, channel string, n_samples bigint, "
                               "sample_rate double, signal array<double>")
    return spectral.spectral_features(spectral.with_spectrum(df)).first()


def test_spectrum(spark):
    tone = spectrum_of(spark, [math.sin(2 * math.pi * 6 * j / 60) for j in range(60)])
    assert tone.fundamental_freq == pytest.approx(0.1)
    assert tone.fundamental_mag == pytest.approx(0.5, abs=0.02)
    short = spectrum_of(spark, [1.0, 2.0, 3.0])
    assert (short.fundamental_freq, short.total_energy, short.thd) == (0.0, 0.0, 0.0)
    silent = spectrum_of(spark, [0.2] * 20)
    assert silent.thd == 0.0 and silent.fundamental_freq == pytest.approx(1 / 20)


@pytest.mark.parametrize("machine, rms, var, thd, imb, state, confidence, reason", [
    ("furnace", 1.0, 0.5, 0.0, 0.0, "RED", 0.5, "RMS=1.00 A <= 2.0 A, Var=0.50 A2 <= 1.0 A2"),
    ("furnace", 1.0, 1.5, 0.0, 0.0, "AMBER", 0.0, "RMS=1.00 A between thresholds [2.0, 12.0]"),
    ("furnace", 12.0, 2.5, 0.0, 0.0, "GREEN", 0.75, "RMS=12.00 A >= 12.0 A"),
    ("furnace", 15.0, 0.0, 0.0, 0.0, "GREEN", 0.8, "RMS=15.00 A >> 12.0 A (dominant)"),
    ("furnace", 7.0, 0.0, 0.0, 0.0, "AMBER", 0.5, "RMS=7.00 A between thresholds [2.0, 12.0]"),
    ("conveyer", 0.4, 0.0006, 0.0, 0.0, "GREEN", 0.65, "RMS=0.400 A >= 0.35 A"),
    ("conveyer", 0.4, 0.0, 0.06, 0.2, "GREEN", 1.0, "RMS=0.400 A >= 0.35 A; THD=0.060; Imb=0.20"),
    ("robo", 0.085, 0.0, 0.0, 9.0, "RED", 0.0, "RMS=0.0850 A <= 0.085 A (STANDBY threshold)"),
    ("robo", 0.12, 0.0, 0.0, 9.0, "AMBER", 1.0, "RMS=0.1200 A in IDLE band [0.085, 0.115] A"),
    ("milling", 2.0, 0.0, 0.0, 0.0, "AMBER", 0.5, "RMS=2.000 A in No-Load band [1.00, 3.00] A"),
])
def test_rules(spark, machine, rms, var, thd, imb, state, confidence, reason):
    df = spark.createDataFrame([(machine, rms, var, thd, imb)],
                               "machine string, rms_i_avg double, variance_i_avg double, thd double, phase_imbalance double")
    r = classify.classify(df).first()
    assert (r.state, r.confidence, r.reason) == (state, confidence, reason)
    assert (r.scores.imbalance is None) == (machine == "robo")


def test_job_names():
    assert display.job_names(1, "Job") == ["Standard"]
    assert display.job_names(2, "Mode") == ["Light Load", "Heavy Load"]
    assert display.job_names(4, "Job")[3] == "Job A" and display.job_names(4, "Mode")[3] == "Mode A"


def test_split_points(spark):
    stats = spark.createDataFrame([("furnace", 100), ("robo", 90)], "machine string, n bigint")
    got = {(r.machine, r.split): r.rows for r in lookback.split_sizes(stats).collect()}
    assert [got["furnace", s] for s in ("train", "val", "test")] == [70, 15, 15]
    assert got["robo", "train"] == int(90 * 0.7) == 62


def test_training_sets_reject_short_splits(spark):
    rows = readings(spark, "robo", range(100)).withColumns(
        {"state_label": F.lit(0), "cycle_pos": F.lit(None).cast("double"), "job_type": F.lit(-1)})
    with pytest.raises(ValueError, match="fewer than the look-back"):
        lookback.training_sets(rows, machine_stats(rows))


def test_unknown_machine_fails(spark):
    rows = spark.createDataFrame([("press_1", 1)], "machine string, x int")
    with pytest.raises(Exception, match="no profile for machine press_1"):
        with_profile(rows, "window_seconds").collect()


def test_unreadable_clock_hides_no_wrap(spark):
    rows = [("furnace", i, t) for i, t in enumerate(["59:50.0", "bad", "00:10.0"])]
    raw = spark.createDataFrame(rows, "machine string, row_idx long, timestamp_str string")
    got = wrapping_clock(raw, "2024-01-01 00:00:00").orderBy("row_idx").collect()
    assert [str(r.timestamp) for r in got] == ["2024-01-01 00:59:50", "None", "2024-01-01 01:00:10"]


def test_class_the_model_never_saw(spark):
    row = spark.createDataFrame([("m", 2, 0.5, 5, [0.5, 0.5], [1.0], 0.5)],
                                "machine string, state_label int, cycle_pos double, job_type int, state_probs array<double>, "
                                "job_probs array<double>, ml_cycle_pos double")
    assert multi_task_loss(row, ["machine"]).first().loss > 10
