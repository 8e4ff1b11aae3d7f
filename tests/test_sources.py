"""Logs, registry, saved ranges, result runs and medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from loadline.functions import parsing
from loadline.operators.session_stats import machine_stats
from loadline.plans.blocks import exact_median
from loadline.sources import events, logs, sinks


def write_log(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")
    return str(folder)


def test_registry_takes_training_logs_only_when_asked(spark, tmp_path):
    plain = [f"2026-01-01 00:00:{i:02d},0.{i},0.1,0.2,50" for i in range(5)]
    cyclic = write_log(tmp_path / "cyclic", "a.csv", "Timestamp,I1,I2,I3,Hz", plain)
    flat = write_log(tmp_path / "flat", "b.csv", " DateTime ,i_1,I 2,i3,Frequency,Remark",
                     [f"2026-01-02 00:00:{i:02d},1,1,1,50,x" for i in range(3)])
    robo = write_log(tmp_path / "robo", "r.csv", "time,i1,I_Avg", ["2026-01-01 00:00:01,2,3"])
    furnace = write_log(tmp_path / "furnace", "f.csv", "My Time Stamp,i1,i2,i3", ["59:59.0,1,2,3", "00:01.0,4,5,6"])
    registry = spark.createDataFrame(
        [("conveyer", cyclic, 0, False), ("conveyer", flat, 1, True), ("robo_2", robo, 0, None), ("furnace", furnace, 0, False)],
        "machine string, source string, rank int, training_only boolean")
    got = {}
    for r in logs.load_registry(spark, registry).collect():
        got.setdefault(r.machine, []).append((r.row_idx, r.i1, r.i_avg, r.frequency))
    assert {m: len(v) for m, v in got.items()} == {"conveyer": 5, "robo_2": 1, "furnace": 2}
    assert got["robo_2"] == [(0, 2.0, 3.0, 50.0)]
    assert sorted(got["furnace"]) == [(0, 1.0, 2.0, 50.0), (1, 4.0, 5.0, 50.0)]
    both = logs.load_registry(spark, registry, training=True).filter("machine = 'conveyer'").orderBy("row_idx").collect()
    assert [r.row_idx for r in both] == list(range(8)) and [r.i1 for r in both][5:] == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        logs.load_machines(spark, {"press": cyclic})


def test_first_lines_are_read_without_the_rest(spark, tmp_path):
    files = []
    for i in range(6):
        path = tmp_path / f"log{i}.csv"
        path.write_text(f"Time,I{i % 2}\n" + "x,1\n" * 300_000)
        files.append(str(path))
    (tmp_path / "empty.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {r.file.rsplit("/", 1)[-1]: r.header for r in logs.first_lines(spark, [*files, str(tmp_path / "empty.csv")]).collect()}
    assert got == {f"log{i}.csv": f"Time,I{i % 2}" for i in range(6)}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert [len(g) for g in logs.header_groups(spark, files)] == [3, 3]


def test_header_columns_equal_names(spark):
    headers = [" Time Stamp", "TIME", "my stamp", "I_1", "i2 ", "I 3", "i_average", "Hz", "Freq", "Remark", ""]
    rows = spark.createDataFrame([(h, a) for h in headers for a in (True, False)], "header string, any boolean")
    for r in rows.withColumn("name", parsing.canonical_column("header", F.col("any"))).collect():
        assert r.name == parsing.canonical_name(r.header, r.any)


def test_a_range_opens_the_files_of_its_blocks(spark, tmp_path, sf_dir):
    path = str(tmp_path / "saved")
    rows = events.readings(spark, sf_dir)
    logs.save_readings(rows, path, rows_per_file=50)
    part = logs.read_range(spark, path, 60, 95, look_back=5, rows_per_file=50)
    assert part.select(F.input_file_name()).distinct().count() == 4 < len(spark.read.parquet(path).inputFiles())
    want = rows.filter("row_idx >= 55 and row_idx < 95")
    assert sorted(map(str, part.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert logs.read_range(spark, path, 0, 3, look_back=5, rows_per_file=50).count() == 12
    assert logs.read_range(spark, path, 5, 5, rows_per_file=50).count() == 0


def test_long_logs_get_larger_files(spark, tmp_path, sf_dir, monkeypatch):
    monkeypatch.setattr(logs, "SAVED_FILES", 8)
    path = str(tmp_path / "saved")
    rows = events.readings(spark, sf_dir)
    logs.save_readings(rows, path, rows_per_file=10)
    assert len(spark.read.parquet(path).inputFiles()) <= 8 + rows.select("machine").distinct().count()
    part = logs.read_range(spark, path, 130, 140, look_back=5, rows_per_file=10)
    want = rows.filter("row_idx >= 125 and row_idx < 140")
    assert sorted(map(str, part.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert part.select(F.input_file_name()).distinct().count() < len(spark.read.parquet(path).inputFiles())


def test_a_failed_write_leaves_the_run_before(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "machine string, v int")
    sinks.save_run(first, path, "r1")
    broken = first.withColumn("v", F.when(F.col("machine") == "b", F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        sinks.save_run(broken, path, "r1")
    assert sorted((r.machine, r.v) for r in sinks.read_run(spark, path, "r1").collect()) == [("a", 1), ("b", 2)]
    sinks.save_run(first.filter("v = 2"), path, "r1")
    sinks.save_run(first.filter("v = 1"), path, "r0")
    assert [r.v for r in sinks.read_run(spark, path, "r1").collect()] == [2]
    assert [r.v for r in sinks.read_run(spark, path).collect()] == [1]
    assert {(r.run, r.rows) for r in sinks.runs(spark, path).collect()} == {("r0", 1), ("r1", 1)}
    with pytest.raises(ValueError):
        sinks.read_run(spark, path, "none")


def test_median_where_all_values_differ(spark):
    rng = random.Random(4)
    values = {f"m{k}": [rng.random() * 10 for _ in range(n)] for k, n in enumerate((1, 2, 3, 1000, 1001))}
    values["same"] = [2.0] * 500 + [3.0] * 500
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("m0", None), ("none", None)]
    df = spark.createDataFrame(rows, "machine string, v double").repartition(7)
    got = {r.machine: r.mid for r in exact_median(df, ["machine"], "v", "mid").collect()}
    assert got.keys() == values.keys()
    assert all(abs(got[k] - statistics.median(vs)) < 1e-12 for k, vs in values.items())


def test_sample_rate_of_a_jittery_log(spark, blocks):
    rng = random.Random(6)
    times, t = [], 0
    for _ in range(301):
        times.append(t)
        t += 1_000_000 + rng.randrange(1, 900_000)
    rows = spark.createDataFrame([("robo", i, us, 1.0) for i, us in enumerate(times)], "machine string, row_idx bigint, us bigint, i_avg double")
    got = machine_stats(rows.withColumn("timestamp", F.timestamp_micros("us"))).first()
    steps = [b - a for a, b in zip(times, times[1:])]
    assert len(set(steps)) > 290 and abs(got.sample_rate - 1e6 / statistics.median(steps)) < 1e-9 and got.n == 301
