"""Every operator as a named query: a Spark plan and, where SQL can express it, its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadline.functions import display, parsing
from loadline.functions.columns import with_exprs
from loadline.operators import (
    classify, cycles, features, ingest, labels, lookback, metrics, models, quality, session_stats, slices,
    spectral, states, windows)
from loadline.plans import state_analysis as analysis
from loadline.plans.blocks import number_rows, over_neighbours
from loadline.plans.labelling import Labelling
from loadline.plans.staging import new_path, on_remove, stage
from loadline.profiles import CONVEYER, FURNACE, MILLING, PROFILES, ROBO, with_profile
from loadline.registry.oracle import r, rs, rules, runs_sql, sql
from loadline.sources import events, logs, sinks
from loadline.streaming import states as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, by the same arithmetic as in the checking SQL."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.expr(f"floor(`{c}` * 1e6D + 5e-1D) / 1e6D") for c in doubles})


def _stats(spark, sf):
    rows = events.readings(spark, sf)
    stats = session_stats.machine_stats(rows)
    return rows, stats


def _labelling(spark, sf):
    return Labelling(events.readings(spark, sf))


def _raw(spark, sf, profile):
    return events.raw_readings(spark, sf).filter(F.col("machine") == profile.profile)


def _iso(spark, sf, profile):
    return events.raw_iso_readings(spark, sf).filter(F.col("machine") == profile.profile)


# ---------------------------------------------------------------- sources and ingest

@query("readings_clean", sql(f"select machine, row_idx, ts as timestamp, {rs('i1', 'i2', 'i3', 'i_avg', 'frequency')} from readings"))
def readings_clean(spark, sf):
    return rounded(events.readings(spark, sf))


@query("csv_scan", sql("select machine, timestamp_str, i1, i2, i3, frequency from raw"))
def csv_scan(spark, sf):
    """Text logs written by machine, scanned back as text."""
    path = new_path(spark, "csv")
    logs.write_csv_logs(events.raw_readings(spark, sf).drop("event_id")
                        .withColumnRenamed("timestamp_str", "Timestamp"), path)
    parts = [logs.scan_csv(spark, logs.list_files(spark, f"{path}/machine={p.profile}"))
             .withColumn("machine", F.lit(p.profile)) for p in PROFILES]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.select("machine", "timestamp_str", "i1", "i2", "i3", "frequency")


_LOADED = f"""select 'furnace' as machine, row_idx, timestamp '2024-01-01' + to_microseconds(row_idx * 10000000) as timestamp,
  timestamp_str, {r('n1', 'i1')}, {r('n2', 'i2')}, {r('n3', 'i3')}, {r('(n1 + n2 + n3) / 3e0', 'i_avg')},
  {r('nf', 'frequency')} from numeric_raw where machine = 'furnace'"""


@query("load_furnace_log", sql(_LOADED))
def load_furnace_log(spark, sf):
    """Loader end to end: odd header names, wrapping clock, dirty numbers, file order."""
    path = new_path(spark, "csv-furnace")
    raw = _raw(spark, sf, FURNACE).select(
        "machine", "row_idx", F.col("timestamp_str").alias(" Time Stamp"), F.col("i1").alias("I1"),
        F.col("i2").alias("I_2"), F.col("i3").alias("i3 "), F.col("frequency").alias("Freq"))
    logs.write_csv_logs(raw, path)
    return rounded(logs.load_log(spark, "furnace", f"{path}/machine=furnace"))


@query("load_milling_logs", sql(f"""select machine, row_number() over (order by timestamp, file_no, event_id) - 1 as row_idx,
  timestamp, timestamp_str, i1, i2, i3, i_avg, frequency from (
    select f.file_no, q.event_id, 'milling' as machine, try_cast(q.timestamp_str as timestamp) as timestamp, q.timestamp_str,
      {r('n1', 'i1')}, {r('n2', 'i2')}, {r('n3', 'i3')}, {r('(n1 + n2 + n3) / 3e0', 'i_avg')}, {r('nf', 'frequency')}
    from numeric_raw n join iso q using (event_id) cross join (values (0), (1)) f(file_no)
    where n.machine = 'milling' and try_cast(q.timestamp_str as timestamp) is not null)"""))
def load_milling_logs(spark, sf):
    """Two sources in order, bad times dropped, sorted by time with ties in file order."""
    paths = []
    for _ in range(2):
        path = new_path(spark, "csv-milling")
        logs.write_csv_logs(_iso(spark, sf, MILLING).drop("event_id", "i_avg_src")
                            .withColumnRenamed("timestamp_str", "DateTime"), path)
        paths.append(f"{path}/machine=milling")
    return rounded(logs.load_log(spark, "milling", paths))


_HEADERS = """select * from (values ('furnace', 'Time Stamp', 'timestamp_str'), ('furnace', 'I1', 'i1'), ('furnace', 'I_2', 'i2'), ('furnace', 'i3', 'i3'),
  ('furnace', 'Freq', 'frequency'), ('furnace', 'Note', null), ('milling', 'DateTime', 'timestamp_str'), ('milling', 'I 1', 'i1'), ('milling', 'i2', 'i2'),
  ('milling', 'I3', 'i3'), ('milling', 'I_Avg', 'i_avg_src'), ('milling', 'Hz', 'frequency')) t(machine, header, canonical)"""


@query("header_rules", sql("select h.machine, h.header, h.canonical, count(*) as rows from headers h join raw r using (machine) group by h.machine, h.header, h.canonical", {"headers": _HEADERS}))
def header_rules(spark, sf):
    """Headers of text logs of two machines, the names they are read under, and the rows below them."""
    furnace = _raw(spark, sf, FURNACE).select(
        "machine", "row_idx", F.col("timestamp_str").alias(" Time Stamp"), F.col("i1").alias("I1"), F.col("i2").alias("I_2"),
        F.col("i3").alias("i3 "), F.col("frequency").alias("Freq"), F.lit("x").alias("Note"))
    milling = _iso(spark, sf, MILLING).select(
        "machine", "row_idx", F.col("timestamp_str").alias("DateTime"), F.col("i1").alias("I 1"), "i2", F.col("i3").alias("I3"),
        F.col("i_avg_src").alias("I_Avg"), F.col("frequency").alias("Hz"))
    paths = []
    for log in (furnace, milling):
        paths.append(new_path(spark, "csv-headers"))
        logs.write_csv_logs(log, paths[-1])
    files = [f for path in paths for f in logs.list_files(spark, f"{path}/machine=*")]
    lines = logs.first_lines(spark, files)
    rows = spark.read.text(files).groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count("*") - 1).alias("rows"))
    split = lines.withColumn("machine", F.regexp_extract("file", "machine=([a-z]+)", 1)).select(
        "machine", "file", F.explode(F.split("header", ",")).alias("header"))
    split = split.withColumn("header", F.regexp_replace("header", '^"|"$', ""))
    named = parsing.canonical_column("header", F.col("machine") == "furnace")
    return split.join(rows, "file").groupBy("machine", "header").agg(F.sum("rows").alias("rows")).withColumn("canonical", named)


@query("registry_load", sql(f"""select 'furnace' as machine, row_idx, timestamp '2024-01-01' + to_microseconds(row_idx * 10000000) as timestamp,
    {r('n1', 'i1')}, {r('(n1 + n2 + n3) / 3e0', 'i_avg')} from numeric_raw where machine = 'furnace'
  union all select machine, row_number() over (partition by machine order by t, row_idx) - 1, t, floor(n1 * 1e6 + 5e-1) / 1e6, floor((n1 + n2 + n3) / 3e0 * 1e6 + 5e-1) / 1e6
  from (select n.machine, n.row_idx, n1, n2, n3, coalesce(try_cast(q.timestamp_str as timestamp),
    first_value(try_cast(q.timestamp_str as timestamp) ignore nulls) over (order by n.row_idx rows between unbounded preceding and unbounded following) + to_seconds(n.row_idx)) as t
    from numeric_raw n join iso q using (event_id) where n.machine = 'conveyer')"""))
def registry_load(spark, sf):
    """Two machines from one registry table; the conveyer's log without cycles serves training only."""
    sources = []
    for profile, raw in ((FURNACE, _raw(spark, sf, FURNACE)), (CONVEYER, _iso(spark, sf, CONVEYER).drop("i_avg_src"))):
        path = new_path(spark, "csv-registry")
        logs.write_csv_logs(raw.drop("event_id").withColumnRenamed("timestamp_str", "Timestamp"), path)
        sources.append((profile.profile, f"{path}/machine={profile.profile}", 0, False))
    sources.append(("conveyer", sources[1][1], 1, True))
    registry = stage(spark.createDataFrame(sources, "machine string, source string, rank int, training_only boolean"))
    return rounded(logs.load_registry(spark, registry).select("machine", "row_idx", "timestamp", "i1", "i_avg"))


@query("machine_registry", sql("""select p.profile as machine, p.window_seconds, p.green_min_rms, n as samples
  from profiles p join stats s on s.machine = p.profile"""))
def machine_registry(spark, sf):
    _, stats = _stats(spark, sf)
    return with_profile(stats, "window_seconds", "green_min_rms").select(
        "machine", "window_seconds", "green_min_rms", F.col("n").alias("samples"))


@query("clock_seconds", sql(f"""select machine, row_idx, {r("cast(split_part(timestamp_str, ':', 1) as double) * 60e0 + cast(split_part(timestamp_str, ':', 2) as double)", 'seconds')} from raw"""))
def clock_seconds(spark, sf):
    return rounded(events.raw_readings(spark, sf).select(
        "machine", "row_idx", ingest.clock_seconds("timestamp_str").alias("seconds")))


@query("timestamp_wrap", sql("""select machine, row_idx, timestamp '2024-01-01' + to_microseconds(cast(
    round((secs + 3600e0 * sum(case when secs < prev - 1800e0 then 1 else 0 end) over (partition by machine order by row_idx)) * 1e6) as bigint)) as timestamp
  from (select *, lag(secs) over (partition by machine order by row_idx) as prev from (
    select machine, row_idx, cast(split_part(timestamp_str, ':', 1) as double) * 60e0 + cast(split_part(timestamp_str, ':', 2) as double) as secs from raw))"""))
def timestamp_wrap(spark, sf):
    return ingest.wrapping_clock(events.raw_readings(spark, sf), FURNACE.base_time).select(
        "machine", "row_idx", "timestamp")


@query("timestamp_fallback", sql("""select machine, row_idx, coalesce(t, base + to_seconds(row_idx)) as timestamp from (
    select machine, row_idx, try_cast(timestamp_str as timestamp) as t,
      first_value(try_cast(timestamp_str as timestamp) ignore nulls) over (partition by machine order by row_idx
        rows between unbounded preceding and unbounded following) as base from iso where machine in ('conveyer', 'robo'))"""))
def timestamp_fallback(spark, sf):
    both = _iso(spark, sf, CONVEYER).unionByName(_iso(spark, sf, ROBO))
    return ingest.iso_with_fallback(both, CONVEYER.base_time).select("machine", "row_idx", "timestamp")


@query("timestamp_drop_bad", sql("""select machine, row_idx, try_cast(timestamp_str as timestamp) as timestamp from iso
  where machine = 'milling' and try_cast(timestamp_str as timestamp) is not null"""))
def timestamp_drop_bad(spark, sf):
    return ingest.iso_dropping_bad(_iso(spark, sf, MILLING)).select("machine", "row_idx", "timestamp")


@query("bad_timestamp_count", sql("""select machine, count(*) filter (try_cast(timestamp_str as timestamp) is null) as bad_rows,
  count(*) as rows from iso group by machine"""))
def bad_timestamp_count(spark, sf):
    return ingest.count_bad_times(events.raw_iso_readings(spark, sf))


@query("bad_clock_count", sql("""select machine, count(*) filter (event_id % 103 = 0) as bad_rows, count(*) as rows from raw group by machine"""))
def bad_clock_count(spark, sf):
    """Clocks that can't be read, counted, as their rows get no time."""
    raw = events.raw_readings(spark, sf)
    broken = F.when(F.col("event_id") % 103 == 0, F.lit("12:xx.0")).otherwise(F.col("timestamp_str"))
    return ingest.count_bad_clocks(raw.withColumn("timestamp_str", broken))


@query("synthetic_time", sql("""select machine, row_idx, timestamp '2026-01-01' + to_seconds(row_idx) as timestamp,
  strftime(timestamp '2026-01-01' + to_seconds(row_idx), '%H:%M:%S') as timestamp_str from raw"""))
def synthetic_time(spark, sf):
    raw = events.raw_readings(spark, sf).drop("timestamp_str")
    return ingest.synthetic_time(raw, CONVEYER.base_time).select("machine", "row_idx", "timestamp", "timestamp_str")


@query("numeric_coercion", sql(f"""select machine, row_idx, {r('n1', 'i1')}, {r('n2', 'i2')}, {r('n3', 'i3')},
  {r('nf', 'frequency')}, {r('(n1 + n2 + n3) / 3e0', 'i_avg')} from numeric_raw"""))
def numeric_coercion(spark, sf):
    return rounded(ingest.numeric_columns(events.raw_readings(spark, sf)).select(
        "machine", "row_idx", "i1", "i2", "i3", "frequency", "i_avg"))


@query("sensor_average", sql(f"""select machine, row_idx, {r("greatest(coalesce(try_cast(i_avg_src as double), 0e0), 0e0)", 'i_avg')}
  from iso where machine = 'robo'"""))
def sensor_average(spark, sf):
    return rounded(ingest.numeric_columns(_iso(spark, sf, ROBO), True).select("machine", "row_idx", "i_avg"))


@query("sort_and_renumber", sql("""select machine, event_id, row_number() over (partition by machine order by t, src) - 1 as row_idx
  from (select machine, event_id, row_idx as src, coalesce(try_cast(timestamp_str as timestamp),
    first_value(try_cast(timestamp_str as timestamp) ignore nulls) over (partition by machine order by row_idx
      rows between unbounded preceding and unbounded following) + to_seconds(row_idx - event_id % 5)) as t from iso)"""))
def sort_and_renumber(spark, sf):
    """Times made slightly out of order, then sorted with ties in file order."""
    raw = events.raw_iso_readings(spark, sf)
    timed = ingest.iso_with_fallback(raw, CONVEYER.base_time)
    bad = ingest.iso_timestamp("timestamp_str").isNull()
    shifted = timed.withColumn("timestamp", F.when(
        bad, F.timestamp_micros(F.unix_micros("timestamp") - F.expr("(event_id % 5) * 1000000L"))).otherwise(F.col("timestamp")))
    return ingest.sort_by_time(shifted).select("machine", "event_id", "row_idx")


@query("sample_rate", sql(f"select machine, {r('sample_rate')} from stats"))
def sample_rate(spark, sf):
    _, stats = _stats(spark, sf)
    return rounded(stats.select("machine", "sample_rate"))


@query("session_overview", sql(f"""select machine, n as total_samples, {r('n / (sample_rate * 3600e0)', 'duration_hours')},
  {rs('sample_rate', 'min_i_avg', 'max_i_avg')} from stats"""))
def session_overview(spark, sf):
    _, stats = _stats(spark, sf)
    return rounded(session_stats.session_overview(stats))


# ---------------------------------------------------------------- slices

@query("hours_slice", sql("""select machine, row_idx from readings join stats using (machine)
  where row_idx < floor(1 * sample_rate * 3600)"""))
def hours_slice(spark, sf):
    rows, stats = _stats(spark, sf)
    return slices.first_hours(rows, stats, 1).select("machine", "row_idx")


@query("default_hours_slice", sql("""select machine, row_idx from readings join stats using (machine)
  where row_idx < floor(least(4, greatest(1, floor(n / (sample_rate * 3600)))) * sample_rate * 3600)"""))
def default_hours_slice(spark, sf):
    rows, stats = _stats(spark, sf)
    return slices.first_hours(rows, stats).select("machine", "row_idx")


@query("moment_context", sql(f"""select machine, row_idx, {r('i_avg')} from readings
  where ts between timestamp '2024-01-01 00:10:00' - interval 60 second and timestamp '2024-01-01 00:10:00' + interval 60 second"""))
def moment_context(spark, sf):
    at = F.lit("2024-01-01 00:10:00").cast("timestamp")
    return rounded(slices.around(events.readings(spark, sf), at).select("machine", "row_idx", "i_avg"))


@query("context_join", sql("""select a.machine, b.row_idx as centre_id, a.row_idx from readings a
  join readings b on a.machine = b.machine and b.row_idx % 100 = 7
    and a.ts between b.ts - interval 60 second and b.ts + interval 60 second"""))
def context_join(spark, sf):
    rows = events.readings(spark, sf)
    centres = rows.filter("row_idx % 100 = 7").select(
        "machine", F.col("row_idx").alias("centre_id"), F.col("timestamp").alias("centre_time"))
    return slices.context_rows(rows, centres, 60).select("machine", "centre_id", "row_idx")


@query("window_context", sql("""select w.machine, w.window_index, r.row_idx from windows w join readings r
  on r.machine = w.machine and r.ts >= w.start_time - 3 * (w.end_time - w.start_time)
    and r.ts <= w.end_time + 3 * (w.end_time - w.start_time)"""))
def window_context(spark, sf):
    """Context of every window of every machine."""
    rows = events.readings(spark, sf)
    table = stage(windows.generate_windows(rows, analysis.settings_of(rows)))
    return slices.window_context(rows, table).select("machine", "window_index", "row_idx")


@query("row_range_context", sql("""select machine, row_idx from readings where row_idx >= 600 and row_idx < 900"""))
def row_range_context(spark, sf):
    """A range, extended by the look-back, given a look-back mean, then trimmed again."""
    wide = slices.row_range_with_context(events.readings(spark, sf), 600, 900, 120)
    return slices.trim_context(wide).select("machine", "row_idx")


@query("row_range_files", sql("""select machine, count(*) as rows, min(row_idx) as first_row, max(row_idx) as last_row, true as fewer_files from readings
  where row_idx >= 150 - 119 and row_idx < 220 group by machine"""))
def row_range_files(spark, sf):
    """A range and its look-back from saved readings, opening only the files of its blocks."""
    path = new_path(spark, "saved-readings")
    logs.save_readings(events.readings(spark, sf), path, rows_per_file=60)
    every = len(spark.read.parquet(path).inputFiles())
    part = logs.read_range(spark, path, 150, 220, look_back=119, rows_per_file=60).withColumn("_file", F.input_file_name())
    counted = part.groupBy("machine").agg(F.count("*").alias("rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"),
                                          F.count_distinct("_file").alias("_files"))
    return counted.withColumn("fewer_files", F.col("_files") * len(PROFILES) < every).drop("_files")


@query("downsample", sql("""select machine, row_idx from readings join stats using (machine)
  where row_idx % greatest(1, n // 2000) = 0"""))
def downsample(spark, sf):
    rows, stats = _stats(spark, sf)
    return slices.thin_rows(rows, stats).select("machine", "row_idx")


@query("preview", sql("select machine, row_idx from readings where row_idx < 1000"))
def preview(spark, sf):
    return slices.preview(events.readings(spark, sf), 1000).select("machine", "row_idx")


# ---------------------------------------------------------------- sample states

_STATE = "case when i_avg < red_max_rms then 'RED' when i_avg >= green_min_rms then 'GREEN' else 'AMBER' end"


@query("per_sample_state", sql(f"""select machine, row_idx, state, case state when 'RED' then 0 when 'GREEN' then 2 else 1 end as state_code,
    case when state = 'GREEN' then 1e0 else 0e0 end as running,
    case state when 'RED' then state_red when 'GREEN' then state_green else state_amber end as label
  from (select r.machine, row_idx, {_STATE} as state, p.* from readings r join profiles p on p.profile = r.machine)"""))
def per_sample_state(spark, sf):
    out = classify.sample_states(events.readings(spark, sf)).withColumn("running", display.is_running("state"))
    named = with_profile(out, "state_red", "state_amber", "state_green")
    return named.withColumn("label", display.state_label("state")).select(
        "machine", "row_idx", "state", "state_code", "running", "label")


def share_sql(source: str) -> str:
    return f"""select m.machine, s.state, count(x.machine) as samples, {r('count(x.machine) * 1e0 / m.total * 100e0', 'share_pct')}
      from (select machine, count(*) as total from {source} group by machine) m
      cross join (values ('RED'), ('AMBER'), ('GREEN')) s(state)
      left join {source} x on x.machine = m.machine and x.state = s.state group by m.machine, m.total, s.state"""


@query("state_share", sql(share_sql("sampled"), {
    "sampled": f"select r.machine, {_STATE} as state from readings r join profiles p on p.profile = r.machine"}))
def state_share(spark, sf):
    return rounded(classify.state_share(classify.sample_states(events.readings(spark, sf))))


@query("result_runs", sql(share_sql("sampled"), {"sampled": f"select r.machine, {_STATE} as state from readings r join profiles p on p.profile = r.machine"}))
def result_runs(spark, sf):
    """State shares written twice as one run, read back once."""
    path = new_path(spark, "result-runs")
    share = rounded(classify.state_share(classify.sample_states(events.readings(spark, sf))))
    for _ in range(2):
        sinks.save_run(share, path, "2024-01")
    return sinks.read_run(spark, path)


@query("job_names", sql("""select machine, cycle_id, job_type, case k when 1 then 'Standard'
    when 2 then ['Light Load', 'Heavy Load'][job_type + 1] else ['Light Load', 'Medium Load', 'Heavy Load'][job_type + 1] end as job_name
  from jobs join profiles p on p.profile = machine join (select machine, least(any_value(job_types), count(*)) as k from job_raw group by machine) using (machine)"""))
def job_names(spark, sf):
    """Name of the job type of every cycle, by the number of types that its machine has."""
    return cycles.named_jobs(_labelling(spark, sf).jobs).select("machine", "cycle_id", "job_type", "job_name")


# ---------------------------------------------------------------- windows

@query("timeline_labels", sql("""select machine, window_index, strftime(centre_time, '%b %d  %H:%M:%S') as label, strftime(start_time, '%H:%M:%S') as starts
  from windows"""))
def timeline_labels(spark, sf):
    """Texts of window centres and starts as a timeline shows them."""
    rows = events.readings(spark, sf)
    table = windows.generate_windows(rows, analysis.settings_of(rows))
    return table.select("machine", "window_index", display.timeline_label("centre_time").alias("label"), display.clock_label("start_time").alias("starts"))


@query("sliding_windows", sql("""select machine, window_index, start_time, end_time, centre_time, n_samples, start_row, end_row from windows"""))
def sliding_windows(spark, sf):
    rows = events.readings(spark, sf)
    return windows.generate_windows(rows, analysis.settings_of(rows))


@query("thinned_windows", sql("""select machine, window_index from windows join (select machine, max(window_index) + 1 as n from windows group by machine)
  using (machine) where window_index % case when n > 100 then n // 100 else 1 end = 0"""))
def thinned_windows(spark, sf):
    rows = events.readings(spark, sf)
    table = stage(windows.generate_windows(rows, analysis.settings_of(rows)))
    return windows.thin_windows(table, 100).select("machine", "window_index")


@query("last_full_window", sql("""select machine, coalesce(max(window_index) filter (n_samples >= 8), max(window_index)) as last_full_index
  from windows group by machine"""))
def last_full_window(spark, sf):
    rows = events.readings(spark, sf)
    return windows.last_full_window(windows.generate_windows(rows, analysis.settings_of(rows)))


@query("axis_ticks", sql("""select machine, unnest(list_distinct([cast(round_even(i * (n - 1) / (least(8, n) - 1e0), 0) as int)
    for i in range(0, least(8, n))])) as window_index
  from (select machine, max(window_index) + 1 as n from windows group by machine)"""))
def axis_ticks(spark, sf):
    rows = events.readings(spark, sf)
    table = stage(windows.generate_windows(rows, analysis.settings_of(rows)))
    return slices.tick_rows(table).select("machine", "window_index")


@query("window_time_features", sql(f"""select machine, window_index, n_samples,
  {rs(*features.TIME_FEATURES)} from timef"""))
def window_time_features(spark, sf):
    return rounded(analysis.time_features(events.readings(spark, sf)).select(
        "machine", "window_index", "n_samples", *features.TIME_FEATURES))


@query("phase_imbalance", sql(f"select machine, window_index, {r('phase_imbalance')} from timef"))
def phase_imbalance(spark, sf):
    return rounded(analysis.time_features(events.readings(spark, sf)).select(
        "machine", "window_index", "phase_imbalance"))


_VALID = f"""machine, window_index, is_valid, freq_ok, range_ok, phase_ok, energy_ok,
  {rs('freq_valid_pct', 'avg_freq', 'validation_imbalance', 'avg_i_avg')}, failure_reason"""


@query("window_validation", sql(f"select {_VALID} from valid"))
def window_validation(spark, sf):
    return rounded(analysis.validated_windows(events.readings(spark, sf)))


@query("dataset_validation", sql(f"""select machine, count(*) filter (is_valid) * 1e0 / count(*) * 100e0 / 100e0 >= max(valid_window_fraction) as is_dataset_valid,
  count(*) as total_windows, count(*) filter (is_valid) as valid_windows,
  {r('count(*) filter (is_valid) * 1e0 / count(*) * 100e0', 'valid_pct')}, {r('avg(avg_freq)', 'avg_freq')},
  {r('avg(validation_imbalance)', 'avg_phase_imbalance')}, {r('avg(avg_i_avg)', 'avg_i_avg')} from valid group by machine"""))
def dataset_validation(spark, sf):
    rows, stats = _stats(spark, sf)
    settings = windows.window_settings(stats)
    return rounded(quality.dataset_verdict(stats, analysis.validated_windows(rows, settings=settings)))


# ---------------------------------------------------------------- spectra and features

@query("spectrum", sql(f"""select machine, window_index, channel, n_samples, cast(bin as int) as bin,
  {r('bin * rate / n_samples', 'freq_hz')}, {r('magnitude')} from bins"""))
def spectrum(spark, sf):
    return rounded(spectral.spectrum_bins(analysis.channel_spectra(events.readings(spark, sf))))


@query("spectral_features", sql(f"""select machine, window_index, channel, n_samples, {rs(
    'fundamental_freq', 'fundamental_mag', 'harmonic2_mag', 'harmonic3_mag', 'total_energy', 'high_freq_energy', 'thd')} from spectral"""))
def spectral_features(spark, sf):
    return rounded(spectral.spectral_features(analysis.channel_spectra(events.readings(spark, sf))))


@query("window_features", sql(f"select machine, window_index, {rs(*features.FEATURE_COLUMNS)} from features"))
def window_features(spark, sf):
    return rounded(analysis.window_features(events.readings(spark, sf)).select(
        "machine", "window_index", *features.FEATURE_COLUMNS))


# ---------------------------------------------------------------- rules and smoothed states

_CLASS = f"""machine, window_index, state, {r('confidence')}, reason, {r('round(srms, 3)', 'score_rms')}, {r('round(svar, 3)', 'score_variance')},
  {r('round(sthd, 3)', 'score_thd')}, {r('round(simb, 3)', 'score_imbalance')}"""


def _classified(df: DataFrame) -> DataFrame:
    return rounded(df.select(
        "machine", "window_index", "state", "confidence", "reason",
        *[F.col(f"scores.{s}").alias(f"score_{s}") for s in ("rms", "variance", "thd", "imbalance")]))


@query("rag_classification", sql(f"select {_CLASS} from classified"))
def rag_classification(spark, sf):
    return _classified(classify.classify(analysis.window_features(events.readings(spark, sf))))


_OVERRIDDEN = {"changed": """select * replace (case profile when 'furnace' then 6.5e0 when 'milling' then 0.4e0 else red_max_rms end as red_max_rms,
  case profile when 'conveyer' then 0.3e0 else green_min_rms end as green_min_rms) from profiles"""}


@query("rag_thresholds_override", sql(f"select {_CLASS} from classified", _OVERRIDDEN | rules("changed")))
def rag_thresholds_override(spark, sf):
    """Defaults from the profiles, replaced per machine where a user value is given."""
    user = spark.createDataFrame(
        [("furnace", 6.5, None), ("milling", 0.4, None), ("conveyer", None, 0.3)],
        "machine string, red_max_rms double, green_min_rms double")
    return _classified(classify.classify(analysis.window_features(events.readings(spark, sf)), overrides=user))


@query("hysteresis", sql("select machine, window_index, state, smoothed_state from smoothed"))
def hysteresis(spark, sf):
    return analysis.analyse(events.readings(spark, sf)).select("machine", "window_index", "state", "smoothed_state")


@query("window_analysis", sql(f"""select s.machine, s.window_index, v.is_valid, s.state, {r('s.confidence', 'confidence')}, s.smoothed_state,
  {r('s.rms_i_avg', 'rms_i_avg')}, {r('s.thd', 'thd')}, {r('s.fundamental_freq * 1000e0', 'fundamental_mhz')}
  from smoothed s join valid v on v.machine = s.machine and v.window_index = s.window_index"""))
def window_analysis(spark, sf):
    """The whole chain: windows, spectrum, validation, features, rules, hysteresis."""
    out = analysis.analyse(events.readings(spark, sf))
    return rounded(out.select("machine", "window_index", "is_valid", "state", "confidence", "smoothed_state",
                              "rms_i_avg", "thd", (F.col("fundamental_freq") * 1000.0).alias("fundamental_mhz")))


def _smoothed(spark, sf):
    return stage(analysis.analyse(events.readings(spark, sf)), "smoothed")


@query("window_state_share", sql(share_sql("final"), {"final": "select machine, smoothed_state as state from smoothed"}))
def window_state_share(spark, sf):
    return rounded(classify.state_share(analysis.analyse(events.readings(spark, sf)), "smoothed_state"))


@query("state_transitions", sql(f"""select machine, window_index, smoothed_state as state, {r('confidence')} from (
    select *, lag(smoothed_state) over (partition by machine order by window_index) as prev from smoothed) where prev <> smoothed_state"""))
def state_transitions(spark, sf):
    return rounded(states.transitions(_smoothed(spark, sf), ["machine"]))


@query("state_segments", sql("""select machine, cast(run_id as int) as segment_id, value as state, start_row as start_time, end_row as end_time from segs""", {
    "segs": runs_sql("smoothed", "window_index", "smoothed_state", "centre_time", "centre_time").replace(
        "max(hi) - min(lo) + 1 as len", "count(*) as len")}))
def state_segments(spark, sf):
    return states.segments(_smoothed(spark, sf), ["machine"])


# ---------------------------------------------------------------- labels and cycles

_RUN = "machine, cast(run_id as bigint) as run_id, value, start_row, end_row, len"


def _runs(df: DataFrame) -> DataFrame:
    return df.select("machine", "run_id", "value", F.col("start").alias("start_row"), F.col("end").alias("end_row"), "len")


@query("sample_labels", sql("select machine, row_idx, raw_label from labelled_raw"))
def sample_labels(spark, sf):
    return classify.label_states(events.readings(spark, sf)).select("machine", "row_idx", "raw_label")


@query("run_length", sql(f"select {_RUN} from runs"))
def run_length(spark, sf):
    return _runs(_labelling(spark, sf).raw_runs)


@query("smooth_labels_simultaneous", sql(f"select {_RUN} from together"))
def smooth_labels_simultaneous(spark, sf):
    lab = _labelling(spark, sf)
    return _runs(labels.smooth_simultaneous(lab.raw_runs.filter("merge_rule = 'simultaneous'")))


@query("smooth_labels_leftmost", sql(f"select {_RUN} from leftmost"))
def smooth_labels_leftmost(spark, sf):
    lab = _labelling(spark, sf)
    return _runs(labels.smooth_leftmost(lab.raw_runs.filter("merge_rule = 'leftmost'"), lab.stats))


_CYCLE = "machine, cast(cycle_id as bigint) as cycle_id, start_row, end_row, duration_s"


@query("cycles_non_red", sql(f"select {_CYCLE} from cycles where machine = 'furnace'"))
def cycles_non_red(spark, sf):
    return _labelling(spark, sf).cycles.filter("machine = 'furnace'")


@query("cycles_green_runs", sql(f"select {_CYCLE} from cycles where machine <> 'furnace'"))
def cycles_green_runs(spark, sf):
    return _labelling(spark, sf).cycles.filter("machine <> 'furnace'")


@query("cycle_position", sql(f"select machine, row_idx, state_label, cycle_id, {r('cycle_pos')} from labelled"))
def cycle_position(spark, sf):
    lab = _labelling(spark, sf)
    return rounded(cycles.labelled_samples(lab.readings, lab.intervals).select(
        "machine", "row_idx", "state_label", "cycle_id", "cycle_pos"))


@query("cycle_features_furnace", sql(f"""select l.machine, l.cycle_id, cast(count(*) as double) as duration_s, {r('ln(1e0 + count(*))', 'log_duration')},
  {r('coalesce(avg(i_avg) filter (state_label = 2), 0e0)', 'mean_green')}, {r('coalesce(max(i_avg) filter (state_label = 2), 0e0)', 'max_green')},
  {r('coalesce(stddev_pop(i_avg) filter (state_label = 2), 0e0)', 'std_green')},
  {r('count(*) filter (state_label = 2) * 1e0 / count(*)', 'green_fraction')}, {r('count(*) filter (state_label = 1) * 1e0 / count(*)', 'amber_fraction')}
  from labelled l where machine = 'furnace' and cycle_id >= 0 group by l.machine, l.cycle_id"""))
def cycle_features_furnace(spark, sf):
    lab = _labelling(spark, sf)
    found = cycles.green_cycle_features(cycles.cycle_samples(lab.readings, lab.intervals))
    return rounded(found.withColumn("cycle_id", F.col("cycle_id").cast("int")))


@query("cycle_features_runs", sql(f"""select machine, cycle_id, cast(count(*) as double) as duration_s, {r('avg(i_avg)', 'mean_iavg')}, {r('max(i_avg)', 'max_iavg')},
  {r('stddev_pop(i_avg)', 'std_iavg')}, {r('avg(i1)', 'mean_i1')}, {r('avg((i2 + i3) / 2e0)', 'mean_i23')}, {r('log10(count(*) + 1e0)', 'log_duration')}
  from labelled where machine <> 'furnace' and cycle_id >= 0 group by machine, cycle_id"""))
def cycle_features_runs(spark, sf):
    lab = _labelling(spark, sf)
    found = cycles.run_cycle_features(cycles.cycle_samples(lab.readings, lab.intervals))
    return rounded(found.withColumn("cycle_id", F.col("cycle_id").cast("int")))


@query("cycle_hours", sql(f"""select machine, cycle_id, {r('count(*) / 3600e0', 'hours')} from labelled where machine = 'furnace' and cycle_id >= 0
  group by machine, cycle_id"""))
def cycle_hours(spark, sf):
    """Durations of furnace cycles back from their logarithm."""
    lab = _labelling(spark, sf)
    found = cycles.green_cycle_features(cycles.cycle_samples(lab.readings, lab.intervals))
    return rounded(found.select("machine", F.col("cycle_id").cast("int"), cycles.hours_of("log_duration").alias("hours")))


@query("cycle_summary", sql(f"""select s.machine, count(k.cycle_id) as n_cycles, {r('coalesce(avg(duration_s), 0e0)', 'mean_duration')},
  {r('coalesce(stddev_pop(duration_s), 0e0)', 'std_duration')}, {r('coalesce(median(duration_s), 0e0)', 'median_duration')}
  from stats s left join cycles k using (machine) group by s.machine"""))
def cycle_summary(spark, sf):
    lab = _labelling(spark, sf)
    return rounded(cycles.cycle_summary(lab.stats, lab.cycles))


@query("label_state_counts", sql("""select machine, sum(len) filter (value = 0) as red_samples, sum(len) filter (value = 1) as amber_samples,
  sum(len) filter (value = 2) as green_samples from smooth group by machine"""))
def label_state_counts(spark, sf):
    return _labelling(spark, sf).summary.select("machine", "red_samples", "amber_samples", "green_samples")


@query("duration_histogram", sql(f"""select machine, bin, count(*) as samples, {r('lo + bin * (hi - lo) / 40', 'bin_start')} from (
    select machine, lo, hi, cast(case when hi = lo then 0 else least(39, floor((duration_s - lo) / (hi - lo) * 40)) end as int) as bin
    from (select *, cast(min(duration_s) over (partition by machine) as double) as lo,
                 cast(max(duration_s) over (partition by machine) as double) as hi from cycles)) group by machine, bin, lo, hi"""))
def duration_histogram(spark, sf):
    return rounded(cycles.histogram(_labelling(spark, sf).cycles, ["machine"], "duration_s", 40))


@query("job_clusters", sql("select machine, cycle_id, job_type from jobs"))
def job_clusters(spark, sf):
    return _labelling(spark, sf).jobs


@query("job_cluster_summary", sql(f"""select machine, job_type, count(*) as segments, {r('median(duration_s)', 'median_duration')},
  {r("avg(case when machine = 'furnace' then mean_green else mean_iavg end)", 'mean_load')} from job_raw join jobs using (machine, cycle_id) group by machine, job_type"""))
def job_cluster_summary(spark, sf):
    lab = _labelling(spark, sf)
    load = lab.features.withColumn("load", F.coalesce("mean_iavg", "mean_green"))
    return rounded(cycles.job_summary(load.join(lab.jobs, ["machine", "cycle_id"]), "load"))


@query("labelled_readings", sql(f"""select l.machine, l.row_idx, ts as timestamp, {rs('i1', 'i2', 'i3', 'i_avg', 'frequency')}, state_label, l.cycle_id,
  {r('cycle_pos')}, coalesce(j.job_type, -1) as job_type from labelled l
  left join cycles k on k.machine = l.machine and l.row_idx between k.start_row and k.end_row
  left join jobs j on j.machine = k.machine and j.cycle_id = k.cycle_id"""))
def labelled_readings(spark, sf):
    return rounded(_labelling(spark, sf).samples)


_JOBS_BY_RULE = """select l.*, case when cycle_id < 0 then -1 when cycle_id % 4 = 3 then -1 else cycle_id % 3 end as job_type from labelled l"""


@query("job_lookup", sql("select machine, row_idx, cycle_id, job_type from jobbed", {"jobbed": _JOBS_BY_RULE}))
def job_lookup(spark, sf):
    """Cycle to job type by a rule that leaves some cycles out; a miss is -1."""
    lab = _labelling(spark, sf)
    jobs = lab.cycles.filter("cycle_id % 4 <> 3").select(
        "machine", "cycle_id", F.expr("int(cycle_id % 3)").alias("job_type"))
    return cycles.labelled_samples(lab.readings, lab.intervals, jobs).select("machine", "row_idx", "cycle_id", "job_type")


# ---------------------------------------------------------------- splits, look-back, metrics

@query("temporal_split", sql("""select machine, split, count(*) as rows, min(row_idx) as first_row, max(row_idx) as last_row from split_rows group by machine, split""", {
    "split_rows": """select machine, row_idx, case when row_idx < floor(n * 7e-1) then 'train'
      when row_idx < floor(n * (7e-1 + 15e-2)) then 'val' else 'test' end as split from readings join stats using (machine)"""}))
def temporal_split(spark, sf):
    rows, stats = _stats(spark, sf)
    return lookback.temporal_split(rows, stats).groupBy("machine", "split").agg(
        F.count("*").alias("rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


_TRAIN = {"train": "select r.* from readings r join stats using (machine) where row_idx < floor(n * 7e-1)",
          "moments": "select machine, " + ", ".join(
              f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in features.CHANNELS) + " from train group by machine"}
_MOMENTS = [f"{p}_{c}" for c in features.CHANNELS for p in ("mean", "std")]


@query("norm_stats", sql(f"select machine, {rs(*_MOMENTS)} from moments", _TRAIN))
def norm_stats(spark, sf):
    rows, stats = _stats(spark, sf)
    return rounded(lookback.norm_stats(lookback.temporal_split(rows, stats).filter("split = 'train'")))


_LOOK = _TRAIN | {
    "normed": "select r.machine, r.row_idx, case when row_idx < floor(n * 7e-1) then 'train' when row_idx < floor(n * (7e-1 + 15e-2)) then 'val' else 'test' end as split, "
    + ", ".join(f"({c} - mean_{c}) / case when std_{c} < 1e-8 then 1e0 else std_{c} end as z_{c}" for c in features.CHANNELS)
    + " from readings r join moments using (machine) join stats using (machine)",
    "looked": """select machine, split, row_idx, look_back, count(*) over w as have, first_value(z_i1) over w as oldest_i1,
      z_i_avg as newest_i_avg, lag(z_i1, 60 - 1) over (partition by machine, split order by row_idx) as middle_i1
      from normed join profiles p on p.profile = machine where look_back = 120
      window w as (partition by machine, split order by row_idx rows between 119 preceding and current row)
      union all select machine, split, row_idx, look_back, count(*) over w, first_value(z_i1) over w, z_i_avg,
      lag(z_i1, 15 - 1) over (partition by machine, split order by row_idx)
      from normed join profiles p on p.profile = machine where look_back = 30
      window w as (partition by machine, split order by row_idx rows between 29 preceding and current row)"""}


@query("lookback_windows", sql(f"""select machine, split, row_idx, look_back as length, {r('oldest_i1')}, {r('newest_i_avg')}, {r('middle_i1')}
  from looked where have = look_back""", _LOOK))
def lookback_windows(spark, sf):
    """Normalised look-back arrays inside splits, shown by a few numbers of each array."""
    rows, stats = _stats(spark, sf)
    split = lookback.temporal_split(rows, stats)
    normed = lookback.normalised(split, lookback.norm_stats(split.filter("split = 'train'")))
    out = lookback.lookback(normed, ["machine", "split"])
    return rounded(out.select(
        "machine", "split", "row_idx", F.size("x").alias("length"), F.expr("x[0][0]").alias("oldest_i1"),
        F.expr("element_at(element_at(x, -1), -1)").alias("newest_i_avg"),
        F.expr("element_at(x[cast(size(x) div 2 as int)], 1)").alias("middle_i1")))


@query("lookback_moments", sql(f"""select machine, split, row_idx, {r('m_first', 'mean_first')}, {r('m_last', 'mean_last')}, {r('p_first', 'power_first')}, {r('p_last', 'power_last')} from (
  select *, count(*) over w as have, avg(z_i1) over w as m_first, avg(z_i_avg) over w as m_last, avg(z_i1 * z_i1) over w as p_first, avg(z_i_avg * z_i_avg) over w as p_last
  from normed join profiles p on p.profile = machine where look_back = 120 window w as (partition by machine, split order by row_idx rows between 119 preceding and current row)
  union all select *, count(*) over w, avg(z_i1) over w, avg(z_i_avg) over w, avg(z_i1 * z_i1) over w, avg(z_i_avg * z_i_avg) over w
  from normed join profiles p on p.profile = machine where look_back = 30 window w as (partition by machine, split order by row_idx rows between 29 preceding and current row))
  where have = look_back""", _LOOK))
def lookback_moments(spark, sf):
    """Mean and mean square of every channel over the look-back, from prefix sums."""
    rows, stats = _stats(spark, sf)
    split = lookback.temporal_split(rows, stats)
    normed = lookback.normalised(split, lookback.norm_stats(split.filter("split = 'train'")))
    out = lookback.lookback_moments(normed, ["machine", "split"])
    return rounded(out.select("machine", "split", "row_idx", F.expr("look_mean[0]").alias("mean_first"), F.element_at("look_mean", -1).alias("mean_last"),
                              F.expr("look_power[0]").alias("power_first"), F.element_at("look_power", -1).alias("power_last")))


def _predictions(spark, sf) -> DataFrame:
    """Labels of five rows before in place of a model; none for the first L - 1 rows."""
    lab = _labelling(spark, sf)
    labelled = cycles.labelled_samples(lab.readings, lab.intervals)

    def lagged(w):
        return [{"_ls": F.lag("state_label", 5).over(w), "_lp": F.lag("cycle_pos", 5).over(w),
                 "_lj": F.lag(F.col("cycle_id") % 2, 5).over(w)}]

    out = over_neighbours(labelled, ["machine"], "row_idx", lagged, before=5)
    return with_exprs(
        with_profile(out, "look_back"),
        ml_state="case when row_idx < look_back - 1 then -1 else _ls end",
        ml_cycle_pos="case when row_idx >= look_back - 1 then coalesce(_lp, 5e-1D) end",
        ml_job_type="case when row_idx < look_back - 1 then -1 when _lj < 0 then 0 else _lj end",
        job_type="case when cycle_id < 0 then -1 else cycle_id % 3 % 2 end",
        ml_state_conf="case when row_idx >= look_back - 1 then 6e-1D + (row_idx % 37) / 1e2D end")


@query("prediction_mask", sql("select machine, row_idx, ml_state from predictions where ml_state >= 0"))
def prediction_mask(spark, sf):
    return metrics.predicted(_predictions(spark, sf)).select("machine", "row_idx", "ml_state")


@query("label_agreement", sql("select machine, row_idx, state_label, ml_state from predictions"))
def label_agreement(spark, sf):
    lab = _labelling(spark, sf)
    labelled = cycles.labelled_samples(lab.readings, lab.intervals)
    return metrics.label_agreement(labelled, _predictions(spark, sf))


def confusion_sql(true: str, pred: str, where: str, classes: int) -> str:
    grid = ", ".join(f"({t}, {p})" for t in range(classes) for p in range(classes))
    return f"""select g.machine, g.true_class, g.pred_class, count(x.machine) as samples,
      {r('coalesce(count(x.machine) * 1e0 / nullif(sum(count(x.machine)) over (partition by g.machine, g.true_class), 0), 0e0)', 'row_share')}
      from (select distinct machine, t as true_class, p as pred_class from predictions cross join (values {grid}) v(t, p) where {where}) g
      left join predictions x on x.machine = g.machine and x.{true} = g.true_class and x.{pred} = g.pred_class and {where}
      group by g.machine, g.true_class, g.pred_class"""


@query("confusion_matrix", sql(confusion_sql("state_label", "ml_state", "ml_state >= 0", 3)))
def confusion_matrix(spark, sf):
    return rounded(metrics.confusion_matrix(metrics.predicted(_predictions(spark, sf))))


@query("job_confusion", sql(confusion_sql("job_type", "ml_job_type", "ml_state >= 0 and job_type >= 0", 2)))
def job_confusion(spark, sf):
    return rounded(metrics.job_confusion(metrics.predicted(_predictions(spark, sf)), 2))


_REPORT = {
    "k": "select machine, unnest([0, 1, 2]) as i from stats",
    "rep0": """select k.machine, k.i, count(*) filter (state_label = i and ml_state = i) as tp, count(*) filter (ml_state = i) as pp,
      count(*) filter (state_label = i) as support from k join predictions x on x.machine = k.machine and ml_state >= 0 group by k.machine, k.i""",
    "rep1": """select machine, i, support, coalesce(tp * 1e0 / nullif(pp, 0), 0e0) as precision, coalesce(tp * 1e0 / nullif(support, 0), 0e0) as recall from rep0""",
    "rep2": """select *, coalesce(2e0 * precision * recall / nullif(precision + recall, 0e0), 0e0) as f1 from rep1""",
    "rep": """select machine, ['RED', 'AMBER', 'GREEN'][i + 1] as class, precision, recall, f1, support from rep2
      union all select machine, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from rep2 group by machine
      union all select machine, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) from rep2 group by machine"""}


@query("class_report", sql(f"select machine, class, {rs('precision', 'recall', 'f1')}, cast(support as bigint) as support from rep", _REPORT))
def class_report(spark, sf):
    return rounded(metrics.class_report(metrics.predicted(_predictions(spark, sf))))


@query("masked_metrics", sql(f"""select machine, count(*) as n_valid, {r('avg(case when state_label = ml_state then 1e0 else 0e0 end)', 'state_acc')},
  {r('avg(abs(ml_cycle_pos - cycle_pos)) filter (cycle_pos >= 0)', 'cyc_mae')},
  {r('avg(case when job_type = ml_job_type then 1e0 else 0e0 end) filter (job_type >= 0)', 'job_acc')} from predictions where ml_state >= 0 group by machine"""))
def masked_metrics(spark, sf):
    return rounded(metrics.evaluation(_predictions(spark, sf)))


_PROBS = """select *, case when ml_state = state_label then 8e-1 else 1e-1 end as ps,
  case when ml_job_type = job_type then 75e-2 else 25e-2 end as pj from predictions where ml_state >= 0"""


@query("multitask_loss", sql(f"""select machine, {rs('loss_state', 'loss_cyc', 'loss_job')}, {r('loss_state + 5e-1 * loss_cyc + 5e-1 * loss_job', 'loss')}
  from (select machine, avg(-ln(ps)) as loss_state, coalesce(avg(pow(ml_cycle_pos - cycle_pos, 2)) filter (cycle_pos >= 0), 0e0) as loss_cyc,
    coalesce(avg(-ln(pj)) filter (job_type >= 0), 0e0) as loss_job from probs group by machine)""", {"probs": _PROBS}))
def multitask_loss(spark, sf):
    rows = metrics.predicted(_predictions(spark, sf)).withColumns({
        "state_probs": F.expr("transform(sequence(0, 2), i -> case when i = ml_state then 8e-1D else 1e-1D end)"),
        "job_probs": F.expr("transform(sequence(0, 1), i -> case when i = ml_job_type then 75e-2D else 25e-2D end)")})
    return rounded(metrics.multi_task_loss(rows))


@query("prediction_breakdown", sql(share_sql("named"), {
    "named": "select machine, ['RED', 'AMBER', 'GREEN'][ml_state + 1] as state from predictions where ml_state >= 0"}))
def prediction_breakdown(spark, sf):
    return rounded(metrics.prediction_breakdown(_predictions(spark, sf)))


@query("confidence_histogram", sql(f"""select machine, bin, count(*) as samples, {r('lo + bin * (hi - lo) / 40', 'bin_start')} from (
    select machine, lo, hi, cast(least(39, floor((ml_state_conf - lo) / (hi - lo) * 40)) as int) as bin
    from (select *, min(ml_state_conf) over (partition by machine) as lo, max(ml_state_conf) over (partition by machine) as hi
          from predictions where ml_state >= 0)) group by machine, bin, lo, hi"""))
def confidence_histogram(spark, sf):
    return rounded(metrics.confidence_histogram(_predictions(spark, sf)))


# ---------------------------------------------------------------- models

_models: dict[tuple, tuple] = {}
forget_models = _models.clear
on_remove(forget_models)


def _trained(spark, sf):
    """Models of every machine kind with the default candidates, on labels of the whole logs."""
    key = (spark.sparkContext.applicationId, sf, spark.conf.get("spark.loadline.blockRows", ""))
    if key not in _models:
        lab = _labelling(spark, sf)
        labelled = stage(lab.samples, "labelled")
        trained = models.train(labelled, lab.stats)
        path = new_path(spark, "models")
        models.save_models(trained, path)
        _models[key] = models.load_models(spark, path), trained.left_out, labelled, lab.stats
    return _models[key]


@query("ml_training_history")
def ml_training_history(spark, sf):
    """Train and validation metrics of every candidate of every machine kind."""
    return rounded(_trained(spark, sf)[0].history)


_KINDS = {"trainable": """select s.machine, s.n, p.look_back from stats s join profiles p on p.profile = s.machine
  where least(floor(n * 7e-1), floor(n * (7e-1 + 15e-2)) - floor(n * 7e-1), n - floor(n * (7e-1 + 15e-2))) >= look_back"""}


@query("ml_candidates", sql("""select machine as profile, 3 as candidates, 1 as chosen, true as falls, true as finite from trainable""", _KINDS))
def ml_candidates(spark, sf):
    """Candidates per machine kind; the one with least validation loss is the model, and all beat the loss of no information."""
    trained, _, _, _ = _trained(spark, sf)
    regs = spark.createDataFrame([(k, m.reg) for k, m in trained.kinds.items()], "profile string, reg double")
    seen = trained.history.join(regs, "profile")
    return seen.groupBy("profile").agg(
        F.count("*").cast("int").alias("candidates"),
        F.count_if((F.col("reg_param") == F.col("reg"))).cast("int").alias("chosen"),
        F.bool_and(F.col("train_loss") < 2.5).alias("falls"),
        F.bool_and(~F.isnan("val_loss") & (F.col("val_loss") < float("inf"))).alias("finite"))


@query("ml_predictions")
def ml_predictions(spark, sf):
    """Predictions of saved and reloaded models for every reading of every machine."""
    trained, _, labelled, _ = _trained(spark, sf)
    return rounded(models.predict(labelled, trained))


@query("ml_prediction_check", sql("""select s.machine, s.n as rows, case when t.machine is null then 0 else s.n - p.look_back + 1 end as predicted,
    true as first_unpredicted, true as in_range, true as named, t.machine is not null as beats_majority
  from stats s join profiles p on p.profile = s.machine left join trainable t on t.machine = s.machine""", _KINDS))
def ml_prediction_check(spark, sf):
    """Rows with a prediction, ranges and names, and whether the states beat the largest class."""
    trained, _, labelled, _ = _trained(spark, sf)
    out = with_profile(models.predict(labelled, trained), "look_back")
    some = F.col("ml_state") >= 0
    full = F.col("row_idx") >= F.col("look_back") - 1
    shown = F.col("ml_state_name").isin("RED", "AMBER", "GREEN") & (F.col("ml_job_name") != "–")
    counted = out.groupBy("machine").agg(
        F.count("*").alias("rows"), F.count_if(some).alias("predicted"),
        F.bool_and(full | ~some).alias("first_unpredicted"),
        F.bool_and(F.when(some, F.col("ml_cycle_pos").between(0, 1) & F.col("ml_state_conf").between(1 / 3 - 1e-9, 1)).otherwise(
            F.col("ml_cycle_pos").isNull() & (F.col("ml_job_type") == -1))).alias("in_range"),
        F.bool_and(F.when(some, shown).otherwise(F.col("ml_state_name") == "–")).alias("named"),
        F.count_if(some & (F.col("ml_state") == F.col("state_label"))).alias("_hits"),
        *[F.count_if(some & (F.col("state_label") == c)).alias(f"_n{c}") for c in range(3)])
    return counted.withColumn("beats_majority", F.col("_hits") > F.greatest("_n0", "_n1", "_n2")).drop("_hits", "_n0", "_n1", "_n2")


@query("ml_range", sql("""select machine, row_idx, row_idx >= look_back - 1 and t.machine is not null as predicted, true as same
  from readings r join profiles p on p.profile = r.machine left join (select machine as m, machine from trainable) t on t.m = r.machine
  where row_idx >= 100 and row_idx < 400""".replace("select machine, row_idx,", "select r.machine, row_idx,"), _KINDS))
def ml_range(spark, sf):
    """A range predicted from itself and the look-back rows before it, next to the predictions on whole logs."""
    trained, _, labelled, _ = _trained(spark, sf)
    part = models.predict_range(labelled, trained, 100, 400)
    whole = models.predict(labelled, trained).select("machine", "row_idx", F.struct("ml_state", "ml_job_type", F.round("ml_cycle_pos", 9)).alias("_whole"))
    return part.join(whole, ["machine", "row_idx"]).select(
        "machine", "row_idx", (F.col("ml_state") >= 0).alias("predicted"),
        F.struct("ml_state", "ml_job_type", F.round("ml_cycle_pos", 9)).eqNullSafe(F.col("_whole")).alias("same"))


@query("ml_evaluation")
def ml_evaluation(spark, sf):
    """Metrics on the last 15 % of every log."""
    trained, _, labelled, stats = _trained(spark, sf)
    return rounded(metrics.evaluation(models.predict(lookback.last_rows(labelled, stats), trained)))


@query("short_logs", sql("""select s.machine, split, rows, p.look_back from (
    select machine, unnest(['train', 'val', 'test']) as split,
      unnest([floor(n * 7e-1), floor(n * (7e-1 + 15e-2)) - floor(n * 7e-1), n - floor(n * (7e-1 + 15e-2))])::bigint as rows from stats) s
  join profiles p on p.profile = s.machine where rows < p.look_back * 4""".replace("p.look_back from", "p.look_back * 4 as look_back from")))
def short_logs(spark, sf):
    """Splits that are shorter than a look-back of four times the default."""
    _, stats = _stats(spark, sf)
    wide = tuple(replace(p, look_back=4 * p.look_back) for p in PROFILES)
    return lookback.short_logs(stats, wide)


# ---------------------------------------------------------------- streams

@query("streaming_state", sql(f"select r.machine, row_idx, {_STATE} as state from readings r join profiles p on p.profile = r.machine"))
def streaming_state(spark, sf):
    stream = streaming.as_stream(spark, events.readings(spark, sf), "state-input", files_per_batch=2)
    return streaming.run_to_table(streaming.stream_sample_states(stream).select("machine", "row_idx", "state"), "state-stream")


@query("streaming_windows", sql(f"""select c.machine, c.start_time, c.end_time, c.n_samples, {r('c.rms_i_avg', 'rms_i_avg')}, v.is_valid, c.state, {r('c.confidence', 'confidence')}
  from classified c join valid v on v.machine = c.machine and v.window_index = c.window_index
  where c.end_time <= (select max(ts) from readings) - interval 10 second"""))
def streaming_windows(spark, sf):
    """Windows closed by the watermark (10 s behind the latest reading)."""
    stream = streaming.as_stream(spark, events.readings(spark, sf), "window-input")
    both = streaming.run_to_table(streaming.stream_all_windows(stream), "windows-stream")
    first = events.readings(spark, sf).groupBy("machine").agg(F.min("timestamp").alias("_first"))
    return rounded(both.join(first, "machine").filter("start_time >= _first").drop("_first"))


_RED_START = f"machine, end_time, state, {r('confidence')}, smoothed_state"


def _stream_smoothed(spark, sf):
    done = analysis.analyse(events.readings(spark, sf)).select("machine", "end_time", "state", "confidence")
    stream = streaming.as_stream(spark, done, "hysteresis-input", order="end_time")
    return streaming.run_to_table(streaming.stream_hysteresis(stream), "hysteresis-stream")


@query("streaming_hysteresis", sql(f"select {_RED_START} from smoothed_red"))
def streaming_hysteresis(spark, sf):
    return rounded(_stream_smoothed(spark, sf).drop("changed"))


@query("streaming_transitions", sql(f"""select machine, end_time, smoothed_state as state, {r('confidence')} from (
    select *, coalesce(lag(smoothed_state) over (partition by machine order by window_index), 'RED') as prev from smoothed_red)
  where prev <> smoothed_state"""))
def streaming_transitions(spark, sf):
    return rounded(streaming.stream_transitions(_stream_smoothed(spark, sf)))


@query("streaming_smoothed", sql("select machine, true as same from stats"))
def streaming_smoothed(spark, sf):
    """Readings to smoothed window states in one stream, against batch hysteresis over the same windows."""
    stream = streaming.as_stream(spark, events.readings(spark, sf), "smoothed-input", files_per_batch=2)
    out = streaming.run_to_table(streaming.stream_smoothed_windows(stream), "smoothed-stream", provider=streaming.ROCKSDB)
    numbered = number_rows(out, ["machine"], ["end_time"], "window_index")
    both = states.hysteresis(numbered, ["machine"], initial="RED", out="again")
    return both.groupBy("machine").agg(F.bool_and(F.col("smoothed_state") == F.col("again")).alias("same"))
