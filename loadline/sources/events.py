"""Sensor tables derived from the ``events`` table.

Each event becomes one reading: ``event_id % 4`` picks the machine, the position by time
inside the machine is the 1 Hz sample number, and ``value`` gives load and noise.  The
derived tables are written once per session and input folder, as a loader would do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadline.plans.blocks import block_number, block_rows, number_rows
from loadline.plans.staging import on_remove, stage

_tables: dict[tuple, DataFrame] = {}
on_remove(_tables.clear)

# Load step, base currents and noise of the derived sensor log.
_CURRENTS = """
  case (case cast(floor(row_idx / 90e0) as int) % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 1 end
        + case when value > 200e0 then 1 else 0 end) % 3
    when 0 then case machine when 'furnace' then 5e-1 when 'conveyer' then 5e-2 when 'robo' then 5e-2 else 3e-1 end
    when 1 then case machine when 'furnace' then 6e0 when 'conveyer' then 2e-1 when 'robo' then 1003e-4 else 2e0 end
    else case machine when 'furnace' then 15e0 when 'conveyer' then 6e-1 when 'robo' then 13e-2 else 6e0 end
  end"""


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name, spark.conf.get("spark.loadline.blockRows", ""))
    if key not in _tables:
        _tables[key] = build()
    return _tables[key]


def _write_by_block(df: DataFrame, name: str) -> DataFrame:
    """Write a table so that scans meet each machine's rows in time order."""
    rows = block_rows(df)
    return stage(
        df.repartition("machine", block_number("row_idx", rows))
        .sortWithinPartitions("machine", "row_idx"), name)


def currents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
            "event_id", "ts", "value",
            F.expr("""case event_id % 4 when 0 then 'furnace' when 1 then 'conveyer'
                      when 2 then 'robo' else 'milling' end""").alias("machine"))
        c = (number_rows(events, ["machine"], ["ts", "event_id"])
             .withColumn("u", F.expr("least(value, 100e0) / 100e0 - 5e-1"))
             .withColumn("base", F.expr(_CURRENTS)))
        c = c.select(
            "event_id", "machine", "row_idx", "value", "u",
            F.expr("""case when machine = 'robo' then 3e0 * base * (1e0 + 4e-1 * u)
                      else base * (1e0 + 4e-1 * u) end""").alias("i1"),
            F.expr("case when machine = 'robo' then 0e0 else base * (1e0 - 3e-1 * u) end").alias("i2"),
            F.expr("case when machine = 'robo' then 0e0 else base * (1e0 + 1e-1 * u) end").alias("i3"),
            F.expr("50e0 + case when value > 200e0 then 8e-1 else 4e-1 * u end").alias("frequency"))
        return _write_by_block(c, "currents")
    return _once(spark, sf_dir, "currents", build)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean readings: machine, row_idx, timestamp, i1, i2, i3, i_avg, frequency."""
    def build():
        c = currents(spark, sf_dir)
        return _write_by_block(c.select(
            "machine", "row_idx", F.expr("timestamp_seconds(1704067200 + row_idx)").alias("timestamp"),
            "i1", "i2", "i3", F.expr("(i1 + i2 + i3) / 3e0").alias("i_avg"), "frequency"), "readings")
    return _once(spark, sf_dir, "readings", build)


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text readings with a clock that wraps every hour (one sample per 10 s)."""
    def build():
        return _write_by_block(currents(spark, sf_dir).select(
            "event_id", "machine", "row_idx",
            F.expr("""format_string('%02d:%04.1f', cast(floor((row_idx * 10) / 60e0) as int) % 60,
                      cast((row_idx * 10) % 60 as double))""").alias("timestamp_str"),
            F.expr("""case when event_id % 97 = 0 then 'bad' when event_id % 89 = 0 then '-1.0'
                      when event_id % 83 = 0 then null else format_string('%.10f', i1) end""").alias("i1"),
            F.expr("format_string('%.10f', i2)").alias("i2"),
            F.expr("format_string('%.10f', i3)").alias("i3"),
            F.expr("""case when event_id % 101 = 0 then 'n/a'
                      else format_string('%.10f', frequency) end""").alias("frequency")), "raw")
    return _once(spark, sf_dir, "raw_readings", build)


def raw_iso_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with ISO times, some of them corrupt, and a sensor average."""
    def build():
        return _write_by_block(raw_readings(spark, sf_dir).select(
            "event_id", "machine", "row_idx",
            F.expr("""case when event_id % 103 = 0 then 'corrupt' else
                      date_format(timestamp_seconds(1704067200 + row_idx), 'yyyy-MM-dd HH:mm:ss') end"""
                   ).alias("timestamp_str"),
            "i1", "i2", "i3",
            F.expr("case when event_id % 107 = 0 then 'x' else i1 end").alias("i_avg_src"),
            "frequency"), "raw-iso")
    return _once(spark, sf_dir, "raw_iso_readings", build)
