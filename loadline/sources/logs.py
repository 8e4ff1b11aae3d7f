"""CSV logs of machines: scan, header rules, file order, loading by machine kind."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadline.functions.parsing import canonical_name
from loadline.operators.ingest import clean
from loadline.plans.blocks import number_rows
from loadline.plans.staging import stage
from loadline.profiles import PROFILES, Profile

FILE_ORDER = ["src_rank", "src_block", "src_pos"]


def list_files(spark: SparkSession, source: str | Sequence[str]) -> list[str]:
    """A file, a list of files (in that order), or all ``*.csv`` of a folder (sorted)."""
    entries = [source] if isinstance(source, str) else list(source)
    files: list[str] = []
    for entry in entries:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(entry)
                 .select("_metadata.file_path").collect())
        files += sorted(r.file_path for r in found)
    return files


def canonical_columns(headers: list[str], any_time_header: bool = False) -> dict[str, str]:
    """Raw header -> canonical name, for the headers that are known."""
    named = {h: canonical_name(h, any_time_header) for h in headers}
    return {h: c for h, c in named.items() if c}


def first_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, header): the first line of every file.

    One task a file, which stops after one row, so nothing behind the first line is fetched but the reader's buffer.
    """
    whole = str(1 << 50)  # a file is one partition
    held = {key: spark.conf.get(key) for key in _HEADER_SETTINGS}
    spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    spark.conf.set("spark.sql.files.openCostInBytes", whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        lines = spark.read.text(list(files)).select("value", F.col("_metadata.file_path").alias("file"))

        def first(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("value")], ["file", "header"])
                return

        return stage(lines.mapInArrow(first, "file string, header string"), "headers")
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


_HEADER_SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")


def header_groups(spark: SparkSession, files: Sequence[str]) -> list[list[str]]:
    """Files grouped by their first line; empty files are in no group."""
    grouped = first_lines(spark, files).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [r.files for r in grouped.orderBy("files").collect()]


def scan_csv(spark: SparkSession, files: Sequence[str], any_time_header: bool = False, machines: Sequence[str] | None = None) -> DataFrame:
    """All columns as text under canonical names, with file rank, split and position.

    Files are grouped by header, so each group is one scan.  ``machines`` names the machine of each file.
    """
    def scan(paths):
        return spark.read.option("header", True).option("enforceSchema", False).csv(paths)

    ranks = spark.createDataFrame([(i, f, m) for i, (f, m) in enumerate(zip(files, machines or [None] * len(files)))],
                                  "src_rank int, _file string, machine string")
    if machines is None:
        ranks = ranks.drop("machine")
    parts = []
    for paths in header_groups(spark, sorted(set(files))):
        names = canonical_columns(scan(paths[:1]).columns, any_time_header)
        parts.append(scan(paths).select(
            *[F.col(f"`{h}`").alias(c) for h, c in names.items()],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("src_block"),
            F.monotonically_increasing_id().alias("src_pos")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.join(ranks, "_file").drop("_file")


def load_files(spark: SparkSession, files: Sequence[tuple[str, str]], profile: Profile) -> DataFrame:
    """Clean readings of all machines of one profile from (machine, file) pairs, in one plan."""
    rows = scan_csv(spark, [f for _, f in files], profile.time_mode == "wrapping_clock", [m for m, _ in files])
    if "timestamp_str" not in rows.columns or profile.time_mode != "iso_fallback":
        raw = number_rows(rows, ["machine"], FILE_ORDER)
        return clean(raw, profile)
    # The fallback time counts rows inside the file, so number those first.
    in_file = number_rows(rows, ["machine", "src_rank"], ["src_block", "src_pos"], "file_row")
    raw = number_rows(in_file, ["machine"], ["src_rank", "file_row"])
    return clean(raw, profile, ("machine", "src_rank"), "file_row")


def load_log(spark: SparkSession, machine: str, source: str | Sequence[str], profiles=PROFILES) -> DataFrame:
    """Clean readings of one machine from its CSV log, by the rules of its profile."""
    return load_machines(spark, {machine: source}, profiles)


def load_machines(spark: SparkSession, sources: dict[str, str | Sequence[str]], profiles=PROFILES) -> DataFrame:
    """Readings of all machines of ``{machine: source}``: one branch of one plan a profile, however many machines."""
    known = {p.profile: p for p in profiles}
    by_profile: dict[str, list[tuple[str, str]]] = {}
    for machine, source in sources.items():
        name = machine.split("_")[0]
        if name not in known:
            raise ValueError(f"no profile for machine {machine}")
        by_profile.setdefault(name, []).extend((machine, f) for f in list_files(spark, source))
    return reduce(DataFrame.unionByName, [load_files(spark, files, known[name]) for name, files in by_profile.items()])


def load_registry(spark: SparkSession, registry: DataFrame, training: bool = False, profiles=PROFILES) -> DataFrame:
    """Readings of all machines of a registry table (machine, source, rank, training_only).

    Sources of a machine are taken by rank.  Those marked training_only (logs that do not show the machine's cycles) are left out
    unless ``training`` asks for them; a machine without any other source has no readings then.
    """
    rows = registry.filter(F.lit(training) | ~F.coalesce("training_only", F.lit(False))).orderBy("machine", "rank").collect()  # configuration
    sources: dict[str, list[str]] = {}
    for r in rows:
        sources.setdefault(r.machine, []).append(r.source)
    return load_machines(spark, sources, profiles)


#: Full files that ``save_readings`` writes at most; each machine may add one that is not full.
SAVED_FILES = 2048


def save_readings(readings: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet by machine and block of rows, in time order, so that a range of rows is a few files.

    Tables of more than ``SAVED_FILES`` such files get blocks of twice, four times, ... as many rows, so that writing and listing
    files does not grow with the table.  The folder ``block_rows`` tells the size.
    """
    total = readings.count()
    while total // rows_per_file > SAVED_FILES:
        rows_per_file *= 2
    out = readings.withColumns({"block_rows": F.lit(rows_per_file).cast("long"), "block": F.expr(f"row_idx div {rows_per_file}")})
    (out.repartition("machine", "block").sortWithinPartitions("machine", "row_idx")
     .write.mode("overwrite").partitionBy("block_rows", "machine", "block").parquet(path))


def read_range(spark: SparkSession, path: str, start: int, end: int, look_back: int = 0, rows_per_file: int = 5_000_000) -> DataFrame:
    """Rows [start - look_back, end) of every machine saved with ``save_readings``; other blocks' files are not opened."""
    low = max(0, start - look_back)
    saved = spark.read.parquet(path)
    size = "block_rows" if "block_rows" in saved.columns else f"{rows_per_file}"  # folders of earlier versions do not tell it
    saved = saved.filter(F.expr(f"block between {low} div {size} and {max(0, end - 1)} div {size}"))
    return saved.filter((F.col("row_idx") >= low) & (F.col("row_idx") < end)).drop("block", "block_rows")


def write_csv_logs(readings: DataFrame, path: str) -> None:
    """Text logs, one folder per machine; rows stay in order inside and across files."""
    by_block = readings.repartitionByRange("machine", "row_idx").sortWithinPartitions("machine", "row_idx")
    by_block.drop("row_idx").write.partitionBy("machine").option("header", True).csv(path)
