"""Result tables that can be written again: a run is whole or not there.

A run's rows go to a folder of their own; a manifest written afterwards names the folder.  Readers go by
manifests only, so a write that fails, or a second write of the same run, never mixes with what is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, folder string, rows bigint, written timestamp"


def save_run(results: DataFrame, path: str, run: str, by: tuple[str, ...] = ("machine",)) -> None:
    """Write ``results`` as the rows of ``run``, in place of an earlier write of that run."""
    spark = results.sparkSession
    folder = f"data/{run}-{uuid.uuid4().hex}"
    results.write.partitionBy(*by).parquet(f"{path}/{folder}")
    rows = spark.read.schema(results.schema).parquet(f"{path}/{folder}").count()
    manifest = spark.range(1).select(F.lit(run).alias("run"), F.lit(folder).alias("folder"), F.lit(rows).cast("bigint").alias("rows"),
                                     F.current_timestamp().alias("written"))
    manifest.write.parquet(f"{path}/manifest/{uuid.uuid4().hex}")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The last manifest of every run."""
    found = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{path}/manifest")
    return found.groupBy("run").agg(F.max_by(F.struct("folder", "rows", "written"), F.struct("written", "folder")).alias("m")).select("run", "m.*")


def read_run(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Rows of a run, by default of the one written last."""
    known = runs(spark, path)
    known = known.filter(F.col("run") == run) if run is not None else known
    last = known.orderBy(F.desc("written"), "folder").first()
    if last is None:
        raise ValueError(f"no run {run or ''} in {path}")
    return spark.read.parquet(f"{path}/{last.folder}")
