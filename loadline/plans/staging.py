"""Written intermediate tables.

``stage`` writes a DataFrame to parquet in the folder the cluster names in
``spark.checkpoint.dir`` and reads it back.  It cuts lineage, survives lost executors,
computes the plan once, and gives Catalyst the real size of the result, so a later join
is broadcast only when the written files are below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
#: Called when staged tables are removed, to drop frames that read them.
_forget: list[Callable[[], None]] = []


def on_remove(forget: Callable[[], None]) -> None:
    _forget.append(forget)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only on a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir")
    if configured:
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="loadline-")
    return _local_roots[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/loadline/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, name: str = "small") -> DataFrame:
    """A per-machine table, written once; Catalyst joins it by its written size."""
    return stage(df, name)


def remove_staged(spark: SparkSession) -> None:
    """Delete the tables this application staged; frames built on them become invalid."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/loadline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for forget in _forget:
        forget()
