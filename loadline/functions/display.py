"""Names, codes and display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadline.profiles import AMBER, GREEN, RED, STATE_CODES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def state_code(state: Column | str) -> Column:
    """RED 0, AMBER 1, GREEN 2; anything unknown counts as AMBER."""
    s = _col(state)
    return (F.when(s == RED, STATE_CODES[RED]).when(s == GREEN, STATE_CODES[GREEN])
            .otherwise(STATE_CODES[AMBER]))


def state_name(code: Column | str) -> Column:
    """Code to name; no prediction (negative) and unknown codes give an en dash."""
    c = _col(code)
    names = [F.when(c == n, s) for s, n in STATE_CODES.items()]
    return F.coalesce(*names, F.lit("–"))


def state_label(state: Column | str) -> Column:
    """Machine-specific wording; needs state_red, state_amber, state_green columns."""
    s = _col(state)
    return (F.when(s == RED, F.col("state_red")).when(s == AMBER, F.col("state_amber"))
            .when(s == GREEN, F.col("state_green")).otherwise(s))


def is_running(state: Column | str) -> Column:
    return F.when(_col(state) == GREEN, 1.0).otherwise(0.0)


def job_names(count: int, extra: str) -> list[str]:
    """Names of ``count`` job clusters in load order; from the fourth on, lettered."""
    # Wording of the job names.
    if count == 1:
        return ["Standard"]
    if count == 2:
        return ["Light Load", "Heavy Load"]
    lettered = [f"{extra} {chr(ord('A') + i)}" for i in range(count)]
    return (["Light Load", "Medium Load", "Heavy Load"] + lettered)[:count]


def job_name_table(spark: SparkSession, up_to: int = 6) -> DataFrame:
    rows = [(extra, k, i, name)
            for extra in ("Job", "Mode") for k in range(1, up_to + 1)
            for i, name in enumerate(job_names(k, extra))]
    return spark.createDataFrame(rows, "extra_job_name string, job_types int, job_type int, job_name string")


def job_name(job: Column | str, count: int, extra: str) -> Column:
    j = _col(job)
    named = [F.when(j == i, n) for i, n in enumerate(job_names(count, extra))]
    return F.coalesce(*named, F.lit("–"))


def timeline_label(ts: Column | str) -> Column:
    return F.date_format(ts, "MMM dd  HH:mm:ss")


def clock_label(ts: Column | str) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def phase_spread(a: str, b: str, c: str, floor: float = 0.01) -> Column:
    """Population standard deviation over mean of three values; 0 below the floor."""
    mean = f"(({a} + {b} + {c}) / 3D)"
    square = " + ".join(f"({v} - {mean}) * ({v} - {mean})" for v in (a, b, c))
    return F.expr(f"case when {mean} > {floor}D then sqrt(({square}) / 3D) / {mean} else 0D end")
