"""Sequences of states: runs, hysteresis, transitions, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadline.plans.blocks import BLOCK, carry_scan, over_neighbours, previous
from loadline.plans.staging import stage

MIN_CONSECUTIVE = 3


def run_table(df: DataFrame, keys: list[str], order: str, value: str,
              low: str | None = None, high: str | None = None, name: str = "runs", carried: list[str] | None = None) -> DataFrame:
    """Run-length encoding: keys, run_id (0, 1, ...), value, start, end, len.

    Runs inside a block come from one shuffle by block; only the pieces at block edges
    are merged afterwards, on the (small) table of pieces.  ``low`` / ``high`` are the
    first and last position a row stands for when ``df`` is itself a run table; ``carried``
    are columns constant per key.
    """
    flagged = over_neighbours(
        df, keys, order,
        lambda w: [{"_new": F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)}],
        keep_block=True)
    return runs_of_flags(flagged, keys, order, value, low or order, high or order, name, carried or [])


def runs_of_flags(flagged: DataFrame, keys: list[str], order: str, value: str, low: str, high: str, name: str, carried: list[str]) -> DataFrame:
    """Runs from rows with their block and ``_new``, 1 where a run starts."""
    constant = [F.first(c).alias(c) for c in carried]
    upto = (Window.partitionBy(*keys, BLOCK).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = (flagged.withColumn("_seq", F.sum("_new").over(upto)).groupBy(*keys, BLOCK, "_seq")
              .agg(F.min(low).alias("start"), F.max(high).alias("end"), F.first(value).alias("value"),
                   *constant))
    pieces = stage(pieces, name)
    earlier = (Window.partitionBy(*keys).orderBy(BLOCK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = (pieces.groupBy(*keys, BLOCK).agg(F.max("_seq").alias("_n"))
             .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    return (pieces.join(carry, [*keys, BLOCK])
            .withColumn("run_id", F.col("_before") + F.col("_seq") - 1)
            .groupBy(*keys, "run_id")
            .agg(F.first("value").alias("value"), F.min("start").alias("start"), F.max("end").alias("end"),
                 *constant)
            .withColumn("len", F.col("end") - F.col("start") + 1))


def hysteresis(df: DataFrame, keys: list[str], order: str = "window_index", state: str = "state",
               min_consecutive: int = MIN_CONSECUTIVE, initial: str | None = None,
               out: str = "smoothed_state") -> DataFrame:
    """Accept a state once it was raw ``min_consecutive`` times in a row.

    Starts from the first raw state, or from ``initial`` if given.  Whether a state is
    accepted at a position needs only the few states before it; the accepted state is
    then carried forward.
    """
    n = max(1, min_consecutive)

    def streak(w):
        recent = w.rowsBetween(-(n - 1), 0)
        full = (F.count(state).over(recent) == n) & (F.min(state).over(recent) == F.max(state).over(recent))
        return [{"_accepted": F.when(full, F.col(state))}]

    marked = over_neighbours(df, keys, order, streak, before=n - 1)
    first = F.when(F.col(order) == 0, F.lit(initial) if initial else F.col(state))
    return carry_scan(
        marked.withColumn("_accepted", F.coalesce("_accepted", first)), keys, order,
        lasts={out: F.col("_accepted")}, name="hysteresis").drop("_accepted")


def transitions(smoothed: DataFrame, keys: list[str], order: str = "window_index",
                state: str = "smoothed_state", initial: Column | None = None) -> DataFrame:
    """Positions where the confirmed state changes (from ``initial`` at the start, if given)."""
    prev = previous(smoothed, keys, order, _prev=state)
    before = F.coalesce("_prev", initial) if initial is not None else F.col("_prev")
    return prev.filter(before != F.col(state)).select(
        *keys, order, F.col(state).alias("state"), "confidence")


def segments(smoothed: DataFrame, keys: list[str], order: str = "window_index",
             state: str = "smoothed_state", centre: str = "centre_time") -> DataFrame:
    """Compact timeline: state with first and last window centre of each segment."""
    timed = smoothed.withColumn("_ms", F.unix_millis(centre))
    runs = run_table(timed, keys, order, state, low="_ms", high="_ms", name="segments")
    return runs.select(
        *keys, F.col("run_id").cast("int").alias("segment_id"), F.col("value").alias("state"),
        F.timestamp_millis("start").alias("start_time"), F.timestamp_millis("end").alias("end_time"))
