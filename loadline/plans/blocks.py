"""Ordered operators that never put one machine's whole log into one task.

A log is ordered by a dense number per key (``row_idx``, ``run_id``, ``window_index``:
0, 1, 2, ...).  The number divided by the block size gives a block; ``(keys, block)`` is
the shuffle key, so a task holds at most one block however long a single log is.  What a
plain ``Window.partitionBy(machine).orderBy(row_idx)`` would do is split in three kinds:

* ``over_neighbours``: bounded look-back / look-ahead.  The few rows next to a block edge
  are also sent to the adjacent block, so one shuffle is enough.
* ``carry_scan``: running sums and fill-forward over the whole log.  Each block is
  scanned alone and written; one total per block is accumulated and joined back.
* ``assign_intervals``: which interval holds this row.  Interval starts are merged into
  the ordered block and filled forward.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loadline.plans.staging import stage

BLOCK_ROWS_KEY = "spark.loadline.blockRows"
DEFAULT_BLOCK_ROWS = 1 << 17
BLOCK = "_block"


def block_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BLOCK_ROWS_KEY, str(DEFAULT_BLOCK_ROWS)))


def block_number(order: str, rows: int) -> Column:
    return F.expr(f"`{order}` div {rows}")


def sent_to_blocks(df: DataFrame, order: str, before: int = 0, after: int = 0) -> tuple[DataFrame, Column]:
    """Rows with the block they are sent to, and the block they belong to.

    The last ``before`` rows of a block also go to the next one, the first ``after`` rows to the one before.
    """
    rows = block_rows(df)
    if max(before, after) >= rows:
        raise ValueError(f"looking {max(before, after)} rows away needs larger blocks than {rows}")
    own = block_number(order, rows)
    in_block = F.pmod(F.col(order), F.lit(rows))
    ends = in_block >= rows - before if before else F.lit(False)
    starts = (in_block < after) & (own > 0) if after else F.lit(False)
    targets = (F.when(ends & starts, F.array(own, own + 1, own - 1))
               .when(ends, F.array(own, own + 1)).when(starts, F.array(own, own - 1))
               .otherwise(F.array(own)))
    return df.withColumn(BLOCK, F.explode(targets) if before or after else own), own


def over_neighbours(
    df: DataFrame, keys: list[str], order: str,
    columns: Callable[[WindowSpec], list[dict[str, Column]]],
    before: int = 1, after: int = 0, keep_block: bool = False,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead.

    ``columns`` gets the ordered window and returns one or more dicts of new columns,
    applied in turn.  With ``keep_block`` the block column stays, and the result is still
    hash partitioned by ``(keys, block)``.
    """
    out, own = sent_to_blocks(df, order, before, after)
    window = Window.partitionBy(*keys, BLOCK).orderBy(order)
    for step in columns(window):
        out = out.withColumns(step)
    out = out.filter(F.col(BLOCK) == own)
    return out if keep_block else out.drop(BLOCK)


def previous(df: DataFrame, keys: list[str], order: str,
             **names: str) -> DataFrame:
    """``previous(df, ["machine"], "row_idx", prev="value")``: lag by one row."""
    return over_neighbours(
        df, keys, order, lambda w: [{new: F.lag(old).over(w) for new, old in names.items()}])


def carry_scan(
    df: DataFrame, keys: list[str], order: str,
    sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
    name: str = "scan",
) -> DataFrame:
    """Running (inclusive) sums of non-negative columns and last non-null values so far.

    One shuffle by ``(keys, block)`` and one write.  The carry into a block is computed
    from one row per block (1 / block size of the data) and joined back.
    """
    sums, lasts = sums or {}, lasts or {}
    rows = block_rows(df)
    upto = (Window.partitionBy(*keys, BLOCK).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    scanned = ({out: F.sum(c).over(upto) for out, c in sums.items()}
               | {out: F.last(c, ignorenulls=True).over(upto) for out, c in lasts.items()})
    local = stage(df.withColumn(BLOCK, block_number(order, rows)).withColumns(scanned), name)
    totals = local.groupBy(*keys, BLOCK).agg(
        *[F.max(out).alias(out) for out in sums],
        *[F.max_by(out, order).alias(out) for out in lasts])
    earlier = (Window.partitionBy(*keys).orderBy(BLOCK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(
        *keys, BLOCK,
        *[F.sum(out).over(earlier).alias(f"_carry_{out}") for out in sums],
        *[F.last(out, ignorenulls=True).over(earlier).alias(f"_carry_{out}") for out in lasts])
    joined = local.join(carry, [*keys, BLOCK])
    joined = joined.withColumns(
        {out: F.col(out) + F.coalesce(f"_carry_{out}", F.lit(0)) for out in sums}
        | {out: F.coalesce(out, f"_carry_{out}") for out in lasts})
    return joined.drop(BLOCK, *[f"_carry_{out}" for out in [*sums, *lasts]])


def dense_number(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Number rows 0, 1, 2, ... per key by a sparse, unique, non-negative ``order``."""
    numbered = carry_scan(df, keys, order, sums={out: F.lit(1).cast("bigint")},
                          name=f"number-{out}")
    return numbered.withColumn(out, F.col(out) - 1)


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "row_idx") -> DataFrame:
    """Number rows 0, 1, 2, ... per key by any sortable columns that make a row unique.

    A range partitioned sort splits by ``(keys, order)``, so neither a hot key nor dense
    times can fill one task.  The sorted table is written; positions inside a written
    partition plus the counts of the partitions before it give the number.
    """
    n, base, part, pos = "_n", "_base", "_part", "_pos"
    ordered = stage(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(pos, F.monotonically_increasing_id()),
        "ordered")
    counts = ordered.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n), F.min(pos).alias(base))
    earlier = (Window.partitionBy(*keys).orderBy(part)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, part, (F.coalesce(F.sum(n).over(earlier), F.lit(0)) - F.col(base)).alias(base))
    return (ordered.join(offsets, [*keys, part])
            .withColumn(out, F.col(pos) + F.col(base)).drop(part, pos, base))


def ranged_counts(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A written table of counts per key and value, sorted by ranges, which split hot keys."""
    return stage(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "counts")


def median_of_counts(ranged: DataFrame, keys: list[str], value: str, count: str, out: str) -> DataFrame:
    """Median of ``value`` per key from ``ranged_counts``: no task holds the values of a key.

    Counts before a value, inside its range and of earlier ranges, tell which values hold the middle ranks.  NULLs do not
    count; a key without values is absent.
    """
    some = ranged.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(count).alias("_n"), "_part")
    parts = some.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    line = Window.partitionBy(*keys).orderBy("_part")
    base = parts.select(*keys, "_part", F.coalesce(F.sum("_in").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                        F.sum("_in").over(Window.partitionBy(*keys)).alias("_all"))
    upto = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = some.withColumn("_to", F.sum("_n").over(upto)).join(base, [*keys, "_part"]).withColumn("_to", F.col("_to") + F.col("_base"))
    holds = [F.expr(f"case when _to - _n <= ({rank}) and ({rank}) < _to then double(_v) else 0D end") for rank in ("(_all - 1) div 2", "_all div 2")]
    return ranked.groupBy(*keys).agg((F.sum(holds[0] + holds[1]) / 2).alias(out))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    return median_of_counts(ranged_counts(counted, keys, value), keys, value, "_count", out)


def assign_intervals(
    rows: DataFrame, intervals: DataFrame, keys: list[str], order: str,
    start: str, end: str, attributes: list[str],
) -> DataFrame:
    """Attach ``attributes`` of the interval ``[start, end]`` that holds each row.

    Intervals of one key do not overlap.  Each is sent to every block it touches (clipped
    to the block), merged with the rows in order and filled forward, so there is one
    shuffle of the rows, no carry between blocks and no range join.  Rows outside every
    interval get NULLs.
    """
    size = block_rows(rows)
    payload = [c for c in rows.columns if c not in keys]
    touched = F.explode(F.sequence(block_number(start, size), block_number(end, size)))
    held = F.struct(F.col(end).alias("_end"), *attributes)
    marks = intervals.select(*keys, touched.alias(BLOCK), F.col(start).alias("_start"), held.alias("_held"))
    marks = marks.select(
        *keys, BLOCK, F.greatest("_start", F.col(BLOCK) * size).alias("_at"),
        F.lit(0).alias("_kind"), "_held")
    samples = rows.select(
        *keys, block_number(order, size).alias(BLOCK), F.col(order).alias("_at"),
        F.lit(1).alias("_kind"), F.struct(*payload).alias("_row"))
    merged = marks.unionByName(samples, allowMissingColumns=True)
    upto = (Window.partitionBy(*keys, BLOCK).orderBy("_at", "_kind")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = merged.withColumn("_held", F.last("_held", ignorenulls=True).over(upto))
    inside = F.col("_at") <= F.col("_held._end")
    return filled.filter("_kind = 1").select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in payload],
        *[F.when(inside, F.col(f"_held.{a}")).alias(a) for a in attributes])
