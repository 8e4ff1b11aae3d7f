"""Automatic sample labels: run smoothing and production cycles, all on run tables.

A run table has one row per stretch of equal labels (machine, run_id, value, start, end,
len); smoothing and cycle detection never touch the samples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.operators.classify import label_states
from loadline.operators.states import run_table, runs_of_flags
from loadline.plans.blocks import BLOCK, carry_scan, dense_number, over_neighbours, sent_to_blocks
from loadline.plans.staging import stage
from loadline.profiles import PROFILES, with_profile

KEYS = ["machine"]
MAX_PASSES = 10
PASSES_PER_WRITE = 3


def label_runs(readings: DataFrame, profiles=PROFILES) -> DataFrame:
    """Runs of the raw sample labels, with the profile's minimum run length and rules."""
    runs = run_table(label_states(readings, profiles), KEYS, "row_idx", "raw_label",
                     name="label-runs")
    return stage(with_profile(runs, "label_min_run", "merge_rule", "cycle_rule", profiles=profiles), "label-runs")


def smooth_simultaneous(runs: DataFrame, passes: int = MAX_PASSES) -> DataFrame:
    """Every short run takes the value of its longer neighbour (left on a tie), all at once.

    Repeated on the re-encoded runs until none is short, at most ``passes`` times.  A lone
    run keeps its value.
    """
    for first in range(0, passes, PASSES_PER_WRITE):
        for _ in range(min(PASSES_PER_WRITE, passes - first)):
            runs = _merge_pass(runs)
        runs = stage(runs, "smooth-pass")
        open_logs = runs.groupBy(*KEYS).agg(
            F.bool_or(F.col("len") < F.col("label_min_run")).alias("_short"), F.max("run_id").alias("_last"))
        if open_logs.filter("_short and _last > 0").isEmpty():
            break
    return runs.select(*KEYS, "run_id", "value", "start", "end", "len")


def _merge_pass(runs: DataFrame) -> DataFrame:
    """One pass; without a short run it changes nothing.

    New values and the places where a run of them starts come from one shuffle: a block also gets the two runs before it
    and the one after it.
    """
    sent, own = sent_to_blocks(runs, "run_id", before=2, after=1)
    w = Window.partitionBy(*KEYS, BLOCK).orderBy("run_id")
    near = sent.withColumns({"_left": F.lag("len").over(w), "_right": F.lead("len").over(w), "_lv": F.lag("value").over(w), "_rv": F.lead("value").over(w)})
    moved = with_exprs(near, value="""case when len >= label_min_run or coalesce(_left, _right) is null then value
                                           when coalesce(_left, 0) >= coalesce(_right, 0) then _lv else _rv end""")
    flagged = moved.withColumn("_new", F.when(F.lag("value").over(w).eqNullSafe(F.col("value")), 0).otherwise(1)).filter(F.col(BLOCK) == own)
    return runs_of_flags(flagged, KEYS, "run_id", "value", "start", "end", "smooth-runs", ["label_min_run"])


def smooth_leftmost(runs: DataFrame, stats: DataFrame) -> DataFrame:
    """The leftmost short run takes its longer neighbour's value, repeated to the fixpoint.

    The fixpoint is found without replaying the merges, from these facts:

    * Left of the leftmost short run everything is long, so a run stays once it is long.
      At the start of a log, short runs merge into the next until ``min_run`` samples are
      reached: the run holding sample ``min_run - 1`` becomes the head and starts at 0.
    * Short runs after a long run ``P`` join ``P``, as a following short run is never
      longer than ``P``.  Long runs of one value separated only by short runs become one.
    * Only the last short run ``c`` before a long run ``Q`` of another value is open.  It
      joins ``Q`` if ``Q`` is longer than what ``P`` has grown to by then, which depends on
      whether ``P`` itself got the short run before it: one bit.  So each boundary maps
      that bit to the next one, either to a constant or to its opposite, and the bit at a
      boundary is the last constant, flipped once per boundary since.
    """
    long_run = "({e} + 1 >= label_min_run and {s} < label_min_run) or ({n} >= label_min_run and {s} >= label_min_run)"

    def neighbours(w):
        return [{f"_p_{c}": F.lag(c).over(w) for c in ("value", "start", "end", "len")}
                | {"_next": F.lead("run_id").over(w)},
                {"_long": F.expr(f"({long_run.format(e='end', s='start', n='len')})"
                                 " or (_next is null and end + 1 < label_min_run)"),
                 "_p_long": F.expr(long_run.format(e="_p_end", s="_p_start", n="_p_len"))}]

    marked = over_neighbours(runs, KEYS, "run_id", neighbours, before=1, after=1)
    scanned = carry_scan(marked, KEYS, "run_id", lasts={"_before": F.expr("case when _p_long then _p_value end")},
                         name="leftmost-values")
    chains = with_exprs(
        scanned.filter("_long and (_before is null or _before <> value)"),
        _at="case when start < label_min_run or (_next is null and end + 1 < label_min_run) then 0L else start end",
        _c_len="case when _before is not null and not _p_long then _p_len end",
        _c_start="case when _before is not null and not _p_long then _p_start end",
        _open="coalesce(_before is not null and not _p_long and _p_value <> _before, false)")
    chains = dense_number(chains, KEYS, "run_id", "_sid")

    def flips(w):
        return [{"_P": F.lag("_at").over(w), "_P_c": F.lag("_c_len").over(w)},
                {"_f0": F.expr("coalesce(_open and _c_start - _P < len, false)"),
                 "_f1": F.expr("coalesce(_open and _c_start - _P + coalesce(_P_c, 0) < len, false)")}]

    bits = over_neighbours(chains, KEYS, "_sid", flips, before=1)
    bits = carry_scan(
        bits, KEYS, "_sid",
        lasts={"_anchor": F.expr("case when _f0 = _f1 then pmod(int(_f0) + _sid, 2) end")},
        name="leftmost-bits")
    moved = with_exprs(bits, start="case when pmod(_anchor + _sid, 2) = 1 then _at - _c_len else _at end")
    ended = over_neighbours(
        moved, KEYS, "_sid", lambda w: [{"_next_start": F.lead("start").over(w)}], before=0, after=1).join(stats.select("machine", "n"), KEYS)
    return (ended.withColumn("end", F.coalesce("_next_start", "n") - 1)
            .select(*KEYS, F.col("_sid").alias("run_id"), "value", "start", "end",
                    (F.col("end") - F.col("start") + 1).alias("len")))


def smooth(runs: DataFrame, stats: DataFrame, profiles=PROFILES) -> DataFrame:
    """Each machine's runs by the merge rule of its profile."""
    rules = {r.merge_rule for r in with_profile(stats, "merge_rule", profiles=profiles).select("merge_rule").distinct().collect()}
    done = []
    if "simultaneous" in rules:
        done.append(smooth_simultaneous(runs.filter("merge_rule = 'simultaneous'")))
    if "leftmost" in rules:
        done.append(smooth_leftmost(runs.filter("merge_rule = 'leftmost'"), stats))
    return reduce(DataFrame.unionByName, done) if done else runs.select(*KEYS, "run_id", "value", "start", "end", "len")


def cycles_between_reds(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Non-RED stretches after a RED run that hold a GREEN run; the last may be open.

    Returns the runs with their ``cycle_key`` and the cycles (machine, cycle_key,
    cycle_start, cycle_end).  Runs outside cycles get distinct negative keys: as NULLs they
    would all meet in one task of the later join.
    """
    red = F.when(F.col("value") == 0, 1).otherwise(0).cast("bigint")
    keyed = carry_scan(runs, KEYS, "run_id", sums={"_reds": red}, name="red-count")
    keyed = keyed.withColumn("cycle_key", F.expr(
        "case when value <> 0 and _reds >= 1 then _reds else -1 - run_id end")).drop("_reds")
    cycles = (keyed.filter("cycle_key >= 0").groupBy(*KEYS, "cycle_key")
              .agg(F.min("start").alias("cycle_start"), F.max("end").alias("cycle_end"),
                   F.bool_or(F.col("value") == 2).alias("_green"))
              .filter("_green").drop("_green"))
    return keyed, cycles


def cycles_of_green_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every GREEN run of at least the minimum length is a cycle."""
    keyed = runs.withColumn(
        "cycle_key", F.expr("case when value = 2 and len >= label_min_run then run_id else -1 - run_id end"))
    cycles = keyed.filter("cycle_key >= 0").select(
        *KEYS, "cycle_key", F.col("start").alias("cycle_start"), F.col("end").alias("cycle_end"))
    return keyed, cycles


def numbered_cycles(cycles: DataFrame) -> DataFrame:
    """Cycles with ``cycle_id`` 0, 1, ... per machine, in order."""
    return dense_number(cycles, KEYS, "cycle_key", "cycle_id")


def label_intervals(smoothed: DataFrame, profiles=PROFILES) -> DataFrame:
    """Smoothed runs with the cycle that holds them, ready to be assigned to samples."""
    runs = with_profile(smoothed, "label_min_run", "cycle_rule", profiles=profiles)
    columns = [*KEYS, "start", "end", F.col("value").alias("state_label"),
               "cycle_id", "cycle_start", "cycle_end", "cycle_rule"]
    found = [detect(runs.filter(F.col("cycle_rule") == rule))
             for rule, detect in (("non_red", cycles_between_reds), ("green_runs", cycles_of_green_runs)) if rule in {p.cycle_rule for p in profiles}]
    keyed, cycles = (reduce(DataFrame.unionByName, part) for part in zip(*[(k.select(*runs.columns, "cycle_key"), c) for k, c in found]))
    return stage(keyed.join(numbered_cycles(cycles), [*KEYS, "cycle_key"], "left").select(*columns), "label-intervals")


def cycle_table(intervals: DataFrame) -> DataFrame:
    return (intervals.filter("cycle_id is not null")
            .groupBy(*KEYS, "cycle_id").agg(
                F.first("cycle_start").alias("start_row"), F.first("cycle_end").alias("end_row"))
            .withColumn("duration_s", F.col("end_row") - F.col("start_row") + 1))
