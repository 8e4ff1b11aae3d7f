"""Look-back windows, time-ordered splits and channel statistics for models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.operators.features import CHANNELS
from loadline.plans.blocks import over_neighbours
from loadline.plans.staging import small_table
from loadline.profiles import PROFILES, profile_of

TRAIN, VALIDATION = 0.70, 0.15


def temporal_split(labelled: DataFrame, stats: DataFrame, train: float = TRAIN, val: float = VALIDATION) -> DataFrame:
    """``split`` by row position: the first 70 %, the next 15 %, the rest."""
    cuts = stats.select("machine", F.floor(F.col("n") * train).alias("_t1"),
                        F.floor(F.col("n") * (train + val)).alias("_t2"))
    return with_exprs(
        labelled.join(cuts, "machine"),
        split="case when row_idx < _t1 then 'train' when row_idx < _t2 then 'val' else 'test' end",
    ).drop("_t1", "_t2")


def split_sizes(stats: DataFrame, train: float = TRAIN, val: float = VALIDATION) -> DataFrame:
    cuts = with_exprs(stats, t1=f"bigint(floor(n * {train!r}D))", t2=f"bigint(floor(n * {train + val!r}D))")
    return cuts.select("machine", F.expr("stack(3, 'train', t1, 'val', t2 - t1, 'test', n - t2) as (split, rows)"))


def last_rows(labelled: DataFrame, stats: DataFrame) -> DataFrame:
    """The last 15 % of every log."""
    return temporal_split(labelled, stats).filter("split = 'test'").drop("split")


def norm_stats(rows: DataFrame) -> DataFrame:
    """Mean and population std of every channel per machine (give it the train split)."""
    return small_table(rows.groupBy("machine").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in CHANNELS],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in CHANNELS]), "norm-stats")


def normalised(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Channels replaced by (x - mean) / std; a std below 1e-8 counts as 1."""
    out = rows.join(stats, "machine")
    out = with_exprs(out, **{
        c: f"({c} - mean_{c}) / case when std_{c} < 1e-8D then 1D else std_{c} end" for c in CHANNELS})
    return out.drop(*[f"{p}_{c}" for p in ("mean", "std") for c in CHANNELS])


def _by_shape(profiles) -> dict[tuple[int, str], list[str]]:
    shapes: dict[tuple[int, str], list[str]] = {}
    for p in profiles:
        shapes.setdefault((p.look_back, p.model_channels), []).append(p.profile)
    return shapes


def lookback(rows: DataFrame, keys: list[str], profiles=PROFILES, look_back: int | None = None) -> DataFrame:
    """``x``: the last L rows of the profile's channels (oldest first), one array per row.

    Rows without L rows before them (inside the same key) are left out.  The sliding frame
    runs inside blocks; only L - 1 rows per block edge are sent twice.
    """
    parts = []
    for (default, channels), names in _by_shape(profiles).items():
        length = look_back or default
        names_of = channels.split(",")
        blank = F.array(*[F.lit(0.0) for _ in names_of])
        mine = rows.filter(profile_of().isin(names)).withColumn("_s", F.array(*names_of))

        # A frame that is not full is padded as well as filtered out, so that a model
        # never meets a vector of another size, in whatever order Catalyst puts filters.
        def frames(w, length=length, blank=blank):
            frame = w.rowsBetween(-(length - 1), 0)
            return [{"_have": F.count("_s").over(frame), "x": F.collect_list("_s").over(frame)},
                    {"x": F.concat(F.array_repeat(blank, F.lit(length) - F.size("x")), F.col("x"))}]

        found = over_neighbours(mine, keys, "row_idx", frames, before=length - 1)
        parts.append(found.filter(F.col("_have") == length).drop("_s", "_have"))
    return reduce(DataFrame.unionByName, parts)


def lookback_moments(rows: DataFrame, keys: list[str], profiles=PROFILES, look_back: int | None = None) -> DataFrame:
    """``look_mean`` and ``look_power``: mean and mean square of each channel over the last L rows.

    Differences of prefix sums inside blocks, so a row costs the same whatever L is and no array is built.  Rows
    without L rows before them are left out.
    """
    parts = []
    for (default, channels), names in _by_shape(profiles).items():
        length = look_back or default
        names_of = channels.split(",")
        mine = rows.filter(profile_of().isin(names))

        def sums(w, length=length, names_of=names_of):
            upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            running = {f"_{k}_{c}": F.sum(v).over(upto) for c in names_of for k, v in (("s", F.col(c)), ("q", F.col(c) * F.col(c)))}
            first = F.col("_n") == length
            before = {f"_b{x}": F.when(first, F.lit(0.0)).otherwise(F.lag(x, length).over(w)) for x in running}
            return [running | {"_n": F.count(F.lit(1)).over(upto)}, before]

        found = over_neighbours(mine, keys, "row_idx", sums, before=length).filter(F.col("_n") >= length)
        arrays = {out: F.array(*[(F.col(f"_{k}_{c}") - F.col(f"_b_{k}_{c}")) / length for c in names_of])
                  for out, k in (("look_mean", "s"), ("look_power", "q"))}
        parts.append(found.withColumns(arrays).drop("_n", *[f"{p}_{k}_{c}" for p in ("", "_b") for k in "sq" for c in names_of]))
    return reduce(DataFrame.unionByName, parts)


def short_logs(stats: DataFrame, profiles=PROFILES, look_back: int | None = None) -> DataFrame:
    """(machine, split, rows, look_back): splits with fewer rows than the look-back; their machine trains no model."""
    lengths = {p.profile: look_back or p.look_back for p in profiles}
    needed = F.create_map(*[F.lit(v) for pair in lengths.items() for v in pair])[profile_of()]
    return split_sizes(stats).withColumn("look_back", needed).filter(F.col("rows") < F.col("look_back"))


def training_rows(labelled: DataFrame, stats: DataFrame, profiles=PROFILES, look_back: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, statistics, left out): normalised labelled rows with their split, statistics of the train rows.

    Machines with a split shorter than the look-back are left out and listed; all others go on.  Raises if none is left.
    """
    short = small_table(short_logs(stats, profiles, look_back), "short-logs")
    if stats.join(short, "machine", "left_anti").isEmpty() and (first := short.orderBy("machine", "split").first()):
        raise ValueError(f"{first.machine}: {first.split} has {first.rows} rows, fewer than the look-back, and no other machine is longer")
    split = temporal_split(labelled, stats).join(short.select("machine").distinct(), "machine", "left_anti")
    means = norm_stats(split.filter("split = 'train'"))
    return normalised(split, means), means, short


def training_sets(labelled: DataFrame, stats: DataFrame, profiles=PROFILES, look_back: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Look-back samples of all splits as arrays, and the train channel statistics.

    Windows never cross a split.  Machines with a split shorter than the look-back are left out (``short_logs``); raises
    if none is left.
    """
    rows, means, _ = training_rows(labelled, stats, profiles, look_back)
    samples = lookback(rows, ["machine", "split"], profiles, look_back)
    targets = samples.select(
        "machine", "split", "row_idx", "x", F.col("state_label").alias("state"),
        F.coalesce("cycle_pos", F.lit(-1.0)).alias("cycle_pos"), "job_type")
    return targets, means
