"""Job types: K-means over cycle features, for all machines and all starts in one job.

Cycle features are standardised per machine.  Ten k-means++ starts run side by side: a
step joins the cycles with the small table of centroids (one row per machine and start)
and aggregates sums per cluster, with partial aggregation before the shuffle.  Several steps
make one job; a start that stands still is kept as it is and leaves the next job.  Random
choices are arithmetic in whole numbers, so results depend neither on the partitioning nor on the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.plans.staging import small_table, stage
from loadline.profiles import PROFILES, with_profile

STARTS = 10
MAX_STEPS = 300
STEPS_PER_JOB = 6
TOLERANCE = 1e-4
SEED = 42
GROUP = ["machine", "start_no"]
#: Fixed values of the integer draws: multipliers and a prime modulus.
CYCLE_FACTOR, START_FACTOR, ROUND_FACTOR, PRIME = 7919, 104729, 1299709, 1000003


def feature_vectors(features: DataFrame, profiles=PROFILES) -> DataFrame:
    """machine, cycle_id, ``x``: the profile's feature list, standardised per machine.

    Features of a machine without variance are only centred.
    """
    have = [f for f in features.columns if f not in ("machine", "cycle_id")]
    lookup = F.create_map(*[v for f in have for v in (F.lit(f), F.col(f).cast("double"))])
    raw = with_profile(features, "job_features", "job_types", "cycle_rule", profiles=profiles).withColumn(
        "_all", lookup)
    raw = with_exprs(raw, raw="transform(split(job_features, ','), f -> _all[f])")
    raw = raw.select("machine", "cycle_id", "raw", "job_types", "cycle_rule")
    moments = (raw.select("machine", F.posexplode("raw"))
               .groupBy("machine", "pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"),
                                              F.count(F.lit(1)).alias("n")))
    scale = moments.groupBy("machine").agg(
        F.sort_array(F.collect_list(F.struct("pos", "m", "s"))).alias("_scale"), F.max("n").alias("_n"))
    return stage(with_exprs(
        raw.join(scale, "machine"), x="zip_with(raw, _scale, (v, t) -> (v - t.m) / case when t.s < 1e-12D then 1D else t.s end)",
        k="least(job_types, int(_n))").select("machine", "cycle_id", "x", "k", "cycle_rule"), "job-points")


_DISTANCES = """transform(centroids, c -> aggregate(zip_with(c, x, (a, b) -> (a - b) * (a - b)),
                0D, (t, d) -> t + d))"""


def _uniform(round_no: int) -> str:
    """A number in (0, 1) fixed by start, round and cycle."""
    base = f"pmod(cycle_id * {CYCLE_FACTOR} + start_no * {START_FACTOR} + {round_no * ROUND_FACTOR + SEED}, {PRIME})"
    return f"(pmod({base} * {base} * {base} + start_no * {CYCLE_FACTOR}, {PRIME}) + 1) / {PRIME + 1}D"


def _starts(points: DataFrame) -> DataFrame:
    """k-means++: each next centroid is drawn with weight = squared distance to the nearest.

    The smallest ``-ln(u) / weight`` is such a draw, and a minimum is partially aggregated.
    """
    most = points.agg(F.max("k")).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(STARTS - 1).cast("bigint")))
    centroids = points.select("machine").distinct().withColumn("start_no", starts).withColumn(
        "centroids", F.expr("cast(array() as array<array<double>>)"))
    for round_no in range(most):
        drawn = points.join(centroids, "machine")
        drawn = with_exprs(drawn, _near="case when size(centroids) = 0 then 1D when size(centroids) >= k then 0D else "
                                        f"array_min({_DISTANCES}) end")
        drawn = with_exprs(drawn, _key=f"case when _near > 0 then struct(-ln({_uniform(round_no)}) / _near as a, cycle_id as b) end")
        grown = drawn.groupBy(*GROUP).agg(F.min_by("x", "_key").alias("_new"), F.first("centroids").alias("centroids"))
        centroids = grown.select(*GROUP, F.expr("case when _new is null then centroids else concat(centroids, array(_new)) end").alias("centroids"))
    return centroids


def _assigned(points: DataFrame, centroids: DataFrame) -> DataFrame:
    return points.sparkSession.sql(f"""
        select machine, start_no, cycle_id, cycle_rule, x, array_min(_d) as _dist,
               int(array_position(_d, array_min(_d))) - 1 as cluster
        from (select *, {_DISTANCES} as _d from {{points}} join {{centroids}} using (machine))""",
        points=points, centroids=centroids)


def _step(points: DataFrame, centroids: DataFrame, width: int) -> DataFrame:
    """New centroids, how far they moved, and steps so far.

    A cluster without members stays in place, and so does a start that no longer moves.
    """
    means = ", ".join(f"avg(get(x, {i}))" for i in range(width))
    return points.sparkSession.sql(f"""
        with assigned as (
          select machine, start_no, x, centroids, moved, steps, int(array_position(_d, array_min(_d))) - 1 as cluster
          from (select *, {_DISTANCES} as _d from {{points}} join {{centroids}} using (machine))),
        means as (
          select machine, start_no, cluster, slice(array({means}), 1, first(size(x))) as c,
                 first(centroids) as centroids, first(moved) as moved, first(steps) as steps
          from assigned group by machine, start_no, cluster),
        grouped as (
          select machine, start_no, map_from_entries(collect_list(struct(cluster, c))) as new,
                 first(centroids) as centroids, first(moved) as was, first(steps) as steps
          from means group by machine, start_no),
        next as (
          select *, transform(centroids, (c, i) -> coalesce(new[i], c)) as after from grouped)
        select machine, start_no,
          case when was <= {TOLERANCE}D then centroids else after end as centroids,
          case when was <= {TOLERANCE}D then was else
            aggregate(zip_with(after, centroids, (a, b) -> aggregate(zip_with(a, b, (p, q) -> (p - q) * (p - q)),
                      0D, (t, d) -> t + d)), 0D, (t, d) -> t + d) end as moved,
          case when was <= {TOLERANCE}D then steps else steps + 1 end as steps
        from next""", points=points, centroids=centroids)


def cluster_runs(points: DataFrame, profiles=PROFILES) -> DataFrame:
    """(machine, start_no, centroids, moved, steps) of every start, at the end.

    ``moved`` above ``TOLERANCE`` marks a start that still moved after ``MAX_STEPS`` steps.
    """
    width = max(len(p.job_features.split(",")) for p in profiles)
    active = with_exprs(_starts(points), moved="double('inf')", steps="0")
    done: list[DataFrame] = []
    for first in range(0, MAX_STEPS, STEPS_PER_JOB):
        for _ in range(min(STEPS_PER_JOB, MAX_STEPS - first)):
            active = _step(points, active, width)
        stepped = small_table(active, "centroids")
        done.append(stepped.filter(F.col("moved") <= TOLERANCE))
        active = stepped.filter(F.col("moved") > TOLERANCE)
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, active])


def job_clusters(features: DataFrame, profiles=PROFILES) -> DataFrame:
    """(machine, cycle_id, job_type): clusters of the best start, numbered by load.

    Order key: mean GREEN load for cycles between REDs, mean log duration otherwise.
    """
    points = feature_vectors(features, profiles)
    centroids = cluster_runs(points, profiles)
    cost = _assigned(points, centroids).groupBy(*GROUP).agg(F.sum("_dist").alias("_cost"))
    best = cost.groupBy("machine").agg(F.min_by("start_no", F.struct("_cost", "start_no")).alias("start_no"))
    chosen = _assigned(points, small_table(centroids.join(best, GROUP), "best-start"))
    order_key = F.expr("case when cycle_rule = 'non_red' then x[1] else x[0] end")
    loads = chosen.groupBy("machine", "cluster").agg(F.avg(order_key).alias("_load"))
    by_load = Window.partitionBy("machine").orderBy("_load", "cluster")
    ranks = small_table(loads.select("machine", "cluster", (F.row_number().over(by_load) - 1).alias("job_type")), "job-ranks")
    return chosen.join(ranks, ["machine", "cluster"]).select("machine", "cycle_id", "job_type")
