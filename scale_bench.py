"""Larger logs than the test tables hold: replicated machines and one very long log.

    python scale_bench.py [sf_dir] [million_rows]

A third of all rows belongs to one machine.  Prints one JSON line with seconds and rows/s.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from loadline.operators import lookback
from loadline.operators.classify import sample_states, state_share
from loadline.operators.session_stats import machine_stats
from loadline.plans import state_analysis as analysis
from loadline.plans.blocks import block_number, block_rows
from loadline.plans.labelling import Labelling
from loadline.plans.staging import remove_staged, stage
from loadline.session import build_session
from loadline.sources import events


def long_logs(spark, sf_dir, rows):
    base = events.readings(spark, sf_dir)
    per_machine = base.filter("machine = 'furnace'").count()
    hot, rest = max(1, rows // 3 // per_machine), max(1, rows * 2 // 3 // (4 * per_machine))
    copies = base.filter("machine = 'furnace'").crossJoin(spark.range(hot).withColumnRenamed("id", "copy"))
    shift = F.col("copy") * per_machine
    one = copies.withColumns({
        "machine": F.lit("furnace_hot"), "row_idx": F.col("row_idx") + shift,
        "timestamp": F.timestamp_micros(F.unix_micros("timestamp") + shift * 1_000_000)}).drop("copy")
    many = base.crossJoin(spark.range(rest).withColumnRenamed("id", "copy")).withColumn(
        "machine", F.concat_ws("_", "machine", "copy")).drop("copy")
    both = one.unionByName(many)
    return stage(both.repartition(64, "machine", block_number("row_idx", block_rows(both)))
                 .sortWithinPartitions("machine", "row_idx"), "long-logs")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    rows = int(float(sys.argv[2]) * 1e6) if len(sys.argv) > 2 else 10_000_000
    spark = build_session(os.environ.get("BENCH_CPUS", "8"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    readings = long_logs(spark, sf_dir, rows)
    total = readings.count()
    stats = machine_stats(readings)
    longest = stats.agg(F.max("n")).first()[0]
    lab = Labelling(readings)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    work = {
        "state_share": lambda: noop(state_share(sample_states(readings))),
        "machine_stats": lambda: noop(machine_stats(readings)),
        "time_features": lambda: noop(analysis.time_features(readings)),
        "window_analysis": lambda: noop(analysis.analyse(readings)),
        "smoothed_runs": lambda: noop(lab.runs),
        "cycle_features": lambda: noop(lab.features),
        "labelled_samples": lambda: noop(lab.samples),
        "lookback": lambda: noop(lookback.lookback(readings, ["machine"])),
    }
    seconds = {}
    for name, run in work.items():
        start = time.time()
        run()
        seconds[name] = round(time.time() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"rows": total, "longest_log": longest, "machines": stats.count(), "seconds": seconds,
                      "rows_per_sec": {n: int(total / s) for n, s in seconds.items()}}))
    remove_staged(spark)


if __name__ == "__main__":
    main()
