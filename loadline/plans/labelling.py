"""From readings to labelled samples, cycles and job types."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.operators.cycles import (
    cycle_samples, cycle_summary, green_cycle_features, labelled_samples, run_cycle_features)
from loadline.operators.jobs import job_clusters
from loadline.operators.labels import cycle_table, label_intervals, label_runs, smooth
from loadline.operators.session_stats import machine_stats
from loadline.plans.staging import stage
from loadline.profiles import PROFILES


@dataclass
class Labelling:
    """Steps of automatic labelling; each is built when first asked for."""

    readings: DataFrame
    profiles: tuple = PROFILES

    @cached_property
    def stats(self) -> DataFrame:
        return machine_stats(self.readings)

    @cached_property
    def raw_runs(self) -> DataFrame:
        return label_runs(self.readings, self.profiles)

    @cached_property
    def runs(self) -> DataFrame:
        return smooth(self.raw_runs, self.stats, self.profiles)

    @cached_property
    def intervals(self) -> DataFrame:
        return label_intervals(self.runs, self.profiles)

    @cached_property
    def cycles(self) -> DataFrame:
        return cycle_table(self.intervals)

    @cached_property
    def features(self) -> DataFrame:
        """Features of all cycles; those of the other cycle rule are NULL."""
        samples = cycle_samples(self.readings, self.intervals)
        both = green_cycle_features(samples).unionByName(run_cycle_features(samples), allowMissingColumns=True)
        return stage(both, "cycle-features")

    @cached_property
    def jobs(self) -> DataFrame:
        return stage(job_clusters(self.features, self.profiles), "jobs")

    @cached_property
    def samples(self) -> DataFrame:
        """The labelled readings."""
        return labelled_samples(self.readings, self.intervals, self.jobs)

    @cached_property
    def summary(self) -> DataFrame:
        counts = self.intervals.groupBy("machine").agg(*[
            F.sum(F.when(F.col("state_label") == code, F.col("end") - F.col("start") + 1).otherwise(0)).alias(name)
            for code, name in enumerate(("red_samples", "amber_samples", "green_samples"))])
        return cycle_summary(self.stats, self.cycles).join(counts, "machine")
