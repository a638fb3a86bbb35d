"""Baselines of rules that can be merged: count, mean and squared deviation of the block indicator per rule and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baseline_parts(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., rule_id, day, n, mean, m2) of events with rule_id, terminating and event_us; m2 is the sum of squared deviations from the mean."""
    keys = [*(by or []), "rule_id", "day"]
    hit = F.col("terminating").cast("double")
    seen = events.where("rule_id is not null").withColumn("day", F.timestamp_micros("event_us").cast("date"))
    return seen.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("mean"), (F.var_pop(hit) * F.count("*")).alias("m2"))


def merge_baselines(parts: DataFrame, by: list[str] | None = None, keep_day: bool = False) -> DataFrame:
    """parts of disjoint events merged pairwise, in the order of their days: what one pass over all of their events gives.

    keep_day: per day, for storing; else over all days, of which a rule has as many as are kept.
    """
    keys = [*(by or []), "rule_id", *(["day"] if keep_day else [])]
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a, b):
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", "n", "mean", "m2"))), lambda p: F.struct(p["n"].alias("n"), p["mean"].alias("mean"), p["m2"].alias("m2")))
    return parts.groupBy(*keys).agg(F.aggregate(ordered, state, merge).alias("_s")).select(*keys, "_s.n", "_s.mean", "_s.m2")


def last_days(parts: DataFrame, days: int, until: str | None = None) -> DataFrame:
    """The parts of the last days up to ``until`` (or the last one there is): how old days leave a sliding baseline."""
    end = F.lit(until if until else parts.agg(F.max("day")).first()[0]).cast("date")
    return parts.where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days)))


def as_baseline(merged: DataFrame) -> DataFrame:
    """The form of stats.rule_baseline(): observations, mean and the variance of the sample."""
    return merged.withColumn("observations", F.col("n")).withColumn("variance", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).otherwise(0.0)).drop("n", "m2")
