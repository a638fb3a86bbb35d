"""Retention tiers, legal holds and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_policy(hot_days: int, warm_days: int, cold_months: int) -> None:
    if hot_days <= 0:
        raise ValueError("hot_days must be positive")
    if warm_days < 0 or cold_months < 0:
        raise ValueError("tier durations cannot be negative")
    if warm_days > 0 and cold_months > 0 and hot_days + warm_days > cold_months * 30:
        raise ValueError("the cold window ends before the warm one")


def tier(age_days: Column, hot_days: int, warm_days: int, cold_months: int) -> Column:
    return F.when(age_days < hot_days, "hot").when(age_days < hot_days + warm_days, "warm").when(age_days < cold_months * 30, "cold").otherwise("expired")


def held_by(parts: DataFrame, holds: DataFrame, day: str = "day") -> DataFrame:
    """parts with ``hold_id`` of the first open hold of the tenant whose range, open where NULL, covers the day.

    Holds are few, but their number is not taken for granted: the join is on the tenant, and the
    planner broadcasts the holds only where it knows that they are small.
    """
    h = holds.where("released_at is null").select(F.col("tenant").alias("_t"), "hold_id", "from_day", "to_day")
    covers = (F.col("tenant") == F.col("_t")) & (F.col("from_day").isNull() | (F.col(day) >= F.col("from_day"))) & (F.col("to_day").isNull() | (F.col(day) <= F.col("to_day")))
    first = parts.select("tenant", day).distinct().join(h, covers).groupBy("tenant", day).agg(F.min("hold_id").alias("hold_id"))
    return parts.join(first, ["tenant", day], "left")


def expire(parts: DataFrame, holds: DataFrame, day: str = "day") -> DataFrame:
    """The expired parts that no hold keeps."""
    return held_by(parts, holds, day).where("tier = 'expired' and hold_id is null").drop("hold_id")


def raw_expiry(raw: DataFrame, tenants: DataFrame, now_us: int) -> DataFrame:
    """The raw records past their tenant's retention (raw_retention_days, 7 where unset)."""
    days = F.coalesce("raw_retention_days", F.lit(7))
    return raw.join(tenants.select("tenant", "raw_retention_days"), "tenant").where(F.col("received_us") < now_us - days * 86_400_000_000)
