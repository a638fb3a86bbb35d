"""Dashboard aggregates, baselines and correlation quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKED = ("blocked", "challenge_failed")
RANGES_US = {"15m": 900_000_000, "1h": 3_600_000_000, "24h": 86_400_000_000}
BASELINE_MIN, BASELINE_FACTOR, ZERO_BASELINE_RATE = 100, 3.0, 0.01
QUALITY_MIN = 100


def dashboard_range(preset: str | None = None) -> int:
    """Microseconds of a dashboard's range; an hour where the preset is unknown."""
    return RANGES_US.get(preset or "", RANGES_US["1h"])


def within_range(flows: DataFrame, preset: str | None, now_us: int) -> DataFrame:
    return flows.where(F.col("first_us").between(now_us - dashboard_range(preset), now_us))


def counts_by(flows: DataFrame, field: str) -> DataFrame:
    return flows.groupBy(F.coalesce(F.col(field), F.lit("")).alias(field)).agg(F.count("*").alias("n"))


def filter_count(flows: DataFrame, condition: Column) -> DataFrame:
    return flows.where(condition).agg(F.count("*").alias("n"))


def top_sources(flows: DataFrame, k: int = 10) -> DataFrame:
    agg = flows.where("client_ip is not null").groupBy("client_ip").agg(F.count("*").alias("events"), F.count_if(F.col("effective_outcome") == "blocked").alias("blocked"), F.max("country").alias("country"), F.max("asn").alias("asn"))
    return agg.orderBy(F.col("events").desc(), "client_ip").limit(k)


def top_networks(flows: DataFrame, k: int = 10) -> DataFrame:
    agg = flows.where("asn > 0").groupBy("asn").agg(F.count("*").alias("events"), F.count_if(F.col("effective_outcome") == "blocked").alias("blocked"), F.countDistinct("client_ip").alias("sources"), F.max("country").alias("country"))
    return agg.orderBy(F.col("events").desc(), "asn").limit(k)


def provider_event_counts(flows: DataFrame) -> DataFrame:
    return flows.select(F.explode("events").alias("e")).groupBy(F.col("e.provider").alias("provider")).agg(F.count("*").alias("n"))


def dashboard(flows: DataFrame) -> DataFrame:
    """One row: totals, and the share that was joined by identifiers (1 when there are no flows)."""
    total, loose = F.count("*"), F.count_if(F.col("correlation_method") == "heuristic")
    return flows.agg(
        total.alias("total"), F.count_if("bridged").alias("bridged"), loose.alias("heuristic"), F.count_if(F.col("completeness") == "complete").alias("complete"), F.count_if(F.col("effective_outcome") == "blocked").alias("blocked"),
        F.when(total == 0, 1.0).otherwise((total - loose) / total).alias("exact_join_ratio"), F.round(F.when(total == 0, 0.0).otherwise(100.0 * F.count_if(F.col("effective_outcome") == "blocked") / total), 4).alias("block_rate_pct"),
    )


def outcome_breakdown(flows: DataFrame) -> DataFrame:
    """(dimension, value, n) for outcome, completeness and terminating layer in one pass."""
    names = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in ("effective_outcome", "completeness", "terminating_layer")])
    rows = flows.select(F.explode(names).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    return rows.where("not (dimension = 'terminating_layer' and value = '')")


def daily_rows(events: DataFrame, at: str = "ts") -> DataFrame:
    return events.groupBy(F.date_trunc("day", F.col(at)).cast("date").alias("day")).agg(F.count("*").alias("n"))


def whole_day_rate(events: DataFrame, at: str = "ts") -> DataFrame:
    """(days, rows_per_day): the mean over the last eight days without the partial one at the end."""
    days = daily_rows(events, at).withColumn("today", F.max("day").over(Window.partitionBy()))
    whole = days.where((F.col("day") < F.col("today")) & (F.col("day") >= F.date_sub("today", 8)))
    return whole.agg(F.count("*").alias("days"), F.avg("n").alias("rows_per_day"))


def storage_forecast(rate: DataFrame, bytes_per_row: float, free_bytes: int) -> DataFrame:
    per_day = F.coalesce(F.col("rows_per_day"), F.lit(0.0)) * bytes_per_row
    return rate.select("days", F.round(per_day, 3).alias("bytes_per_day"), F.when(per_day > 0, F.round(free_bytes / per_day, 3)).alias("days_left"), (per_day <= 0).alias("steady"))


def rule_baseline(events: DataFrame) -> DataFrame:
    """(rule_id, observations, mean, variance) of the block indicator; the variance is of the sample."""
    hit = F.col("terminating").cast("double")
    return events.where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("observations"), F.avg(hit).alias("mean"), F.coalesce(F.var_samp(hit), F.lit(0.0)).alias("variance"))


def rule_deviation(baseline: DataFrame, recent: DataFrame) -> DataFrame:
    """Recent block rates against a baseline of enough observations; an all-zero baseline fires above one per cent."""
    b, r = baseline.select("rule_id", "observations", "mean"), recent.select("rule_id", F.col("mean").alias("recent"))
    enough = F.col("observations") >= BASELINE_MIN
    factor = F.when(F.col("mean") > 0, F.col("recent") / F.col("mean")).when(F.col("recent") > ZERO_BASELINE_RATE, F.lit(float("inf"))).otherwise(0.0)
    return b.join(r, "rule_id").select("rule_id", "observations", "mean", "recent", factor.alias("factor"), (enough & (factor >= BASELINE_FACTOR)).alias("deviates"))


def correlation_quality(flows: DataFrame) -> DataFrame:
    total = F.count("*")
    share = lambda c: F.round(F.when(total == 0, 0.0).otherwise(F.count_if(c) / total), 6)
    return flows.agg(total.alias("total"), share(F.col("correlation_method") == "exact").alias("exact"), share(F.col("correlation_method") == "heuristic").alias("heuristic"), share(F.col("completeness") == "ambiguous").alias("ambiguous"), share(F.size("providers") > 1).alias("multi_provider"), (total >= QUALITY_MIN).alias("meaningful"))


def shares(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n, share): counts with their share inside by."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6))


def used_percent(metrics: DataFrame) -> DataFrame:
    """The share of storage in use, of data and free space; NULL where there is neither."""
    whole = F.col("data_bytes") + F.col("free_bytes")
    return metrics.withColumn("used_pct", F.when(whole > 0, F.round(100.0 * F.col("data_bytes") / whole, 4)))


def scrape_metrics(lines: DataFrame) -> DataFrame:
    """(data_bytes, free_bytes) from a metrics page: the sum of the sizes, the last free space."""
    value = F.regexp_extract("value", r"\s([0-9.eE+-]+)\s*$", 1).try_cast("double")
    return lines.withColumn("v", value).agg(F.sum(F.when(F.col("value").startswith("vl_data_size_bytes"), F.col("v"))).alias("data_bytes"), F.max_by(F.when(F.col("value").startswith("vl_free_disk_space_bytes"), F.col("v")), F.when(F.col("value").startswith("vl_free_disk_space_bytes"), F.col("line_no"))).alias("free_bytes"))
