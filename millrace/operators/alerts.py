"""Detections, alerts, suppression and health."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.identifiers import joined_id
from millrace.operators.search import scoped

SUPPRESS_US = 900_000_000
BACKLOG = 100_000
# Severities, worst first.
SEVERITIES = ("critical", "high", "medium", "low", "info")


@dataclass(frozen=True)
class Detection:
    """A named predicate, as a SQL expression over a subject row, with a row that must fire and one that must not."""

    id: str
    kind: str
    severity: str
    condition: str
    fires: dict
    near_miss: dict
    version: str = "1"


BUILTIN = (
    Detection("source_silence", "source", "high", "health = 'silent'", {"health": "silent"}, {"health": "awaiting"}),
    Detection("zero_output", "stage", "critical", "inputs > 0 and outputs = 0", {"inputs": 5, "outputs": 0}, {"inputs": 0, "outputs": 0}),
    Detection("parse_failure", "source", "high", "records > 0 and failures / records > 0.01", {"records": 1000, "failures": 11}, {"records": 1000, "failures": 10}),
    Detection("exact_ratio", "flow", "medium", "total >= 100 and exact < 0.80", {"total": 100, "exact": 0.79}, {"total": 99, "exact": 0.5}),
)


def validate(spark, detection: Detection) -> None:
    """Raise unless the detection fires on its positive row and not on the near miss."""
    for row, wanted in ((detection.fires, True), (detection.near_miss, False)):
        if bool(spark.createDataFrame([row]).where(detection.condition).count()) != wanted:
            raise ValueError(f"detection {detection.id}: {'does not fire' if wanted else 'fires on the near miss'}")


def evaluate(subjects: DataFrame, detection: Detection, id_column: str, at: str = "at_us") -> DataFrame:
    """Alert rows (alert_id, detection_id, severity, tenant, subject, grouping_key, at_us) where the condition holds."""
    hit = subjects.where(detection.condition)
    key = joined_id("grp_", F.lit(detection.id), F.lit(detection.version), F.col("tenant"), F.lit(detection.kind), F.col(id_column).cast("string"))
    return hit.select(joined_id("al_", F.lit(detection.id), F.col("tenant"), F.col(id_column).cast("string"), F.col(at).cast("string")).alias("alert_id"), F.lit(detection.id).alias("detection_id"), F.lit(detection.severity).alias("severity"), "tenant", F.col(id_column).cast("string").alias("subject"), key.alias("grouping_key"), F.col(at).alias("at_us"))


def with_evidence(alerts: DataFrame, subjects: DataFrame, id_column: str, evidence: list[str]) -> DataFrame:
    """alerts with ``evidence``: the named columns of their subject at that time, as JSON."""
    said = subjects.select(F.col("tenant").alias("_t"), F.col(id_column).cast("string").alias("_s"), F.to_json(F.struct(*evidence)).alias("evidence")).groupBy("_t", "_s").agg(F.max("evidence").alias("evidence"))
    return alerts.join(said, (F.col("tenant") == F.col("_t")) & (F.col("subject") == F.col("_s")), "left").drop("_t", "_s")


def alert_groups(alerts: DataFrame) -> DataFrame:
    """(tenant, grouping_key, detection_id, severity, occurrences, subjects, first_us, last_us, evidence): alerts of one condition that still happens.

    The severity is the worst one, the evidence that of the last alert; what each alert rests on
    stays with the alerts.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(99))
    last = F.max_by("evidence", F.struct("at_us", "alert_id")) if "evidence" in alerts.columns else F.lit(None).cast("string")
    return alerts.groupBy("tenant", "grouping_key").agg(
        F.min("detection_id").alias("detection_id"), F.min_by("severity", rank).alias("severity"), F.count("*").alias("occurrences"), F.countDistinct("subject").alias("subjects"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), last.alias("evidence")
    )


def _folded(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], at: str, name: str, admit: Callable[[], Callable[[int], bool]]) -> DataFrame:
    """rows with a boolean column: what a fold over the times of each key, in order, says of each.

    Whether a row is admitted depends on the rows admitted before it, which no window frame
    expresses. The rows of a key stream through one task in order; the fold's state is all that
    is held of them. admit makes the fold of one key.
    """
    ordered = rows.select("*", F.struct(*keys).alias("_key")).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ordered.select("*", F.lit(True).alias(name)).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fold = None, None
        for batch in batches:
            said = []
            for key, time in zip(batch.column("_key").to_pylist(), batch.column(at).to_pylist(), strict=True):
                if fold is None or key != held:
                    held, fold = key, admit()
                said.append(fold(time))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.bool_())], [*batch.schema.names, name])

    return ordered.mapInArrow(read, schema).drop("_key")


def suppress(alerts: DataFrame, window_us: int = SUPPRESS_US, keys: tuple[str, ...] = ("tenant", "grouping_key"), at: str = "at_us", ident: str = "alert_id") -> DataFrame:
    """Adds ``admitted``: the first of a key, and each at least window_us after the last admitted one. A row without a time is not admitted."""

    def fresh() -> Callable[[int], bool]:
        last = [None]

        def fold(time: int) -> bool:
            if time is None or last[0] is not None and time - last[0] < window_us:
                return False
            last[0] = time
            return True

        return fold

    return _folded(alerts, keys, (at, ident), at, "admitted", fresh)


def suppression_counts(admitted: DataFrame, keys: tuple[str, ...] = ("tenant", "grouping_key")) -> DataFrame:
    """(keys..., fired, suppressed) from the result of suppress()."""
    return admitted.groupBy(*keys).agg(F.count_if("admitted").alias("fired"), F.count_if(~F.col("admitted")).alias("suppressed"))


def rate_limit(hits: DataFrame, limit: int = 10, window_us: int = 60_000_000, keys: tuple[str, ...] = ("key",), at: str = "at_us", ident: str = "hit_id") -> DataFrame:
    """Adds ``allowed``: fewer than limit hits of the key were allowed within window_us before. Refused hits do not count."""

    def fresh() -> Callable[[int], bool]:
        allowed: deque[int] = deque()

        def fold(time: int) -> bool:
            if time is None:
                return False
            while allowed and time - allowed[0] >= window_us:
                allowed.popleft()
            if len(allowed) >= limit:
                return False
            allowed.append(time)
            return True

        return fold

    return _folded(hits, keys, (at, ident), at, "allowed", fresh)


def ordered_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(99))
    return alerts.orderBy(F.when(rank == 0, 99).otherwise(rank), F.col("at_us").desc(), "alert_id").limit(limit)


def alert_list(alerts: DataFrame, tenant: str, unacknowledged: bool = False, limit: int = 100) -> DataFrame:
    """A tenant's alerts, worst first and newest first among equals; perhaps only those nobody has acknowledged."""
    mine = scoped(alerts, tenant)
    return ordered_alerts(mine.where("acknowledged_at is null") if unacknowledged else mine, limit)


def audit_list(records: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    """A tenant's audit records, newest first."""
    return scoped(records, tenant).orderBy(F.col("at_us").desc(), F.col("audit_id").desc()).limit(limit)


def source_health(sources: DataFrame, records: DataFrame, now_us: int) -> DataFrame:
    """sources (source_id, enabled, cadence_us) with last_us and health: disabled, awaiting, silent or healthy."""
    last = records.groupBy("source_id").agg(F.max("received_us").alias("last_us"))
    health = F.when(~F.col("enabled"), "disabled").when(F.col("last_us").isNull(), "awaiting").when(now_us - F.col("last_us") > F.col("cadence_us"), "silent").otherwise("healthy")
    return sources.join(last, "source_id", "left").withColumn("health", health)


def stage_state(stages: DataFrame) -> DataFrame:
    state = F.when((F.col("inputs") > 0) & (F.col("outputs") == 0), "zero_output").when(F.col("backlog") > BACKLOG, "backlogged").otherwise("healthy")
    return stages.withColumn("state", state)


# What a source must state, with the condition under which it is missing.
ONBOARDING = {
    "id": "coalesce(trim(source_id), '') = ''", "tenant": "coalesce(trim(tenant), '') = ''", "provider": "coalesce(trim(provider), '') = ''", "delivery_mode": "coalesce(delivery_mode, '') not in ('push', 'pull')", "parser": "coalesce(trim(parser_version), '') = ''",
    "fixtures": "coalesce(fixture_count, 0) = 0", "cadence": "coalesce(cadence_us, 0) <= 0", "classification": "coalesce(trim(data_classification), '') = ''", "retention": "coalesce(trim(retention_policy), '') = ''", "detections": "coalesce(trim(detection_posture), '') = ''",
}


def onboarding_gaps(sources: DataFrame) -> DataFrame:
    """sources with ``missing``: the names of what each has not stated, in the order of ONBOARDING."""
    return sources.withColumn("missing", F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in ONBOARDING.items()])))
