"""Conflicts between the verdicts of one flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUSPICIOUS_SCORE = 20


def conflicts(flows: DataFrame, tenant: str = "tenant") -> DataFrame:
    """(tenant, flow_id, kind, severity): a row for each kind of conflict that the flow's events show."""
    events = F.col("events")
    allowed, blocked = F.filter(events, lambda e: e["action"] == "allowed"), F.filter(events, lambda e: e["action"].isin("blocked", "challenge_failed"))
    low = lambda ord_: F.exists(allowed, lambda e: (e["layer_ord"] == ord_) & (e["score"] < SUSPICIOUS_SCORE))
    both = (F.size(allowed) > 0) & (F.size(blocked) > 0)
    kinds = F.array_compact(F.array(
        F.when(low(1), F.struct(F.lit("score_conflict").alias("kind"), F.lit("medium").alias("severity"))).when(low(0), F.struct(F.lit("score_conflict").alias("kind"), F.lit("low").alias("severity"))),
        F.when(both, F.struct(F.lit("layer_disagreement").alias("kind"), F.lit("medium").alias("severity"))),
        F.when(both & (F.get(blocked, 0)["pos"] > F.get(allowed, 0)["pos"]), F.struct(F.lit("blocked_after_allow").alias("kind"), F.lit("high").alias("severity"))),
        F.when(F.exists(events, lambda e: ~e["mapped"]), F.struct(F.lit("unmapped_action").alias("kind"), F.lit("low").alias("severity"))),
    ))
    return flows.select(tenant, "flow_id", F.explode(kinds).alias("c")).select(tenant, "flow_id", "c.kind", "c.severity")


def conflict_events(flows: DataFrame, tenant: str = "tenant") -> DataFrame:
    """(tenant, flow_id, kind, severity, layers): a row for each event that shows a score conflict or an unmapped action, and one for each disagreement."""
    events = F.col("events")
    row = lambda kind, severity, layers: F.struct(kind.alias("kind"), severity.alias("severity"), layers.alias("layers"))
    allowed, blocked = F.filter(events, lambda e: e["action"] == "allowed"), F.filter(events, lambda e: e["action"].isin("blocked", "challenge_failed"))
    scored = F.transform(F.filter(allowed, lambda e: (e["score"] < SUSPICIOUS_SCORE) & e["layer_ord"].isin(0, 1)), lambda e: row(F.lit("score_conflict"), F.when(e["layer_ord"] == 1, "medium").otherwise("low"), F.array(e["layer"])))
    both = (F.size(allowed) > 0) & (F.size(blocked) > 0)
    named = lambda es: F.transform(es, lambda e: e["layer"])
    against = F.array_compact(F.array(
        F.when(both, row(F.lit("layer_disagreement"), F.lit("medium"), F.concat(named(allowed), named(blocked)))),
        F.when(both & (F.get(blocked, 0)["pos"] > F.get(allowed, 0)["pos"]), row(F.lit("blocked_after_allow"), F.lit("high"), F.array(F.get(allowed, 0)["layer"], F.get(blocked, 0)["layer"]))),
    ))
    unmapped = F.transform(F.filter(events, lambda e: ~e["mapped"]), lambda e: row(F.lit("unmapped_action"), F.lit("low"), F.array(e["layer"])))
    return flows.select(tenant, "flow_id", F.explode(F.concat(scored, against, unmapped)).alias("c")).select(tenant, "flow_id", "c.*")


def majority_disagreement(ordered: DataFrame, tenant: str = "tenant") -> DataFrame:
    """(tenant, key, event_id, action, majority, disagrees) for flows with several actions; of equal counts the action seen first leads."""
    counts = ordered.groupBy(tenant, "key", "action").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    lead = counts.groupBy(tenant, "key").agg(F.max_by("action", F.struct("n", -F.col("at"))).alias("majority"), F.count("*").alias("kinds"))
    return ordered.join(lead, [tenant, "key"]).select(tenant, "key", "event_id", "action", "majority", ((F.col("kinds") > 1) & (F.col("action") != F.col("majority"))).alias("disagrees"))
