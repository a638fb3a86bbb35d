"""Captured requests against a table of weighted patterns: scores by paranoia level, and what the capture could not tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.filters import MAX_PATTERNS

THRESHOLD = 5
#: The parts of a request that a rule may look at.
TARGETS = ("uri", "method", "headers", "body", "any")
CAPTURE = ("uri string", "method string", "headers map<string,string>", "body string", "client_ip string", "masked_fields array<string>", "body_truncated boolean")


def _text(target: str) -> Column:
    headers = F.array_join(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    parts = {"uri": F.coalesce("uri", F.lit("")), "method": F.coalesce("method", F.lit("")), "headers": headers, "body": F.coalesce("body", F.lit(""))}
    return F.concat_ws("\n", *parts.values()) if target == "any" else parts[target]


def completeness_warnings() -> Column:
    """Why a result may differ from production's, as an array of the capture's shortcomings."""
    masked = F.coalesce(F.size("masked_fields"), F.lit(0))
    return F.array_compact(F.array(
        F.when(F.coalesce("body_truncated", F.lit(False)), "body truncated: rules on the missing part cannot fire"),
        F.when(masked > 0, F.concat(masked.cast("string"), F.lit(" field(s) masked ("), F.array_join("masked_fields", ", "), F.lit("): rules see the mask"))),
        F.when(F.coalesce("client_ip", F.lit("")) == "", "no client address: rules on addresses cannot be evaluated"),
        F.when(F.coalesce(F.size("headers"), F.lit(0)) <= 0, "no headers: rules on headers cannot fire"),
    ))


def replay_requests(requests: DataFrame, rules: DataFrame, threshold: int = THRESHOLD, paranoia: int = 1) -> DataFrame:
    """(request_id, matched_rules, score, score_by_level, would_block, warnings) of every row of requests.

    requests: request_id and any columns of CAPTURE; what is lacking is empty, and warned of. rules:
    (rule_id, target, pattern, score, paranoia), at most MAX_PATTERNS of the levels up to paranoia,
    which become one pass over the requests. Only rules up to that level count; score_by_level has
    an entry for each level. A request blocks if its score reaches the threshold.
    """
    active = rules.where(F.col("paranoia") <= paranoia).select("rule_id", "target", "pattern", "score", "paranoia").orderBy("rule_id").limit(MAX_PATTERNS + 1).collect()
    if len(active) > MAX_PATTERNS:
        raise ValueError("too many patterns")
    if wrong := sorted({r["target"] for r in active} - set(TARGETS)):
        raise ValueError(f"unknown targets {wrong}")
    missing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CAPTURE if c.split()[0] not in requests.columns]
    seen = requests.select("*", *missing)
    texts = seen.select("request_id", completeness_warnings().alias("warnings"), *[_text(t).alias(f"_{t}") for t in sorted({r["target"] for r in active})])
    kind = "array<struct<rule_id:string,score:bigint,paranoia:int>>"
    hits = F.array_compact(F.array(*[F.when(F.col(f"_{r['target']}").rlike(r["pattern"]), F.struct(F.lit(r["rule_id"]), F.lit(r["score"]).cast("long"), F.lit(r["paranoia"]).cast("int"))) for r in active])) if active else F.array()
    rows = texts.select("request_id", "warnings", hits.cast(kind).alias("hits"))
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda s, h: s + h["score"])
    levels = F.transform(F.sequence(F.lit(1), F.lit(paranoia)), lambda level: total(F.filter("hits", lambda h: h["paranoia"] == level)))
    return rows.select("request_id", F.transform("hits", lambda h: h["rule_id"]).alias("matched_rules"), total(F.col("hits")).alias("score"), levels.alias("score_by_level"), (total(F.col("hits")) >= threshold).alias("would_block"), "warnings")


def rule_counts(replayed: DataFrame) -> DataFrame:
    """(rule_id, requests, blocked): how many requests each rule matched, and how many of these would be blocked."""
    return replayed.select(F.explode("matched_rules").alias("rule_id"), "would_block").groupBy("rule_id").agg(F.count("*").alias("requests"), F.count_if("would_block").alias("blocked"))
