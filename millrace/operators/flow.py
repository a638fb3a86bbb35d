"""Materialising flows: causal order, outcome, coverage, timing, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.schema import CACHE_SERVED, LAYERS, UNKNOWN_LAYER

ORIGIN = len(LAYERS) - 1
FIRST_SET = ("client_ip", "asn", "country", "user_agent", "method", "host", "path")


def causal(layer_ord: str = "layer_ord") -> list[Column]:
    """Known layers in order, unknown ones last, then time, then id."""
    return [F.coalesce(F.col(layer_ord), F.lit(UNKNOWN_LAYER)), F.col("event_us"), F.col("event_id")]


def causal_order(keyed: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Adds ``pos`` (from 1) and ``skew_ms`` against the previous event of another known layer."""
    w = Window.partitionBy(tenant, "key").orderBy(*causal())
    before, layer = F.lag("event_us").over(w), F.lag("layer_ord").over(w)
    behind = layer.isNotNull() & F.col("layer_ord").isNotNull() & (layer != F.col("layer_ord")) & (before > F.col("event_us"))
    return keyed.withColumn("pos", F.row_number().over(w)).withColumn("skew_ms", F.when(behind, F.floor((before - F.col("event_us")) / 1000).cast("long")))


#: What a flow takes from an event, besides what orders it.
TAKEN = ("provider", "layer", "layer_ord", "action", "terminating", "raw_id", "score", "mapped", "ids", "status", "duration_ms", "cache_status", "rule_id", "method_tier", *FIRST_SET)


def _in_order(keyed: DataFrame, tenant: str) -> DataFrame:
    """(tenant, key, _e): the events of each key in causal order. Of several with one event_id, nulls together, the greatest one stays, so that values win over nulls."""
    more = [c for c in ("data_quality_flags",) if c in keyed.columns]
    layer, *rest = causal()
    flows = keyed.where("key is not null").groupBy(tenant, "key").agg(F.sort_array(F.collect_list(F.struct(layer.alias("_layer"), *rest, *TAKEN, *more))).alias("_e"))
    repeated = F.size(F.array_distinct("_e.event_id")) < F.size("_e")
    flows = flows.withColumn("_by_id", F.when(repeated, F.sort_array(F.transform("_e", lambda e: F.struct(e["event_id"].alias("id"), e.alias("e"))))))
    once = F.filter("_by_id", lambda x, i: (i == F.size("_by_id") - 1) | ~x["id"].eqNullSafe(F.get("_by_id", i + 1)["id"]))
    return flows.select(tenant, "key", F.coalesce(F.sort_array(F.transform(once, lambda x: x["e"])), "_e").alias("_e"))


def _known(value: str, of: str = "_e") -> Column:
    return F.array_compact(F.col(f"{of}.{value}"))


def _first(value: str, of: str = "_e") -> Column:
    return F.get(_known(value, of), 0)


def materialize(keyed: DataFrame, tenant: str = "tenant", closed: bool = True, expected: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """One row a flow from events with key and method_tier. Repeated event_ids count once.

    A flow's events are moved once and aggregated once, to an array in causal order; all else is told
    from that. Events with ``data_quality_flags`` pass them on to their flow, in the order in which they occur.
    """
    passed = [F.array_distinct(F.flatten(_known("data_quality_flags"))).alias("_flags")] if "data_quality_flags" in keyed.columns else []
    behind = lambda a, e: a["layer_ord"].isNotNull() & e["layer_ord"].isNotNull() & (a["layer_ord"] != e["layer_ord"]) & (a["event_us"] > e["event_us"])
    skews = F.zip_with("_e", F.slice("_e", 2, F.size("_e")), lambda a, e: F.when(behind(a, e), F.floor((a["event_us"] - e["event_us"]) / 1000).cast("long")))
    ordered = _in_order(keyed, tenant).withColumns({
        "providers": F.sort_array(F.array_distinct(_known("provider"))), "layers_present": F.sort_array(F.array_distinct(_known("layer_ord"))),
        "_stops": F.filter("_e", lambda e: e["terminating"]), "_timed": F.filter("_e", lambda e: e["duration_ms"] > 0),
    })
    served = F.coalesce(F.exists("_e", lambda e: (e["layer_ord"] == 0) & F.lower(e["cache_status"]).isin(*CACHE_SERVED)), F.lit(False))
    spent = lambda i: F.aggregate("_timed", F.lit(None).cast("double"), lambda s, e: F.when(e["layer_ord"] == i, F.coalesce(s, F.lit(0.0)) + e["duration_ms"]).otherwise(s))
    agg = ordered.select(
        tenant, "key", "providers", "layers_present", F.get("_e.method_tier", 0).alias("correlation_method"), F.size("_e").cast("long").alias("n_events"),
        _first("action", "_stops").alias("_stop_action"), _first("layer_ord", "_stops").alias("_stop_layer"), F.get("_e.action", F.size("_e") - 1).alias("_last_action"), served.alias("cache_served"),
        F.array_max("layers_present").alias("_deepest"), F.array_max(skews).alias("skew_ms"), (F.array_max(F.transform("_e.ids", lambda x: F.size(x) > 1)) & (F.size("providers") > 1)).alias("bridged"),
        *[_first(c).alias(c) for c in FIRST_SET], F.get(F.filter("_stops.rule_id", lambda x: x != ""), 0).alias("rule_id"), F.try_element_at(F.filter("_e.status", lambda x: x > 0), F.lit(-1)).alias("status"),
        *[spent(i).alias(f"ms_{layer}") for i, layer in enumerate(LAYERS)],
        F.array_distinct(F.flatten(F.sort_array(_known("ids")))).alias("ids"), F.array_min("_e.event_us").alias("first_us"), F.array_max("_e.event_us").alias("last_us"),
        F.transform("_e", lambda e, i: F.struct((i + 1).alias("pos"), *[e[c].alias(c) for c in ("event_id", "provider", "layer", "layer_ord", "action", "terminating", "event_us", "raw_id", "score", "mapped")])).alias("events"), *passed,
    )
    stopped = F.col("_stop_layer").isNotNull() | F.col("_stop_action").isNotNull()
    boundary = F.greatest(F.col("_deepest"), F.when(stopped, F.coalesce("_stop_layer", F.lit(0))).when(F.col("cache_served"), 0).otherwise(ORIGIN), F.lit(0))
    wanted = F.filter(F.array(*map(F.lit, expected)), lambda i: i <= F.col("_boundary"))
    named = lambda ords: F.transform(ords, lambda i: F.get(F.array(*map(F.lit, LAYERS)), i))
    out = agg.withColumn("_boundary", boundary).withColumn("layers_missing", F.array_except(wanted, "layers_present"))
    gaps = F.size("layers_missing") > 0
    skewed, tier = F.coalesce(F.col("skew_ms") > 0, F.lit(False)), F.col("correlation_method")
    confidence = F.when(tier == "exact", 1.0).when(tier == "heuristic", 0.6 + F.when(F.size("layers_present") >= 3, 0.1).otherwise(0.0) - F.when(skewed, 0.2).otherwise(0.0)).otherwise(0.0)
    return out.select(
        tenant, F.concat(F.lit("flow:"), "key").alias("flow_id"), F.col("key").alias("correlation_key"), "correlation_method", F.round(confidence, 2).alias("confidence"), "n_events", "providers",
        named("layers_present").alias("layers_present"), named("layers_missing").alias("layers_missing"), F.size("layers_present").alias("layer_count"),
        F.when(tier == "none", "ambiguous").when(~gaps | F.lit(not closed), "complete").otherwise("partial").alias("completeness"),
        F.coalesce("_stop_action", "_last_action").alias("effective_outcome"), F.get(F.array(*map(F.lit, LAYERS)), F.col("_stop_layer")).alias("terminating_layer"), "bridged", "cache_served", "skew_ms",
        F.array_union(F.col("_flags") if passed else F.array().cast("array<string>"), F.array_compact(F.array(F.when(skewed, "clock_skew"), F.when(tier == "heuristic", "heuristic_join"), F.when(F.col("bridged"), "bridged")))).alias("flags"),
        *FIRST_SET, "rule_id", "status", *[f"ms_{layer}" for layer in LAYERS], F.filter("ids", lambda i: i.startswith("ray:")).alias("ray_ids"), F.filter("ids", lambda i: ~i.startswith("ray:")).alias("vendor_request_ids"), "first_us", "last_us", "events",
    )


def terminal_complete(keyed: DataFrame, tenant: str = "tenant") -> DataFrame:
    """(tenant, key, terminal_complete): all layers down to the shallowest terminating one are there."""
    stop = F.min(F.when(F.col("terminating"), F.col("layer_ord")))
    agg = keyed.groupBy(tenant, "key").agg(stop.alias("stop"), F.collect_set("layer_ord").alias("have"))
    return agg.select(tenant, "key", F.coalesce(F.size(F.array_except(F.sequence(F.lit(0), F.coalesce("stop", F.lit(0))), "have")) == 0, F.lit(False)).alias("covered"), F.col("stop").isNotNull().alias("stopped")).select(tenant, "key", (F.col("covered") & F.col("stopped")).alias("terminal_complete"))


def merge_late(stored: DataFrame, late: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Union of a flow's stored events and its late ones, stored rows first on the same event_id. Adds ``amended``."""
    both = stored.withColumn("_late", F.lit(0)).unionByName(late.withColumn("_late", F.lit(1)))
    w = Window.partitionBy(tenant, "key", "event_id").orderBy("_late")
    kept = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    whole = Window.partitionBy(tenant, "key")
    return kept.withColumn("amended", (F.max("_late").over(whole) == 1) & (F.min("_late").over(whole) == 0)).drop("_late")


def latest_version(flows: DataFrame, tenant: str = "tenant") -> DataFrame:
    """The version of each flow that closed last, and of several the one whose JSON is the greatest, before any other operator looks at them."""
    w = Window.partitionBy(tenant, "flow_id").orderBy(F.col("closed_us").desc_nulls_last(), F.to_json(F.struct(*flows.columns)).desc())
    return flows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
