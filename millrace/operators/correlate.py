"""Joining the records of one request: by identifiers, then by attributes and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import connected_components

HEURISTIC_WINDOW_US = 5_000_000


def exact_keys(events: DataFrame, ids: str = "ids", tenant: str = "tenant") -> DataFrame:
    """events that have an identifier, with ``key``: the smallest identifier of their component.

    Only records with several identifiers make links, so the graph is that of the bridging
    records and the other records join it by their first identifier. The tenant is part of
    every node. Repeated records link once.
    """
    node = lambda i: F.concat_ws("\u0001", F.col(tenant), i)
    links = events.where(F.size(ids) > 1).select(F.col(tenant).alias("t"), F.explode(F.slice(ids, 2, 1 << 20)).alias("to"), F.get(F.col(ids), 0).alias("from"))
    edges = links.select(F.concat_ws("\u0001", "t", "from").alias("u"), F.concat_ws("\u0001", "t", "to").alias("v"))
    groups = connected_components(edges, "u", "v").withColumnRenamed("node", "_node")
    keyed = events.where(F.size(ids) > 0).withColumn("_node", node(F.get(F.col(ids), 0))).join(groups, "_node", "left")
    return keyed.withColumn("key", F.substring_index(F.coalesce("component", "_node"), "\u0001", -1)).drop("_node", "component")


def exact_components(keyed: DataFrame, tenant: str = "tenant") -> DataFrame:
    """(tenant, key, n_events, providers, bridged): bridged needs a record with several identifiers and more than one provider."""
    return keyed.groupBy(tenant, "key").agg(
        F.countDistinct("event_id").alias("n_events"), F.array_sort(F.collect_set("provider")).alias("providers"), (F.max(F.size("ids") > 1) & (F.countDistinct("provider") > 1)).alias("bridged")
    )


def _clusters(events: DataFrame, window_us: int, tenant: str) -> DataFrame:
    """events with ``_n``, the size of their cluster, ``ambiguous`` and ``key``. Rows without one of the attributes or a time have the size 0."""
    same = [tenant, "client_ip", "host", "path", "_method", "_apart"]
    usable = F.expr(" and ".join(f"coalesce({c}, '') <> ''" for c in ("client_ip", "host", "path", "_method")) + " and event_us is not null")
    events = events.withColumn("_method", F.upper("method")).withColumn("_apart", F.when(~usable, F.xxhash64("event_id")))
    order = Window.partitionBy(*same).orderBy("event_us", "event_id")
    gap = F.col("event_us") - F.lag("event_us").over(order)
    numbered = events.withColumn("_new", F.when(gap <= window_us, 0).otherwise(1)).withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*same, "_cluster")
    seen = F.size(F.collect_set("provider").over(whole))
    out = numbered.withColumn("_n", F.when(F.col("_apart").isNull(), F.count("*").over(whole)).otherwise(0)).withColumn("ambiguous", seen < F.count("*").over(whole)).withColumn("key", F.concat(F.lit("heur:"), F.min("event_id").over(whole).cast("string")))
    return out.drop("_method", "_apart", "_new", "_cluster")


def heuristic_keys(events: DataFrame, window_us: int = HEURISTIC_WINDOW_US, tenant: str = "tenant") -> DataFrame:
    """events clustered by client, host, path and method, gaps of at most window_us between neighbours.

    Adds ``key`` (``heur:`` and the smallest event_id) and ``ambiguous`` (a provider occurs
    twice). Rows without one of the attributes or a time, and clusters of one, are left out.
    """
    return _clusters(events, window_us, tenant).where("_n > 1").drop("_n")


def correlate(events: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Every event with key and method: exact, heuristic, or none (no key). An event_id that has joined a cluster is not listed as one without a key as well."""
    exact = exact_keys(events, tenant=tenant).withColumn("method_tier", F.lit("exact"))
    joined = (F.col("_n") > 1) & ~F.col("ambiguous")
    loose = _clusters(events.where(F.size("ids") == 0), HEURISTIC_WINDOW_US, tenant).withColumn("_joined", joined)
    elsewhere = F.max("_joined").over(Window.partitionBy(tenant, "event_id")) & F.col(tenant).isNotNull() & F.col("event_id").isNotNull()
    loose = loose.withColumn("_elsewhere", elsewhere).where("_joined or not _elsewhere")
    loose = loose.withColumn("key", F.when(F.col("_joined"), F.col("key"))).withColumn("method_tier", F.when(F.col("_joined"), "heuristic").otherwise("none"))
    return exact.unionByName(loose.drop("_n", "ambiguous", "_joined", "_elsewhere"))
