"""The driver's tables as a four-layer request log.

Four consecutive events make one request, seen by the four layers; some layers are missing, some
requests lack the bridge between the two identifier spaces, and some records have no identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.correlate import correlate
from millrace.operators.flow import materialize
from millrace.schema import LAYERS, PROVIDERS
from millrace.staging import stage

_flows: dict[tuple, DataFrame] = {}


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of the events from another: the session, the path, and each file's time and length."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in (store.listStatus(path) if store.getFileStatus(path).isDirectory() else [store.getFileStatus(path)]))
    return spark.sparkContext.applicationId, sf_dir, *files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("r", F.floor(F.col("event_id") / 4).cast("bigint")).withColumn("slot", (F.col("event_id") % 4).cast("int"))
    r, slot, kind = F.col("r"), F.col("slot"), F.col("event_type")
    e = e.withColumn("base_us", F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("r")))
    e = e.where(~((slot == 1) & (r % 5 == 0)) & ~((slot == 3) & (r % 7 == 0)) & ~((slot == 2) & (r % 11 == 0)))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), slot)
    terminating = kind.isin("error", "click")
    return e.select(
        "event_id", "r", slot.alias("layer_ord"), pick(LAYERS).alias("layer"), pick(list(PROVIDERS)).alias("provider"),
        F.array_compact(F.array(F.when((slot == 0) | ((slot >= 2) & (r % 17 != 0)), F.concat(F.lit("ray:"), r)), F.when((slot == 1) | ((slot == 0) & (r % 13 != 0)), F.concat(F.lit("dd:"), r)))).alias("ids"),
        F.when(kind == "error", "blocked").when(kind == "signup", "challenged").when(kind == "click", "rate_limited").when(kind == "view", "logged").otherwise("allowed").alias("action"), terminating.alias("terminating"),
        (F.col("base_us") + slot * 150_000 - F.when((slot == 3) & (r % 19 == 0), 2_000_000).otherwise(0)).alias("event_us"), F.concat(F.lit("t"), r % 3).alias("tenant"), F.concat(F.lit("10.0.0."), r % 50).alias("client_ip"),
        F.when(r % 10 != 0, 64500 + r % 40).alias("asn"), F.when(r % 3 == 0, "US").when(r % 3 == 1, "DE").alias("country"), F.when(slot == 0, "agent/1.0").alias("user_agent"), F.when(r % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("h"), r % 7, F.lit(".example.com")).alias("host"), F.concat(F.lit("/p/"), r % 23).alias("path"), F.when(slot == 0, F.when(kind == "error", 403).otherwise(200)).when(slot == 3, (200 + 100 * (r % 4)).cast("int")).alias("status"),
        F.when(slot.isin(0, 3), F.round("value", 3)).alias("duration_ms"), F.when((slot == 0) & (r % 9 == 0), "HIT").alias("cache_status"), F.concat(F.lit("rule-"), r % 6).alias("rule_id"), F.when(slot == 1, (r * 7 % 100).cast("double")).alias("score"), (r % 29 != 0).alias("mapped"),
        F.concat(F.lit("raw:"), "event_id").alias("raw_id"), "props", "value", "ts",
    )


def keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with key and method_tier, staged once a session and state of the events: events as they lie in the flow store."""
    key = _version(spark, sf_dir)
    if key not in _flows:
        _flows[key] = stage(correlate(request_log(spark, sf_dir)), "keyed_log")
    return _flows[key]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table, materialised once a session from the keyed log."""
    key = (*_version(spark, sf_dir), "flows")
    if key not in _flows:
        _flows[key] = stage(materialize(keyed_log(spark, sf_dir)), "flows")
    return _flows[key]


# The same log, its components and its flows for the SQL side of the comparison.
LOG_SQL = """
b AS (SELECT event_id, ts, event_type AS kind, value, props, CAST(floor(event_id / 4) AS BIGINT) AS r, CAST(event_id % 4 AS INT) AS slot FROM events),
x AS (SELECT *, epoch_us(min(ts) OVER (PARTITION BY r)) AS base_us FROM b),
log AS (SELECT event_id, r, slot AS layer_ord, CASE slot WHEN 0 THEN 'edge' WHEN 1 THEN 'bot_management' WHEN 2 THEN 'app_firewall' ELSE 'origin' END AS layer,
  CASE slot WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'datadome' WHEN 2 THEN 'f5asm' ELSE 'nginx' END AS provider,
  CASE WHEN slot = 0 OR (slot >= 2 AND r % 17 <> 0) THEN 'ray:' || r END AS id1, CASE WHEN slot = 1 OR (slot = 0 AND r % 13 <> 0) THEN 'dd:' || r END AS id2,
  CASE kind WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'challenged' WHEN 'click' THEN 'rate_limited' WHEN 'view' THEN 'logged' ELSE 'allowed' END AS action, kind IN ('error', 'click') AS terminating,
  base_us + slot * 150000 - CASE WHEN slot = 3 AND r % 19 = 0 THEN 2000000 ELSE 0 END AS event_us, 't' || (r % 3) AS tenant, '10.0.0.' || (r % 50) AS client_ip,
  CASE WHEN r % 10 <> 0 THEN 64500 + r % 40 END AS asn, CASE r % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' END AS country, CASE WHEN slot = 0 THEN 'agent/1.0' END AS user_agent, CASE WHEN r % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
  'h' || (r % 7) || '.example.com' AS host, '/p/' || (r % 23) AS path, CASE WHEN slot = 0 THEN CASE WHEN kind = 'error' THEN 403 ELSE 200 END WHEN slot = 3 THEN CAST(200 + 100 * (r % 4) AS INT) END AS status,
  CASE WHEN slot IN (0, 3) THEN round(value, 3) END AS duration_ms, CASE WHEN slot = 0 AND r % 9 = 0 THEN 'HIT' END AS cache_status, 'rule-' || (r % 6) AS rule_id, CASE WHEN slot = 1 THEN CAST(r * 7 % 100 AS DOUBLE) END AS score, r % 29 <> 0 AS mapped,
  'raw:' || event_id AS raw_id, props, value, ts
  FROM x WHERE NOT (slot = 1 AND r % 5 = 0) AND NOT (slot = 3 AND r % 7 = 0) AND NOT (slot = 2 AND r % 11 = 0))"""

KEY_SQL = (
    LOG_SQL
    + """,
link AS (SELECT DISTINCT tenant, id1 AS a, id2 AS b FROM log WHERE id1 IS NOT NULL AND id2 IS NOT NULL),
both_ways AS (SELECT tenant, a, b FROM link UNION SELECT tenant, b, a FROM link),
node AS (SELECT DISTINCT tenant, id1 AS id FROM log WHERE id1 IS NOT NULL UNION SELECT DISTINCT tenant, id2 FROM log WHERE id2 IS NOT NULL),
reach AS (SELECT tenant, id, id AS label FROM node UNION SELECT reach.tenant, w.b, reach.label FROM reach JOIN both_ways w ON w.tenant = reach.tenant AND w.a = reach.id),
label AS (SELECT tenant, id, min(label) AS key FROM reach GROUP BY 1, 2),
exact AS (SELECT log.*, label.key, 'exact' AS method_tier FROM log JOIN label ON label.tenant = log.tenant AND label.id = coalesce(id1, id2)),
bare AS (SELECT *, event_us - lag(event_us) OVER (PARTITION BY tenant, client_ip, host, path, upper(method) ORDER BY event_us, event_id) AS gap FROM log WHERE id1 IS NULL AND id2 IS NULL),
run AS (SELECT *, sum(CASE WHEN gap <= 5000000 THEN 0 ELSE 1 END) OVER (PARTITION BY tenant, client_ip, host, path, upper(method) ORDER BY event_us, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM bare),
grp AS (SELECT tenant, client_ip, host, path, upper(method) AS m, cluster, count(*) AS n, count(DISTINCT provider) AS p, 'heur:' || min(event_id) AS key FROM run GROUP BY ALL HAVING count(*) > 1),
loose AS (SELECT run.* EXCLUDE (gap, cluster), grp.key, 'heuristic' AS method_tier, grp.p < grp.n AS ambiguous FROM run JOIN grp ON run.tenant = grp.tenant AND run.client_ip = grp.client_ip AND run.host = grp.host AND run.path = grp.path AND upper(run.method) = grp.m AND run.cluster = grp.cluster),
keyed AS (SELECT * FROM exact UNION ALL BY NAME SELECT * EXCLUDE (ambiguous) FROM loose WHERE NOT ambiguous),
pos AS (SELECT *, row_number() OVER w AS pos, lag(event_us) OVER w AS before_us, lag(layer_ord) OVER w AS before_layer FROM keyed WINDOW w AS (PARTITION BY tenant, key ORDER BY layer_ord, event_us, event_id)),
ordered AS (SELECT *, CASE WHEN before_layer <> layer_ord AND before_us > event_us THEN (before_us - event_us) // 1000 END AS skew_ms FROM pos)"""
)

FLOW_SQL = (
    KEY_SQL
    + """,
agg AS (SELECT tenant, key, any_value(method_tier) AS correlation_method, count(*) AS n_events, list_sort(list(DISTINCT provider)) AS providers, list_sort(list(DISTINCT layer_ord)) AS present,
  arg_min(action, pos) FILTER (WHERE terminating) AS stop_action, arg_min(layer_ord, pos) FILTER (WHERE terminating) AS stop_layer, arg_max(action, pos) AS last_action,
  coalesce(bool_or(layer_ord = 0 AND lower(cache_status) IN ('hit', 'revalidated', 'updating', 'stale')), false) AS cache_served, max(layer_ord) AS deepest, max(skew_ms) AS skew_ms,
  bool_or(id1 IS NOT NULL AND id2 IS NOT NULL) AND count(DISTINCT provider) > 1 AS bridged,
  arg_min(client_ip, pos) AS client_ip, arg_min(asn, pos) FILTER (WHERE asn IS NOT NULL) AS asn, arg_min(country, pos) FILTER (WHERE country IS NOT NULL) AS country, arg_min(user_agent, pos) FILTER (WHERE user_agent IS NOT NULL) AS user_agent,
  arg_min(method, pos) AS method, arg_min(host, pos) AS host, arg_min(path, pos) AS path, arg_min(rule_id, pos) FILTER (WHERE terminating) AS rule_id, arg_max(status, pos) FILTER (WHERE status > 0) AS status,
  sum(duration_ms) FILTER (WHERE layer_ord = 0 AND duration_ms > 0) AS ms_edge, sum(duration_ms) FILTER (WHERE layer_ord = 3 AND duration_ms > 0) AS ms_origin, min(event_us) AS first_us, max(event_us) AS last_us FROM ordered GROUP BY tenant, key),
bound AS (SELECT *, greatest(deepest, CASE WHEN stop_layer IS NOT NULL THEN stop_layer WHEN cache_served THEN 0 ELSE 3 END) AS boundary FROM agg),
flow AS (SELECT *, 'flow:' || key AS flow_id, len(present) AS layer_count, list_filter(range(0, boundary + 1), lambda i: NOT list_contains(present, CAST(i AS INT))) AS missing, coalesce(stop_action, last_action) AS effective_outcome,
  CASE stop_layer WHEN 0 THEN 'edge' WHEN 1 THEN 'bot_management' WHEN 2 THEN 'app_firewall' WHEN 3 THEN 'origin' END AS terminating_layer FROM bound),
flows AS (SELECT *, CASE WHEN len(missing) = 0 THEN 'complete' ELSE 'partial' END AS completeness,
  round(CASE WHEN correlation_method = 'exact' THEN 1.0 ELSE 0.6 + CASE WHEN layer_count >= 3 THEN 0.1 ELSE 0 END - CASE WHEN skew_ms > 0 THEN 0.2 ELSE 0 END END, 2) AS confidence FROM flow)"""
)
