"""Registered queries over what surrounds flows: lists and pages, limits, exports, sources, profiles in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.values import status_class
from millrace.operators import alerts, filters, flow, profile, replay, search, stats, verdict
from millrace.plans.profile_queries import URL_SQL, urls
from millrace.sources.driver_tables import FLOW_SQL, KEY_SQL, LOG_SQL, flows, keyed_log, request_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, head: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {head} {sql}" if head else sql
        return f

    return register


@query("SELECT raw_id, event_id, provider FROM log WHERE tenant = 't2' AND raw_id = 'raw:20'", LOG_SQL)
def raw_by_id(spark, d):
    return search.raw_by_id(request_log(spark, d), "t2", "raw:20").select("raw_id", "event_id", "provider")


@query("SELECT event_id, host FROM log WHERE lower(host) IN ('h1.example.com', 'h4.example.com')", LOG_SQL)
def property_scope(spark, d):
    return request_log(spark, d).where(filters.property_scope(F.col("host"), ["H1.example.com", "h4.example.com"])).select("event_id", "host")


def _alerts(spark, d):
    severity = F.when(F.col("layer_ord") == 0, "critical").when(F.col("layer_ord") == 1, "low").when(F.col("layer_ord") == 2, "high").otherwise("info")
    return request_log(spark, d).where("action = 'blocked'").select("tenant", "event_id", F.concat(F.lit("al_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("alert_id"), severity.alias("severity"), F.col("event_us").alias("at_us"), F.when(F.col("r") % 3 == 0, F.col("event_us") + 1).alias("acknowledged_at"), F.concat("rule_id", F.lit("/"), "tenant").alias("grouping_key"))


_ALERT_SQL = LOG_SQL + ", alerts AS (SELECT tenant, event_id, 'al_' || lpad(event_id::VARCHAR, 12, '0') AS alert_id, CASE layer_ord WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'info' END AS severity, event_us AS at_us, r % 3 <> 0 AS open, rule_id || '/' || tenant AS grouping_key FROM log WHERE action = 'blocked')"


@query("SELECT alert_id, severity, at_us FROM alerts WHERE tenant = 't1' ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END, at_us DESC, alert_id LIMIT 100", _ALERT_SQL)
def alerts_ordered(spark, d):
    return alerts.alert_list(_alerts(spark, d), "t1").select("alert_id", "severity", "at_us")


@query("SELECT alert_id, severity, at_us FROM alerts WHERE tenant = 't2' AND open ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END, at_us DESC, alert_id LIMIT 40", _ALERT_SQL)
def alerts_unacknowledged(spark, d):
    return alerts.alert_list(_alerts(spark, d), "t2", unacknowledged=True, limit=40).select("alert_id", "severity", "at_us")


_FOLD_SQL = """, a AS (SELECT tenant, grouping_key, at_us, row_number() OVER (PARTITION BY tenant, grouping_key ORDER BY at_us, alert_id) AS n FROM alerts),
f AS (SELECT tenant, grouping_key, n, at_us AS last_us, true AS admitted FROM a WHERE n = 1 UNION ALL
SELECT a.tenant, a.grouping_key, a.n, CASE WHEN a.at_us - f.last_us >= 900000000 THEN a.at_us ELSE f.last_us END, a.at_us - f.last_us >= 900000000 FROM f JOIN a ON a.tenant = f.tenant AND a.grouping_key = f.grouping_key AND a.n = f.n + 1)"""


@query("SELECT tenant, grouping_key, count(*) FILTER (WHERE admitted) AS fired, count(*) FILTER (WHERE NOT admitted) AS suppressed FROM f GROUP BY tenant, grouping_key", _ALERT_SQL + _FOLD_SQL)
def suppression_counts(spark, d):
    return alerts.suppression_counts(alerts.suppress(_alerts(spark, d)))


_LIMIT_SQL = LOG_SQL + """, hit AS (SELECT client_ip AS key, event_id, event_us AS at_us, row_number() OVER (PARTITION BY client_ip ORDER BY event_us, event_id) AS n FROM log),
f AS (SELECT key, event_id, n, [at_us] AS held, true AS allowed FROM hit WHERE n = 1 UNION ALL
SELECT h.key, h.event_id, h.n, CASE WHEN len(list_filter(f.held, lambda t: h.at_us - t < 172800000000)) < 5 THEN list_append(list_filter(f.held, lambda t: h.at_us - t < 172800000000), h.at_us) ELSE list_filter(f.held, lambda t: h.at_us - t < 172800000000) END, len(list_filter(f.held, lambda t: h.at_us - t < 172800000000)) < 5
FROM f JOIN hit h ON h.key = f.key AND h.n = f.n + 1)"""


@query("SELECT event_id, allowed FROM f", _LIMIT_SQL)
def rate_limiter(spark, d):
    hits = request_log(spark, d).select(F.col("client_ip").alias("key"), "event_id", F.col("event_us").alias("at_us"))
    return alerts.rate_limit(hits, 5, 172_800_000_000, ident="event_id").select("event_id", "allowed")


@query("SELECT o_orderkey AS audit_id, at_us FROM (SELECT o_orderkey, 't' || (o_custkey % 3) AS tenant, epoch_us(o_orderdate) AS at_us FROM orders) WHERE tenant = 't2' ORDER BY at_us DESC, audit_id DESC LIMIT 200")
def audit_newest(spark, d):
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("audit_id"), F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"))
    return alerts.audit_list(records, "t2", 200).select("audit_id", "at_us")


@query("SELECT tenant, key, array_to_string(list(field ORDER BY pos, i), ' ') AS redactions FROM (SELECT tenant, key, field, arg_min(i, pos * 10 + i) AS i, min(pos) AS pos FROM (SELECT tenant, key, pos, unnest(fs) AS field, generate_subscripts(fs, 1) AS i FROM (SELECT tenant, key, pos, CASE layer_ord WHEN 0 THEN ['request.headers.cookie', 'request.query'] WHEN 2 THEN ['request.query', 'request.path'] ELSE [] END AS fs FROM ordered)) GROUP BY tenant, key, field) GROUP BY tenant, key", KEY_SQL)
def export_redactions(spark, d):
    fields = F.when(F.col("layer_ord") == 0, F.array(F.lit("request.headers.cookie"), F.lit("request.query"))).when(F.col("layer_ord") == 2, F.array(F.lit("request.query"), F.lit("request.path"))).otherwise(F.array().cast("array<string>"))
    masked = flow.causal_order(keyed_log(spark, d).where("key is not null")).withColumn("masked_fields", fields)
    return search.export_redactions(masked).withColumn("redactions", F.array_join("redactions", " "))


def _profiles(spark, d):
    seen = request_log(spark, d).withColumn("template", F.col("path")).withColumn("seen_us", F.col("event_us"))
    return profile.endpoint_profile(seen, ["host"])


@query("SELECT count(*) AS total FROM (SELECT host, path, count(*) AS n FROM log GROUP BY ALL) WHERE n >= 20 AND path ILIKE '%/p/1%'", LOG_SQL)
def profile_total(spark, d):
    return profile.profile_total(_profiles(spark, d), 20, q="/P/1")


@query("SELECT DISTINCT host, path AS template FROM (SELECT host, path, count(*) OVER (PARTITION BY host) AS n, (SELECT count(DISTINCT path) FROM log) AS k FROM log) WHERE n >= 64 AND k >= 8", LOG_SQL)
def retired_endpoints(spark, d):
    """The literal endpoints that are gone once their position has collapsed."""
    log = request_log(spark, d)
    stored = log.select("host", F.col("path").alias("template")).distinct()
    return profile.retired(stored, profile.learn_templates(log, ["host"]), ["host", "template"])


@query("SELECT preset, count(flow_id) AS n FROM (VALUES ('15m', 900000000), ('1h', 3600000000), ('24h', 86400000000), ('other', 3600000000)) p(preset, us) LEFT JOIN flows ON first_us BETWEEN (SELECT max(first_us) FROM flows) - us AND (SELECT max(first_us) FROM flows) GROUP BY preset", FLOW_SQL)
def dashboard_ranges(spark, d):
    f = flows(spark, d)
    now = f.agg(F.max("first_us")).first()[0]
    counts = [stats.within_range(f, p, now).agg(F.lit(p).alias("preset"), F.count("*").alias("n")) for p in ("15m", "1h", "24h", "other")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT s_suppkey, trim(CASE WHEN s_suppkey % 2 = 0 THEN 'tenant ' ELSE '' END || CASE WHEN s_suppkey % 5 = 3 THEN 'delivery_mode ' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN 'fixtures ' ELSE '' END || CASE WHEN s_acctbal <= 0 THEN 'cadence ' ELSE '' END || CASE WHEN s_nationkey < 5 THEN 'detections' ELSE '' END) AS missing FROM supplier")
def onboarding_gaps(spark, d):
    k = F.col("s_suppkey")
    sources = table(spark, d, "supplier").select(
        k, F.col("s_name").alias("source_id"), F.when(k % 2 == 0, " ").otherwise("t").alias("tenant"), F.lit("nginx").alias("provider"), F.when(k % 5 == 3, "mail").when(k % 5 == 4, "pull").otherwise("push").alias("delivery_mode"), F.lit("1").alias("parser_version"),
        (k % 7).alias("fixture_count"), F.col("s_acctbal").alias("cadence_us"), F.lit("public").alias("data_classification"), F.lit("r30").alias("retention_policy"), F.when(F.col("s_nationkey") >= 5, "none apply").alias("detection_posture"),
    )
    return alerts.onboarding_gaps(sources).select("s_suppkey", F.array_join("missing", " ").alias("missing"))


@query("""SELECT tenant, flow_id, kind, severity, layers FROM (
SELECT tenant, 'flow:' || key AS flow_id, 'score_conflict' AS kind, 'medium' AS severity, layer AS layers FROM ordered WHERE layer_ord = 1 AND score < 20 AND action = 'allowed'
UNION ALL SELECT tenant, 'flow:' || key, 'unmapped_action', 'low', layer FROM ordered WHERE NOT mapped
UNION ALL SELECT tenant, 'flow:' || key, 'layer_disagreement', 'medium', a || ' ' || b FROM v WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT tenant, 'flow:' || key, 'blocked_after_allow', 'high', split_part(a, ' ', 1) || ' ' || split_part(b, ' ', 1) FROM v WHERE pb > pa)""",
       KEY_SQL + ", v AS (SELECT tenant, key, string_agg(layer, ' ' ORDER BY pos) FILTER (WHERE action = 'allowed') AS a, string_agg(layer, ' ' ORDER BY pos) FILTER (WHERE action IN ('blocked', 'challenge_failed')) AS b, min(pos) FILTER (WHERE action = 'allowed') AS pa, min(pos) FILTER (WHERE action IN ('blocked', 'challenge_failed')) AS pb FROM ordered GROUP BY tenant, key)")
def verdict_conflict_events(spark, d):
    return verdict.conflict_events(flows(spark, d)).withColumn("layers", F.array_join("layers", " "))


_KINDS = "CASE WHEN len(ks) = 0 THEN 'empty' WHEN len(ks) = 1 THEN ks[1] WHEN list_sort(ks) = ['float', 'int'] THEN 'float' WHEN list_sort(ks) = ['hex', 'int'] THEN 'hex' WHEN len(list_filter(ks, lambda k: k NOT IN ('bool', 'int', 'hex', 'alnum'))) = 0 THEN 'alnum' ELSE 'freetext' END"


@query(f"SELECT host, name, {_KINDS} AS inferred_type, observations, least(k, 64) AS distinct_estimate, k > 64 AS enum_overflowed, present_count, CASE WHEN k <= 64 THEN array_to_string(vs, ' ') END AS enum_values FROM (SELECT host, name, coalesce(list(DISTINCT kind) FILTER (WHERE kind <> 'empty'), []) AS ks, count(*) AS observations, count(DISTINCT value) AS k, list_sort(list(DISTINCT value)) AS vs, count(DISTINCT page_id) AS present_count FROM typed GROUP BY host, name)", URL_SQL)
def param_merge(spark, d):
    """Three partial profiles, by page, merged."""
    params = profile.parameters(urls(spark, d))
    parts = [profile.parameter_parts(params.where(F.col("page_id") % 3 == k), ["host"]) for k in range(3)]
    out = profile.merge_parameters(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["host"])
    return out.select("host", "name", "inferred_type", "observations", "distinct_estimate", "enum_overflowed", "present_count", F.array_join("enum_values", " ").alias("enum_values"))


@query("SELECT e.host, e.n AS observations, list(p.name ORDER BY p.name)[1] AS first_name, round(sum(round(p.present / e.n, 6)), 6) AS presence_sum, count(*) AS parameters FROM (SELECT host, name, count(DISTINCT page_id) AS present FROM params GROUP BY host, name) p JOIN (SELECT host, count(*) AS n FROM urls GROUP BY host) e ON e.host = p.host GROUP BY e.host, e.n", URL_SQL)
def profile_response(spark, d):
    u = urls(spark, d).withColumn("template", F.lit("/"))
    shown = profile.endpoint_profile(u.withColumn("seen_us", F.col("page_id")).withColumn("provider", F.lit("p")), ["host"])
    params = profile.parameter_profile(profile.parameters(u), ["host", "template"]).withColumn("location", F.lit("query"))
    out = profile.profile_response(shown, params, ["host"]).where("parameters is not null")
    total = F.aggregate("parameters", F.lit(0.0).cast("double"), lambda s, p: s + p["presence"])
    return out.select("host", "observations", F.get("parameters", 0)["name"].alias("first_name"), F.round(total, 6).alias("presence_sum"), F.size("parameters").cast("bigint").alias("parameters"))


@query("SELECT r // 500 AS part, CAST(status // 100 AS VARCHAR) || 'xx' AS class, count(*) AS n FROM log WHERE status IS NOT NULL GROUP BY ALL", LOG_SQL)
def status_classes(spark, d):
    return request_log(spark, d).where("status is not null").groupBy(F.floor(F.col("r") / 500).alias("part"), status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT host, path AS template, array_to_string(list_sort(list(DISTINCT name)), ' ') AS cookie_names FROM (SELECT host, path, unnest(['sid', 'u' || (r % 4)]) AS name FROM log WHERE layer_ord = 0) GROUP BY ALL", LOG_SQL)
def cookie_name_profile(spark, d):
    seen = request_log(spark, d).where("layer_ord = 0").withColumn("template", F.col("path")).withColumn("cookie_names", F.array(F.lit("sid"), F.concat(F.lit("u"), F.col("r") % 4)))
    return profile.cookie_name_profile(seen, ["host"]).select("host", "template", F.array_join("cookie_names", " ").alias("cookie_names"))


@query(
    "SELECT event_id AS request_id, a + b + c AS n_rules, 2 * a + 3 * b + 4 * c AS score, 2 * a + 3 * b AS level_1, 4 * c AS level_2, 2 * a + 3 * b + 4 * c >= 5 AS would_block, CASE WHEN r % 9 = 0 THEN '1 field(s) masked (cookie): rules see the mask' ELSE '' END AS warnings FROM (SELECT *, CAST(regexp_matches(path, '/p/1[0-9]') AS BIGINT) AS a, CAST(method = 'POST' AS BIGINT) AS b, CAST(host = 'h3.example.com' AS BIGINT) AS c FROM log)",
    LOG_SQL,
)
def request_replay(spark, d):
    """Every logged request against weighted patterns of three paranoia levels, of which two count."""
    rules = spark.createDataFrame([("r1", "uri", "/p/1[0-9]", 2, 1), ("r2", "method", "^POST$", 3, 1), ("r3", "headers", "Host: h3[.]", 4, 2), ("r4", "any", "p", 9, 3)], "rule_id string, target string, pattern string, score int, paranoia int")
    masked = F.when(F.col("r") % 9 == 0, F.array(F.lit("cookie")))
    requests = request_log(spark, d).select(F.col("event_id").alias("request_id"), F.col("path").alias("uri"), "method", F.create_map(F.lit("Host"), F.col("host")).alias("headers"), "client_ip", masked.alias("masked_fields"))
    out = replay.replay_requests(requests, rules, paranoia=2)
    return out.select("request_id", F.size("matched_rules").cast("long").alias("n_rules"), "score", F.get("score_by_level", 0).alias("level_1"), F.get("score_by_level", 1).alias("level_2"), "would_block", F.array_join("warnings", "; ").alias("warnings"))


@query(
    "SELECT tenant, client_ip AS subject, count(*) AS occurrences, min(event_us) AS first_us, max(event_us) AS last_us, arg_max(path, CAST(event_us AS HUGEINT) * 1000000000000 + event_id) AS last_path FROM log WHERE action = 'blocked' GROUP BY tenant, client_ip",
    LOG_SQL,
)
def alert_groups(spark, d):
    """Blocked requests as alerts of their client, grouped to one condition each, with the last one as evidence."""
    rows = request_log(spark, d).where("action = 'blocked'").select("tenant", F.col("client_ip").alias("subject"), F.concat_ws("/", F.lit("blocked"), "client_ip").alias("grouping_key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("alert_id"), F.lit("blocked").alias("detection_id"), F.lit("high").alias("severity"), F.col("event_us").alias("at_us"), F.to_json(F.struct("path")).alias("evidence"))
    out = alerts.alert_groups(rows)
    return out.select("tenant", F.substring_index("grouping_key", "/", -1).alias("subject"), "occurrences", "first_us", "last_us", F.get_json_object("evidence", "$.path").alias("last_path"))
