"""Registered queries over flows, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import alerts, baseline, correlate, filters, flow, search, stats, verdict
from millrace.schema import LAYERS
from millrace.sources.driver_tables import FLOW_SQL, KEY_SQL, LOG_SQL, flows, keyed_log, request_log, table
from millrace.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, head: str = ""):
    """Register a query with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {head} {sql}" if head else sql).strip()
        return f

    return register


SPACED = "array_to_string({}, ' ')"


@query("SELECT effective_outcome, coalesce(terminating_layer, '') AS terminating_layer, count(*) AS n FROM flows GROUP BY ALL", FLOW_SQL)
def flow_outcomes(spark, d):
    return flows(spark, d).groupBy("effective_outcome", F.coalesce("terminating_layer", F.lit("")).alias("terminating_layer")).agg(F.count("*").alias("n"))


@query("SELECT tenant, key, count(DISTINCT event_id) AS n_events, array_to_string(list_sort(list(DISTINCT provider)), ' ') AS providers, bool_or(id1 IS NOT NULL AND id2 IS NOT NULL) AND count(DISTINCT provider) > 1 AS bridged FROM exact GROUP BY tenant, key", KEY_SQL)
def exact_components(spark, d):
    return correlate.exact_components(correlate.exact_keys(request_log(spark, d))).withColumn("providers", F.array_join("providers", " "))


@query("SELECT tenant, count(*) AS n FROM (SELECT tenant, key FROM exact GROUP BY tenant, key HAVING bool_or(id1 IS NOT NULL AND id2 IS NOT NULL) AND count(DISTINCT provider) > 1) GROUP BY tenant", KEY_SQL)
def bridged_components(spark, d):
    return correlate.exact_components(keyed_log(spark, d).where("method_tier = 'exact'")).where("bridged").groupBy("tenant").agg(F.count("*").alias("n"))


@query("SELECT tenant, key, count(*) AS n, array_to_string(list_sort(list(DISTINCT provider)), ' ') AS providers FROM loose WHERE NOT ambiguous GROUP BY tenant, key", KEY_SQL)
def heuristic_components(spark, d):
    bare = request_log(spark, d).where(F.size("ids") == 0)
    return correlate.heuristic_keys(bare).where("not ambiguous").groupBy("tenant", "key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("provider")), " ").alias("providers"))


@query("SELECT event_id, key FROM loose WHERE ambiguous", KEY_SQL.replace("gap <= 5000000", "gap <= 864000000000").replace("'/p/' || (r % 23) AS path", "'/x' AS path").replace("'h' || (r % 7) || '.example.com' AS host", "'h' AS host").replace("'10.0.0.' || (r % 50) AS client_ip", "'10.0.0.1' AS client_ip"))
def heuristic_ambiguous(spark, d):
    bare = request_log(spark, d).where(F.size("ids") == 0)
    return correlate.heuristic_keys(bare.withColumns({"path": F.lit("/x"), "host": F.lit("h"), "client_ip": F.lit("10.0.0.1")}), 864_000_000_000).where("ambiguous").select("event_id", "key")


@query("SELECT tenant, count(*) AS n FROM log WHERE id1 IS NULL AND id2 IS NULL AND event_id NOT IN (SELECT event_id FROM loose WHERE NOT ambiguous) GROUP BY tenant", KEY_SQL)
def uncorrelated_events(spark, d):
    return keyed_log(spark, d).where("method_tier = 'none'").groupBy("tenant").agg(F.count("*").alias("n"))


@query("SELECT tenant, key, event_id, pos, layer FROM ordered", KEY_SQL)
def causal_order(spark, d):
    return flow.causal_order(keyed_log(spark, d).where("key is not null")).select("tenant", "key", "event_id", F.col("pos").cast("bigint").alias("pos"), "layer")


@query("SELECT tenant, key, max(skew_ms) AS skew_ms FROM ordered GROUP BY tenant, key HAVING max(skew_ms) IS NOT NULL", KEY_SQL)
def clock_skew(spark, d):
    return flows(spark, d).where("skew_ms is not null").select("tenant", F.col("correlation_key").alias("key"), "skew_ms")


NAMED = "array_to_string(list_transform({}, lambda i: CASE i WHEN 0 THEN 'edge' WHEN 1 THEN 'bot_management' WHEN 2 THEN 'app_firewall' ELSE 'origin' END), ' ')"


@query(f"SELECT tenant, flow_id, {NAMED.format('present')} AS present, {NAMED.format('missing')} AS missing, completeness, CAST(layer_count AS BIGINT) AS layer_count FROM flows", FLOW_SQL)
def layer_coverage(spark, d):
    return flows(spark, d).select("tenant", "flow_id", F.array_join("layers_present", " ").alias("present"), F.array_join("layers_missing", " ").alias("missing"), "completeness", F.col("layer_count").cast("bigint").alias("layer_count"))


@query("SELECT tenant, flow_id, layer, round(ms, 3) AS ms FROM (SELECT tenant, flow_id, 'edge' AS layer, ms_edge AS ms FROM flows UNION ALL SELECT tenant, flow_id, 'origin', ms_origin FROM flows) WHERE ms IS NOT NULL", FLOW_SQL)
def timing_attribution(spark, d):
    rows = F.array(*[F.struct(F.lit(x).alias("layer"), F.col(f"ms_{x}").alias("ms")) for x in LAYERS])
    return flows(spark, d).select("tenant", "flow_id", F.explode(rows).alias("t")).where("t.ms is not null").select("tenant", "flow_id", "t.layer", F.round("t.ms", 3).alias("ms"))


@query("SELECT tenant, flow_id, client_ip, asn, country, user_agent, method, host, path, CAST(status AS BIGINT) AS status, rule_id FROM flows", FLOW_SQL)
def flow_denormalized(spark, d):
    return flows(spark, d).select("tenant", "flow_id", "client_ip", "asn", "country", "user_agent", "method", "host", "path", F.col("status").cast("bigint").alias("status"), "rule_id")


@query("SELECT tenant, flow_id, trim(CASE WHEN skew_ms > 0 THEN 'clock_skew ' ELSE '' END || CASE WHEN correlation_method = 'heuristic' THEN 'heuristic_join ' ELSE '' END || CASE WHEN bridged THEN 'bridged' ELSE '' END) AS flags FROM flows", FLOW_SQL)
def flow_flags(spark, d):
    return flows(spark, d).select("tenant", "flow_id", F.array_join("flags", " ").alias("flags"))


@query("SELECT correlation_method, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n FROM flows GROUP BY ALL", FLOW_SQL)
def flow_confidence(spark, d):
    return flows(spark, d).groupBy("correlation_method", "confidence").agg(F.count("*").alias("n"))


@query("SELECT tenant, flow_id, first_us, last_us, last_us - first_us AS span_us, cache_served FROM flows", FLOW_SQL)
def flow_span(spark, d):
    return flows(spark, d).select("tenant", "flow_id", "first_us", "last_us", (F.col("last_us") - F.col("first_us")).alias("span_us"), "cache_served")


@query("SELECT tenant, key, stop IS NOT NULL AND len(list_filter(range(0, coalesce(stop, 0) + 1), lambda i: NOT list_contains(have, CAST(i AS INT)))) = 0 AS terminal_complete FROM (SELECT tenant, key, min(layer_ord) FILTER (WHERE terminating) AS stop, list(DISTINCT layer_ord) AS have FROM keyed GROUP BY tenant, key)", KEY_SQL)
def terminal_complete(spark, d):
    return flow.terminal_complete(keyed_log(spark, d).where("key is not null"))


@query("SELECT tenant, flow_id, n_events, effective_outcome, completeness, a.amended FROM flows JOIN (SELECT tenant AS t, key AS k, bool_or(event_id % 10 = 3) AND bool_or(event_id % 10 <> 3) AS amended FROM keyed GROUP BY tenant, key) a ON a.t = tenant AND a.k = key", FLOW_SQL)
def straggler_merge(spark, d):
    keyed = keyed_log(spark, d).where("key is not null")
    merged = flow.merge_late(keyed.where("event_id % 10 <> 3"), keyed.where("event_id % 10 = 3"))
    amended = merged.groupBy("tenant", F.concat(F.lit("flow:"), "key").alias("flow_id")).agg(F.max("amended").alias("amended"))
    return flow.materialize(merged.drop("amended")).select("tenant", "flow_id", "n_events", "effective_outcome", "completeness").join(amended, ["tenant", "flow_id"])


@query("""SELECT tenant, flow_id, kind, severity FROM (
SELECT f.tenant, f.flow_id, 'score_conflict' AS kind, 'medium' AS severity FROM flows f WHERE EXISTS (SELECT 1 FROM ordered o WHERE o.tenant = f.tenant AND o.key = f.key AND o.layer_ord = 1 AND o.score < 20 AND o.action = 'allowed')
UNION ALL SELECT f.tenant, f.flow_id, 'layer_disagreement', 'medium' FROM flows f JOIN v ON v.tenant = f.tenant AND v.key = f.key WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT f.tenant, f.flow_id, 'blocked_after_allow', 'high' FROM flows f JOIN v ON v.tenant = f.tenant AND v.key = f.key WHERE b > a
UNION ALL SELECT f.tenant, f.flow_id, 'unmapped_action', 'low' FROM flows f WHERE EXISTS (SELECT 1 FROM ordered o WHERE o.tenant = f.tenant AND o.key = f.key AND NOT o.mapped))""",
       FLOW_SQL + ", v AS (SELECT tenant, key, min(pos) FILTER (WHERE action = 'allowed') AS a, min(pos) FILTER (WHERE action IN ('blocked', 'challenge_failed')) AS b FROM ordered GROUP BY tenant, key)")
def verdict_conflicts(spark, d):
    return verdict.conflicts(flows(spark, d))


@query("SELECT o.tenant, o.key, o.event_id, o.action, m.majority, m.kinds > 1 AND o.action <> m.majority AS disagrees FROM ordered o JOIN m ON m.tenant = o.tenant AND m.key = o.key",
       KEY_SQL + ", c AS (SELECT tenant, key, action, count(*) AS n, min(pos) AS p0 FROM ordered GROUP BY ALL), m AS (SELECT tenant, key, first(action ORDER BY n DESC, p0) AS majority, count(*) AS kinds FROM c GROUP BY tenant, key)")
def majority_disagreement(spark, d):
    return verdict.majority_disagreement(flow.causal_order(keyed_log(spark, d).where("key is not null")))


@query("SELECT flow_id, host, method, CAST(status AS BIGINT) AS status FROM flows WHERE tenant = 't1' AND method = 'GET' AND effective_outcome = 'blocked' AND layer_count >= 2 AND list_contains(providers, 'nginx') AND starts_with(path, '/p/1')", FLOW_SQL)
def flow_search(spark, d):
    want = search.FlowSearch(method="get", outcome="blocked", min_layers=2, provider="nginx", path_prefix="/p/1")
    return want.where(search.scoped(flows(spark, d), "t1")).select("flow_id", "host", "method", F.col("status").cast("bigint").alias("status"))


@query("SELECT flow_id, first_us FROM flows WHERE tenant = 't0' AND bridged ORDER BY first_us DESC, flow_id LIMIT 25 OFFSET 10", FLOW_SQL)
def flow_search_paged(spark, d):
    return search.FlowSearch(bridged=True, offset=10, limit=25).page(search.scoped(flows(spark, d), "t0")).select("flow_id", "first_us")


@query("SELECT flow_id, effective_outcome FROM flows WHERE tenant = 't1' AND (key = 'dd:25' OR key = 'ray:25' OR flow_id = '25')", FLOW_SQL)
def quick_find(spark, d):
    return search.FlowSearch(quick="25").where(search.scoped(flows(spark, d), "t1")).select("flow_id", "effective_outcome")


@query("SELECT flow_id, n_events, host FROM flows WHERE tenant = 't1' AND flow_id = 'flow:dd:25'", FLOW_SQL)
def flow_by_id(spark, d):
    return search.flow_by_id(flows(spark, d), "t1", "flow:dd:25").select("flow_id", "n_events", "host")


@query("SELECT flow_id, effective_outcome FROM flows WHERE tenant = 't2' AND first_us BETWEEN 1704672000000000 AND 1705276800000000 AND country IS NULL AND asn = 64502", FLOW_SQL)
def flow_search_range(spark, d):
    return search.FlowSearch(from_us=1704672000000000, to_us=1705276800000000, asn=64502).where(search.scoped(flows(spark, d), "t2")).where("country is null").select("flow_id", "effective_outcome")


for _field in ("effective_outcome", "completeness", "terminating_layer", "correlation_method"):
    _name = f"counts_by_{_field}"
    QUERIES[_name] = lambda spark, d, f=_field: stats.counts_by(flows(spark, d), f)
    ORACLE_SQL[_name] = f"WITH RECURSIVE {FLOW_SQL} SELECT coalesce({_field}, '') AS {_field}, count(*) AS n FROM flows GROUP BY ALL"


@query("SELECT count(*) AS n FROM flows WHERE bridged", FLOW_SQL)
def bridged_count(spark, d):
    return stats.filter_count(flows(spark, d), F.col("bridged"))


@query("SELECT provider, count(*) AS n FROM keyed GROUP BY provider", KEY_SQL)
def provider_event_counts(spark, d):
    return stats.provider_event_counts(flows(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE bridged) AS bridged, count(*) FILTER (WHERE correlation_method = 'heuristic') AS heuristic, count(*) FILTER (WHERE completeness = 'complete') AS complete, count(*) FILTER (WHERE effective_outcome = 'blocked') AS blocked, (count(*) - count(*) FILTER (WHERE correlation_method = 'heuristic')) / count(*) AS exact_join_ratio, round(100.0 * count(*) FILTER (WHERE effective_outcome = 'blocked') / count(*), 4) AS block_rate_pct FROM flows", FLOW_SQL)
def dashboard_summary(spark, d):
    return stats.dashboard(flows(spark, d))


@query("SELECT 'effective_outcome' AS dimension, effective_outcome AS value, count(*) AS n FROM flows GROUP BY ALL UNION ALL SELECT 'completeness', completeness, count(*) FROM flows GROUP BY ALL UNION ALL SELECT 'terminating_layer', terminating_layer, count(*) FROM flows WHERE terminating_layer IS NOT NULL GROUP BY ALL", FLOW_SQL)
def outcome_breakdown(spark, d):
    return stats.outcome_breakdown(flows(spark, d))


@query("SELECT client_ip, count(*) AS events, count(*) FILTER (WHERE effective_outcome = 'blocked') AS blocked, max(country) AS country, max(asn) AS asn FROM flows WHERE client_ip IS NOT NULL GROUP BY client_ip ORDER BY events DESC, client_ip LIMIT 10", FLOW_SQL)
def top_sources(spark, d):
    return stats.top_sources(flows(spark, d))


@query("SELECT asn, count(*) AS events, count(*) FILTER (WHERE effective_outcome = 'blocked') AS blocked, count(DISTINCT client_ip) AS sources, max(country) AS country FROM flows WHERE asn > 0 GROUP BY asn ORDER BY events DESC, asn LIMIT 10", FLOW_SQL)
def top_networks(spark, d):
    return stats.top_networks(flows(spark, d))


@query("SELECT f.flow_id, f.tenant, f.asn, n.n_name AS owner FROM flows f LEFT JOIN nation n ON n.n_nationkey = f.asn - 64500 WHERE f.asn IS NOT NULL", FLOW_SQL)
def asn_owner_lookup(spark, d):
    owners = table(spark, d, "nation").select((F.col("n_nationkey") + 64500).cast("bigint").alias("asn"), F.col("n_name").alias("owner"))
    return flows(spark, d).where("asn is not null").select("flow_id", "tenant", "asn").join(owners, "asn", "left")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_row_rate(spark, d):
    return stats.daily_rows(table(spark, d, "events")).withColumn("day", F.col("day").cast("string"))


@query("WITH day AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), rate AS (SELECT count(*) AS days, avg(n) AS r FROM day WHERE day < (SELECT max(day) FROM day) AND day >= (SELECT max(day) FROM day) - 8) SELECT days, round(r * 512.5, 3) AS bytes_per_day, round(1000000000 / (r * 512.5), 3) AS days_left, r * 512.5 <= 0 AS steady FROM rate")
def storage_forecast(spark, d):
    return stats.storage_forecast(stats.whole_day_rate(table(spark, d, "events")), 512.5, 1_000_000_000)


@query("SELECT rule_id, count(*) AS observations, round(avg(CAST(terminating AS DOUBLE)), 6) AS mean, round(coalesce(var_samp(CAST(terminating AS DOUBLE)), 0), 6) AS variance FROM log GROUP BY rule_id", LOG_SQL)
def rule_block_baseline(spark, d):
    return stats.rule_baseline(request_log(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


_BASELINE_SQL = "SELECT tenant, rule_id, count(*) AS observations, round(avg(CAST(terminating AS DOUBLE)), 6) AS mean, round(coalesce(var_samp(CAST(terminating AS DOUBLE)), 0), 6) AS variance FROM log"


@query(f"{_BASELINE_SQL} GROUP BY tenant, rule_id", LOG_SQL)
def rule_baseline_merge(spark, d):
    """The states of five parts of the log, by day, merged into those of one pass."""
    log = request_log(spark, d)
    parts = reduce(DataFrame.unionByName, [baseline.baseline_parts(log.where(F.col("r") % 5 == k), ["tenant"]) for k in range(5)])
    days = baseline.merge_baselines(parts, ["tenant"], keep_day=True)
    return baseline.as_baseline(baseline.merge_baselines(days, ["tenant"])).withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query(f"{_BASELINE_SQL} WHERE event_us >= epoch_us((SELECT date_trunc('day', make_timestamp(max(event_us))) FROM log)) - 6 * 86400000000 GROUP BY tenant, rule_id", LOG_SQL)
def rule_baseline_sliding(spark, d):
    """The last seven days of the stored states: older days have left the baseline."""
    days = baseline.baseline_parts(request_log(spark, d), ["tenant"])
    return baseline.as_baseline(baseline.merge_baselines(baseline.last_days(days, 7), ["tenant"])).withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query("SELECT b.rule_id, b.observations, round(b.mean, 6) AS mean, round(r.mean, 6) AS recent, round(CASE WHEN b.mean > 0 THEN r.mean / b.mean WHEN r.mean > 0.01 THEN CAST('inf' AS DOUBLE) ELSE 0 END, 6) AS factor, b.observations >= 100 AND CASE WHEN b.mean > 0 THEN r.mean / b.mean >= 3 ELSE r.mean > 0.01 END AS deviates FROM b2 b JOIN r2 r ON r.rule_id = b.rule_id", LOG_SQL + ", b2 AS (SELECT rule_id, count(*) AS observations, avg(CAST(terminating AS DOUBLE)) AS mean FROM log WHERE event_us < 1705622400000000 GROUP BY rule_id), r2 AS (SELECT rule_id, avg(CAST(terminating AS DOUBLE)) AS mean FROM log WHERE event_us >= 1705622400000000 GROUP BY rule_id)")
def rule_deviation(spark, d):
    log = request_log(spark, d)
    since = 1_705_622_400_000_000
    out = stats.rule_deviation(stats.rule_baseline(log.where(F.col("event_us") < since)), stats.rule_baseline(log.where(F.col("event_us") >= since)))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "recent", "factor")})


@query("SELECT count(*) AS total, round(count(*) FILTER (WHERE correlation_method = 'exact') / count(*), 6) AS exact, round(count(*) FILTER (WHERE correlation_method = 'heuristic') / count(*), 6) AS heuristic, round(count(*) FILTER (WHERE completeness = 'ambiguous') / count(*), 6) AS ambiguous, round(count(*) FILTER (WHERE len(providers) > 1) / count(*), 6) AS multi_provider, count(*) >= 100 AS meaningful FROM flows", FLOW_SQL)
def correlation_quality(spark, d):
    return stats.correlation_quality(flows(spark, d))


@query("SELECT tenant, status, n, round(n / sum(n) OVER (PARTITION BY tenant), 6) AS share FROM (SELECT tenant, CAST(status // 100 AS VARCHAR) || 'xx' AS status, count(*) AS n FROM log WHERE status IS NOT NULL GROUP BY ALL)", LOG_SQL)
def status_mix(spark, d):
    from millrace.functions.values import status_class

    return stats.shares(request_log(spark, d).where("status is not null").withColumn("status", status_class(F.col("status"))), ["tenant"], "status")


SUPPRESS_SQL = """a AS (SELECT tenant, rule_id, event_us AS at_us, row_number() OVER (PARTITION BY tenant, rule_id ORDER BY event_us, event_id) AS n, event_id FROM log WHERE action = 'blocked'),
f AS (SELECT tenant, rule_id, n, at_us AS last_us, event_id, true AS admitted FROM a WHERE n = 1 UNION ALL
SELECT a.tenant, a.rule_id, a.n, CASE WHEN a.at_us - f.last_us >= 21600000000 THEN a.at_us ELSE f.last_us END, a.event_id, a.at_us - f.last_us >= 21600000000 FROM f JOIN a ON a.tenant = f.tenant AND a.rule_id = f.rule_id AND a.n = f.n + 1)"""


@query("SELECT tenant, rule_id, event_id, admitted FROM f", LOG_SQL + ", " + SUPPRESS_SQL)
def alert_suppression(spark, d):
    rows = request_log(spark, d).where("action = 'blocked'").select("tenant", "rule_id", "event_id", F.col("event_us").alias("at_us"))
    return alerts.suppress(rows, 21_600_000_000, ("tenant", "rule_id"), "at_us", "event_id").select("tenant", "rule_id", "event_id", "admitted")


@query("SELECT 'grp_' || left(sha256('r' || chr(0) || '1' || chr(0) || tenant || chr(0) || 'flow' || chr(0) || rule_id), 24) AS grouping_key, count(*) AS n FROM flows WHERE effective_outcome = 'blocked' AND rule_id IS NOT NULL GROUP BY ALL", FLOW_SQL)
def alert_grouping(spark, d):
    rule = alerts.Detection("r", "flow", "high", "effective_outcome = 'blocked' and rule_id is not null", {}, {})
    return alerts.evaluate(flows(spark, d), rule, "rule_id", "first_us").groupBy("grouping_key").agg(F.count("*").alias("n"))


@query("SELECT provider AS source_id, max(event_us) AS last_us, CASE WHEN (SELECT max(event_us) FROM log) - max(event_us) > 600000000 THEN 'silent' ELSE 'healthy' END AS health FROM log GROUP BY provider UNION ALL SELECT 'unused', NULL, 'awaiting'", LOG_SQL)
def source_silence(spark, d):
    log = request_log(spark, d).select(F.col("provider").alias("source_id"), F.col("event_us").alias("received_us"))
    now = log.agg(F.max("received_us")).first()[0]
    sources = spark.createDataFrame([(s, True, 600_000_000) for s in ("cloudflare", "datadome", "f5asm", "nginx", "unused")], "source_id string, enabled boolean, cadence_us bigint")
    return alerts.source_health(sources, log, now).select("source_id", "last_us", "health")


@query("SELECT layer AS stage, count(*) AS inputs, count(*) FILTER (WHERE action = 'blocked' AND layer_ord < 3) AS outputs, CASE WHEN count(*) FILTER (WHERE action = 'blocked' AND layer_ord < 3) = 0 THEN 'zero_output' WHEN count(*) * 100 > 100000 THEN 'backlogged' ELSE 'healthy' END AS state FROM log GROUP BY layer", LOG_SQL)
def stage_state(spark, d):
    stages = request_log(spark, d).groupBy(F.col("layer").alias("stage")).agg(F.count("*").alias("inputs"), F.count_if((F.col("action") == "blocked") & (F.col("layer_ord") < 3)).alias("outputs"), (F.count("*") * 100).alias("backlog"))
    return alerts.stage_state(stages).drop("backlog")


@query("""SELECT subject, detection_id FROM (
SELECT tenant AS subject, 'exact_ratio' AS detection_id FROM (SELECT tenant, count(*) AS total, count(*) FILTER (WHERE correlation_method <> 'heuristic') / count(*) AS exact FROM flows GROUP BY tenant) WHERE total >= 100 AND exact < 0.80
UNION ALL SELECT provider, 'source_silence' FROM log GROUP BY provider HAVING (SELECT max(event_us) FROM log) - max(event_us) > 600000000
UNION ALL SELECT layer, 'zero_output' FROM log GROUP BY layer HAVING count(*) FILTER (WHERE action = 'blocked' AND layer_ord < 3) = 0
UNION ALL SELECT provider, 'parse_failure' FROM log GROUP BY provider HAVING count(*) FILTER (WHERE status >= 500) / count(*) > 0.01)""", FLOW_SQL)
def builtin_detections(spark, d):
    """All four: flows by tenant, sources and parse failures (here server errors) by provider, stages by layer. The log is read once, for counts by provider and layer."""
    one_of = {x.id: x for x in alerts.BUILTIN}
    total = F.count("*").alias("total")
    tenants = flows(spark, d).groupBy("tenant").agg(total, (F.count_if(F.col("correlation_method") != "heuristic") / F.count("*")).alias("exact"), F.max("last_us").alias("at_us"))
    stopped, failed = (F.col("action") == "blocked") & (F.col("layer_ord") < 3), F.col("status") >= 500
    counts = request_log(spark, d).groupBy(F.col("provider").alias("source_id"), F.col("layer").alias("stage")).agg(F.count("*").alias("records"), F.count_if(stopped).alias("outputs"), F.count_if(failed).alias("failures"), F.max("event_us").alias("received_us"))
    seen = stage(counts, "log_counts").withColumn("tenant", F.lit("t"))
    now, at = seen.agg(F.max("received_us")).first()[0], F.max("received_us").alias("at_us")
    sources = seen.select("source_id", F.lit(True).alias("enabled"), F.lit(600_000_000).alias("cadence_us")).distinct()
    sources = alerts.source_health(sources, seen, now).select("source_id", "health", F.col("last_us").alias("at_us"), F.lit("t").alias("tenant"))
    stages = seen.groupBy("tenant", "stage").agg(F.sum("records").alias("inputs"), F.sum("outputs").alias("outputs"), at)
    parsed = seen.groupBy("tenant", "source_id").agg(F.sum("records").alias("records"), F.sum("failures").alias("failures"), at)
    found = None
    for rows, name, key in ((tenants, "exact_ratio", "tenant"), (sources, "source_silence", "source_id"), (stages, "zero_output", "stage"), (parsed, "parse_failure", "source_id")):
        fired = alerts.evaluate(rows, one_of[name], key).select("subject", "detection_id")
        found = fired if found is None else found.unionByName(fired)
    return found


@query("SELECT tenant, flow_id, event_id, raw_id, pos FROM (SELECT tenant, 'flow:' || key AS flow_id, event_id, raw_id, pos FROM ordered)", KEY_SQL)
def raw_evidence(spark, d):
    raw = request_log(spark, d).select("tenant", "raw_id", "event_id")
    return search.raw_for_flow(flows(spark, d), raw).select("tenant", "flow_id", "event_id", "raw_id", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT tenant, flow_id, arg_max(version, closed_us) AS version FROM (SELECT tenant, flow_id, 1 AS version, last_us AS closed_us FROM flows UNION ALL SELECT tenant, flow_id, 2, last_us + 1000 FROM flows WHERE n_events > 2) GROUP BY ALL", FLOW_SQL)
def latest_version(spark, d):
    f = flows(spark, d)
    first = f.select("tenant", "flow_id", F.lit(1).alias("version"), F.col("last_us").alias("closed_us"))
    second = f.where("n_events > 2").select("tenant", "flow_id", F.lit(2).alias("version"), (F.col("last_us") + 1000).alias("closed_us"))
    return flow.latest_version(first.unionByName(second)).drop("closed_us")


@query("SELECT tenant, flow_id, rule, matched, caveat FROM (SELECT tenant, flow_id, 'posts' AS rule, method = 'POST' AND coalesce(status, 0) >= 300 AS matched, status IS NULL AS caveat FROM (SELECT tenant, flow_id, method, status FROM flows) UNION ALL SELECT tenant, flow_id, 'foreign', coalesce(country, '') <> 'US' AND contains(path, '/p/1'), country IS NULL FROM flows)", FLOW_SQL)
def rule_expression_match(spark, d):
    rules = {"posts": "http_request_method = 'POST' and http_response_code >= 300", "foreign": "ip_src_country <> 'US' and contains(http_request_uri_path, '/p/1')"}
    return filters.evaluate_rules(flows(spark, d), rules)


@query("SELECT client_ip, count(*) AS n FROM log WHERE CAST(split_part(client_ip, '.', 4) AS INT) BETWEEN 16 AND 31 OR client_ip = '10.0.0.7' GROUP BY client_ip", LOG_SQL)
def cidr_match(spark, d):
    return request_log(spark, d).where(filters.in_networks(F.col("client_ip"), ["10.0.0.16/28", "10.0.0.7/32"])).groupBy("client_ip").agg(F.count("*").alias("n"))


@query("SELECT tenant, count(*) AS n FROM flows WHERE tenant = 't2' GROUP BY tenant", FLOW_SQL)
def tenant_isolation(spark, d):
    return search.scoped(flows(spark, d), "t2").groupBy("tenant").agg(F.count("*").alias("n"))


@query("SELECT request_id, count(rule_id) AS matched_rules, coalesce(sum(score), 0)::BIGINT AS score, coalesce(sum(score), 0) >= 5 AS blocked FROM (SELECT event_id AS request_id, path || ' ' || method AS subject FROM log) q LEFT JOIN (VALUES ('r1', 'POST$', 3), ('r2', '/p/1[0-9]', 2), ('r3', 'h9', 5)) rules(rule_id, pattern, score) ON regexp_matches(subject, pattern) GROUP BY request_id", LOG_SQL)
def rule_table_scoring(spark, d):
    rules = spark.createDataFrame([("r1", "POST$", 3, 1), ("r2", "/p/1[0-9]", 2, 1), ("r3", "h9", 5, 1), ("r4", "p", 9, 3)], "rule_id string, pattern string, score int, paranoia int")
    return filters.score_requests(request_log(spark, d).select(F.col("event_id").alias("request_id"), F.concat_ws(" ", "path", "method").alias("subject")), rules)
