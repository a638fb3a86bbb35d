"""Relational operators on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import alerts, components, correlate, filters, flow, profile, retention, search, stats, verdict
from millrace.operators.components import connected_components
from millrace.staging import stage

LOG = "event_id long, tenant string, provider string, layer string, layer_ord int, ids array<string>, action string, terminating boolean, event_us long, client_ip string, asn long, country string, user_agent string, method string, host string, path string, status int, duration_ms double, cache_status string, rule_id string, score double, mapped boolean, raw_id string"
LAYER = {"cloudflare": (0, "edge"), "datadome": (1, "bot_management"), "f5asm": (2, "app_firewall"), "nginx": (3, "origin")}


def event(i, provider, ids, us=0, action="allowed", tenant="t", **more):
    order, layer = LAYER[provider]
    base = dict(event_id=i, tenant=tenant, provider=provider, layer=layer, layer_ord=order, ids=ids, action=action, terminating=action == "blocked" and provider != "nginx", event_us=us, client_ip="1.1.1.1", asn=None, country=None, user_agent=None, method="GET", host="h", path="/", status=None, duration_ms=None, cache_status=None, rule_id=None, score=None, mapped=True, raw_id=f"r{i}")
    return base | more


def log(spark, *events):
    return spark.createDataFrame([tuple(e[c.split()[0]] for c in LOG.split(", ")) for e in events], LOG)


def test_components_of_chains_and_rings(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 5), (300, 301), (300, 301)]
    random.Random(1).shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100, 102: 100, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_join_is_transitive_and_order_free(spark, seed):
    rows = [event(1, "cloudflare", ["ray:a", "dd:x"]), event(2, "datadome", ["dd:x"]), event(3, "nginx", ["ray:a"]), event(4, "nginx", ["ray:b"]), event(5, "cloudflare", ["ray:c", "ray:a"]), event(6, "nginx", []), event(7, "nginx", ["ray:a"], tenant="u")]
    random.Random(seed).shuffle(rows)
    keyed = correlate.exact_keys(log(spark, *rows))
    assert {r["event_id"]: r["key"] for r in keyed.collect()} == {1: "dd:x", 2: "dd:x", 3: "dd:x", 4: "ray:b", 5: "dd:x", 7: "ray:a"}
    got = {(r["tenant"], r["key"]): r["bridged"] for r in correlate.exact_components(keyed).collect()}
    assert got == {("t", "dd:x"): True, ("t", "ray:b"): False, ("u", "ray:a"): False}


def test_heuristic_join(spark):
    second = 1_000_000
    rows = [event(1, "cloudflare", [], 0), event(2, "nginx", [], 5 * second), event(3, "nginx", [], 100 * second), event(4, "f5asm", [], 200 * second), event(5, "f5asm", [], 201 * second), event(6, "nginx", [], 0, host=None)]
    got = {r["event_id"]: (r["key"], r["ambiguous"]) for r in correlate.heuristic_keys(log(spark, *rows)).collect()}
    assert got == {1: ("heur:1", False), 2: ("heur:1", False), 4: ("heur:4", True), 5: ("heur:4", True)}


def test_flow(spark):
    rows = [
        event(1, "cloudflare", ["ray:a", "dd:x"], 100_000, "allowed", duration_ms=10.0, status=200, user_agent="ua"), event(2, "datadome", ["dd:x"], 150_000, "logged"), event(3, "f5asm", ["ray:a"], 0, "blocked", rule_id="7", asn=5), event(3, "f5asm", ["ray:a"], 0, "blocked", rule_id="7"),
        event(4, "cloudflare", ["ray:b"], cache_status="HIT"), event(5, "cloudflare", ["ray:c"], action="logged"), event(6, "cloudflare", ["ray:d"], action="blocked"),
    ]
    got = {r["correlation_key"]: r for r in flow.materialize(correlate.correlate(log(spark, *rows))).collect()}
    a, b, c, d = (got[k] for k in ("dd:x", "ray:b", "ray:c", "ray:d"))
    assert (a["n_events"], a["effective_outcome"], a["terminating_layer"], a["completeness"], a["layers_missing"], a["skew_ms"], a["bridged"], a["rule_id"], a["asn"], a["ms_edge"], a["status"]) == (3, "blocked", "app_firewall", "complete", [], 150, True, "7", 5, 10.0, 200)
    assert [e["event_id"] for e in a["events"]] == [1, 2, 3] and a["flags"] == ["clock_skew", "bridged"] and a["ray_ids"] == ["ray:a"] and a["vendor_request_ids"] == ["dd:x"]
    assert (b["completeness"], b["effective_outcome"]) == ("complete", "allowed")
    assert (c["completeness"], c["layers_missing"]) == ("partial", ["bot_management", "app_firewall", "origin"])
    assert (d["completeness"], d["terminating_layer"]) == ("complete", "edge")
    assert {r["kind"] for r in verdict.conflicts(flow.materialize(correlate.correlate(log(spark, *rows)))).where("flow_id = 'flow:dd:x'").collect()} == {"layer_disagreement", "blocked_after_allow"}


def test_late_events_amend(spark):
    keyed = lambda *e: log(spark, *e).withColumn("key", F.lit("k")).withColumn("method_tier", F.lit("exact"))
    merged = flow.merge_late(keyed(event(1, "cloudflare", ["ray:a"], action="allowed")), keyed(event(1, "cloudflare", ["ray:a"], action="blocked"), event(2, "nginx", ["ray:a"])))
    assert sorted((r["event_id"], r["action"], r["amended"]) for r in merged.collect()) == [(1, "allowed", True), (2, "allowed", True)]


def test_search(spark):
    rows = [event(k, "cloudflare", [f"ray:{k}"], k * 1_000_000, path=f"/p/{k}", country="DE") for k in range(1, 8)] + [event(9, "cloudflare", ["ray:9"], tenant="other")]
    flows = flow.materialize(correlate.correlate(log(spark, *rows)))
    mine = search.scoped(flows, "t")
    ids = lambda df: [r["correlation_key"] for r in df.collect()]
    assert ids(search.FlowSearch(limit=2, offset=1).page(mine)) == ["ray:6", "ray:5"]
    assert ids(search.FlowSearch(quick="3").where(mine)) == ["ray:3"] and ids(search.FlowSearch(path_prefix="/p/4", country="de").where(mine)) == ["ray:4"]
    assert sorted(ids(search.FlowSearch(from_us=2_500_000, to_us=4_000_000).where(mine))) == ["ray:2", "ray:3", "ray:4"]
    for bad in ("a\n", "x'y", "a*"):
        with pytest.raises(search.UnsafeValue) as e:
            search.FlowSearch(host=bad)
        assert bad not in str(e.value)
    with pytest.raises(ValueError):
        search.scoped(flows, "")
    with pytest.raises(ValueError):
        search.FlowSearch(offset=-1)
    assert "tenant" in mine._jdf.queryExecution().optimizedPlan().toString()


def test_alerts(spark):
    for detection in alerts.BUILTIN:
        alerts.validate(spark, detection)
    with pytest.raises(ValueError):
        alerts.validate(spark, alerts.Detection("x", "k", "low", "a > 0", {"a": 1}, {"a": 2}))
    minute = 60_000_000
    rows = [("t", "g", f"a{k}", m * minute) for k, m in enumerate([0, 5, 14, 15, 16, 29, 30, 100, 100])]
    got = alerts.suppress(spark.createDataFrame(rows, "tenant string, grouping_key string, alert_id string, at_us long")).collect()
    assert sorted(r["alert_id"] for r in got if r["admitted"]) == ["a0", "a3", "a6", "a7"] and len(got) == len(rows)


def test_rate_limit_counts_allowed_hits_only(spark):
    rows = [("a", k, t) for k, t in enumerate([0, 1, 2, 3, 59, 60, 61, 62, 62])] + [("b", 0, 5), ("b", 1, None)]
    got = alerts.rate_limit(spark.createDataFrame(rows, "key string, hit_id long, at_us long"), limit=2, window_us=60).collect()
    assert sorted((r["key"], r["hit_id"]) for r in got if r["allowed"]) == [("a", 0), ("a", 1), ("a", 5), ("a", 6), ("b", 0)] and len(got) == len(rows)


def test_rules_are_made_of_allowed_pieces(spark):
    flows = flow.materialize(correlate.correlate(log(spark, event(1, "cloudflare", ["ray:a"], country=None, status=None))))
    rules = {"a": "ip_src_country <> 'US' and http_host in ('h', 'x')", "b": "not (http_response_code between 200 and 299) or contains(lower(http_host), 'H')", "c": "ssl = true", "d": "http_host = 'it''s -- reflect('"}
    got = {r["rule"]: (r["matched"], r["caveat"]) for r in filters.evaluate_rules(flows, rules).collect()}
    assert got == {"a": (True, True), "b": (True, True), "c": (False, True), "d": (False, False)}
    for bad in ("reflect('java.lang.System','getProperty','user.name') = 'root'", "java_method('a','b') is null", "flow_id = 'x'", "http_host = (select 1)", "`http_host` = 'x'", "http_host('x')", "http_host = 'x' -- c", "1 = 1; drop", "http_host = \"x\"", "exists (http_host)", "http_host[0] = 'x'"):
        with pytest.raises(filters.ForbiddenRule):
            filters.evaluate_rules(flows, {"bad": bad})


def test_profile_config_fails_closed():
    good = '{"enabled": true, "hosts": ["*.example.com"], "excluded_paths": ["/health"]}'
    assert filters.profile_config(good) == {"enabled": True, "hosts": ["*.example.com"], "excluded_paths": ["/health"]}
    for bad in (None, "", "{broken", "[]", '{"enabled": true, "hosts": ["a.*.com"]}', '{"enabled": true, "excluded_paths": ["health"]}', '{"enabled": true, "hosts": ["h"]}'.replace('["h"]', str([f"h{k}" for k in range(201)]).replace("'", '"'))):
        assert filters.profile_config(bad)["enabled"] is False


def test_conflicts_by_event(spark):
    rows = [event(1, "cloudflare", ["ray:a", "dd:x"], score=5.0), event(2, "datadome", ["dd:x"], score=5.0), event(3, "f5asm", ["ray:a"], action="blocked", mapped=False), event(4, "nginx", ["ray:a"], mapped=False)]
    got = sorted((r["kind"], r["severity"], r["layers"]) for r in verdict.conflict_events(flow.materialize(correlate.correlate(log(spark, *rows)))).collect())
    assert got == [("blocked_after_allow", "high", ["edge", "app_firewall"]), ("layer_disagreement", "medium", ["edge", "bot_management", "origin", "app_firewall"]), ("score_conflict", "low", ["edge"]), ("score_conflict", "medium", ["bot_management"]), ("unmapped_action", "low", ["app_firewall"]), ("unmapped_action", "low", ["origin"])]


def test_deep_paths_are_templated(spark):
    paths = ["/" + "/".join(["d"] * 40) + f"/{k}" for k in range(80)]
    out = profile.learn_templates(spark.createDataFrame([("s", p) for p in paths] + [(None, None)], "scope string, path string"), ["scope"])
    assert {r["template"]: r["count"] for r in out.groupBy("template").count().collect()} == {"/" + "/".join(["d"] * 40) + "/{int}": 80, None: 1}


def test_storage_used(spark):
    lines = [(1, 'vl_data_size_bytes{type="a"} 30'), (2, 'vl_data_size_bytes{type="b"} 45'), (3, "vl_free_disk_space_bytes 9"), (4, "vl_free_disk_space_bytes 25"), (5, "other 7")]
    row = stats.used_percent(stats.scrape_metrics(spark.createDataFrame(lines, "line_no long, value string"))).first()
    assert (row["data_bytes"], row["free_bytes"], row["used_pct"]) == (75.0, 25.0, 75.0)


def test_filters(spark):
    rows = [("A.Example.com", "/x"), ("example.com:80", "/health"), (None, "/x"), ("evil-example.com", "/x")]
    df = spark.createDataFrame(rows, "host string, path string")
    dropped = filters.drop_filter([{"field": "request_host", "op": "equals", "values": ["a.example.com"]}, {"field": "request_path", "op": "suffix", "values": ["LTH"]}])
    assert [r[0] for r in df.select(dropped).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(filters.host_allowed(F.col("host"), ["*.example.com"])).collect()] == [True, True, False, False]
    for rules in ([{"field": "request_host", "op": "equals", "values": [" "]}], [{"field": "request_host", "op": "equals", "values": ["x"]}] * 65):
        with pytest.raises(ValueError):
            filters.drop_filter(rules)
    ips = spark.createDataFrame([("10.0.0.5",), ("10.0.1.5",), ("300.1.1.1",), (None,)], "ip string")
    assert [r[0] for r in ips.select(filters.in_networks(F.col("ip"), ["10.0.0.0/24"])).collect()] == [True, False, False, False]


def test_templates(spark):
    paths = [f"/job/{k}" for k in range(100)] + ["/job/search"] * 5 + ["/health"] * 10 + [f"/u/{k:08x}-aaaa-bbbb-cccc-{k:012x}/edit" for k in range(70)] + [f"/few/{k % 4}" for k in range(100)] + [f"/mix/name{k}x" for k in range(300)]
    random.Random(3).shuffle(paths)
    out = profile.learn_templates(spark.createDataFrame([("s", p) for p in paths], "scope string, path string"), ["scope"])
    got = {r["template"]: r["count"] for r in out.groupBy("template").count().collect()}
    assert got == {"/job/{int}": 100, "/job/search": 5, "/health": 10, "/u/{uuid}/edit": 70, "/mix/{var}": 300} | {f"/few/{k}": 25 for k in range(4)}


def test_retention(spark):
    parts = spark.createDataFrame([("t", "2024-01-01", "expired"), ("t", "2024-02-01", "expired"), ("u", "2024-01-01", "expired"), ("t", "2024-03-01", "hot")], "tenant string, day string, tier string").withColumn("day", F.to_date("day"))
    holds = spark.createDataFrame([("t", "h2", "2024-01-01", None, None), ("t", "h1", None, "2024-01-01", None), ("u", "h3", None, None, "2024-05-05")], "tenant string, hold_id string, from_day string, to_day string, released_at string").withColumns({c: F.to_date(c) for c in ("from_day", "to_day")})
    assert {(r["tenant"], str(r["day"])): r["hold_id"] for r in retention.held_by(parts, holds).collect()} == {("t", "2024-01-01"): "h1", ("t", "2024-02-01"): "h2", ("t", "2024-03-01"): "h2", ("u", "2024-01-01"): None}
    assert [(r["tenant"], str(r["day"])) for r in retention.expire(parts, holds).collect()] == [("u", "2024-01-01")]
    for policy in ((0, 1, 1), (1, -1, 1), (10, 30, 1)):
        with pytest.raises(ValueError):
            retention.validate_policy(*policy)


def test_dashboard_of_nothing(spark):
    empty = flow.materialize(correlate.correlate(log(spark)))
    row = stats.dashboard(empty).first()
    assert (row["total"], row["exact_join_ratio"], row["block_rate_pct"]) == (0, 1.0, 0.0)


def test_flows_are_moved_once(spark):
    rows = [event(1, "cloudflare", ["ray:a"], 5), event(2, "nginx", ["ray:a"], 1), event(2, "nginx", ["ray:a"], 1, asn=7), event(None, "f5asm", ["ray:a"]), event(None, "f5asm", ["ray:a"])]
    made = flow.materialize(log(spark, *rows).withColumn("key", F.lit("k")).withColumn("method_tier", F.lit("exact")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    row = made.first()
    assert (row["n_events"], [(e["pos"], e["event_id"]) for e in row["events"]], row["asn"]) == (3, [(1, 1), (2, None), (3, 2)], 7)


def test_correlation_reads_the_log_twice_and_lists_no_event_twice(spark):
    rows = [event(1, "cloudflare", [], 0), event(2, "nginx", [], 1), event(2, "nginx", [], 1, host=None), event(3, "nginx", [], 0, host=None), event(3, "nginx", [], 0, host=None), event(4, "nginx", [], None), event(5, "f5asm", [], 0, path="/x"), event(6, "nginx", ["ray:a"])]
    out = correlate.correlate(log(spark, *rows))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    got = sorted((r["event_id"], r["host"], r["key"], r["method_tier"]) for r in out.where("host is not null").collect())
    assert got == [(1, "h", "heur:1", "heuristic"), (2, "h", "heur:1", "heuristic"), (4, "h", None, "none"), (5, "h", None, "none"), (6, "h", "ray:a", "exact")]
    assert sorted((r["event_id"], r["key"]) for r in out.where("host is null").collect()) == [(3, None), (3, None)]


def test_stars_take_one_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "stage", lambda df, name: written.append(name) or stage(df, name))
    got = dict(connected_components(spark.createDataFrame([(1, 2), (3, 1), (5, 4), (None, 9), (7, 7)], "a long, b long"), "a", "b").collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and len(written) == 2
