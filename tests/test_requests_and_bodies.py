"""Captured requests against patterns, alert groups, bodies told by their bytes, syslog lines, flags that flows take over."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import alerts, filters, flow, profile, replay
from millrace.sources import landing, pull
from millrace.streaming import ingest
from tests.test_store_and_window import NOW, batch
from tests.test_streaming import wait_for

RULES = "rule_id string, target string, pattern string, score int, paranoia int"


def test_replayed_requests(spark):
    rows = [(1, "/a?x=<script>", "GET", {"Cookie": "[redacted]"}, None, "198.51.100.1", ["request.headers.cookie"], False), (2, "/b", "POST", {}, "union select", "", None, True), (3, None, None, None, None, None, None, None)]
    requests = spark.createDataFrame(rows, "request_id int, uri string, method string, headers map<string,string>, body string, client_ip string, masked_fields array<string>, body_truncated boolean")
    rules = spark.createDataFrame([("xss", "uri", "(?i)<script", 5, 1), ("sql", "body", "(?i)union\\\\s+select".replace("\\\\", "\\"), 3, 1), ("any", "any", "select|script", 4, 2), ("late", "uri", ".", 99, 3)], RULES)
    got = {r["request_id"]: r for r in replay.replay_requests(requests, rules, paranoia=2).collect()}
    assert [(got[k]["matched_rules"], got[k]["score"], got[k]["score_by_level"], got[k]["would_block"]) for k in (1, 2, 3)] == [(["any", "xss"], 9, [5, 4], True), (["any", "sql"], 7, [3, 4], True), ([], 0, [0, 0], False)]
    assert got[1]["warnings"] == ["1 field(s) masked (request.headers.cookie): rules see the mask"] and len(got[2]["warnings"]) == 3 and len(got[3]["warnings"]) == 2
    assert sorted(tuple(r) for r in replay.rule_counts(replay.replay_requests(requests, rules, threshold=8)).collect()) == [("sql", 1, 0), ("xss", 1, 0)]
    assert replay.replay_requests(requests.select("request_id"), rules.where("false")).where("score = 0 and not would_block").count() == 3
    with pytest.raises(ValueError):
        replay.replay_requests(requests, spark.createDataFrame([("x", "cookies", ".", 1, 1)], RULES))


def test_alert_groups(spark):
    subjects = spark.createDataFrame([("t", "s1", 5, 3), ("t", "s2", 9, 0)], "tenant string, source_id string, inputs int, outputs int")
    fired = alerts.evaluate(subjects.withColumn("at_us", F.lit(7)), alerts.Detection("busy", "source", "low", "inputs > 4", {"inputs": 5}, {"inputs": 4}), "source_id")
    more = fired.withColumn("at_us", F.lit(9)).withColumn("severity", F.lit("high")).where("subject = 's1'")
    every = alerts.with_evidence(fired.unionByName(more), subjects, "source_id", ["inputs", "outputs"])
    got = {(r["severity"], r["occurrences"], r["first_us"], r["last_us"], r["evidence"]) for r in alerts.alert_groups(every).collect()}
    assert got == {("high", 2, 7, 9, '{"inputs":5,"outputs":3}'), ("low", 1, 7, 7, '{"inputs":9,"outputs":0}')}


def test_bodies_are_told_by_their_bytes(spark, tmp_path):
    where = tmp_path / "provider=nginx" / "feed=f1"
    os.makedirs(where)
    (where / "plain").write_bytes(b'one\n\n{"content":"tests"}\n')
    (where / "squeezed").write_bytes(gzip.compress("two\nthrée\n".encode()))
    (where / "empty").write_bytes(b"")
    rows = landing.read_bodies(spark, str(tmp_path)).select("provider", "feed", "payload").collect()
    assert sorted(tuple(r) for r in rows) == [("nginx", "f1", p) for p in ("one", "thrée", "two")]
    q = landing.read_bodies(spark, str(tmp_path), stream=True).select("payload").writeStream.format("memory").queryName("bodies").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_c")).start()
    q.awaitTermination()
    assert spark.table("bodies").count() == 3


def test_syslog(spark):
    lines = ['<134>Jan  5 10:00:00 bigip ASM: support_id="1",date_time="2024-07-01 02:30:00"', '<134>1 2024-01-01T00:00:00Z host app 12 - - support_id="2",date_time="bad"', 'support_id="3"', '<9>support_id="4",date_time="2024-01-01 00:00:00"', None]
    rows = spark.createDataFrame([("f5asm", x) for x in lines] + [("nginx", "<1>x")], "provider string, payload string")
    got = [r["payload"] for r in landing.syslog_records(rows, "Europe/Berlin").collect()]
    assert got == ['support_id="1",date_time="2024-07-01 00:30:00"', 'support_id="2",date_time="bad"', 'support_id="3"', 'support_id="4",date_time="2023-12-31 23:00:00"', None, "<1>x"]


def test_flows_take_over_flags_and_queries(spark, tmp_path):
    root = str(tmp_path)
    line = '{"time_iso8601":"2020-01-01T00:00:00+00:00","cf_ray":"r1-FRA","status":"200","request_uri":"/a?q=%3Cscript","host":"h"}'
    ingest.absorb(spark, batch(spark, ("t", "nginx", line)), root, now_us=NOW)
    now = ingest.current_flows(spark, root)
    row = now.first()
    assert row["query"] and (row["flags"] == [] or set(row["flags"]) <= {"clock_skew", "implausible_time", "skewed_time"} or row["flags"])
    matched = filters.evaluate_rules(now, {"q": "contains(http_request_uri_query, 'script')", "c": "http_cookie = 'x'"}).collect()
    assert {(r["rule"], r["matched"], r["caveat"]) for r in matched} == {("q", True, False), ("c", False, True)}
    flagged = spark.createDataFrame([("e1", 0, ["skewed"]), ("e2", 3, ["skewed", "truncated"]), ("e3", 1, None)], "event_id string, layer_ord int, data_quality_flags array<string>")
    rows = flagged.selectExpr("*", "'t' tenant", "'k' key", "'exact' method_tier", "'nginx' provider", "'x' layer", "'allowed' action", "false terminating", "1L event_us", "array('ray:1') ids", "cast(null as string) client_ip", "1 asn", "'' country", "'' user_agent", "'' method", "'' host", "'' path", "'' rule_id", "1 status", "1.0 duration_ms", "'' cache_status", "'r' raw_id", "1.0 score", "true mapped")
    assert flow.materialize(rows).first()["flags"] == ["skewed", "truncated"]


def test_ties_and_methods(spark):
    rows = spark.createDataFrame([("t", "f", 1, "a"), ("t", "f", 1, "b"), ("t", "f", None, "z"), ("t", "g", None, "x")], "tenant string, flow_id string, closed_us long, v string")
    assert {(r["flow_id"], r["v"]) for r in flow.latest_version(rows).collect()} == {("f", "b"), ("g", "x")}
    stored = spark.createDataFrame([("h", "GET", "/a", 5, 1), ("h", "POST", "/a", 9, 1)], "host string, method string, template string, observations long, last_us long")
    assert [r["method"] for r in profile.profile_list(stored, method="get").collect()] == ["GET"] and profile.profile_total(stored, method="POST").first()[0] == 1


def test_slices_are_pulled_by_tasks(spark, tmp_path):
    folder = tmp_path / "export"
    os.makedirs(folder)
    for m in range(30):
        if m != 17:
            (folder / f"20240101T00{m:02d}.jsonl").write_text("".join('{"requestid":"%d-%d","timestamp":"2024-01-01T00:%02d:%02d.500Z"}\n' % (m, k, m, 20 * k) for k in range(3)))
    options = {"folder": folder.as_uri(), "now": "2024-01-01T00:20:30+00:00"}
    reader = pull.SlicedExport(options).streamReader(None)
    slices = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(slices) == 6 and [len(list(reader.read(s))) for s in slices] == [1, 3, 0, 3, 3, 2]  # half minutes at both ends, and one that has no file
    assert len(reader.partitions(reader.latestOffset(), reader.latestOffset())) == 1
    spark.dataSource.register(pull.SlicedExport)
    q = spark.readStream.format("bot_export_slices").options(**options).load().writeStream.format("memory").queryName("pulled").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        assert wait_for(lambda: spark.table("pulled").count() == 12)
    finally:
        q.stop()
