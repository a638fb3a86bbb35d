"""What the store and the stream must keep: rows without a day, odd tenant names, filtered records, replays, open and closed flows, restarts."""

import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import filters
from millrace.sources import store
from millrace.streaming import dead_letters, ingest, window
from tests.test_functions import EDGE
from tests.test_streaming import BOT, ORIGIN, wait_for

UNTIMED = '{"RayID":"%s","ClientRequestHost":"h","ClientRequestURI":"/a","ClientRequestMethod":"GET","EdgeResponseStatus":200}'
NOW = 1_700_000_000_000_000
HOUR = 3_600_000_000


def batch(spark, *rows, received="2024-01-01 00:00:10"):
    return spark.createDataFrame(rows, "tenant string, provider string, payload string").withColumn("received_at", F.to_timestamp(F.lit(received)))


def flows(spark, root):
    df = store.load(spark, f"{root}/flows")
    return {(r["tenant"], r["flow_id"]): r["n_events"] for r in df.collect()} if df else {}


def same_flows(spark, root):
    """The log's last versions are the table."""
    now = {(r["tenant"], r["flow_id"]): r["n_events"] for r in ingest.current_flows(spark, root).collect()}
    assert now == flows(spark, root)
    return now


def test_events_without_a_time_are_kept(spark, tmp_path):
    root = str(tmp_path)
    ingest.absorb(spark, batch(spark, ("t", "cloudflare", UNTIMED % "n0"), ("t", "cloudflare", UNTIMED % "n1")), root, now_us=NOW)
    ingest.absorb(spark, batch(spark, ("t", "cloudflare", UNTIMED % "n2"), ("t", "cloudflare", EDGE % ("a1", 200, "allow", "d1")), ("t", "cloudflare", UNTIMED % "n0")), root, now_us=NOW + 1)
    assert same_flows(spark, root) == {("t", f"flow:{k}"): 1 for k in ("ray:n0", "ray:n1", "ray:n2", "dd:d1")}


def test_rows_without_a_day_are_replaced_by_key(spark, tmp_path):
    root, schema = str(tmp_path), "tenant string, id string, v int, day date"
    put = lambda *rows, **how: store.overwrite_by_key(spark, root, "x", spark.createDataFrame(rows, schema), ["tenant", "id"], **how)
    rows = lambda: sorted((r["tenant"], r["id"], r["v"]) for r in store.load(spark, f"{root}/x").collect())
    put(("t", "a", 1, None))  # a table whose only day is null
    put(("t", "b", 2, None))
    put(("t", "c", 3, None), ("7", "d", 4, None))
    assert rows() == [("7", "d", 4), ("t", "a", 1), ("t", "b", 2), ("t", "c", 3)]
    gone = spark.createDataFrame([("t", "b")], "tenant string, id string")
    put(("t", "a", 9, None), gone=gone, within=spark.createDataFrame([("t", None)], "tenant string, day date"))
    assert rows() == [("7", "d", 4), ("t", "a", 9), ("t", "c", 3)]
    store.delete_where(spark, root, "x", F.col("id") == "c")
    assert rows() == [("7", "d", 4), ("t", "a", 9)]


@pytest.mark.parametrize("tenant", ["a:b/c", "x=y%20", "ü #?", "t.1"])
def test_tenants_of_any_name_are_deleted(spark, tmp_path, tenant):
    root, schema = str(tmp_path), "tenant string, id string, day string"
    store.overwrite_by_key(spark, root, "x", spark.createDataFrame([(tenant, "a", "2024-01-01"), (tenant, "b", "2024-01-02"), ("other", "a", "2024-01-01")], schema), ["tenant", "id"])
    store.delete_keys(spark, root, "x", spark.createDataFrame([(tenant, "a")], "tenant string, id string"), ["tenant", "id"])
    assert sorted((r["tenant"], r["id"]) for r in store.load(spark, f"{root}/x").collect()) == sorted([(tenant, "b"), ("other", "a")])
    store.delete_where(spark, root, "x", F.col("tenant") == tenant)
    assert [(r["tenant"], r["id"]) for r in store.load(spark, f"{root}/x").collect()] == [("other", "a")]


def test_filters_hold_for_evidence_and_for_replays(spark, tmp_path):
    root = str(tmp_path)
    rules = json.dumps([{"field": "request_path", "op": "prefix", "values": ["/a"]}])
    configs = spark.createDataFrame([("A", rules), ("E", json.dumps([{"field": "request_host", "op": "equals", "values": [" "]}])), ("U", json.dumps([{"field": "cookie", "op": "equals", "values": ["h"]}])), ("M", json.dumps([{"field": "request_host", "op": "equals", "values": ["h"]}] * 65))], "tenant string, filters string")
    rows = batch(spark, *[(t, "nginx", ORIGIN % "q") for t in "ABEUM"])
    ingest.absorb(spark, rows, root, configs, now_us=NOW, flows=False)
    want = set("BEUM")  # a config that breaks a limit keeps everything
    assert {r["tenant"] for r in store.load(spark, f"{root}/raw").collect()} == want and {r["tenant"] for r in ingest.stored_events(spark, root).collect()} == want
    assert ingest.replay(spark, rows, root, configs=configs, now_us=NOW + 1) == (5, 0)
    assert {t for t, _ in flows(spark, root)} == want and {r["tenant"] for r in store.load(spark, f"{root}/raw").collect()} == want
    assert ingest.replay_range(spark, root, "nginx", 1_704_067_000_000_000, 1_704_068_000_000_000, dry_run=True) == (4, 0) and ingest.replay_range(spark, root, "nginx", 0, 9, dry_run=True) == (0, 0)
    with pytest.raises(ValueError):
        ingest.replay_range(spark, root, "nginx", 5, 5)


def test_checked_rules(spark):
    some = [{"field": "request_host", "op": "suffix", "values": [" A.Example ", ""]}]
    got = spark.createDataFrame([(json.dumps(some),), ("[]",), ("{broken",), (None,), (json.dumps([{"field": "request_host", "op": "regex", "values": ["a"]}]),)], "f string").select(filters.checked_rules(F.col("f")).alias("r")).collect()
    assert [r["r"] and [tuple(x) for x in r["r"]] for r in got] == [[("request_host", "suffix", ["a.example"])], [], None, None, None]


def test_dead_letters_have_states(spark, tmp_path):
    root = str(tmp_path)
    ingest.absorb(spark, batch(spark, ("t", "cloudflare", "{broken"), ("t", "cloudflare", '{"x":1}'), ("u", "nginx", "also broken")), root, now_us=NOW)
    state = lambda: {r["payload"]: (r["state"], r["attempts"]) for r in dead_letters.states(spark, root).collect()}
    assert state() == {"{broken": ("pending", 0), '{"x":1}': ("pending", 0), "also broken": ("pending", 0)}
    assert dead_letters.replay(spark, root, dry_run=True) == dead_letters.Replayed(3, 0, 3, 0) and not store.load(spark, f"{root}/dead_letter_moves")
    # a parser that has learned to read one of them; the others fail again and stay
    fixed = dict(ingest.PARSERS) | {"cloudflare": lambda raw: ingest.PARSERS["cloudflare"](raw.withColumn("payload", F.when(F.col("payload") == '{"x":1}', EDGE % ("f1", 200, "allow", "d1")).otherwise(F.col("payload")))).withColumn("payload", F.when(F.col("parse_error").isNull(), '{"x":1}').otherwise(F.col("payload")))}
    assert dead_letters.replay(spark, root, tenant="t", parsers=fixed, max_attempts=2, now_us=NOW + 1) == dead_letters.Replayed(2, 1, 1, 0)
    assert state() == {"{broken": ("pending", 1), '{"x":1}': ("reprocessed", 0), "also broken": ("pending", 0)} and flows(spark, root) == {("t", "flow:dd:d1"): 1}
    assert dead_letters.replay(spark, root, tenant="t", parsers=fixed, max_attempts=2, now_us=NOW + 2) == dead_letters.Replayed(1, 0, 1, 1)
    dead_letters.abandon(spark, root, dead_letters.states(spark, root), NOW + 3)
    assert state() == {"{broken": ("abandoned", 2), '{"x":1}': ("reprocessed", 0), "also broken": ("abandoned", 0)}
    assert dead_letters.replay(spark, root) == dead_letters.Replayed(0, 0, 0, 0)


def test_a_late_bridge_moves_flows_and_a_long_flow_stays_whole(spark, tmp_path):
    root = str(tmp_path)
    step = lambda k, *rows: ingest.absorb(spark, batch(spark, *[("t", *r) for r in rows]), root, now_us=NOW + k * HOUR)
    step(0, ("nginx", ORIGIN % "z1"), ("datadome", BOT % "d1"))
    step(1, ("nginx", (ORIGIN % "z1").replace('"/a"', '"/b"')))  # an hour later, in another partition of the log
    assert same_flows(spark, root) == {("t", "flow:ray:z1"): 2, ("t", "flow:dd:d1"): 1}
    step(2, ("cloudflare", EDGE % ("z1", 200, "allow", "d1")))  # joins both keys; the first events are two hours back
    assert same_flows(spark, root) == {("t", "flow:dd:d1"): 4}
    row = store.load(spark, f"{root}/flows").first()
    assert (row["first_arrival_us"], row["last_arrival_us"], row["amended"]) == (NOW, NOW + 2 * HOUR, True)
    log = store.load(spark, f"{root}/flow_log")
    assert [(r["flow_id"], r["version"]) for r in log.where("gone").collect()] == [("flow:ray:z1", NOW + 2 * HOUR)]
    # what a batch looks up does not grow with what is stored
    hours = ingest.recent_hours(spark, root, NOW + 2 * HOUR)
    assert hours.count() == 3 and ingest.recent_hours(spark, root, NOW + 900 * HOUR).count() == 2


def follow(spark, root, checkpoint, **how):
    return window.run(spark, root, str(checkpoint), **how)


def state_of(spark, root):
    now = ingest.current_flows(spark, root)
    return {} if now is None else {r["flow_id"]: (r["state"], r["completeness"], r["n_events"], r["amended"]) for r in now.collect()}


def settled(spark, root):
    """The flow table, or None while it is being rewritten."""
    try:
        return flows(spark, root)
    except Exception as e:
        assert "FILE_NOT_EXIST" in str(e) or "does not exist" in str(e) or "PATH_NOT_FOUND" in str(e)


def test_flows_open_close_and_are_amended(spark, tmp_path):
    root = str(tmp_path / "store")
    put = lambda *rows: ingest.absorb(spark, batch(spark, *[("t", *r) for r in rows]), root, flows=False)
    put(("cloudflare", EDGE % ("g1", 200, "allow", "d1")), ("cloudflare", EDGE % ("s1", 403, "block", "d2")), ("nginx", ORIGIN % "z1"), ("cloudflare", EDGE % ("g1", 200, "allow", "d1")))
    q = follow(spark, root, tmp_path / "c", window_ms=600_000)
    try:
        # a gap stays open, a flow that its edge has stopped is as whole as it will be
        assert wait_for(lambda: len(state_of(spark, root)) == 3)
        assert state_of(spark, root) == {"flow:dd:d1": ("open", "complete", 1, False), "flow:dd:d2": ("closed", "complete", 1, False), "flow:ray:z1": ("open", "complete", 1, False)}
        put(("cloudflare", EDGE % ("z1", 200, "allow", "d1")), ("datadome", BOT % "d2"))  # joins two open flows; a straggler for the closed one
        want = {"flow:dd:d1": ("open", "complete", 3, False), "flow:dd:d2": ("closed", "complete", 2, True)}
        assert wait_for(lambda: state_of(spark, root) == want), state_of(spark, root)
        assert wait_for(lambda: settled(spark, root) == {("t", "flow:dd:d1"): 3, ("t", "flow:dd:d2"): 2})  # the table follows its log
        closed = store.load(spark, f"{root}/flow_log").where("flow_id = 'flow:dd:d2'").select("closed_us").distinct().count()
        assert closed == 1  # an amended flow keeps its closing time
    finally:
        q.stop()
    # restored with a shorter window, the open flow's time is over: partial, with the gaps named
    q = follow(spark, root, tmp_path / "c2", window_ms=1, snapshot=window.state_snapshot(spark, str(tmp_path / "c")))
    try:
        assert wait_for(lambda: state_of(spark, root).get("flow:dd:d1") == ("closed", "partial", 3, False)), state_of(spark, root)
    finally:
        q.stop()
    row = ingest.current_flows(spark, root).where("flow_id = 'flow:dd:d1'").first()
    assert row["layers_missing"] == ["bot_management", "app_firewall"] and len(state_of(spark, root)) == 2


def test_a_restart_resumes_a_flow(spark, tmp_path):
    root = str(tmp_path / "store")
    put = lambda *rows: ingest.absorb(spark, batch(spark, *[("t", *r) for r in rows]), root, flows=False)
    put(("cloudflare", EDGE % ("g1", 200, "allow", "d1")))
    for k in range(2):
        q = follow(spark, root, tmp_path / "c", layers=(0, 3))
        try:
            assert wait_for(lambda: state_of(spark, root) == {"flow:dd:d1": (("open", "complete", 1, False), ("closed", "complete", 2, False))[k]})  # noqa: B023
        finally:
            q.stop()
        if not k:
            put(("nginx", ORIGIN % "g1"), ("cloudflare", EDGE % ("g1", 200, "allow", "d1")))  # one of them again


def test_input_of_one_batch_is_folded_in_order():
    assert window.close_reason({0, "other", 2}, set(), 3) == "all_layers" and window.close_reason({0, 1, 3}, {2}, 9) is None and time.time() > 0
