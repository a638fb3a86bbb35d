"""Streams: files to flows, windows, pulls, stores."""

import datetime
import gzip
import json
import os
import time

from pyspark.sql import functions as F

from millrace.sources import landing, pull, store
from millrace.streaming import ingest, profiles, window
from tests.test_functions import EDGE


def deliver(root, provider, feed, name, lines, squeeze=False):
    folder = os.path.join(root, f"provider={provider}", f"feed={feed}")
    os.makedirs(folder, exist_ok=True)
    data = "\n".join(lines).encode()
    with open(os.path.join(folder, name + (".gz" if squeeze else "")), "wb") as f:
        f.write(gzip.compress(data) if squeeze else data)


def wait_for(condition, seconds=90):
    until = time.monotonic() + seconds
    while not condition():
        if time.monotonic() > until:
            return False
        time.sleep(0.5)
    return True


ORIGIN = '{"time_iso8601":"2024-01-01T00:00:00+00:00","cf_ray":"%s-FRA","status":"200","request_uri":"/a","host":"h"}'
BOT = '{"requestid":"%s","timestamp":"2024-01-01T00:00:00.150Z","action":"allow"}'


def test_stream_of_files(spark, tmp_path):
    folder, root, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "checkpoint"))
    feeds = spark.createDataFrame([("f1", "t1", "cloudflare", True), ("f2", "t1", "nginx", True), ("f3", "t1", "datadome", True), ("off", "t1", "nginx", False)], "feed string, tenant string, provider string, enabled boolean")
    deliver(folder, "cloudflare", "f1", "a", [EDGE % ("aa1", 200, "allow", "dd-1"), '{"content":"tests"}', "", EDGE % ("bb2", 403, "block", "dd-2"), "{broken"], squeeze=True)
    deliver(folder, "nginx", "off", "a", [ORIGIN % "aa1"])
    deliver(folder, "datadome", "f3", "a", [BOT % "dd-1"])
    ingest.run(spark, folder, feeds, root, checkpoint).awaitTermination()
    flows = {r["correlation_key"]: r for r in spark.read.parquet(f"{root}/flows").collect()}
    assert set(flows) == {"dd:dd-1", "dd:dd-2"} and flows["dd:dd-1"]["n_events"] == 2 and flows["dd:dd-2"]["effective_outcome"] == "blocked"
    assert [r["payload"] for r in spark.read.parquet(f"{root}/dead_letters").collect()] == ["{broken"]
    # a straggler and a redelivery, after a restart from the checkpoint
    deliver(folder, "nginx", "f2", "b", [ORIGIN % "aa1"])
    deliver(folder, "cloudflare", "f1", "b", [EDGE % ("aa1", 200, "allow", "dd-1")])
    ingest.run(spark, folder, feeds, root, checkpoint).awaitTermination()
    flows = {r["correlation_key"]: r for r in spark.read.parquet(f"{root}/flows").collect()}
    assert flows["dd:dd-1"]["n_events"] == 3 and flows["dd:dd-1"]["providers"] == ["cloudflare", "datadome", "nginx"] and len(flows) == 2
    raw = landing.with_feeds(landing.read_landing(spark, folder), feeds)
    assert ingest.replay(spark, landing.distinct_records(raw), root, dry_run=True) == (4, 1)


def test_window_closes(spark, tmp_path):
    assert window.close_reason({0, 1, 2, 3}, set(), 4) == "all_layers" and window.close_reason({0, 1}, {1}, 4) == "terminal_complete"
    assert window.close_reason({1}, {1}, 4) is None and window.close_reason({0, 1}, set(), 4) is None
    rows = [("t", "k1", "1", 0, False), ("t", "k1", "2", 1, False), ("t", "k1", "2", 1, False), ("t", "k1", "3", 2, False), ("t", "k1", "4", 3, False), ("t", "k2", "5", 0, True), ("t", "k3", "6", 1, True)]
    path = str(tmp_path / "in")
    schema = "tenant string, key string, event_id string, layer_ord int, terminating boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    q = window.windows(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName("closed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    # timers of processing time always ask for one more batch, so the stream is stopped from outside
    closed = lambda: {(r["key"], r["reason"], r["n_events"]) for r in spark.table("closed").collect()}
    want = {("k1", "all_layers", 4), ("k2", "terminal_complete", 1)}
    assert wait_for(lambda: closed() == want) and wait_for(lambda: q.lastProgress is not None)
    q.stop()


def test_window_elapses(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "tenant string, key string, event_id string, layer_ord int, terminating boolean"
    spark.createDataFrame([("t", "k3", "6", 1, True), ("t", "k3", "7", 2, False)], schema).coalesce(1).write.parquet(path)
    q = window.windows(spark.readStream.schema(schema).parquet(path), window_ms=2000).writeStream.format("memory").queryName("elapsed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    done = wait_for(lambda: [(r["key"], r["reason"], r["n_events"]) for r in spark.table("elapsed").collect()] == [("k3", "elapsed", 2)])
    q.stop()
    assert done


SUPPORT = 'support_id="%s",request_status="blocked",date_time="2024-01-01 00:00:0%d",ip_client="198.51.100.1",host="h",method="GET",uri="/a"'
BARE = '{"time_iso8601":"2024-01-01T00:00:00+00:00","cf_ray":"-","remote_addr":"198.51.100.1","host":"h","request_method":"GET","request_uri":"/a","status":"200"}'


def batch(spark, *rows):
    return spark.createDataFrame(rows, "tenant string, provider string, payload string").withColumn("received_at", F.to_timestamp(F.lit("2024-01-01 00:00:10")))


def stored(spark, root):
    flows = store.load(spark, f"{root}/flows")
    return {(r["tenant"], r["flow_id"]): r["n_events"] for r in flows.collect()} if flows else {}


def test_tenants_that_share_an_identifier_keep_their_flows(spark, tmp_path):
    root = str(tmp_path)
    ingest.absorb(spark, batch(spark, ("A", "nginx", ORIGIN % "x1"), ("B", "nginx", ORIGIN % "x1")), root)
    assert set(stored(spark, root)) == {("A", "flow:ray:x1"), ("B", "flow:ray:x1")}
    ingest.absorb(spark, batch(spark, ("A", "cloudflare", EDGE % ("x1", 200, "allow", "dd-1"))), root)
    assert stored(spark, root) == {("A", "flow:dd:dd-1"): 2, ("B", "flow:ray:x1"): 1}
    assert [r["payload"] for r in ingest.raw_by_id(spark, root, "A", "cf:x1").collect()] == [EDGE % ("x1", 200, "allow", "dd-1")] and ingest.raw_by_id(spark, root, "B", "cf:x1").count() == 0


def test_a_cluster_that_becomes_ambiguous_leaves_no_flow(spark, tmp_path):
    root = str(tmp_path)
    ingest.absorb(spark, batch(spark, ("A", "f5asm", SUPPORT % ("z9", 1)), ("A", "nginx", BARE)), root)
    assert list(stored(spark, root).values()) == [2]
    ingest.absorb(spark, batch(spark, ("A", "f5asm", SUPPORT % ("z5", 2))), root)
    assert stored(spark, root) == {}


def test_batches_in_any_order_give_the_flows_of_one_batch(spark, tmp_path):
    rows = [("A", "cloudflare", EDGE % ("a1", 200, "allow", "d1")), ("A", "nginx", ORIGIN % "a1"), ("A", "datadome", BOT % "d1"), ("A", "nginx", ORIGIN % "b2"), ("A", "nginx", ORIGIN % "b2"), ("A", "cloudflare", (EDGE % ("far", 200, "allow", "d9")).replace("2024-01-01", "2023-12-20"))]
    ingest.absorb(spark, batch(spark, *rows), str(tmp_path / "one"))
    want = stored(spark, str(tmp_path / "one"))
    for part in (rows[3:], rows[2:4], rows[:1], rows[:3]):
        ingest.absorb(spark, batch(spark, *part), str(tmp_path / "many"))
    assert stored(spark, str(tmp_path / "many")) == want and want["A", "flow:dd:d1"] == 3


def test_tenant_filters_drop_at_ingest(spark, tmp_path):
    configs = spark.createDataFrame([("A", '[{"field":"request_host","op":"equals","values":[" H "]}]'), ("B", "{broken")], "tenant string, filters string")
    ingest.absorb(spark, batch(spark, *[(t, "nginx", ORIGIN % "q") for t in "ABC"]), str(tmp_path), configs)
    assert set(stored(spark, str(tmp_path))) == {("B", "flow:ray:q"), ("C", "flow:ray:q")}


def test_flow_profiles_count_each_flow_once(spark, tmp_path):
    rows = [("t", "f1", "h", "GET", "/a", 1, "2024-01-01 00:00:00"), ("t", "f1", "h", "GET", "/a", 1, "2024-01-01 00:00:00"), ("t", "f2", "h", "GET", "/a", 5, "2024-01-01 00:00:05")]
    schema = "tenant string, flow_id string, host string, method string, path string, last_us long, last_seen string"
    path = str(tmp_path / "flows")
    spark.createDataFrame(rows, schema).withColumn("last_seen", F.to_timestamp("last_seen")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema.replace("last_seen string", "last_seen timestamp")).parquet(path)
    profiles.run(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    seen = lambda: sorted((r["template"], r["observations"], r["last_us"]) for r in profiles.profiles(spark, str(tmp_path / "out")).collect())
    assert seen() == [("/a", 2, 5)]
    more = [("t", f"g{k}", "h", "GET", f"/u/{k}", k, "2024-01-01 00:00:09") for k in range(80)]
    spark.createDataFrame(more, schema).withColumn("last_seen", F.to_timestamp("last_seen")).coalesce(1).write.mode("append").parquet(path)
    profiles.run(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = [("/a", 2, 5), ("/u/{int}", 80, 79)]
    assert seen() == want
    profiles.compact(spark, str(tmp_path / "out"))
    assert seen() == want


def test_pull_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m, tzinfo=datetime.timezone.utc)
    assert pull.next_window(None, at(20)) == (at(15), at(20)) and pull.next_window(at(1).isoformat(), at(20)) == (at(1), at(6)) and pull.next_window(at(18).isoformat(), at(20)) == (at(18), at(20))
    path = tmp_path / "export.jsonl"
    path.write_text("\n".join(json.dumps({"requestid": str(m), "timestamp": f"2024-01-01T00:{m:02d}:00Z"}) for m in range(30)))
    reader = pull.ExportReader({"path": str(path), "now": at(20).isoformat()})
    rows, after = reader.read(reader.initialOffset())
    assert len(list(rows)) == 5 and after == {"watermark": at(20).isoformat()} and list(reader.read(after)[0]) == []
    spark.dataSource.register(pull.ExportSource)


def test_store(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("t", "a", 1, "2024-01-01"), ("t", "b", 2, "2024-01-02"), ("u", "a", 3, "2024-01-01")], "tenant string, id string, v int, day string")
    store.overwrite_by_key(spark, root, "x", df, ["tenant", "id"])
    store.overwrite_by_key(spark, root, "x", spark.createDataFrame([("t", "a", 9, "2024-01-02"), ("t", "c", 4, "2024-01-01")], df.schema), ["tenant", "id"])
    rows = lambda: sorted((r["tenant"], r["id"], r["v"], str(r["day"])) for r in spark.read.parquet(f"{root}/x").collect())
    assert rows() == [("t", "a", 9, "2024-01-02"), ("t", "b", 2, "2024-01-02"), ("t", "c", 4, "2024-01-01"), ("u", "a", 3, "2024-01-01")]
    store.delete_where(spark, root, "x", F.col("id").isin("c", "b"))
    assert rows() == [("t", "a", 9, "2024-01-02"), ("u", "a", 3, "2024-01-01")]
    audit = spark.createDataFrame([("t", 5, "x"), ("t", 6, "y"), ("u", 5, "z")], "tenant string, at_us long, what string")
    assert store.audit_export(audit, "t", 0, 10).first()["n"] == 2 and store.audit_export(audit, "v", 0, 10).count() == 0
    assert store.audit_export(audit, "t", 0, 10).first()["sha256"] == store.audit_export(audit.orderBy(F.rand(1)), "t", 0, 10).first()["sha256"]


def test_asn_owners(spark, tmp_path):
    path = tmp_path / "asn.tsv"
    path.write_text("1.0.0.0\t1.0.0.255\t13335\tUS\tFIRST\n1.1.0.0\t1.1.0.255\t13335\tUS\tSECOND\n2.0.0.0\t2.0.0.1\t0\tNone\tNot routed\n3.0.0.0\t3.0.0.1\t7\tDE\t \n")
    owners = landing.read_asn_owners(spark, str(path))
    assert [tuple(r) for r in owners.collect()] == [(13335, "FIRST")]
    stored = spark.createDataFrame([(13335, "OLD"), (5, "KEPT")], "asn long, owner string")
    assert sorted(tuple(r) for r in landing.replace_owners(stored, owners).collect()) == [(5, "KEPT"), (13335, "FIRST")]
