"""Baselines in parts, exports that show what was changed, and silence that needs no record to be seen."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import baseline, stats
from millrace.sources import audit
from millrace.streaming import health
from tests.test_streaming import wait_for

DAY = 86_400_000_000


def test_merged_baselines_equal_one_pass(spark):
    dice = random.Random(2)
    rows = [(f"r{dice.randrange(4)}", dice.random() < 0.2, DAY * 19_000 + dice.randrange(9 * DAY)) for _ in range(3000)] + [(None, True, DAY * 19_000), ("once", True, DAY * 19_003)]
    events = spark.createDataFrame(rows, "rule_id string, terminating boolean, event_us long").cache()
    whole = {r["rule_id"]: r for r in stats.rule_baseline(events).collect()}
    for seed in (1, 2):
        cut = spark.createDataFrame([(*r, random.Random(seed * 10_000 + i).randrange(6)) for i, r in enumerate(rows)], "rule_id string, terminating boolean, event_us long, part int")
        parts = None
        for k in range(6):
            one = baseline.baseline_parts(cut.where(F.col("part") == k))
            parts = one if parts is None else parts.unionByName(one)
        got = {r["rule_id"]: r for r in baseline.as_baseline(baseline.merge_baselines(baseline.merge_baselines(parts, keep_day=True))).collect()}
        assert got.keys() == whole.keys()
        for k, r in whole.items():
            assert got[k]["observations"] == r["observations"] and abs(got[k]["mean"] - r["mean"]) < 1e-9 and abs(got[k]["variance"] - r["variance"]) < 1e-9
    days = baseline.baseline_parts(events)
    late = events.where(F.timestamp_micros("event_us").cast("date") > F.date_sub(F.lit(days.agg(F.max("day")).first()[0]), 3))
    assert sorted(map(tuple, baseline.merge_baselines(baseline.last_days(days, 3)).select("rule_id", "n").collect())) == sorted(map(tuple, late.where("rule_id is not null").groupBy("rule_id").agg(F.count("*")).collect()))
    assert baseline.last_days(days, 1, "1999-01-01").count() == 0


def test_exports(spark, tmp_path):
    root, schema = str(tmp_path), "tenant string, at_us long, audit_id string, actor string"
    rows = [("a/b", 60_000_000 * (k % 3) + k, f"id{k}", None if k % 4 else "x") for k in range(50)] + [("a/b", 7, "id7", None), ("a/b", None, "no time", "x"), ("other", 5, "o", "x")]
    records = spark.createDataFrame(rows, schema)
    made = audit.export(spark, records, root, "a/b", 0, 150_000_000, 99)
    assert made["entry_count"] == 51 and [b["block"] for b in made["blocks"]] == [0, 1, 2] and made["retain_until_us"] == 99 + audit.RETAIN_DAYS * DAY
    files = sorted(glob.glob(f"{audit.place_of(spark, root, 'a/b', 0, 150_000_000)}/*/block=*/*.txt"))
    assert len(files) == 3 and audit.verify(spark, root, "a/b", 0, 150_000_000) == []
    again = audit.export(spark, records.orderBy(F.rand(3)), str(tmp_path / "two"), "a/b", 0, 150_000_000, 99)
    assert again == made  # the order of the records is not that of the export
    assert audit.export(spark, records.limit(3), root, "a/b", 0, 150_000_000, 100) == made  # written once
    os.remove(os.path.join(os.path.dirname(files[1]), f".{os.path.basename(files[1])}.crc"))  # of the local file system, which would refuse the altered file
    with open(files[1]) as f:
        lines = f.readlines()
    with open(files[1], "w") as f:
        f.writelines([lines[0].replace('"id', '"iD'), *lines[1:]])
    assert audit.verify(spark, root, "a/b", 0, 150_000_000) == [1]
    with open(files[1], "w") as f:
        f.writelines(lines[1:])
    assert audit.verify(spark, root, "a/b", 0, 150_000_000) == [1]
    assert audit.export(spark, records, root, "nobody", 0, 150_000_000, 1) is None and not glob.glob(f"{root}/audit/tenant=nobody*")
    for wrong in (("", 0, 5), ("a/b", 5, 5)):
        with pytest.raises(ValueError):
            audit.export(spark, records, root, *wrong, 1)
    with pytest.raises(ValueError):
        audit.verify(spark, root, "other", 0, 1)


def test_silence_needs_no_record(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "source_id string, cadence_us long, records long"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put(("quick", 3_000_000, 5), ("slow", 3_600_000_000, 1), ("new", 3_000_000, 0), ("loose", None, 2))
    q = health.source_changes(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    seen = lambda: [(r["source_id"], r["state"], r["before"]) for r in spark.table("changes").orderBy("at_us").collect()]
    try:
        assert wait_for(lambda: ("quick", "silent", "healthy") in seen())
        first = seen()
        assert {("slow", "healthy", None), ("new", "awaiting", None), ("loose", "healthy", None), ("quick", "healthy", None)} == set(first) - {("quick", "silent", "healthy")}
        put(("quick", None, 1))
        assert wait_for(lambda: ("quick", "recovered", "silent") in seen())
        assert wait_for(lambda: ("quick", "silent", "recovered") in seen())
        assert not any(s[0] in ("slow", "new", "loose") and s[1] == "silent" for s in seen())
        assert {(r["state"], r["severity"]) for r in health.silence_alerts(spark.table("changes")).collect()} == {("silent", "high"), ("recovered", "info")}
    finally:
        q.stop()
