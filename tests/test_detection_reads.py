"""What the built-in detections read."""

from millrace.plans.flow_queries import QUERIES


def test_detections_read_counts_and_flows_only(spark, sf):
    found = QUERIES["builtin_detections"](spark, sf)
    assert found.inputFiles() and not [f for f in found.inputFiles() if "events.parquet" in f]
