"""The late-arrival window over the log of keyed events, with the flows it opens, closes and amends.

A flow opens with its first arrival. It closes when all expected layers are there, when the
layers down to the shallowest terminating one are there, or when its time is over, which later
arrivals do not prolong. A straggler amends a closed flow, which keeps its closing time, until
the horizon is over. When a flow's events move to another key, the flow ends in a tombstone and
the other one takes them in with the times at which they had arrived.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.flow import materialize
from millrace.sources.store import schema_of
from millrace.staging import discard, stage
from millrace.streaming import ingest
from millrace.streaming.batches import brief

WINDOW_MS = 900_000
HORIZON_MS = 3_600_000
INPUT = "tenant string, key string, version long, event_id string, arrival_us long, layer string, layer_ord int, terminating boolean, at_us long, payload string"
VERSIONS = "tenant string, key string, status string, reason string, first_us long, last_us long, closed_us long, amended boolean, at_us long, was_at_us long, n_events int, events string"
EVENT_STATE = "arrival_us long, layer string, layer_ord int, terminating boolean, at_us long, payload string"
FLOW_STATE = "closed_us long, at_us long, reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def close_reason(layers: set, stops: set[int], expected: int) -> str | None:
    """layers: the places of the layers seen, or their names where they have none; stops: the places of terminating events."""
    if len(layers) >= expected:
        return "all_layers"
    if stops and set(range(min(stops) + 1)) <= layers:
        return "terminal_complete"
    return None


class LateArrivalWindow(StatefulProcessor):
    """Per (tenant, key): the events by id, and when the flow closed and where its last version was dated."""

    def __init__(self, window_ms: int = WINDOW_MS, expected: int = 4, horizon_ms: int = HORIZON_MS):
        self.window_ms, self.expected, self.horizon_ms = window_ms, expected, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_id string", EVENT_STATE)
        self.flow = handle.getValueState("flow", FLOW_STATE)

    def _timer(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(at_ms))

    def _held(self) -> dict:
        return {k[0]: v for k, v in self.events.iterator()} if self.events.exists() else {}

    def _version(self, key, status: str, held: dict, closed, reason, amended: bool, was) -> pd.DataFrame:
        arrived, at = [v[0] for v in held.values()], [v[4] for v in held.values() if v[4] is not None]
        first = min(at, default=None)
        if status != "moved":
            self.flow.update((closed, first, reason))
        payloads = json.dumps([json.loads(held[k][5]) for k in sorted(held)]) if held else None
        row = (key[0], key[1], status, reason, min(arrived, default=None), max(arrived, default=None), closed, amended, first, was, len(held), payloads)
        return pd.DataFrame([row], columns=[c.split()[0] for c in VERSIONS.split(", ")]).astype({"first_us": "Int64", "last_us": "Int64", "closed_us": "Int64", "at_us": "Int64", "was_at_us": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        closed, was, reason = self.flow.get() if self.flow.exists() else (None, None, None)
        arrivals = sorted((r for batch in rows for r in batch.itertuples(index=False)), key=lambda r: (r.version, r.event_id is not None))
        held, grown, moved = self._held(), False, False
        for r in arrivals:
            if r.event_id is None:  # all events have gone to another key
                moved, held, grown = moved or bool(held), {}, False
                self.events.clear()
                self.flow.clear()
            elif r.event_id not in held:
                none = lambda v: None if pd.isna(v) else v
                held[r.event_id] = (now_ms * 1000 if pd.isna(r.arrival_us) else int(r.arrival_us), none(r.layer), None if pd.isna(r.layer_ord) else int(r.layer_ord), bool(r.terminating), None if pd.isna(r.at_us) else int(r.at_us), r.payload)
                self.events.updateValue((r.event_id,), held[r.event_id])
                grown = True
        if moved:
            yield self._version(key, "moved", {}, None, None, False, was)
            closed, was, reason = None, None, None
        if not held:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        elif grown:
            yield from self._grown(key, held, closed, was, reason, now_ms)

    def _grown(self, key, held, closed, was, reason, now_ms) -> Iterator[pd.DataFrame]:
        if closed is not None:
            yield self._version(key, "closed", held, closed, reason, True, was)
            return
        reason = close_reason({v[1] if v[2] is None else v[2] for v in held.values()}, {v[2] for v in held.values() if v[3] and v[2] is not None}, self.expected)
        if reason:
            yield self._close(key, held, reason, was, now_ms)
        else:
            self._timer(min(v[0] for v in held.values()) // 1000 + self.window_ms)
            yield self._version(key, "open", held, None, None, False, was)

    def _close(self, key, held, reason, was, now_ms) -> pd.DataFrame:
        self._timer(now_ms + self.horizon_ms)
        return self._version(key, "closed", held, now_ms * 1000, reason, False, was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, was, _ = self.flow.get() if self.flow.exists() else (None, None, None)
        if closed is None:
            held = self._held()
            if held:
                yield self._close(key, held, "elapsed", was, timerValues.getCurrentProcessingTimeInMs())
        else:  # the horizon is over
            self.events.clear()
            self.flow.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A flow of a snapshot goes on: an open one with the time that this query's window leaves it, a closed one to the end of its horizon."""
        one = initialState.iloc[0]
        for e in json.loads(one["events"]):
            self.events.updateValue((e["event_id"],), (int(e["arrival_us"]), e.get("layer"), e.get("layer_ord"), bool(e["terminating"]), e.get("at_us"), e["payload"]))
        closed = None if pd.isna(one["closed_us"]) else int(one["closed_us"])
        self.flow.update((closed, None if pd.isna(one["at_us"]) else int(one["at_us"]), None if pd.isna(one["reason"]) else one["reason"]))
        first = min(int(e["arrival_us"]) for e in json.loads(one["events"]))
        self._timer(first // 1000 + self.window_ms if closed is None else closed // 1000 + self.horizon_ms)

    def close(self) -> None:
        pass


def flow_versions(rows: DataFrame, window_ms: int = WINDOW_MS, expected: int = 4, horizon_ms: int = HORIZON_MS, snapshot: DataFrame | None = None) -> DataFrame:
    """VERSIONS of flows from a stream of INPUT rows. A row without event_id says that its key's events have moved away. Needs the RocksDB state store.

    snapshot: of another query's state, that this one starts from.
    """
    processor = LateArrivalWindow(window_ms, expected, horizon_ms)
    more = {} if snapshot is None else {"initialState": snapshot.groupBy("tenant", "key")}
    return rows.groupBy("tenant", "key").transformWithStateInPandas(processor, VERSIONS, "Update", "ProcessingTime", **more)


def windows(keyed: DataFrame, window_ms: int = WINDOW_MS, expected: int = 4) -> DataFrame:
    """(tenant, key, reason, n_events, first_us, last_us) of the flows that close, of a stream of (tenant, key, event_id, layer_ord, terminating), which arrive as they come."""
    given = {"version": F.lit(0), "payload": F.lit("{}")}
    rows = keyed.select(*[(F.col(c.split()[0]) if c.split()[0] in keyed.columns else given.get(c.split()[0], F.lit(None))).cast(c.split()[1]).alias(c.split()[0]) for c in INPUT.split(", ")])
    return flow_versions(rows, window_ms, expected).where("status = 'closed' and not amended").select("tenant", "key", "reason", "n_events", "first_us", "last_us")


def log_changes(log: DataFrame) -> DataFrame:
    """INPUT rows of rows of the log: each event under its key, and a mark under the key that it has left."""
    payload = [c for c in log.columns if c not in ("key", "from_key", "arrival_us", "version", "day", "hour", "tenant")]
    event = F.struct("key", "version", "event_id", "arrival_us", "layer", "layer_ord", "terminating", "at_us", F.to_json(F.struct(*payload)).alias("payload"))
    shape = "struct<key:string,version:bigint,event_id:string,arrival_us:bigint,layer:string,layer_ord:int,terminating:boolean,at_us:bigint,payload:string>"
    none = lambda kind: F.lit(None).cast(kind)
    mark = F.struct(F.col("from_key").alias("key"), "version", none("string").alias("event_id"), none("bigint").alias("arrival_us"), none("string").alias("layer"), none("int").alias("layer_ord"), none("boolean").alias("terminating"), none("bigint").alias("at_us"), none("string").alias("payload"))
    return log.select("tenant", F.explode(F.array(event.cast(shape), mark.cast(shape))).alias("r")).select("tenant", "r.*").where("key is not null")


def run(spark: SparkSession, root: str, checkpoint: str, window_ms: int = WINDOW_MS, layers: tuple[int, ...] = (0, 1, 2, 3), horizon_ms: int = HORIZON_MS, snapshot: DataFrame | None = None, seconds: float = 1, files_per_trigger: int = 1000) -> StreamingQuery:
    """Follow the log that ingest writes (with flows=False) and publish the versions of its flows. Runs until it is stopped, as only a running stream has timers.

    layers: the ones that a whole flow has. snapshot: of the state of a stopped query, taken with
    state_snapshot(); the query then needs a new checkpoint and starts after what the old one read
    (events that it gets again change nothing).
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = schema_of(spark, f"{root}/keyed")
    if schema is None:
        raise ValueError("nothing has been ingested yet")
    fields = StructType([f for f in schema if f.name not in ("tenant", *ingest.LOGGED)] + [schema["method_tier"]])
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/keyed")

    def each(batch: DataFrame, batch_id: int) -> None:
        versions = stage(batch, "versions")
        if not versions.isEmpty():
            write_versions(spark, root, versions, fields, layers)
        discard(spark, versions)

    out = flow_versions(log_changes(log), window_ms, len(layers), horizon_ms, snapshot)
    return out.writeStream.outputMode("update").foreachBatch(brief(each)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def write_versions(spark: SparkSession, root: str, versions: DataFrame, fields: StructType, layers: tuple[int, ...] = (0, 1, 2, 3)) -> None:
    """Materialise versions and publish them. Of a flow with several, the last one counts in ``flows``; a tombstone only if nothing follows it."""
    now = versions.where("status <> 'moved'")
    events = now.select("tenant", "key", F.col("status").alias("_state"), F.explode(F.from_json("events", f"array<{fields.simpleString()}>")).alias("e")).select("tenant", "key", "_state", "e.*")
    made = materialize(events.where("_state = 'closed'").drop("_state"), closed=True, expected=layers).unionByName(materialize(events.where("_state = 'open'").drop("_state"), closed=False, expected=layers))
    shape = ingest.arrivals(events.withColumn("arrival_us", F.lit(None).cast("long"))).drop("at_us", "first_arrival_us", "last_arrival_us")
    state = now.join(shape, ingest.KEY).select(*shape.columns, "at_us", F.col("first_us").alias("first_arrival_us"), F.col("last_us").alias("last_arrival_us"), F.col("status").alias("state"), "closed_us", "amended")
    gone = versions.where("status = 'moved'").select("tenant", F.concat(F.lit("flow:"), "key").alias("flow_id"))
    before = ingest.dated(versions.where("was_at_us is not null"), "was_at_us").select("tenant", "day", "hour").distinct()
    ingest.publish(spark, root, made, state, gone, before, time.time_ns() // 1000)


def state_snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(tenant, key, closed_us, at_us, reason, events) of a stopped query's state: what is in flight, and the closed flows that may still be amended."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    events = state("events").select("key.tenant", "key.key", F.struct(F.col("user_map_key.event_id").alias("event_id"), "user_map_value.*").alias("e"))
    flows = state("flow").select("key.tenant", "key.key", "value.*")
    held = events.groupBy("tenant", "key").agg(F.to_json(F.collect_list("e")).alias("events"))
    return held.join(flows, ["tenant", "key"], "left").select("tenant", "key", "closed_us", "at_us", "reason", "events")
