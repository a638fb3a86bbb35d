"""Landing files to flows: a stream of micro-batches with idempotent steps.

``keyed`` is the table that the stream lives by: an append-only log of every event under its
correlation key, partitioned by the hour in which it was written. When a record shows that two
keys are one request, the events of the larger key are written again under the smaller one, with
the key they come from. So the log is at once the index from identifiers to keys, the evidence
that flows are made from, and the change stream that the late-arrival window follows.

A batch looks up its identifiers in the last hours of the log only. A flow that it touches has
all its events in these hours, as those from before are written again with it. So what a batch
reads depends on the rate of arrival and not on what is stored. Every step is keyed by content:
a batch that runs twice, or that stops half-way and runs again, leaves the same flows.
"""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.parsers import PARSERS, parse, split
from millrace.operators import search
from millrace.operators.components import connected_components
from millrace.operators.correlate import heuristic_keys
from millrace.operators.filters import checked_rules
from millrace.operators.flow import materialize
from millrace.schema import UNKNOWN_LAYER
from millrace.sources.landing import stream_landing, with_feeds
from millrace.sources.store import append, append_new, load, matching, names_in, overwrite_by_key
from millrace.staging import discard, stage
from millrace.streaming.batches import brief

HOUR_US = 3_600_000_000
SEP = "\u0001"
EVENT = ["tenant", "event_id"]
KEY = ["tenant", "key"]
TIME = ["day", "hour"]
#: What the events of a log row say about it: not part of the event.
LOGGED = ["key", "method_tier", "from_key", "arrival_us", "version", "day", "hour"]


def log_rows(events: DataFrame) -> DataFrame:
    """Normalised events in the flat form that correlation and flows use."""
    return events.select(
        "event_id", "raw_id", "tenant", "provider", "layer", "layer_ord", F.coalesce("identifiers", F.array().cast("array<string>")).alias("ids"), F.unix_micros("event_time").alias("event_us"), F.col("verdict.action").alias("action"), F.coalesce("verdict.terminating", F.lit(False)).alias("terminating"), F.col("verdict.rule_id").alias("rule_id"), F.col("verdict.mapped").alias("mapped"),
        F.coalesce("bot.datadome_score", F.col("bot.cf_bot_score").cast("double")).alias("score"), F.col("client.ip").alias("client_ip"), F.col("client.asn").alias("asn"), F.col("client.country").alias("country"), F.col("client.user_agent").alias("user_agent"), F.col("request.method").alias("method"), F.col("request.host").alias("host"), F.col("request.path").alias("path"),
        F.col("response.status").alias("status"), F.col("response.duration_ms").alias("duration_ms"), F.col("response.cache_status").alias("cache_status"), F.coalesce(F.unix_micros("event_time"), F.unix_micros("received_at")).alias("at_us"),
        F.col("request.query").alias("query"), F.col("response.bytes").alias("response_bytes"), "shape.request_bytes", "shape.header_count", "shape.header_bytes", "shape.cookie_count", "shape.cookie_names", "data_quality_flags",
    )


def dated(df: DataFrame, at: str) -> DataFrame:
    """df with the day and hour that its table is partitioned by; both are null where the time is."""
    time = F.timestamp_micros(F.col(at))
    return df.withColumn("day", time.cast("date")).withColumn("hour", F.hour(time))


def keep_wanted(events: DataFrame, configs: DataFrame | None) -> DataFrame:
    """events without those that their tenant's filters drop.

    configs: (tenant, filters), filters a JSON list of {field, op, values}. Tenants without a
    config, and those whose filters do not parse or break a limit of ``drop_filter`` (too many
    rules, an empty rule, an unknown field or op), keep everything.
    """
    if configs is None:
        return events
    named = configs.select(F.col("tenant").alias("_tenant"), checked_rules(F.col("filters")).alias("_rules")).where("_rules is not null")

    def hit(rule):
        subject = F.lower(F.nullif(F.when(rule["field"] == "request_host", F.col("host")).when(rule["field"] == "request_path", F.col("path")), F.lit("")))
        return F.exists(rule["values"], lambda v: F.coalesce(F.when(rule["op"] == "equals", subject == v).when(rule["op"] == "suffix", subject.endswith(v)).when(rule["op"] == "prefix", subject.startswith(v)).when(rule["op"] == "contains", subject.contains(v)), F.lit(False)))

    joined = events.join(named, F.col("tenant") == F.col("_tenant"), "left")
    return joined.where(~F.coalesce(F.exists("_rules", hit), F.lit(False))).drop("_tenant", "_rules")


def _hour(us: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(us // 1_000_000, datetime.timezone.utc).replace(minute=0, second=0, microsecond=0)


def recent_hours(spark: SparkSession, root: str, now_us: int) -> DataFrame | None:
    """(day, hour) of the log's partitions that a batch may look up: this hour, the last one that was written before it, and the hour before either.

    After a standstill the stream goes on where it stopped, whatever the clock says by then. Only
    names of folders are read: those of the days, and of the hours of the last days.
    """
    path, found = f"{root}/keyed", []
    for day in [n for n in names_in(spark, path) if n.startswith("day=")][-3:]:
        for hour in names_in(spark, f"{path}/{day}"):
            if hour.startswith("hour="):
                found.append(datetime.datetime.fromisoformat(day[4:]).replace(hour=int(hour[5:]), tzinfo=datetime.timezone.utc))
    now, one = _hour(now_us), datetime.timedelta(hours=1)
    before = [h for h in found if h < now]
    wanted = {now, now - one, *([max(before), max(before) - one] if before else [])} & set(found)
    return spark.createDataFrame([Row(day=h.date(), hour=h.hour) for h in sorted(wanted)], "day date, hour int") if wanted else None


def _latest(rows: DataFrame) -> DataFrame:
    """Each event in the form that was logged last, with whole rows. An event's rows are few, one per move or hour."""
    columns = [c for c in rows.columns if c not in EVENT]
    return rows.groupBy(*EVENT).agg(F.max_by(F.struct(*columns), "version").alias("_row")).select(*EVENT, *[F.col(f"_row.`{c}`").alias(c) for c in columns])


def _exact(new: DataFrame, logged: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(new events with identifiers and their key, the logged events of all flows that they touch with key and _new_key).

    The key of a component is its smallest identifier. A logged key is one, so the graph is made
    of the batch's own links and of one link from each of its known identifiers to its key.
    """
    node = lambda tenant, i: F.concat_ws(SEP, tenant, i)
    first = F.get("ids", 0)
    edges = new.where(F.size("ids") > 1).select("tenant", first.alias("a"), F.explode(F.array_except("ids", F.array(first))).alias("b"))
    hits = None
    if logged is not None:
        wanted = new.select("tenant", F.explode("ids").alias("id")).distinct()
        narrow = logged.where("size(ids) > 0").select(*EVENT, "key", "version", F.explode("ids").alias("id"))
        found = stage(matching(narrow, wanted, ["tenant", "id"]), "hits")  # all rows of an event have its identifiers, so its last row is among them
        last = found.groupBy(*EVENT).agg(F.max_by("key", "version").alias("key"))
        hits = stage(found.select(*EVENT, "id").distinct().join(last, EVENT).select("tenant", "id", "key").distinct(), "labels")
        discard(new.sparkSession, found)
        edges = edges.union(hits.select("tenant", F.col("id"), F.col("key")))
    groups = connected_components(edges.select(node(F.col("tenant"), F.col("a")).alias("u"), node(F.col("tenant"), F.col("b")).alias("v")), "u", "v")
    bare = F.substring_index(F.coalesce("component", "_node"), SEP, -1)
    keyed = new.withColumn("_node", node(F.col("tenant"), first)).join(groups, F.col("_node") == F.col("node"), "left").withColumn("key", bare).drop("_node", "node", "component")
    if hits is None:
        return keyed.withColumn("method_tier", F.lit("exact")), None
    moves = hits.select("tenant", "key").distinct().withColumn("_node", node(F.col("tenant"), F.col("key"))).join(groups, F.col("_node") == F.col("node"), "left").select(F.col("tenant").alias("_t"), F.col("key").alias("_k"), bare.alias("_new_key"))
    moves = stage(moves, "moves")
    discard(new.sparkSession, hits)
    whole = _latest(logged.join(moves, (F.col("tenant") == F.col("_t")) & (F.col("key") == F.col("_k")) & (F.col("method_tier") == "exact")).drop("_t", "_k"))
    return keyed.withColumn("method_tier", F.lit("exact")), whole


def _loose(new: DataFrame, logged: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The same for events without identifiers: clusters of new and logged ones of the same client, host, path and method."""
    near = None
    if logged is not None:
        same = ["tenant", "client_ip", "host", "path", "_method"]
        usable = lambda rows: rows.withColumn("_method", F.upper("method")).where("client_ip is not null and host is not null and path is not null and _method is not null")
        near = stage(_latest(matching(usable(logged.where("size(ids) = 0")), usable(new).select(*same).distinct(), same).drop("_method")), "near")
        again = matching(new, near.select(*EVENT), EVENT, "left_anti")
        events = again.unionByName(near.select(*new.columns))
    else:
        again = events = new
    found = stage(heuristic_keys(events).where("not ambiguous").select(*EVENT, F.col("key").alias("_new_key")), "clusters")
    keyed = again.join(found, EVENT, "left").withColumn("key", F.col("_new_key")).withColumn("method_tier", F.when(F.col("key").isNull(), "none").otherwise("heuristic")).drop("_new_key")
    return keyed, None if near is None else near.join(found, EVENT, "left")


def absorb(spark: SparkSession, batch: DataFrame, root: str, configs: DataFrame | None = None, token_key: bytes | None = None, now_us: int | None = None, flows: bool = True, parsers: dict = PARSERS) -> None:
    """One micro-batch of raw records (tenant, provider, received_at, payload) into the store.

    The raw records of wanted events go to ``raw``, those that do not parse to ``dead_letters``,
    the events to ``keyed``. With ``flows``, the flows that the batch touches are materialised at
    once as closed ones; otherwise the window follows the log and does so (``streaming.window``).
    now_us: the clock, which no later batch may put back.
    """
    absorb_parsed(spark, parse(batch, parsers, token_key), root, configs, now_us, flows)


def absorb_parsed(spark: SparkSession, parsed: DataFrame, root: str, configs: DataFrame | None = None, now_us: int | None = None, flows: bool = True) -> None:
    """absorb() for records that parse() has read."""
    now_us = now_us or time.time_ns() // 1000
    parsed = stage(parsed, "parsed")  # once, for events, dead letters and evidence
    good, dead = split(parsed)
    events = stage(keep_wanted(log_rows(good), configs).dropDuplicates(EVENT), "batch")
    received = lambda df: dated(df.withColumn("_us", F.unix_micros("received_at")), "_us").drop("_us")
    # evidence comes first, so that an event that is logged has it
    letters = stage(received(dead), "letters")
    append_new(spark, root, "dead_letters", letters, ["tenant", "dead_letter_id"], letters.select("tenant", "day", "hour"))
    evidence = stage(received(matching(raw_records(parsed), events.select("tenant", "raw_id").distinct(), ["tenant", "raw_id"])), "evidence")
    append_new(spark, root, "raw", evidence, ["tenant", "raw_id"], evidence.select("tenant", "day", "hour"))
    discard(spark, parsed, letters, evidence)
    if events.isEmpty():
        return
    hours = recent_hours(spark, root, now_us)
    logged = load(spark, f"{root}/keyed", hours) if hours is not None else None
    exact, exact_old = _exact(events.where("size(ids) > 0"), logged)
    loose, loose_old = _loose(events.where("size(ids) = 0"), logged)
    new = exact.unionByName(loose).withColumn("arrival_us", F.lit(now_us))
    old = None
    if logged is not None:
        old = stage(exact_old.select(*[c for c in logged.columns], "_new_key").unionByName(loose_old.select(*[c for c in logged.columns], "_new_key")), "old")
        new = matching(new, old.select(*EVENT), EVENT, "left_anti")
    new = stage(new, "keyed_new")
    place = _hour(now_us)
    log = lambda df, source: df.withColumn("from_key", source).withColumn("version", F.lit(now_us)).withColumn("day", F.lit(place.date())).withColumn("hour", F.lit(place.hour))
    rows, touched, left, before = log(new, F.lit(None).cast("string")), None, None, None
    if old is not None:
        changed = ~F.col("key").eqNullSafe(F.col("_new_key"))
        moved = old.where(changed)
        touched = new.select(*KEY).union(moved.select("tenant", "_new_key")).union(matching(old, events.select(*EVENT), EVENT).select("tenant", "_new_key")).where("key is not null").distinct()
        stay = matching(old.drop("key").withColumnRenamed("_new_key", "key").withColumn("_was", F.lit(None).cast("string")), touched, KEY)
        tier = F.when(F.col("key").isNull(), "none").when(F.size("ids") > 0, "exact").otherwise("heuristic")
        rewritten = old.where(changed).withColumn("_was", F.col("key")).drop("key").withColumnRenamed("_new_key", "key").withColumn("method_tier", tier)
        carried = matching(stay, moved.select(*EVENT), EVENT, "left_anti").where(~((F.col("day") == F.lit(place.date())) & (F.col("hour") == place.hour)))
        again = rewritten.unionByName(carried)
        rows = rows.unionByName(log(again, F.col("_was")).select(*rows.columns))
        left = moved.where("key is not null").select("tenant", F.concat(F.lit("flow:"), "key").alias("flow_id")).distinct()
        before = dated(old.where("key is not null").groupBy(*KEY).agg(F.min("at_us").alias("_at")), "_at").select("tenant", "day", "hour").distinct()
    append(spark, root, "keyed", rows, TIME)
    if flows:
        whole = new.where("key is not null")
        if old is not None:
            kept = stay.drop("_was").withColumn("method_tier", F.when(F.size("ids") > 0, "exact").otherwise("heuristic"))
            whole = matching(new, touched, KEY).unionByName(kept.select(*new.columns))
        state = arrivals(whole).withColumn("state", F.lit("closed")).withColumn("closed_us", F.lit(now_us)).withColumn("amended", F.col("first_arrival_us") < F.col("last_arrival_us"))
        publish(spark, root, materialize(whole.drop("arrival_us")), state, left, before, now_us)
    discard(spark, events, new, *([old] if old is not None else []))


#: What a flow's events measured of the request, for profiles; NULL is "not measured".
SHAPE = ("response_bytes", "request_bytes", "header_count", "header_bytes", "cookie_count")


def arrivals(events: DataFrame) -> DataFrame:
    """Per flow (tenant, key) of log rows: at_us, by which it is dated (a flow may hold no event with a time of its own), its first and last arrival, and what profiles need of the request."""
    order = F.struct(F.coalesce("layer_ord", F.lit(UNKNOWN_LAYER)), F.col("event_us"), F.col("event_id"))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("query", "cookie_names")]
    return events.groupBy(*KEY).agg(F.min("at_us").alias("at_us"), F.min("arrival_us").alias("first_arrival_us"), F.max("arrival_us").alias("last_arrival_us"), *first, *[F.max(c).alias(c) for c in SHAPE])


def publish(spark: SparkSession, root: str, made: DataFrame, state: DataFrame, gone: DataFrame | None, before: DataFrame | None, version: int) -> None:
    """Put materialised flows into ``flows`` and, as versions, into ``flow_log``.

    state: their arrivals() with state (open or closed), closed_us and amended. gone: (tenant, flow_id) that are no
    flows any more; their versions are tombstones. before: the partitions where the flows lay.
    """
    at = state.withColumnRenamed("tenant", "_t").withColumn("_f", F.concat(F.lit("flow:"), "key")).drop("key")
    rows = stage(dated(made.join(at, (F.col("tenant") == F.col("_t")) & (F.col("flow_id") == F.col("_f"))).drop("_t", "_f"), "at_us"), "flows")
    stale = stage(matching(gone, rows.select("tenant", "flow_id"), ["tenant", "flow_id"], "left_anti"), "stale") if gone is not None else None
    log_versions(spark, root, rows, stale, version)
    none = spark.createDataFrame([], rows.select("tenant", "day", "hour").schema)
    overwrite_by_key(spark, root, "flows", rows, ["tenant", "flow_id"], stale, before if before is not None else none)
    discard(spark, rows, *([stale] if stale is not None else []))


def log_versions(spark: SparkSession, root: str, rows: DataFrame, stale: DataFrame | None, version: int) -> None:
    """Append versions of flows, and tombstones of flows that are gone, to the log that followers stream."""
    out = rows.withColumn("version", F.lit(version)).withColumn("gone", F.lit(False))
    if stale is not None:
        empty = [F.lit(version).alias("version") if f.name == "version" else F.lit(True).alias("gone") if f.name == "gone" else F.col(f.name) if f.name in ("tenant", "flow_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]
        out = out.unionByName(stale.select(*empty))
    hour = _hour(version)
    # the log is partitioned by the time of writing, like ``keyed``
    append(spark, root, "flow_log", out.drop("day", "hour").withColumn("day", F.lit(hour.date())).withColumn("hour", F.lit(hour.hour)), TIME)


def current_flows(spark: SparkSession, root: str) -> DataFrame | None:
    """The last version of every flow of the log, without those that are gone."""
    log = load(spark, f"{root}/flow_log")
    if log is None:
        return None
    columns = [c for c in log.columns if c not in ("tenant", "flow_id")]
    last = log.groupBy("tenant", "flow_id").agg(F.max_by(F.struct(*columns), F.struct("version", ~F.col("gone"))).alias("_row"))
    return last.where("not _row.gone").select("tenant", "flow_id", *[F.col(f"_row.`{c}`").alias(c) for c in columns if c not in ("gone", "day", "hour")])


def stored_events(spark: SparkSession, root: str) -> DataFrame | None:
    """Every event once, under its present key."""
    log = load(spark, f"{root}/keyed")
    return None if log is None else _latest(log)


def raw_records(parsed: DataFrame) -> DataFrame:
    """(tenant, provider, raw_id, received_at, payload) of the records that parse: what is kept as evidence."""
    return parsed.where("parse_error is null").select("tenant", "provider", "raw_id", "received_at", "payload").dropDuplicates(["tenant", "raw_id"])


def raw_by_id(spark: SparkSession, root: str, tenant: str, raw_id: str) -> DataFrame:
    """The raw record behind an event."""
    return search.raw_by_id(spark.read.parquet(f"{root}/raw"), tenant, raw_id)


def run(spark: SparkSession, landing: str, feeds: DataFrame, root: str, checkpoint: str, available_now: bool = True, seconds: int = 5, configs: DataFrame | None = None, token_key: bytes | None = None, flows: bool = True) -> StreamingQuery:
    """Start the stream. available_now: take what is there and stop. configs: the tenants' filters; token_key: for masked values; flows: as for absorb."""

    def each(batch: DataFrame, batch_id: int) -> None:
        absorb_parsed(spark, batch, root, configs, flows=flows)

    # parsed in the plan of the stream, which is built once; a record that comes twice is one by its event's or letter's id
    writer = parse(with_feeds(stream_landing(spark, landing), feeds), token_key=token_key).writeStream.foreachBatch(brief(each)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def replay(spark: SparkSession, raw: DataFrame, root: str, dry_run: bool = False, configs: DataFrame | None = None, token_key: bytes | None = None, parsers: dict = PARSERS, now_us: int | None = None) -> tuple[int, int]:
    """Normalise raw records again, e.g. after a parser fix: (events, failures). The tenants' filters and the key hold as in the stream. A dry run stores nothing."""
    raw = stage(raw, "replayed")
    failed = parse(raw, parsers, token_key).select(F.col("parse_error").isNotNull().alias("bad")).groupBy("bad").count().collect()  # two rows at most
    counts = {r["bad"]: r["count"] for r in failed}
    if not dry_run and counts:
        absorb(spark, raw, root, configs, token_key, now_us, parsers=parsers)
    discard(spark, raw)
    return counts.get(False, 0), counts.get(True, 0)


def replay_range(spark: SparkSession, root: str, provider: str, from_us: int, to_us: int, **how) -> tuple[int, int]:
    """Replay the stored raw records of a provider that were received from from_us up to to_us."""
    if to_us <= from_us:
        raise ValueError("a range must end after it starts")
    raw = load(spark, f"{root}/raw")
    if raw is None:
        return 0, 0
    days = F.timestamp_micros(F.lit(from_us)).cast("date"), F.timestamp_micros(F.lit(to_us)).cast("date")
    wanted = raw.where(F.col("day").between(*days) & (F.col("provider") == provider) & (F.unix_micros("received_at") >= from_us) & (F.unix_micros("received_at") < to_us))
    return replay(spark, wanted.select("tenant", "provider", "received_at", "payload"), root, **how)
