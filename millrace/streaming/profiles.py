"""Flow stream to endpoint profiles: each flow once, templates learned as they come, partial profiles merged into the stored ones.

The stored profiles are the statistics that templates are learned from: an endpoint under a
position that has not collapsed is one of its values, with its observations. When a position
collapses, the endpoints under it are folded into the template, and those that they were are
gone from the next generation. What is decided once holds: the positions of stored templates are
learned ones. A batch writes a whole generation beside the one it builds upon and marks it at
the end, so a batch that runs twice, or stops half-way, counts once. Profiles are small next to
the traffic: a few thousand endpoints a host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.values import canonical_host
from millrace.operators import profile
from millrace.operators.filters import profiled
from millrace.sources.store import delete, names_in, read_small, schema_of, write_once
from millrace.staging import discard, stage
from millrace.streaming.batches import brief

DEDUP_TTL = "2 hours"
SCOPE = ["tenant", "host", "method"]
TABLES = ("endpoints", "statuses", "cookies", "params")
GIVEN = ("query string", "status int", "cookie_names array<string>", "request_bytes bigint", "header_count int", "header_bytes int", "cookie_count int", "response_bytes bigint")


def distinct_flows(flows: DataFrame) -> DataFrame:
    """flows (with ``last_seen`` as a timestamp), each flow_id of a tenant once within the TTL."""
    return flows.withWatermark("last_seen", DEDUP_TTL).dropDuplicatesWithinWatermark(["tenant", "flow_id"])


def closed_flows(spark: SparkSession, root: str, files_per_trigger: int = 100) -> DataFrame:
    """The flows of the store's log as they close, as a stream; a later version of the same flow (amended, moved) is none of them.

    files_per_trigger bounds what is taken in at once; the rest waits in the log, nothing is shed.
    """
    schema = schema_of(spark, f"{root}/flow_log")
    if schema is None:
        raise ValueError("no flow has been published yet")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/flow_log")
    return log.where("state = 'closed' and not gone and not amended").withColumn("last_seen", F.timestamp_micros("closed_us"))


def observations(flows: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """What profiles count of a flow: host and method in one spelling, and NULL for columns that the flows do not have.

    configs: (tenant, config) of profiling settings as JSON. With them, tenants without a valid and
    enabled one are not profiled, nor are hosts that are not listed and paths that are excluded.
    """
    missing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in GIVEN if c.split()[0] not in flows.columns]
    method = F.upper(F.trim("method"))
    seen = flows.select("*", *missing).withColumn("host", canonical_host(F.col("host"))).withColumn("method", F.when(F.coalesce(method, F.lit("")) == "", "UNKNOWN").otherwise(method))
    seen = seen.withColumn("seen_us", F.coalesce("last_us", *(["closed_us"] if "closed_us" in flows.columns else []))).where("path is not null and host is not null")
    if "providers" not in seen.columns:
        seen = seen.withColumn("providers", F.array().cast("array<string>"))
    return seen if configs is None else profiled(seen, configs)


def _parts(seen: DataFrame) -> dict[str, DataFrame]:
    """Partial profiles by raw path, as ``template``."""
    seen = stage(seen.withColumn("template", F.col("path")).withColumn("query_length", F.length("query")), "observed")
    by = [*SCOPE, "template"]
    provider = seen.select(*by, F.explode("providers").alias("p")).groupBy(*by).agg(F.array_sort(F.collect_set("p")).alias("providers"))
    endpoints = profile.endpoint_profile(seen.withColumn("provider", F.lit(None).cast("string")), SCOPE).drop("providers").join(provider, by, "left").withColumn("providers", F.coalesce("providers", F.array().cast("array<string>")))
    return {
        "endpoints": endpoints,
        "statuses": profile.status_histogram(seen, SCOPE),
        "cookies": profile.cookie_name_profile(seen, SCOPE),
        "params": profile.parameter_parts(profile.parameters(seen), by, observation="flow_id"),
    }


_MERGE = {
    "endpoints": profile.merge_profiles,
    "statuses": profile.merge_histograms,
    "cookies": profile.merge_cookie_names,
    "params": lambda parts, scope: profile.merge_parameters(parts, [*scope, "template"]),
}


def merged(stored: dict[str, DataFrame] | None, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The profiles of stored and new ones: templates learned from both, everything under one template folded into it."""
    if stored is None:
        stored = {k: v.where("false") for k, v in new.items()}
    both = {k: stored[k].unionByName(new[k]) for k in TABLES}
    learned = profile.learned_positions(stored["endpoints"], SCOPE)
    paths = both["endpoints"].withColumnRenamed("template", "path")
    names = profile.learn_templates(paths, SCOPE, weight="observations", learned=learned).select(*SCOPE, "path", "template").distinct()
    names = stage(names, "templates")
    out = {}
    for k in TABLES:
        renamed = both[k].withColumnRenamed("template", "path").join(names, [*SCOPE, "path"]).drop("path")
        out[k] = _MERGE[k](renamed, SCOPE).select(*both[k].columns)
    return out


def _generations(spark: SparkSession, root: str) -> list[int]:
    """The generations that are complete."""
    path = f"{root}/profiles"
    return sorted(int(n[4:]) for n in names_in(spark, path) if n.startswith("gen=") and read_small(spark, f"{path}/{n}/_done"))


def _read(spark: SparkSession, root: str, gen: int) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{root}/profiles/gen={gen}/{k}") for k in TABLES}


def absorb(spark: SparkSession, flows: DataFrame, root: str, batch_id: int, configs: DataFrame | None = None, keep: int = 2) -> None:
    """Generation batch_id: the profiles of the last complete one before it and of these flows. keep: generations that stay for readers."""
    before = [g for g in _generations(spark, root) if g < batch_id]
    state = merged(_read(spark, root, before[-1]) if before else None, _parts(observations(flows, configs)))
    for k, df in state.items():
        df.write.mode("overwrite").parquet(f"{root}/profiles/gen={batch_id}/{k}")
    write_once(spark, f"{root}/profiles/gen={batch_id}/_done", "1")
    for old in before[: max(0, len(before) + 1 - keep)]:
        delete(spark, f"{root}/profiles/gen={old}")


def run(spark: SparkSession, flows: DataFrame, root: str, checkpoint: str, configs: DataFrame | None = None, seconds: int | None = None) -> StreamingQuery:
    """Merge flows (a stream, e.g. closed_flows()) into ``<root>/profiles``: what is available, or every so many seconds until it is stopped."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch, "flows")
        if not rows.isEmpty():
            absorb(spark, rows, root, batch_id, configs)
        discard(spark, rows)

    writer = distinct_flows(flows).writeStream.foreachBatch(brief(each)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def stored(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """endpoints, statuses, cookies and params of the last complete generation."""
    done = _generations(spark, root)
    return _read(spark, root, done[-1]) if done else None


def profiles(spark: SparkSession, root: str) -> DataFrame:
    """The stored endpoint profiles, with endpoint_id."""
    now = stored(spark, root)
    if now is None:
        raise ValueError("there are no profiles yet")
    return now["endpoints"].withColumn("endpoint_id", profile.endpoint_id([F.col(c) for c in (*SCOPE, "template")]))


def retired(spark: SparkSession, root: str) -> DataFrame:
    """The endpoints of the generation before that the last one has folded into a template."""
    done = _generations(spark, root)
    now = _read(spark, root, done[-1])["endpoints"]
    return profile.retired(_read(spark, root, done[-2])["endpoints"], now, [*SCOPE, "template"]) if len(done) > 1 else now.where("false")


def compact(spark: SparkSession, root: str) -> None:
    """Delete all generations but the last complete one; the stream must be stopped."""
    done = _generations(spark, root)
    for name in names_in(spark, f"{root}/profiles"):
        if done and name.startswith("gen=") and int(name[4:]) != done[-1]:
            delete(spark, f"{root}/profiles/{name}")
