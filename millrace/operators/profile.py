"""Endpoint and parameter profiles of observed traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.identifiers import joined_id
from millrace.functions.quality import contains_secret
from millrace.functions.values import PROMOTABLE, infer_type, join_types, joined_path, matches_type, parameter_name, path_segments, query_pairs, token, token_type
from millrace.staging import discard, stage

ENUM_CAP, COOKIE_CAP = 64, 64
# When a path position collapses.
MIN_SAMPLES, MAX_DISTINCT, MIN_DISTINCT_FOR_TYPE, TYPE_SHARE, SINGLETON_SHARE, REPEAT_FACTOR = 64, 64, 8, 0.9, 0.85, 4
CEILINGS = ("request_bytes", "header_count", "header_bytes", "cookie_count", "query_length", "body_bytes", "response_bytes")


def learned_positions(templates: DataFrame, scope: list[str], template: str = "template") -> DataFrame:
    """(scope..., _prefix, _known) of every position that a template has a token for: what was decided once and holds."""
    segments = path_segments(F.col(template))
    at = F.filter(F.transform(segments, lambda v, i: F.struct(joined_path(F.slice(segments, 1, i)).alias("_prefix"), token_type(v).alias("_known"))), lambda p: p["_known"].isNotNull())
    found = templates.select(*scope, F.explode(at).alias("_p")).select(*scope, "_p.*")
    return found.groupBy(*scope, "_prefix").agg(F.min("_known").alias("_known"))


def learn_templates(observed: DataFrame, scope: list[str], path: str = "path", weight: str | None = None, learned: DataFrame | None = None) -> DataFrame:
    """observed with ``template``: variable path segments replaced by ``{type}`` or ``{var}``.

    One level a round: positions are counted under their rewritten prefix, so a collapse on one
    level is seen by the next. What is rewritten is the table of distinct paths with their
    counts, and only while a level has samples enough for a collapse. Values are counted, never
    collected. weight: a column with the observations that a row stands for. learned: of
    learned_positions(); such a position stays collapsed, for the values of its type, and the
    tokens of templates among the paths stand for themselves.
    """
    spark = observed.sparkSession
    paths = observed.groupBy(*scope, F.col(path).alias("_path")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    rows = stage(paths.withColumn("_segments", path_segments(F.col("_path"))).withColumn("_done", F.array().cast("array<string>")), "templates")
    depth = 0
    known = learned.agg(F.max(F.size(path_segments(F.col("_prefix")))) + 1).first()[0] or 0 if learned is not None else 0
    while depth < known or (rows.agg(F.sum(F.when(F.size("_segments") > depth, F.col("_n")))).first()[0] or 0) >= MIN_SAMPLES:
        level = rows.withColumn("_value", F.get("_segments", depth)).withColumn("_prefix", joined_path(F.col("_done")))
        values = level.where(F.col("_value").isNotNull() & token_type(F.col("_value")).isNull()).groupBy(*scope, "_prefix", "_value").agg(F.sum("_n").alias("n")).withColumn("kind", infer_type(F.col("_value")))
        kinds = values.groupBy(*scope, "_prefix", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("ones"))
        totals = kinds.groupBy(*scope, "_prefix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("ones").alias("ones"), F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.max("n").alias("most"))
        typed = (F.col("n") >= MIN_SAMPLES) & (F.col("k") >= MIN_DISTINCT_FOR_TYPE) & (F.col("most") / F.col("n") >= TYPE_SHARE) & F.col("kind").isin(*PROMOTABLE)
        varied = (F.col("k") > MAX_DISTINCT) & (F.col("n") >= MIN_SAMPLES * REPEAT_FACTOR) & (F.col("ones") / F.col("k") >= SINGLETON_SHARE)
        collapsed = totals.where(typed | varied).select(*scope, "_prefix", F.when(typed, F.col("kind")).otherwise("var").alias("_kind"))
        if learned is not None:
            collapsed = collapsed.join(learned, [*scope, "_prefix"], "full").select(*scope, "_prefix", F.coalesce("_known", "_kind").alias("_kind"))
        level = level.join(collapsed, [*scope, "_prefix"], "left")
        segment = F.when(F.col("_kind").isNotNull() & token_type(F.col("_value")).isNull() & matches_type(F.col("_value"), F.col("_kind")), token(F.col("_kind"))).otherwise(F.col("_value"))
        after = stage(level.withColumn("_done", F.when(F.col("_value").isNotNull(), F.concat("_done", F.array(segment))).otherwise(F.col("_done"))).drop("_value", "_prefix", "_kind"), "templates")
        discard(spark, rows)
        rows, depth = after, depth + 1
    rest = F.slice("_segments", depth + 1, 1 << 30)
    learned = rows.select(*[F.col(c).alias(f"_at_{i}") for i, c in enumerate(scope)], "_path", joined_path(F.concat("_done", rest)).alias("template"))
    same = F.col(path).eqNullSafe(F.col("_path"))
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{i}"))
    return observed.drop("template").join(learned, same, "left").drop("_path", *[f"_at_{i}" for i in range(len(scope))])


def endpoint_id(scope: list[Column]) -> Column:
    return joined_id("ep_", *scope)


def endpoint_profile(observed: DataFrame, scope: list[str]) -> DataFrame:
    """One row an endpoint: observations, first and last seen, ceilings (NULL is "not measured"), providers."""
    have = [c for c in CEILINGS if c in observed.columns]
    return observed.groupBy(*scope, "template").agg(F.count("*").alias("observations"), F.min("seen_us").alias("first_us"), F.max("seen_us").alias("last_us"), *[F.max(c).alias(f"max_{c}") for c in have], F.array_sort(F.collect_set("provider")).alias("providers"))


def status_histogram(observed: DataFrame, scope: list[str]) -> DataFrame:
    return observed.where("status is not null").groupBy(*scope, "template", "status").agg(F.count("*").alias("n"))


def merge_profiles(parts: DataFrame, scope: list[str]) -> DataFrame:
    """Profiles of the same endpoints merged: sums, extremes and unions."""
    have = [c for c in parts.columns if c.startswith("max_")]
    return parts.groupBy(*scope, "template").agg(F.sum("observations").alias("observations"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *[F.max(c).alias(c) for c in have], F.array_sort(F.array_distinct(F.flatten(F.collect_list("providers")))).alias("providers"))


def merge_histograms(parts: DataFrame, scope: list[str]) -> DataFrame:
    """Status histograms of the same endpoints added up."""
    return parts.groupBy(*scope, "template", "status").agg(F.sum("n").alias("n"))


def merge_cookie_names(parts: DataFrame, scope: list[str]) -> DataFrame:
    """Cookie names of the same endpoints: their union, the first COOKIE_CAP in order, with a mark once some are left out."""
    over = parts.groupBy(*scope, "template").agg(F.max("cookie_names_truncated").alias("_over"))
    out = cookie_name_profile(parts, scope).join(over, [*scope, "template"])
    return out.withColumn("cookie_names_truncated", F.col("cookie_names_truncated") | F.col("_over")).drop("_over")


def parameters(observed: DataFrame, query: str = "query") -> DataFrame:
    """A row for each query parameter: name (ids in brackets folded), value, kind, ok."""
    return observed.withColumn("_p", F.explode(query_pairs(F.col(query)))).withColumn("name", parameter_name(F.col("_p.name"))).withColumn("value", F.col("_p.value")).withColumn("ok", F.col("_p.ok")).drop("_p").withColumn("kind", infer_type(F.col("value")))


def parameter_profile(params: DataFrame, by: list[str], endpoints: DataFrame | None = None, observation: str = "page_id") -> DataFrame:
    """One row a parameter: joined type, length range, presence, distinct values up to ENUM_CAP.

    Values are first counted by (parameter, value), so a parameter with a third of all rows meets
    its distinct values only. Values that look like secrets count for type and length alone.
    """
    counted = params.where("ok").groupBy(*by, "name", "value", "kind").agg(F.count("*").alias("n")).withColumn("secret", contains_secret(F.col("value")))
    out = counted.groupBy(*by, "name").agg(
        join_types(F.collect_set("kind")).alias("inferred_type"), F.sum("n").alias("observations"), F.min(F.length("value")).alias("min_len"), F.max(F.length("value")).alias("max_len"),
        F.least(F.count_if(~F.col("secret")), F.lit(ENUM_CAP)).alias("distinct_estimate"), (F.count_if(~F.col("secret")) > ENUM_CAP).alias("enum_overflowed"),
    )
    present = params.where("ok").groupBy(*by, "name").agg(F.countDistinct(observation).alias("present_count"))
    return out.join(present, [*by, "name"])


def parameter_parts(params: DataFrame, by: list[str], observation: str = "page_id") -> DataFrame:
    """Partial parameter profiles that merge_parameters() can merge: with the values themselves, while they are within ENUM_CAP."""
    whole = parameter_profile(params, by, observation=observation)
    values = enum_values(params, by).groupBy(*by, "name").agg(F.array_sort(F.collect_set("value")).alias("enum_values"))
    return whole.join(values, [*by, "name"], "left").withColumn("enum_values", F.when(~F.col("enum_overflowed"), F.coalesce("enum_values", F.array().cast("array<string>"))))


def merge_parameters(parts: DataFrame, by: list[str]) -> DataFrame:
    """Parameter profiles of disjoint observations merged: sums, extremes, joined types, and the union of values up to ENUM_CAP."""
    out = parts.groupBy(*by, "name").agg(
        join_types(F.collect_set("inferred_type")).alias("inferred_type"), F.sum("observations").alias("observations"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"), F.sum("present_count").alias("present_count"),
        F.max("enum_overflowed").alias("_over"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("enum_values")))).alias("_values"),
    )
    over = F.col("_over") | (F.size("_values") > ENUM_CAP)
    return out.withColumn("enum_overflowed", over).withColumn("enum_values", F.when(~over, F.col("_values"))).withColumn("distinct_estimate", F.when(over, ENUM_CAP).otherwise(F.size("_values")).cast("long")).drop("_over", "_values")


def cookie_name_profile(observed: DataFrame, scope: list[str], names: str = "cookie_names") -> DataFrame:
    """(scope..., template, cookie_names, cookie_names_truncated): the names seen, the first COOKIE_CAP in order."""
    seen = observed.select(*scope, "template", F.explode(names).alias("cookie")).distinct()
    rank = F.row_number().over(Window.partitionBy(*scope, "template").orderBy("cookie"))
    return seen.withColumn("_n", rank).where(F.col("_n") <= COOKIE_CAP + 1).groupBy(*scope, "template").agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= COOKIE_CAP, F.col("cookie")))).alias("cookie_names"), (F.max("_n") > COOKIE_CAP).alias("cookie_names_truncated"))


def retired(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """The stored endpoints whose template is no longer learned: what an upsert removes."""
    return stored.join(current.select(*keys).distinct(), keys, "left_anti")


def profile_response(profiles: DataFrame, params: DataFrame, scope: list[str], may_see_cookies: bool = False) -> DataFrame:
    """Profiles as they are shown: with their parameters, query ones first and then by name, and each one's presence.

    params: (scope..., template, location, name, present_count, inferred_type). Cookie names are
    withheld from callers without the permission.
    """
    keys = [*scope, "template"]
    shown = params.drop("observations").join(profiles.select(*keys, "observations"), keys).select(*keys, F.struct((F.col("location") != "query").alias("later"), "name", "location", "inferred_type", F.when(F.col("observations") > 0, F.round(F.col("present_count") / F.col("observations"), 6)).otherwise(0.0).alias("presence")).alias("p"))
    listed = shown.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.dropFields("later")).alias("parameters"))
    out = profiles.join(listed, keys, "left")
    return out if may_see_cookies or "cookie_names" not in out.columns else out.withColumn("cookie_names", F.lit(None).cast("array<string>"))


def enum_values(params: DataFrame, by: list[str]) -> DataFrame:
    """(by..., name, value, n) of the parameters that stay within ENUM_CAP values."""
    counted = params.where("ok").where(~contains_secret(F.col("value"))).groupBy(*by, "name", "value").agg(F.count("*").alias("n"))
    within = counted.groupBy(*by, "name").agg(F.count("*").alias("k")).where(F.col("k") <= ENUM_CAP).drop("k")
    return counted.join(within, [*by, "name"])


def host_stats(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("host").agg(F.count("*").alias("endpoints"), F.sum("observations").alias("observations"), F.max("last_us").alias("last_us"))


def _listed(profiles: DataFrame, min_observations: int, host: str | None, q: str | None, method: str | None = None) -> DataFrame:
    rows = profiles.where(F.col("observations") >= min_observations)
    rows = rows.where(F.col("method") == method.upper()) if method else rows
    rows = rows.where(F.col("host") == host) if host else rows
    return rows.where(F.col("template").ilike(f"%{q}%")) if q else rows


def profile_total(profiles: DataFrame, min_observations: int = 0, host: str | None = None, q: str | None = None, method: str | None = None) -> DataFrame:
    """How many profiles the pages of profile_list() hold in all."""
    return _listed(profiles, min_observations, host, q, method).agg(F.count("*").alias("total"))


def profile_list(profiles: DataFrame, min_observations: int = 0, host: str | None = None, q: str | None = None, sort: str = "observations", descending: bool = True, limit: int = 50, offset: int = 0, method: str | None = None) -> DataFrame:
    column = {"observations": "observations", "last_seen": "last_us", "path": "template"}.get(sort)
    if column is None:
        raise ValueError("unknown sort key")
    rows = _listed(profiles, min_observations, host, q, method)
    order = F.col(column).desc() if descending else F.col(column).asc()
    return rows.orderBy(order, "host", "template").offset(offset).limit(max(1, min(limit or 50, 200)))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-row replacement by key."""
    return new.unionByName(stored.join(new.select(*keys), keys, "left_anti"))


def latest_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
