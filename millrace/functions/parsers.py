"""Provider records to the common event: one Column program a provider.

Each parser takes raw rows (tenant, received_at, payload and maybe more) and returns the event
columns with ``parse_error``; a row with an error goes to the dead-letter table with its bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.identifiers import content_id, identifier, identifier_set, ray_id
from millrace.functions.quality import body_parameters, cookie_count, cookie_names, encoded_parameters, mask_events, time_quality
from millrace.functions.values import uri_path, uri_query
from millrace.schema import EVENT, LAYERS, PROVIDERS, TERMINAL_ACTIONS

SCHEMA_VERSION, PARSER_VERSION = "1.1", "1"

# Action vocabularies of the providers.
EDGE_ACTIONS = {
    "allow": "allowed", "skip": "allowed", "log": "logged", "block": "blocked", "drop": "blocked", "challenge": "challenged",
    "managed_challenge": "challenged", "managedchallenge": "challenged", "managedchallengenoninteractivesolved": "challenge_passed",
    "managedchallengeinteractivesolved": "challenge_passed", "managedchallengebypassed": "allowed", "jschallenge": "challenged", "js_challenge": "challenged",
    "connection_close": "blocked", "connectionclose": "blocked", "force_connection_close": "blocked", "forceconnectionclose": "blocked", "rate_limit": "rate_limited",
}
LEGACY_EDGE_ACTIONS = {"0": "unknown", "1": "allowed", "2": "blocked", "3": "challenged", "5": "logged"}
BOT_ACTIONS = {"allow": "allowed", "authorize": "allowed", "block": "blocked", "hard_block": "blocked", "captcha": "challenged", "interstitial": "challenged", "challenge": "challenged"}
BOT_CALL_HOST = "api-cloudflare.datadome.co"
BOT_HEADER = "x-datadome-requestid"

_EDGE = "RayID string, ParentRayID string, EdgeStartTimestamp string, EdgeEndTimestamp string, ClientIP string, ClientASN bigint, ClientCountry string, ClientRequestUserAgent string, ClientRequestMethod string, ClientRequestHost string, ClientRequestURI string, EdgeResponseStatus int, CacheCacheStatus string, ClientRequestBytes bigint, BotScore int, SecurityAction string, SecurityActions array<string>, SecurityRuleID string, SecurityRuleIDs array<string>, SecurityRuleDescription string, WAFAction string, WAFRuleID string, FirewallMatchesActions array<string>, FirewallMatchesRuleIDs array<string>, RequestHeaders map<string,string>, ResponseHeaders map<string,string>, _corrupt string"


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _text(v: Column) -> Column:
    return F.nullif(v, F.lit(""))


def lower_keys(*maps: Column) -> Column:
    """The entries of all maps under lower-case keys; of keys that meet, the last non-empty value wins. It needs no map policy of the session."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.filter(F.concat(*[F.coalesce(F.map_entries(m), none) for m in maps]), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(lower, lambda e: e["key"])
    return F.map_from_entries(F.filter(lower, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])))


def edge_timestamp(v: Column) -> Column:
    """RFC 3339 text or epoch nanoseconds, cut to microseconds."""
    return F.when(v.rlike(r"\A[0-9]+\z"), F.when(v != "0", F.timestamp_micros(F.floor(v.cast("decimal(20,0)") / 1000).cast("bigint")))).otherwise(F.try_to_timestamp(_text(v)))


def _event(raw: DataFrame, provider: str, dataset: str, error: Column, **fields: Column) -> DataFrame:
    """Complete the event columns: fixed ones, quality of time, NULL for what a provider does not say."""
    layer = fields.pop("layer", F.lit(PROVIDERS[provider]))
    quality = time_quality(F.unix_micros(fields["event_time"]), F.unix_micros("received_at"))
    flags = F.array_compact(F.array(F.when(quality == "skewed", "clock_skew"), F.when(quality == "implausible", "implausible_time"), F.when(~fields["mapped"], "unmapped_values"), F.when(F.size(fields["identifiers"]) == 0, "no_correlation_key"), F.when(F.col("truncated"), "oversized_record") if "truncated" in raw.columns else F.lit(None)))
    action = fields["action"]
    fields |= {
        "schema_version": F.lit(SCHEMA_VERSION), "parser_version": F.lit(PARSER_VERSION), "provider": F.lit(provider), "dataset": F.lit(dataset), "layer": layer, "layer_ord": (F.array_position(F.array(*map(F.lit, LAYERS)), layer) - 1).cast("int"),
        "tenant": F.col("tenant"), "received_at": F.col("received_at"), "time_quality": quality, "data_quality_flags": flags, "parse_error": error,
        "clock_skew_ms": F.floor((F.unix_micros("received_at") - F.unix_micros(fields["event_time"])) / 1000).cast("bigint"),
        "client": F.struct(*[_text(fields.get(k, F.lit(None).cast("string")).cast("string")).alias(k) for k in ("ip", "asn", "country", "user_agent")]),
        "request": F.struct(*[_text(fields.get(k, F.lit(None).cast("string"))).alias(k) for k in ("method", "host", "path", "query")], fields.get("headers", F.lit(None).cast("map<string,string>")).alias("headers")),
        "response": F.struct(*[fields.get(k, F.lit(None)).alias(k) for k in ("status", "bytes", "duration_ms", "cache_status")]),
        "verdict": F.struct(action.alias("action"), fields.get("terminating", action.isin(*TERMINAL_ACTIONS)).alias("terminating"), *[fields.get(k, F.lit(None).cast("string")).alias(k) for k in ("rule_id", "rule_name", "category")], fields.get("score", F.lit(None)).cast("double").alias("score"), fields.get("reason_raw", F.lit(None).cast("string")).alias("reason_raw"), fields["mapped"].alias("mapped")),
    }
    names = [x.split()[0] for x in _columns(EVENT)]
    kinds = dict(x.split(" ", 1) for x in _columns(EVENT))
    return raw.select(*[fields.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names], F.col("payload"))


def _columns(ddl: str) -> list[str]:
    out, depth, start, text = [], 0, 0, " ".join(ddl.split())
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return out


def parse_edge(raw: DataFrame) -> DataFrame:
    r = F.from_json("payload", _EDGE, {"columnNameOfCorruptRecord": "_corrupt"})
    raw = raw.withColumn("r", r).withColumn("headers", lower_keys(F.col("r.RequestHeaders"), F.col("r.ResponseHeaders")))
    c = lambda n: F.col(f"r.{n}")
    header = lambda n: _text(F.try_element_at(F.col("headers"), F.lit(n)))
    parent = F.when(~F.trim(c("ParentRayID")).isin("", "00"), ray_id(c("ParentRayID")))
    bot_call = (F.lower(c("ClientRequestHost")) == BOT_CALL_HOST) & parent.isNotNull()
    modern = F.lower(F.coalesce(_text(c("SecurityAction")), _text(F.get(c("SecurityActions"), 0))))
    legacy = F.lower(_text(F.get(c("FirewallMatchesActions"), 0)))
    bot_type, status = F.lower(header("x-datadome-responsetype")), c("EdgeResponseStatus")
    bot_action = F.when(status == 200, F.when(bot_type.isin("interstitial", "block", "hard_block"), "logged").otherwise("allowed")).when(status == 403, F.when(bot_type == "hard_block", "blocked").otherwise("challenged")).otherwise("unknown")
    bot_mapped = F.when(status == 200, bot_type.isNull() | bot_type.isin("interstitial", "block", "hard_block", "authorize")).when(status == 403, bot_type.isNull() | bot_type.isin("interstitial", "block", "hard_block")).otherwise(False)
    said = F.when(modern.isNotNull(), F.coalesce(_map(EDGE_ACTIONS, modern), F.lit("unknown"))).when(legacy.isNotNull(), F.coalesce(_map(EDGE_ACTIONS, legacy), F.lit("unknown"))).when(c("WAFAction").isNotNull(), F.coalesce(_map(LEGACY_EDGE_ACTIONS, c("WAFAction")), F.lit("unknown"))).otherwise("allowed")
    known = F.when(modern.isNotNull(), _map(EDGE_ACTIONS, modern).isNotNull()).when(legacy.isNotNull(), _map(EDGE_ACTIONS, legacy).isNotNull()).when(c("WAFAction").isNotNull(), _map(LEGACY_EDGE_ACTIONS, c("WAFAction")).isNotNull() & (c("WAFAction") != "0")).otherwise(True)
    start, end = edge_timestamp(c("EdgeStartTimestamp")), edge_timestamp(c("EdgeEndTimestamp"))
    bad_time = start.isNull() & _text(c("EdgeStartTimestamp")).isNotNull() & (c("EdgeStartTimestamp") != "0")
    error = F.when(c("_corrupt").isNotNull() | F.col("r").isNull(), "malformed json").when(_text(c("RayID")).isNull(), "no RayID").when(bad_time, "bad timestamp")
    cookie = header("cookie")
    return _event(
        raw, "cloudflare", "http_requests", error,
        layer=F.when(bot_call, "bot_management").otherwise("edge"),
        event_id=F.when(bot_call, F.concat(F.lit("ddcall:"), parent)).otherwise(F.concat(F.lit("cf:"), c("RayID"))), raw_id=F.concat(F.lit("cf:"), c("RayID")),
        identifiers=F.when(bot_call, identifier_set(identifier("ray", parent))).otherwise(identifier_set(identifier("ray", ray_id(c("RayID"))), identifier("ray", parent), identifier("dd", header(BOT_HEADER)))),
        ray_id=F.when(bot_call, parent).otherwise(ray_id(c("RayID"))), vendor_request_id=F.when(bot_call, c("RayID")).otherwise(header(BOT_HEADER)),
        event_time=start, ip=c("ClientIP"), asn=F.nullif(c("ClientASN"), F.lit(0).cast("bigint")), country=F.upper(c("ClientCountry")), user_agent=c("ClientRequestUserAgent"),
        method=c("ClientRequestMethod"), host=c("ClientRequestHost"), path=uri_path(c("ClientRequestURI")), query=uri_query(c("ClientRequestURI")), headers=F.col("headers"),
        status=F.nullif(status, F.lit(0)), duration_ms=F.when(end >= start, (F.unix_micros(end) - F.unix_micros(start)) / 1000.0), cache_status=_text(c("CacheCacheStatus")),
        action=F.when(bot_call, bot_action).otherwise(said), mapped=F.when(bot_call, bot_mapped).otherwise(known),
        rule_id=F.coalesce(_text(c("SecurityRuleID")), _text(F.get(c("SecurityRuleIDs"), 0)), _text(F.get(c("FirewallMatchesRuleIDs"), 0)), _text(c("WAFRuleID"))), rule_name=_text(c("SecurityRuleDescription")), score=c("BotScore"),
        bot=F.struct(c("BotScore").alias("cf_bot_score"), header(BOT_HEADER).isNotNull().alias("datadome_present"), header("x-datadome-botname").alias("datadome_botname"), header("x-datadome-ruletype").alias("datadome_ruletype"), bot_type.alias("datadome_action"), header("x-datadome-score").try_cast("double").alias("datadome_score")),
        shape=F.struct(c("ClientRequestBytes").alias("request_bytes"), F.lit(None).cast("int").alias("header_count"), F.lit(None).cast("int").alias("header_bytes"), cookie_count(cookie).alias("cookie_count"), cookie_names(cookie).alias("cookie_names"), F.lit(None).cast("string").alias("body_form")),
    )


def parse_bot(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("r", F.from_json("payload", "map<string,string>")).withColumn("r", F.when(F.col("r").isNotNull(), lower_keys(F.col("r"))))
    first = lambda *names: F.coalesce(*[_text(F.try_element_at(F.col("r"), F.lit(n))) for n in names])
    stamp, request, action = first("timestamp", "date"), first("requestid", "request_id"), F.lower(first("action"))
    when = F.when(stamp.rlike(r"\A[0-9]+\z"), F.timestamp_millis(stamp.try_cast("bigint"))).otherwise(F.try_to_timestamp(stamp))
    error = F.when(F.col("r").isNull(), "malformed json").when(request.isNull(), "no requestid").when(when.isNull(), "bad timestamp")
    uri = first("uri", "url")
    return _event(
        raw, "datadome", "logs_export", error, event_id=F.concat(F.lit("dd:"), request), raw_id=F.concat(F.lit("dd:"), request), identifiers=identifier_set(identifier("dd", request)), vendor_request_id=request, event_time=when,
        ip=first("ip", "client_ip"), asn=first("asn").try_cast("bigint"), country=F.upper(first("country")), user_agent=first("ua", "user_agent"), method=first("method"), host=first("host"), path=uri_path(uri), query=uri_query(uri),
        action=F.coalesce(_map(BOT_ACTIONS, action), F.lit("unknown")), mapped=F.coalesce(_map(BOT_ACTIONS, action).isNotNull(), F.lit(False)), rule_name=first("ruletype"), score=first("botscore").try_cast("double"),
        bot=F.struct(F.lit(None).cast("int").alias("cf_bot_score"), F.lit(True).alias("datadome_present"), first("botname").alias("datadome_botname"), first("ruletype").alias("datadome_ruletype"), action.alias("datadome_action"), first("botscore").try_cast("double").alias("datadome_score")),
    )


def key_values(line: Column) -> Column:
    """map of ``key="value"`` pairs with backslash escapes undone; the last of equal keys wins."""
    pattern = F.lit(r'([A-Za-z0-9_]+)="((?:[^"\\]|\\.)*)"')
    keys, values = F.regexp_extract_all(line, pattern, F.lit(1)), F.regexp_extract_all(line, pattern, F.lit(2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], F.regexp_replace(x["v"], r'\\(["\\])', "$1"))))


def parse_firewall(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("r", key_values(F.col("payload")))
    said = lambda n: F.nullif(F.trim(_text(F.try_element_at(F.col("r"), F.lit(n)))), F.lit("N/A"))
    head = F.replace(F.replace(F.coalesce(said("request"), F.lit("")), F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    line = lambda name: _text(F.trim(F.regexp_extract(head, rf"(?im)^{name}:\s*([^\r\n]+)", 1)))
    stamp = F.coalesce(F.try_to_timestamp(said("date_time"), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(said("date_time")))
    ray, status = ray_id(F.coalesce(said("cf_ray"), line("CF-Ray"))), F.lower(said("request_status"))
    error = F.when(F.size("r") == 0, "no key-value pairs").when(said("support_id").isNull(), "no support_id").when(said("date_time").isNotNull() & stamp.isNull(), "bad timestamp")
    headers = F.filter(F.slice(F.split(F.split(head, "\n\n").getItem(0), "\r?\n"), 2, 1 << 30), lambda h: F.instr(h, ":") > 0)
    action = F.when(status == "blocked", "blocked").when(status == "alerted", "logged").when(status == "passed", "allowed").otherwise("unknown")
    cookie = line("Cookie")
    return _event(
        raw, "f5asm", "asm", error, event_id=F.concat(F.lit("f5:"), said("support_id")), raw_id=F.concat(F.lit("f5:"), said("support_id")), identifiers=identifier_set(identifier("ray", ray)), ray_id=ray, vendor_request_id=said("support_id"), event_time=stamp,
        ip=F.coalesce(said("ip_client"), F.trim(F.substring_index(said("x_forwarded_for_header_value"), ",", 1))), country=F.upper(said("geo_location")), method=said("method"), host=F.coalesce(said("host"), said("virtual_server"), line("Host")), path=said("uri"), query=said("query_string"),
        status=F.nullif(said("response_code").try_cast("int"), F.lit(0)), action=action, terminating=status == "blocked", mapped=F.coalesce(status.isin("blocked", "alerted", "passed"), F.lit(False)),
        rule_id=F.trim(F.substring_index(said("sig_ids"), ",", 1)), rule_name=F.trim(F.substring_index(said("sig_names"), ",", 1)), category=F.coalesce(said("attack_type"), said("violations")),
        shape=F.struct(F.lit(None).cast("bigint").alias("request_bytes"), F.nullif(F.size(headers), F.lit(0)).alias("header_count"), F.nullif(F.aggregate(headers, F.lit(0), lambda s, h: s + F.length(h) + 2), F.lit(0)).alias("header_bytes"), cookie_count(cookie).alias("cookie_count"), cookie_names(cookie).alias("cookie_names"), encoded_parameters(body_parameters(_text(F.regexp_extract(head, r"\n\n([\s\S]*)\z", 1)), line("Content-Type"))).alias("body_form")),
    )


def parse_origin(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("r", F.from_json("payload", "map<string,string>"))
    said = lambda n: F.nullif(F.trim(_text(F.try_element_at(F.col("r"), F.lit(n)))), F.lit("-"))
    stamp = F.try_to_timestamp(said("time_iso8601"))
    status, ray = said("status").try_cast("int"), ray_id(said("cf_ray"))
    error = F.when(F.col("r").isNull(), "malformed json").when(said("time_iso8601").isNull() & said("request_uri").isNull(), "neither time nor URI").when(said("time_iso8601").isNotNull() & stamp.isNull(), "bad timestamp")
    ident = content_id("ngx:", F.col("payload"))
    cookie = said("http_cookie")
    return _event(
        raw, "nginx", "access", error, event_id=ident, raw_id=ident, identifiers=identifier_set(identifier("ray", ray)), ray_id=ray, event_time=stamp,
        ip=F.coalesce(said("cf_connecting_ip"), F.nullif(F.trim(F.substring_index(said("x_forwarded_for"), ",", 1)), F.lit("-")), said("remote_addr")), user_agent=said("user_agent"), method=said("request_method"), host=F.coalesce(said("host"), said("server_name")), path=uri_path(said("request_uri")), query=uri_query(said("request_uri")),
        status=F.nullif(status, F.lit(0)), bytes=said("body_bytes_sent").try_cast("bigint"), duration_ms=said("request_time").try_cast("double") * 1000,
        action=F.when(status == 429, "rate_limited").when(status.isin(401, 403), "blocked").otherwise("allowed"), terminating=F.lit(False), mapped=F.lit(True),
        shape=F.struct(said("request_length").try_cast("bigint").alias("request_bytes"), F.lit(None).cast("int").alias("header_count"), F.lit(None).cast("int").alias("header_bytes"), cookie_count(cookie).alias("cookie_count"), cookie_names(cookie).alias("cookie_names"), F.lit(None).cast("string").alias("body_form")),
    )


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"cloudflare": parse_edge, "datadome": parse_bot, "f5asm": parse_firewall, "nginx": parse_origin}


def parse(raw: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] = PARSERS, token_key: bytes | None = None) -> DataFrame:
    """The event columns of every raw row (tenant, provider, received_at, payload), with ``parse_error`` and the payload.

    Events are masked: secret headers are replaced, sensitive ones become tokens under token_key
    (``[masked]`` without one), and secrets inside queries and paths are cut out. With
    ``truncated`` in raw, long records are flagged.
    """
    parsed = None
    for provider, parser in parsers.items():
        rows = parser(raw.where(F.col("provider") == provider))
        parsed = rows if parsed is None else parsed.unionByName(rows)
    return mask_events(parsed, token_key)


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of parsed rows; a dead letter keeps its bytes."""
    bad = F.col("parse_error").isNotNull()
    dead = parsed.where(bad).select(F.substring(F.sha2("payload", 256), 1, 16).alias("dead_letter_id"), "tenant", "provider", "received_at", "payload", F.col("parse_error").alias("reason"), "parser_version", F.lit("pending").alias("state"))
    return parsed.where(~bad).drop("parse_error", "payload"), dead


def normalize(raw: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] = PARSERS, token_key: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of raw rows."""
    return split(parse(raw, parsers, token_key))
