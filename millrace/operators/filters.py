"""Ingest filters, host lists and rule expressions, compiled to Columns."""

from __future__ import annotations

import ipaddress
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES, MAX_HOSTS, MAX_PATHS, MAX_REQUESTS, MAX_PATTERNS = 64, 200, 100, 500, 2000

# What an ingest filter may test, and how.
FILTER_FIELDS, FILTER_OPS = ("request_host", "request_path"), ("equals", "suffix", "prefix", "contains")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def drop_filter(rules: list[dict], host: str = "host", path: str = "path") -> Column:
    """True where any value of any rule ({field, op, values}) matches, case aside. An absent subject never matches."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules")
    out = []
    for rule in rules:
        values = [v.strip().lower() for v in rule.get("values", []) if v and v.strip()]
        if not values:
            raise ValueError("a rule without values")
        subject = F.lower(F.nullif(F.col({"request_host": host, "request_path": path}[rule["field"]]), F.lit("")))
        test = {"equals": lambda v, s=subject: s == v, "suffix": lambda v, s=subject: s.endswith(v), "prefix": lambda v, s=subject: s.startswith(v), "contains": lambda v, s=subject: s.contains(v)}[rule["op"]]
        out.append(_any([test(v) for v in values]))
    return F.coalesce(_any(out), F.lit(False))


def checked_rules(filters: Column) -> Column:
    """The rules of a JSON list of {field, op, values} as an array, values trimmed and in lower case; NULL where they break a rule of ``drop_filter``."""
    rules = F.from_json(filters, "array<struct<field:string,op:string,values:array<string>>>")
    tidy = F.transform(rules, lambda r: F.struct(r["field"].alias("field"), r["op"].alias("op"), F.filter(F.transform(r["values"], lambda v: F.lower(F.trim(v))), lambda v: v != "").alias("values")))
    sound = F.forall(tidy, lambda r: F.coalesce(r["field"].isin(*FILTER_FIELDS) & r["op"].isin(*FILTER_OPS) & (F.size(r["values"]) > 0), F.lit(False)))
    return F.when((F.size(tidy) <= MAX_RULES) & sound, tidy)


def validate_hosts(hosts: list[str], paths: list[str]) -> None:
    if len(hosts) > MAX_HOSTS or len(paths) > MAX_PATHS:
        raise ValueError("too many hosts or paths")
    if any("*" in h and (not h.startswith("*.") or "*" in h[1:]) for h in hosts):
        raise ValueError("a wildcard stands for leading labels only")
    if any(not p.startswith("/") for p in paths):
        raise ValueError("a path starts with a slash")


def host_allowed(host: Column, hosts: list[str], enabled: bool = True) -> Column:
    """Exact names, and ``*.suffix`` for the suffix and all below it; a port is taken off."""
    if not enabled or not hosts:
        return F.lit(False)
    name = F.when(host.contains("]"), F.lower(host)).otherwise(F.lower(F.substring_index(host, ":", 1)))
    tests = [(name == h[2:]) | name.endswith(h[1:]) if h.startswith("*.") else name == h for h in map(str.lower, hosts)]
    return F.coalesce(_any(tests), F.lit(False))


def path_excluded(path: Column, prefixes: list[str]) -> Column:
    return F.coalesce(_any([path.startswith(p) for p in prefixes]), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a number; NULL if it is not IPv4."""
    octet = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    valid = ip.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z") & (octet(1) <= 255) & (octet(2) <= 255) & (octet(3) <= 255) & (octet(4) <= 255)
    return F.when(valid, octet(1) * (1 << 24) + octet(2) * (1 << 16) + octet(3) * 256 + octet(4))


def in_networks(ip: Column, networks: list[str]) -> Column:
    """Whether an IPv4 address lies in one of the networks."""
    n = ipv4_number(ip)
    spans = [ipaddress.ip_network(x, strict=False) for x in networks]
    return F.coalesce(_any([n.between(int(s.network_address), int(s.broadcast_address)) for s in spans]), F.lit(False))


# The fields that a rule expression may name, with the flow column behind each; NULL where flows do not hold it.
RULE_FIELDS = {
    "ip_src": "client_ip", "ip_src_asnum": "asn", "ip_src_country": "country", "ip_geoip_asnum": "asn", "ip_geoip_country": "country", "ip_geoip_continent": None,
    "http_host": "host", "http_request_method": "method", "http_request_uri": "path", "http_request_uri_path": "path", "http_request_uri_query": "query", "http_request_full_uri": None, "http_request_version": None, "http_request_body_raw": None,
    "http_user_agent": "user_agent", "http_referer": None, "http_cookie": None, "http_response_code": "status",
    "cf_threat_score": None, "cf_bot_management_score": None, "cf_bot_management_verified_bot": None, "cf_client_bot": None, "cf_edge_server_port": None, "ssl": None,
}
NUMBERS = ("ip_src_asnum", "ip_geoip_asnum", "http_response_code", "cf_threat_score", "cf_bot_management_score", "cf_edge_server_port")
FLAGS = ("cf_bot_management_verified_bot", "cf_client_bot", "ssl")
#: What a rule may be made of besides fields, numbers and quoted text.
RULE_WORDS = ("and", "or", "not", "in", "between", "is", "null", "like", "true", "false")
RULE_FUNCTIONS = ("contains", "startswith", "endswith", "lower", "upper", "length")
RULE_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|'')*')|(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign><=|>=|<>|!=|=|<|>|\(|\)|,))")


class ForbiddenRule(ValueError):
    """A rule with a name, function or character that rules may not have."""


def rule_fields(condition: str) -> list[str]:
    """The fields that a rule names. Every piece of it must be on the list, so a rule can call no other function."""
    at, named, text = 0, [], condition.strip()
    while at < len(text):
        found = RULE_TOKEN.match(text, at)
        if not found:
            raise ForbiddenRule(f"a rule may not hold what follows character {at}")
        at = found.end()
        if name := found["name"]:
            called = text[at:].lstrip().startswith("(")
            if name in RULE_FIELDS and not called:
                named.append(name)
            elif name.lower() not in (RULE_FUNCTIONS + ("in", "and", "or", "not") if called else RULE_WORDS):
                raise ForbiddenRule(f"a rule may not name {name}")
    return named


def evaluate_rules(flows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(flow_id, rule, matched, caveat) for each rule, a Spark SQL condition over RULE_FIELDS.

    Rules are made of fields, literals, comparisons, RULE_WORDS and RULE_FUNCTIONS only; anything
    else raises. A condition that does not parse raises; it is not a rule that does not match. A
    flow without a field that the rule names is compared with an empty value and carries a caveat.
    """
    if len(rules) > MAX_REQUESTS:
        raise ValueError("too many rules")
    kinds = dict(flows.dtypes)

    def value(field: str) -> Column:
        column = RULE_FIELDS[field] if RULE_FIELDS[field] in kinds else None
        empty = F.lit(0) if field in NUMBERS else F.lit(False) if field in FLAGS else F.lit("")
        return F.coalesce(F.col(column), empty.cast(kinds[column])) if column else empty

    named = {name: rule_fields(condition) for name, condition in rules.items()}
    used = sorted({f for fields in named.values() for f in fields})
    absent = {f: F.col(RULE_FIELDS[f]).isNull() if RULE_FIELDS[f] in kinds else F.lit(True) for f in used}
    subject = flows.select("tenant", "flow_id", *[value(f).alias(f) for f in used], *[absent[f].alias(f"_no_{f}") for f in used])
    found = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.expr(condition), F.lit(False)).alias("matched"), _any([F.col(f"_no_{f}") for f in named[name]]).alias("caveat")) for name, condition in rules.items()]
    return subject.select("tenant", "flow_id", F.explode(F.array(*found)).alias("r")).select("tenant", "flow_id", "r.*")


def score_requests(requests: DataFrame, rules: DataFrame, threshold: int = 5, paranoia: int = 1) -> DataFrame:
    """(request_id, matched_rules, score, blocked): every rule (rule_id, pattern, score, paranoia) whose pattern occurs adds its score.

    The rules, at most MAX_PATTERNS, become columns of one pass over the requests. A request
    without a subject matches nothing; rows that repeat a request_id add up.
    """
    active = rules.where(F.col("paranoia") <= paranoia).select("rule_id", "pattern", "score").limit(MAX_PATTERNS + 1).collect()
    if len(active) > MAX_PATTERNS:
        raise ValueError("too many patterns")
    hits = F.array_compact(F.array(F.lit(None).cast("long"), *[F.when(F.col("subject").rlike(r["pattern"]), F.lit(r["score"]).cast("long")) for r in active]))
    each = requests.select("request_id", hits.alias("hits")).select("request_id", F.size("hits").alias("n"), F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))
    return each.groupBy("request_id").agg(F.sum("n").alias("matched_rules"), F.sum("score").alias("score")).withColumn("blocked", F.col("score") >= threshold)


def property_scope(host: Column, properties: list[str]) -> Column:
    """Whether a caller who is limited to some properties may see the host; an empty list sees all."""
    return F.coalesce(F.lower(host).isin(*[p.lower() for p in properties]), F.lit(False)) if properties else F.lit(True)


def profile_config(text: str | None) -> dict:
    """A tenant's profiling settings (enabled, hosts, excluded_paths) from JSON; profiling is off where they are absent, broken or not valid."""
    off = {"enabled": False, "hosts": [], "excluded_paths": []}
    try:
        said = off | {k: v for k, v in json.loads(text or "{}").items() if k in off}
        validate_hosts(said["hosts"], said["excluded_paths"])
    except (ValueError, AttributeError, TypeError):
        return off
    return said


def profiled(seen: DataFrame, configs: DataFrame) -> DataFrame:
    """The rows that their tenant's profiling settings (tenant, config as JSON) let through: profiling is off for tenants without valid ones.

    One entry a tenant comes to the driver, as settings are validated there; the test of a row is
    an expression over its tenant's lists.
    """
    valid = [(r["tenant"], said["hosts"], said["excluded_paths"]) for r in configs.select("tenant", "config").toLocalIterator() if (said := profile_config(r["config"]))["enabled"] is True and said["hosts"]]
    spark = seen.sparkSession
    named = spark.createDataFrame([(t, [h.lower() for h in hosts], paths) for t, hosts, paths in valid], "_tenant string, _hosts array<string>, _paths array<string>")
    name = F.when(F.col("host").contains("]"), F.lower("host")).otherwise(F.lower(F.substring_index("host", ":", 1)))
    listed = F.exists("_hosts", lambda h: F.when(h.startswith("*."), (name == F.substring(h, 3, 1 << 20)) | name.endswith(F.substring(h, 2, 1 << 20))).otherwise(name == h))
    rows = seen.join(named, F.col("tenant") == F.col("_tenant"))
    return rows.where(F.coalesce(listed, F.lit(False)) & ~F.exists("_paths", lambda p: F.coalesce(F.col("path").startswith(p), F.lit(False)))).drop("_tenant", "_hosts", "_paths")
