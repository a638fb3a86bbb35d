"""Time quality, masking and shape facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.identifiers import keyed_token

SECOND, DAY = 1_000_000, 86_400_000_000

# Header classes; unlisted names are sensitive.
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-csrf-token")
SENSITIVE_HEADERS = ("x-datadome-clientid", "x-forwarded-for", "referer")
PUBLIC_HEADERS = ("user-agent", "host", "accept", "content-type", "cf-ray")
# Secrets inside free text.
SECRET_PATTERNS = {
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{20,}=*",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
# Parts of parameter names whose values are not kept.
SENSITIVE_NAMES = (
    "password", "passwd", "pwd", "pass", "secret", "token", "auth",
    "apikey", "api_key", "accesskey", "access_key", "sessid", "session",
    "csrf", "xsrf", "cvv", "cvc", "cardnum", "card_number", "cardnumber",
    "ccnum", "ssn", "pin", "otp", "mfa", "private", "credential", "signature",
)


def time_quality(event_us: Column, received_us: Column) -> Column:
    """implausible: none, over a day ahead or 30 days behind; skewed: over a second ahead; else ok."""
    ahead = event_us - received_us
    return F.when(event_us.isNull() | (event_us <= 0) | (ahead > DAY) | (ahead < -30 * DAY), "implausible").when(ahead > SECOND, "skewed").otherwise("ok")


def header_class(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(n.isin(*SECRET_HEADERS), "secret").when(n.isin(*PUBLIC_HEADERS), "public").otherwise("sensitive")


def contains_secret(text: Column) -> Column:
    found = F.lit(False)
    for pattern in SECRET_PATTERNS.values():
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def redact(text: Column) -> Column:
    for name, pattern in SECRET_PATTERNS.items():
        text = F.regexp_replace(text, pattern, f"[redacted:{name}]")
    return text


def mask_headers(headers: Column, key: bytes | None) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(header_class(k) == "secret", "[redacted]").when(header_class(k) == "public", v).otherwise(keyed_token(v, key)))


def masked_header_names(headers: Column) -> Column:
    return F.array_sort(F.transform(F.filter(F.map_keys(headers), lambda k: header_class(k) != "public"), lambda k: F.concat(F.lit("request.headers."), F.lower(k))))


def cookie_names(header: Column) -> Column:
    parts = F.filter(F.transform(F.split(header, ";"), lambda c: F.trim(F.substring_index(c, "=", 1))), lambda c: c != "")
    return F.when(header.isNotNull() & (F.trim(header) != ""), F.array_sort(F.array_distinct(parts)))


def cookie_count(header: Column) -> Column:
    return F.when(header.isNotNull() & (F.trim(header) != ""), F.size(F.filter(F.split(header, ";"), lambda c: F.trim(c) != "")))


def mask_events(events: DataFrame, key: bytes | None = None) -> DataFrame:
    """Normalised events with header values, query and path masked, before anything is stored.

    The names of what was masked go to ``masked_fields`` and the flag ``fields_masked`` is set.
    """
    request, headers = F.col("request"), F.col("request.headers")
    hidden = F.array_compact(F.array(*[F.when(contains_secret(request[c]), f"request.{c}") for c in ("query", "path")]))
    masked = F.concat(F.coalesce(masked_header_names(headers), F.array().cast("array<string>")), hidden)
    out = events.withColumn("_masked", masked).withColumn("request", request.withField("headers", mask_headers(headers, key)).withField("query", redact(request["query"])).withField("path", redact(request["path"])))
    flags = F.coalesce("data_quality_flags", F.array().cast("array<string>"))
    some = F.size("_masked") > 0
    return out.withColumn("masked_fields", F.when(some, F.concat(F.coalesce("masked_fields", F.array().cast("array<string>")), "_masked")).otherwise(F.col("masked_fields"))).withColumn("data_quality_flags", F.when(some, F.array_union(flags, F.array(F.lit("fields_masked")))).otherwise(flags)).drop("_masked")


def encoded_parameters(parameters: Column) -> Column:
    """Parameters as one form-encoded text, sorted by name; NULL where there are none."""
    escaped = F.array_sort(F.transform(F.filter(parameters, lambda p: F.trim(p["name"]) != ""), lambda p: F.concat(F.url_encode(F.trim(p["name"])), F.lit("="), F.url_encode(p["value"]))))
    return F.nullif(F.array_join(escaped, "&"), F.lit(""))


def body_parameters(body: Column, content_type: Column | None = None) -> Column:
    """array<struct(name, value)> of a form body or of a JSON object's top level; sensitive names and secret values are emptied.

    Without a content type the first character decides. Nested JSON values are present and empty.
    Other content types give NULL.
    """
    body, kind = F.trim(body), F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    is_form = kind.contains("application/x-www-form-urlencoded") | ((kind == "") & ~body.startswith("{"))
    is_json = kind.contains("application/json") | body.startswith("{")
    form = F.transform(
        F.filter(F.split(body, "&"), lambda p: p != ""),
        lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"), F.when(F.instr(p, "=") > 0, F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("value")),
    )
    as_map = F.from_json(body, "map<string,string>")
    fields = F.transform(F.array_sort(F.map_keys(as_map)), lambda k: F.struct(k.alias("name"), F.when(F.element_at(as_map, k).rlike(r"\A\s*[{\[]"), "").otherwise(F.coalesce(F.element_at(as_map, k), F.lit(""))).alias("value")))
    sensitive = lambda name: F.coalesce(F.lower(name).rlike("|".join(SENSITIVE_NAMES)), F.lit(True))
    return F.transform(F.when(is_form, form).when(is_json, F.coalesce(fields, F.array().cast("array<struct<name:string,value:string>>"))), lambda p: F.struct(p["name"].alias("name"), F.when(sensitive(p["name"]) | contains_secret(p["value"]), "").otherwise(p["value"]).alias("value")))


def oversized(payload: Column, limit: int = 1 << 20) -> Column:
    """Whether a record has more than limit bytes. It is kept whole: cut records do not parse and cannot be replayed."""
    return F.octet_length(payload) > limit
