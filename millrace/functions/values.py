"""Value types and URL parts for traffic profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type lattice; empty is its bottom, freetext its top, var is for path segments only.
TYPES = ("empty", "bool", "int", "float", "uuid", "ipv4", "ipv6", "email", "date", "hex", "json", "alnum", "freetext", "var")
PROMOTABLE = ("int", "uuid", "hex", "date")
ALNUM_ONLY = ("bool", "int", "hex", "alnum")
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(\.{OCTET}){{3}}"
GROUP = "[0-9A-Fa-f]{1,4}"
#: Full and compressed forms, the last two groups perhaps written as IPv4.
IPV6 = rf"(({GROUP}:){{7}}{GROUP}|({GROUP}:){{6}}{IPV4}|(?=[^.]*::)(?!.*::.*::)({GROUP}(:{GROUP}){{0,6}})?::({GROUP}(:{GROUP}){{0,6}})?|(?!.*::.*::)({GROUP}(:{GROUP}){{0,4}})?::({GROUP}:){{0,5}}{IPV4})"

#: IPv4 written inside IPv6 counts as IPv4.
MAPPED = rf"(?i:(::|(0{{1,4}}:){{5}})ffff:){IPV4}"


def _is(v: Column, pattern: str) -> Column:
    return v.rlike(rf"\A(?:{pattern})\z")


def _ipv6(v: Column) -> Column:
    # a compressed address stands for at least one group: at most seven are written
    groups = F.size(F.filter(F.split(v, ":"), lambda g: g != "")) + F.when(v.contains("."), 1).otherwise(0)
    return v.contains(":") & _is(v, IPV6) & (~v.contains("::") | (groups <= 7))


def _date(v: Column) -> Column:
    day = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd").isNotNull()
    clock = _is(F.substring(v, 11, 60), r"T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])")
    return _is(F.substring(v, 1, 10), "[0-9]{4}-[0-9]{2}-[0-9]{2}") & day & ((F.length(v) == 10) | clock)


def infer_type(v: Column) -> Column:
    """The type of one value; the order of the tests is part of the meaning."""
    json = _is(F.substring(v, 1, 1), r"[{\[]") & (F.length(v) >= 2) & F.try_parse_json(v).isNotNull()
    return (
        F.when(v == "", "empty")
        .when(F.lower(v).isin("true", "false"), "bool")
        .when(_is(v, "-?[0-9]+"), "int")
        .when(_is(v, r"-?[0-9]+\.[0-9]+"), "float")
        .when(_is(v, "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"), "uuid")
        .when(_is(v, IPV4) | _is(v, MAPPED), "ipv4")
        .when(_ipv6(v), "ipv6")
        .when(_is(v, r"[^@\s]+@[^@\s]+\.[^@\s]+"), "email")
        .when(_date(v), "date")
        .when(_is(v, "[0-9A-Fa-f]{8,}"), "hex")
        .when(json, "json")
        .when(_is(v, "[0-9A-Za-z]+"), "alnum")
        .when(v.isNotNull(), "freetext")
    )


def join_types(types: Column) -> Column:
    """Least upper bound of an array of types, in any order."""
    s = F.array_distinct(F.filter(types, lambda t: t != "empty"))
    within = lambda *allowed: F.forall(s, lambda t: t.isin(*allowed))
    return F.when(F.size(s) == 0, "empty").when(F.size(s) == 1, F.get(s, 0)).when(within("int", "float"), "float").when(within("int", "hex"), "hex").when(within(*ALNUM_ONLY), "alnum").otherwise("freetext")


def join_types_py(a: str, b: str) -> str:
    """The pairwise join on the driver, for tests of the closed form."""
    if a == b or b == "empty":
        return a
    if a == "empty":
        return b
    pair = {a, b}
    if pair == {"int", "float"}:
        return "float"
    if pair == {"int", "hex"}:
        return "hex"
    return "alnum" if pair <= set(ALNUM_ONLY) else "freetext"


def matches_type(value: Column, kind: Column) -> Column:
    return (kind == "var") | (join_types(F.array(infer_type(value), kind)) == kind)


def token(kind: Column) -> Column:
    return F.concat(F.lit("{"), kind, F.lit("}"))


def token_type(segment: Column) -> Column:
    return F.nullif(F.regexp_extract(segment, r"\A\{(.+)\}\z", 1), F.lit(""))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def joined_path(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def uri_path(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def uri_query(uri: Column) -> Column:
    """What follows the first question mark, undecoded; NULL if nothing does."""
    return F.nullif(F.regexp_extract(uri, r"\A[^?]*\?([\s\S]*)\z", 1), F.lit(""))


def query_pairs(query: Column) -> Column:
    """array<struct(name, value, ok)>: decoded pairs; a part with a bad escape or a semicolon has ok false."""
    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        name = F.try_url_decode(F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p))
        value = F.when(at > 0, F.try_url_decode(F.substring(p, at + 1, F.length(p)))).otherwise("")
        return F.struct(name.alias("name"), value.alias("value"), (name.isNotNull() & value.isNotNull() & ~p.contains(";")).alias("ok"))

    return F.transform(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != ""), pair)


def parameter_name(name: Column) -> Column:
    """Bracketed indices that look like ids are emptied; word indices stay."""
    def fold(part: Column) -> Column:
        inner = F.regexp_extract(part, r"\A\[([^\[\]]*)\]\z", 1)
        index = part.rlike(r"\A\[[^\[\]]*\]\z")
        return F.when(index & ((inner == "") | infer_type(inner).isin("int", "float", "uuid", "hex", "date")), "[]").otherwise(part)

    parts = F.regexp_extract_all(name, F.lit(r"\[[^\[\]]*\]|[^\[]+|\["), F.lit(0))
    return F.when(name.contains("["), F.array_join(F.transform(parts, fold), "")).otherwise(name)


def canonical_host(host: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.trim(host)), r":[^:\]]*\z", ""), "\0", "")


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("other")
