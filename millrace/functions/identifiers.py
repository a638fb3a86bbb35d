"""Identifier functions: validity, canonical form, hashes, masks."""

from __future__ import annotations

import hashlib
import hmac as _hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no identifier".
ABSENT = ("", "-", "na", "n/a", "null", "nil", "none", "unknown", "0")


def identifier(namespace: str, value: Column) -> Column:
    """``ns:value`` of a trimmed value, NULL where the value says that there is none."""
    v = F.trim(value)
    return F.when(~F.lower(v).isin(*ABSENT), F.concat(F.lit(namespace + ":"), v))


def identifier_set(*ids: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*ids)))


def canonical(ids: Column) -> Column:
    return F.array_min(ids)


def namespace_of(identifier: Column) -> Column:
    return F.when(F.instr(identifier, ":") > 0, F.substring_index(identifier, ":", 1))


def value_of(identifier: Column) -> Column:
    return F.nullif(F.regexp_extract(identifier, r"^[^:]*:([\s\S]*)$", 1), F.lit(""))


def ray_id(value: Column) -> Column:
    """The ray without its location suffix; a leading dash alone is no suffix."""
    v = F.trim(value)
    return F.when(~v.isin("", "-"), F.when(v.startswith("-"), v).otherwise(F.regexp_extract(v, "^([^-]+)", 1)))


def content_id(prefix: str, payload: Column, width: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, width))


def joined_id(prefix: str, *parts: Column) -> Column:
    """An id of NUL-joined parts, so that no two lists of parts meet."""
    return content_id(prefix, F.concat_ws("\u0000", *[F.coalesce(p, F.lit("")) for p in parts]))


def flow_id(key: Column) -> Column:
    return F.concat(F.lit("flow:"), key)


def method_of(key: Column) -> Column:
    return F.when(key.startswith("heur:"), "heuristic").otherwise("exact")


def keyed_token(value: Column, key: bytes | None) -> Column:
    """``tok_`` and 16 hex digits of HMAC-SHA256; ``[masked]`` without a key; an empty value stays empty."""
    if not key:
        return F.when(value == "", value).otherwise("[masked]")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256))), 256)
    return F.when(value == "", value).otherwise(F.concat(F.lit("tok_"), F.substring(digest, 1, 16)))


def keyed_token_py(value: str, key: bytes) -> str:
    """The same for one value on the driver."""
    return "tok_" + _hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:16]
