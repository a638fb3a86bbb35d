"""Typed search over flows. Every read goes through ``scoped``."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE = re.compile(r"[A-Za-z0-9 ._:/@+-]{0,256}")
DEFAULT_LIMIT, MAX_LIMIT = 50, 1000


class UnsafeValue(ValueError):
    """A search value outside the allowed characters. The message does not repeat it."""


def safe(name: str, value: str) -> str:
    if not SAFE.fullmatch(value):
        raise UnsafeValue(f"unsafe value for {name}")
    return value


def scoped(df: DataFrame, tenant: str) -> DataFrame:
    """The rows of one tenant; the only way to read a tenant's table."""
    if not tenant:
        raise ValueError("a tenant is needed")
    return df.where(F.col("tenant") == safe("tenant", tenant))


@dataclass(frozen=True)
class FlowSearch:
    """What a caller can ask for; unset fields do not filter."""

    from_us: int | None = None
    to_us: int | None = None
    client_ip: str | None = None
    host: str | None = None
    method: str | None = None
    outcome: str | None = None
    terminating_layer: str | None = None
    rule_id: str | None = None
    country: str | None = None
    completeness: str | None = None
    correlation_method: str | None = None
    status: int | None = None
    asn: int | None = None
    bridged: bool | None = None
    min_layers: int | None = None
    max_layers: int | None = None
    flag: str | None = None
    provider: str | None = None
    vendor_request_id: str | None = None
    ray_id: str | None = None
    quick: str | None = None
    path_prefix: str | None = None
    user_agent: str | None = None
    offset: int = 0
    limit: int = 0

    def __post_init__(self):
        for f in fields(self):
            if isinstance(value := getattr(self, f.name), str):
                safe(f.name, value)
        if self.offset < 0:
            raise ValueError("offset must not be negative")

    def conditions(self) -> list[Column]:
        col, out = F.col, []
        if self.from_us is not None and self.to_us is not None:
            # whole seconds, both ends included
            out.append(col("first_us").between(self.from_us // 1_000_000 * 1_000_000, self.to_us // 1_000_000 * 1_000_000))
        equal = {"client_ip": self.client_ip, "host": self.host, "method": self.method and self.method.upper(), "effective_outcome": self.outcome, "terminating_layer": self.terminating_layer, "rule_id": self.rule_id, "country": self.country and self.country.upper(), "completeness": self.completeness, "correlation_method": self.correlation_method}
        out += [col(c) == v for c, v in equal.items() if v]
        out += [col(c) == v for c, v in {"status": self.status, "asn": self.asn}.items() if v and v > 0]
        if self.bridged is not None:
            out.append(col("bridged") == self.bridged)
        if self.min_layers:
            out.append(col("layer_count") >= self.min_layers)
        if self.max_layers:
            out.append(col("layer_count") <= self.max_layers)
        out += [F.array_contains(c, v) for c, v in {"flags": self.flag, "providers": self.provider}.items() if v]
        out += [F.array_contains(c, f"{ns}:{v}") for c, ns, v in (("vendor_request_ids", "dd", self.vendor_request_id), ("ray_ids", "ray", self.ray_id)) if v]
        if self.quick:
            q = self.quick
            out.append(F.array_contains("ray_ids", f"ray:{q}") | F.array_contains("vendor_request_ids", f"dd:{q}") | (col("flow_id") == q) | col("flow_id").endswith(f":{q}"))
        if self.path_prefix:
            out.append(col("path").startswith(self.path_prefix))
        if self.user_agent:
            out.append(col("user_agent").rlike(self.user_agent))
        return out

    def where(self, flows: DataFrame) -> DataFrame:
        conditions = self.conditions()
        return flows.where(reduce(lambda a, b: a & b, conditions)) if conditions else flows

    def page(self, flows: DataFrame) -> DataFrame:
        """Newest first with flow_id to break ties; at most MAX_LIMIT rows."""
        n = min(self.limit or DEFAULT_LIMIT, MAX_LIMIT)
        return self.where(flows).orderBy(F.col("first_us").desc(), "flow_id").offset(self.offset).limit(n)


def flow_by_id(flows: DataFrame, tenant: str, flow_id: str) -> DataFrame:
    return scoped(flows, tenant).where(F.col("flow_id") == safe("flow_id", flow_id)).orderBy(F.col("last_us").desc()).limit(1)


def raw_by_id(raw: DataFrame, tenant: str, raw_id: str) -> DataFrame:
    """The raw record behind an event."""
    return scoped(raw, tenant).where(F.col("raw_id") == safe("raw_id", raw_id))


def export_redactions(masked: DataFrame, tenant: str = "tenant") -> DataFrame:
    """(tenant, key, redactions) of ordered events (key, pos, masked_fields): the distinct masked fields of a flow, the first seen first."""
    seen = masked.where(F.size("masked_fields") > 0).select(tenant, "key", "pos", F.posexplode("masked_fields").alias("at", "field")).groupBy(tenant, "key", "field").agg(F.min(F.struct("pos", "at")).alias("first"))
    return seen.groupBy(tenant, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "field"))), lambda x: x["field"]).alias("redactions"))


def raw_for_flow(flows: DataFrame, raw: DataFrame) -> DataFrame:
    """The raw record of each event in event order; events whose record is gone are left out."""
    wanted = flows.select("tenant", "flow_id", F.explode("events").alias("e")).select("tenant", "flow_id", F.col("e.pos").alias("pos"), F.col("e.raw_id").alias("raw_id"))
    return wanted.join(raw, ["tenant", "raw_id"])
