"""Exports of the audit trail that cannot be altered unseen: ordered blocks of lines, a manifest of digests, written once.

A block holds the lines of one minute in order, as one file. Its digest is that of its lines'
digests, and the manifest's that of the blocks', so one block can be checked without the others
and no task holds more than a block. The blocks lie in a folder named after the manifest's
digest; the manifest is created last and never replaced.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.sources.store import folder_of, read_small, write_once
from millrace.staging import discard, stage

MINUTE_US = 60_000_000
RETAIN_DAYS = 7 * 365


def _blocks(lines: DataFrame) -> DataFrame:
    """(block, n, sha256) of (block, place, line): the digest of the ordered digests of a block's lines."""
    leaves = F.array_sort(F.collect_list(F.struct("place", F.sha2("line", 256).alias("leaf"))))
    return lines.groupBy("block").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(leaves, lambda x: x["leaf"]), ""), 256).alias("sha256"))


def _root(blocks: list) -> str:
    return hashlib.sha256("".join(b["sha256"] for b in blocks).encode()).hexdigest()


def place_of(spark: SparkSession, root: str, tenant: str, from_us: int, to_us: int) -> str:
    return f"{folder_of(spark, f'{root}/audit', Row(tenant=tenant))}/{from_us}-{to_us}"


def export(spark: SparkSession, records: DataFrame, root: str, tenant: str, from_us: int, to_us: int, now_us: int, retain_days: int = RETAIN_DAYS) -> dict | None:
    """Export the tenant's records (at_us and any other columns) from from_us up to to_us; the manifest, or None if there are none.

    An export that is there already is returned as it is. Records without a time are in no range.
    """
    if not tenant:
        raise ValueError("a tenant is needed")
    if to_us <= from_us:
        raise ValueError("a range must end after it starts")
    at = place_of(spark, root, tenant, from_us, to_us)
    if text := read_small(spark, f"{at}/manifest.json"):
        return json.loads(text)
    mine = records.where((F.col("tenant") == tenant) & (F.col("at_us") >= from_us) & (F.col("at_us") < to_us))
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(records.columns)]), {"ignoreNullFields": "false"})
    rows = stage(mine.select(F.floor(F.col("at_us") / MINUTE_US).alias("block"), F.struct("at_us", line.alias("line")).alias("place"), line.alias("line")), "audit")
    blocks = [r.asDict() for r in _blocks(rows).orderBy("block").collect()]  # one row a minute of the range
    if not blocks:
        discard(spark, rows)
        return None
    digest = _root(blocks)
    rows.repartition("block").sortWithinPartitions("block", "place").select("block", "line").write.mode("overwrite").partitionBy("block").text(f"{at}/{digest}")
    discard(spark, rows)
    manifest = {"tenant": tenant, "from_us": from_us, "to_us": to_us, "entry_count": sum(b["n"] for b in blocks), "sha256": digest, "exported_at_us": now_us, "retain_until_us": now_us + retain_days * 86_400_000_000, "blocks": blocks}
    write_once(spark, f"{at}/manifest.json", json.dumps(manifest, sort_keys=True))
    return json.loads(read_small(spark, f"{at}/manifest.json"))


def verify(spark: SparkSession, root: str, tenant: str, from_us: int, to_us: int) -> list[int]:
    """The blocks of an export that are not what its manifest says, or missing, or not in it; -1 if the manifest contradicts itself."""
    at = place_of(spark, root, tenant, from_us, to_us)
    manifest = json.loads(read_small(spark, f"{at}/manifest.json") or "null")
    if manifest is None:
        raise ValueError("there is no such export")
    lines = spark.read.schema("line string, block long").text(f"{at}/{manifest['sha256']}")
    found = _blocks(lines.withColumn("place", F.struct(F.get_json_object("line", "$.at_us").cast("long").alias("at_us"), "line")))
    there = {r["block"]: (r["n"], r["sha256"]) for r in found.collect()}
    said = {b["block"]: (b["n"], b["sha256"]) for b in manifest["blocks"]}
    wrong = sorted(b for b in there.keys() | said.keys() if there.get(b) != said.get(b))
    sound = _root(manifest["blocks"]) == manifest["sha256"] and sum(b["n"] for b in manifest["blocks"]) == manifest["entry_count"]
    return wrong if sound else [-1, *wrong]
