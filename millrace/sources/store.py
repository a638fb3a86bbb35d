"""The tables of the store: keyed events, flows and their versions, raw records, dead letters, audit exports.

Tables are Parquet, partitioned by tenant, day and hour where they have these, so a tenant's read
prunes its partitions and deletion of whole days drops folders. A table's schema lies beside its
first file, so partition values are never guessed. A null is a value like another here: rows
without a day have their own partition, and keys are compared with nulls as equal.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.staging import discard, stage

PARTITIONS = ("tenant", "day", "hour")


def _file(spark: SparkSession, path: str):
    """(file system, path) by Hadoop's client, which knows every store that Spark does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it is there already, which is then left as it is."""
    store, at = _file(spark, path)
    if store.exists(at):
        return False
    out = store.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str | None:
    store, at = _file(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    store, at = _file(spark, path)
    store.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, in order; none if there is no folder."""
    store, at = _file(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def schema_of(spark: SparkSession, path: str) -> StructType | None:
    text = read_small(spark, f"{path}/_table.json")
    return StructType.fromJson(json.loads(text)) if text else None


def _declare(spark: SparkSession, path: str, schema: StructType) -> None:
    write_once(spark, f"{path}/_table.json", schema.json())


def partition_columns(df: DataFrame) -> list[str]:
    """The columns a table is partitioned by; a busy table has hours, so its rewrites stay small."""
    return [c for c in PARTITIONS if c in df.columns]


def folder_of(spark: SparkSession, path: str, row) -> str:
    """The folder of a partition, as Spark's writer names it: with special characters escaped and a name for null."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join([path, *(utils.getPartitionPathString(c, None if row[c] is None else str(row[c])) for c in row.asDict())])


def read(spark: SparkSession, root: str, name: str, tenant: str, days: tuple[str, str] | None = None) -> DataFrame:
    """One tenant's rows, of the days from first to last."""
    if not tenant:
        raise ValueError("a tenant is needed")
    rows = load(spark, f"{root}/{name}")
    if rows is None:
        raise ValueError(f"there is no table {name}")
    rows = rows.where(F.col("tenant") == tenant)
    return rows.where(F.col("day").between(*days)) if days else rows


def load(spark: SparkSession, path: str, within: DataFrame | None = None) -> DataFrame | None:
    """The table at path; None where there is none yet, or none of its rows are left.

    within: rows of its partition columns; then only these partitions are listed and read. One
    entry a partition comes to the driver.
    """
    store, at = _file(spark, path)
    if not store.exists(at):
        return None
    schema = schema_of(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        if within is None:
            return reader.parquet(path)
        there = [f for f in (folder_of(spark, path, r) for r in within.distinct().toLocalIterator()) if store.exists(_file(spark, f)[1])]
        return reader.option("basePath", path).parquet(*there) if there else None
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def matching(rows: DataFrame, marks: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """rows whose keys occur in marks (or, with left_anti, do not); a null key is equal to a null key."""
    named = marks.select(*[F.col(k).alias(f"_mark_{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_mark_{i}")) for i, k in enumerate(keys)])
    return rows.join(named, same, how)


def append(spark: SparkSession, root: str, name: str, new: DataFrame, parts: list[str] | None = None) -> None:
    """parts: what the table is partitioned by, if not by all that it could be; a log that is followed by time has no tenants there."""
    _declare(spark, f"{root}/{name}", new.schema)
    new.write.mode("append").partitionBy(*(parts or partition_columns(new))).parquet(f"{root}/{name}")


def append_new(spark: SparkSession, root: str, name: str, new: DataFrame, keys: list[str], within: DataFrame | None = None) -> None:
    """Append the rows whose keys are not there yet (in the partitions ``within``), each key once."""
    stored = load(spark, f"{root}/{name}", within)
    once = new.dropDuplicates(keys)
    append(spark, root, name, once if stored is None else matching(once, stored.select(*keys), keys, "left_anti"))


def overwrite_by_key(spark: SparkSession, root: str, name: str, new: DataFrame, keys: list[str], gone: DataFrame | None = None, within: DataFrame | None = None) -> None:
    """Replace the rows of new's keys, and delete those of gone's; only the partitions that hold one of them are rewritten.

    within: the partitions in which rows of these keys can lie; all are searched if none are given.
    """
    path, parts = f"{root}/{name}", partition_columns(new)
    _declare(spark, path, new.schema)
    new = stage(new, name)
    old = load(spark, path, None if within is None else within.select(*parts).union(new.select(*parts)))
    if old is None:
        new.write.mode("append").partitionBy(*parts).parquet(path)
        discard(spark, new)
        return
    marks = new.select(*keys) if gone is None else new.select(*keys).union(gone.select(*keys))
    marks = marks.distinct()
    hit = stage(matching(old, marks, keys).select(*parts).union(new.select(*parts)).distinct(), "touched")
    kept = matching(matching(old, hit, parts), marks, keys, "left_anti")
    _rewrite(spark, path, parts, hit, stage(kept.unionByName(new), name))
    discard(spark, new)


def delete_keys(spark: SparkSession, root: str, name: str, gone: DataFrame, keys: list[str]) -> None:
    """Delete the rows whose keys are in gone; only the partitions that hold one are rewritten."""
    rows = load(spark, f"{root}/{name}")
    if rows is None:
        return
    parts, gone = partition_columns(rows), gone.select(*keys).distinct()
    hit = stage(matching(rows, gone, keys).select(*parts).distinct(), "touched")
    _rewrite(spark, f"{root}/{name}", parts, hit, stage(matching(matching(rows, hit, parts), gone, keys, "left_anti"), "kept"))


def delete_where(spark: SparkSession, root: str, name: str, condition: Column) -> None:
    """Rewrite the partitions that hold a matching row without it."""
    rows = load(spark, f"{root}/{name}")
    if rows is None:
        return
    parts = partition_columns(rows)
    hit = stage(rows.where(condition).select(*parts).distinct(), "touched")
    _rewrite(spark, f"{root}/{name}", parts, hit, stage(matching(rows, hit, parts).where(~F.coalesce(condition, F.lit(False))), "kept"))


def _rewrite(spark: SparkSession, path: str, parts: list[str], hit: DataFrame, whole: DataFrame) -> None:
    """Put the staged rows in place of the partitions that were hit, and drop those of which nothing is left."""
    gone = matching(hit, whole.select(*parts).distinct(), parts, "left_anti")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for row in gone.toLocalIterator():
        delete(spark, folder_of(spark, path, row))
    discard(spark, whole, hit)


def audit_export(records: DataFrame, tenant: str, first_us: int, last_us: int, retain_days: int = 7 * 365) -> DataFrame:
    """(n, sha256, retain_days) of the tenant's records of a time range, in order; no row if there are none.

    A line's digest is its own; the manifest's is that of the ordered line digests, so it can be
    checked without holding the export in one place.
    """
    lines = records.where((F.col("tenant") == tenant) & F.col("at_us").between(first_us, last_us)).select("at_us", F.sha2(F.to_json(F.struct(*records.columns)), 256).alias("digest"))
    # a block holds the lines of one hour whose digests share two hex digits, so no row gathers an hour
    block = F.concat_ws(":", F.lpad(F.floor(F.col("at_us") / 3_600_000_000).cast("string"), 12, "0"), F.substring("digest", 1, 2))
    by_hour = lines.groupBy(block.alias("hour")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    return by_hour.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hour", "digest"))), lambda x: x["digest"]), ""), 256).alias("sha256"), F.lit(retain_days).alias("retain_days")).where("n > 0")
