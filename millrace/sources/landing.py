"""Reading what providers delivered, and lookup tables.

Deliveries lie as text files, gzipped or not, under ``<folder>/provider=<p>/feed=<id>/``. One row
is one record. Spark recognises gzip by the file's extension.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.quality import oversized

#: The probe that a sender posts to test an endpoint; acknowledged and not kept.
PROBE = '{"content":"tests"}'
LANDING = "value string, provider string, feed string"
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
GZIP, BODY_BYTES = b"\x1f\x8b", 128 << 20
#: The head of a syslog line: priority, then version, time, host, program, process and message id (new), or time, host and program (old).
SYSLOG = r"\A<[0-9]{1,3}>(?:1 \S+ \S+ \S+ \S+ \S+ (?:-|(?:\[[^\]]*\])+) ?|[A-Z][a-z]{2} [ 0-9][0-9] [0-9:]{8} \S+ (?:[A-Za-z0-9_./-]+(?:\[[0-9]+\])?: ?)?)?"


def _records(lines: DataFrame, received_at: Column | None = None) -> DataFrame:
    kept = lines.where((F.trim("value") != "") & (F.regexp_replace("value", r"\s", "") != PROBE))
    return kept.select("provider", "feed", (F.current_timestamp() if received_at is None else received_at).alias("received_at"), F.col("value").alias("payload"), oversized(F.col("value")).alias("truncated"), F.substring(F.sha2("value", 256), 1, 16).alias("record_id"))


def read_landing(spark: SparkSession, folder: str, received_at: Column | None = None) -> DataFrame:
    return _records(spark.read.schema(LANDING).text(folder), received_at)


def stream_landing(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return _records(spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files_per_trigger).text(folder))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            where = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
            data = gzip.decompress(content) if content[:2] == GZIP else content
            lines = data.decode("utf-8", "replace").splitlines()
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), *[pa.array([where.get(k)] * len(lines), pa.string()) for k in ("provider", "feed")]], names=["value", "provider", "feed"])


def read_bodies(spark: SparkSession, folder: str, received_at: Column | None = None, stream: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Records of bodies that were stored as they were sent: gzip is told by its first bytes, whatever the file's name.

    A body is one row of its task, as its sender's limit bounds it; files beyond BODY_BYTES raise
    an error, so that none is cut.
    """
    reader = (spark.readStream.schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*")
    files = reader.load(folder).select("path", F.when(F.col("length") <= BODY_BYTES, F.col("content")).otherwise(F.raise_error(F.lit("a body is larger than a sender may send"))).alias("content"))
    return _records(files.mapInArrow(_lines, LANDING), received_at)


def unframed(line: Column) -> Column:
    """What a syslog line says, without its priority, version, time and host; a line without a priority is kept as it is."""
    return F.regexp_replace(line, SYSLOG, "")


def in_utc(line: Column, zone: str) -> Column:
    """A firewall's key="value" line whose date_time, written in the zone's local time, is put into UTC."""
    said = F.regexp_extract(line, r'(?:^|,)date_time="([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"', 1)
    utc = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(said, F.lit("yyyy-MM-dd HH:mm:ss")), zone), "yyyy-MM-dd HH:mm:ss")
    return F.when(utc.isNotNull(), F.replace(line, F.concat(F.lit('date_time="'), said, F.lit('"')), F.concat(F.lit('date_time="'), utc, F.lit('"')))).otherwise(line)


def syslog_records(records: DataFrame, zone: str = "UTC", provider: str = "f5asm") -> DataFrame:
    """records whose payloads of the provider came by syslog: unframed, times in UTC."""
    return records.withColumn("payload", F.when(F.col("provider") == provider, in_utc(unframed(F.col("payload")), zone)).otherwise(F.col("payload")))


def with_feeds(records: DataFrame, feeds: DataFrame) -> DataFrame:
    """Tenant and provider come from the feed (feed, tenant, provider, enabled), never from the record; unknown feeds are dropped."""
    known = feeds.where("enabled").select("feed", "tenant", F.col("provider").alias("feed_provider"))
    return records.join(known, "feed").withColumn("provider", F.col("feed_provider")).drop("feed_provider")


def distinct_records(records: DataFrame) -> DataFrame:
    """A redelivered record is the same record."""
    return records.dropDuplicates(["tenant", "provider", "record_id"])


def read_asn_owners(spark: SparkSession, path: str) -> DataFrame:
    """(asn, owner) of a five-column TSV; the first line of an ASN wins, unrouted and unnamed ranges are left out.

    The order of lines is that of one file, which is how the feed comes; the file name decides
    between files.
    """
    lines = spark.read.schema("first string, last string, asn bigint, country string, owner string").option("sep", "\t").csv(path)
    lines = lines.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    named = lines.where((F.col("asn") > 0) & (F.trim("owner") != "") & (F.lower("owner") != "not routed"))
    return named.groupBy("asn").agg(F.min_by(F.trim("owner"), F.col("_at")).alias("owner"))


def replace_owners(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot over the stored rows; an empty snapshot is refused."""
    if snapshot.isEmpty():
        raise ValueError("an empty snapshot would erase the owners")
    return stored.join(snapshot.withColumnRenamed("owner", "_new"), "asn", "full").select("asn", F.coalesce("_new", "owner").alias("owner"))
