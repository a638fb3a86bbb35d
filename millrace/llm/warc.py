"""WARC archives in Zstandard form: a dictionary frame first, then one frame a record.

Writing: pages are hashed natively; equal payloads of at least MIN_REVISIT bytes keep the record
with the largest page_id, the others become revisits without payload. Every task writes its
records in order of page_id to files named by partition, so a repeated attempt writes the same
files again; a file gets its name when it is whole.

Reading: the dictionary comes from the leading skippable frame, each record is one frame, and
version line, required headers, block length, record end and payload digest are checked.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.staging import new_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
#: The dictionary is trained on so many pages, the first of each at most SAMPLE_BYTES.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32768
SALTS = 16
LEVEL = 3

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

ROW = "archive string, position long, record_type string, record_id string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def train_dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from a bounded sample in hash order; no bytes if the sample is too small to train on."""
    import zstandard

    # about four times the sample passes a threshold on the hash, so that tasks do not send SAMPLE_PAGES each
    n = pages.count()
    share = min(1.0, 4 * SAMPLE_PAGES / max(n, 1))
    h = F.xxhash64("page_id")
    near = pages.where(h <= F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1))).where(F.length("html") > 0)
    sample = near.select(F.substring(F.encode("html", "UTF-8"), 1, SAMPLE_BYTES).alias("b"), h.alias("h")).orderBy("h", "b").limit(SAMPLE_PAGES)
    pieces = [bytes(r["b"]) for r in sample.collect()]  # at most SAMPLE_PAGES x SAMPLE_BYTES
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", "html", F.length(raw).cast("long").alias("payload_bytes"), F.sha1(raw).alias("payload_digest"))
    groups = hashed.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a payload that a third of all pages share meets its one row in SALTS places
    groups = groups.select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    planned = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(groups, ["payload_digest", "salt"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return planned.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, html: str | None, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    block = b"" if kind == "revisit" else HTTP + b"Content-Length: %d\r\n\r\n" % size + (html or "").encode()
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'null' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": size}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + END


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives and return their manifest (archive, records, bytes).

    pages has page_id, url, html and maybe more columns, which are not archived. A null html is
    an empty payload, a null page_id an id of its own that never keeps a shared payload. Rows
    that repeat a page_id with the same payload share the record type. An empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    dictionary = train_dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **shared)
        lead = struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary
        done: list[tuple[str, int, int]] = []
        out, records, size = None, 0, 0

        def close():
            nonlocal out, records, size
            if out is not None:
                out.close()
                name = f"{root}/part-{task.partitionId():06d}-{len(done):04d}.warc.zst"
                store.move(f"{root}/_{task.taskAttemptId()}", name)
                done.append((name, records, size))
            out, records, size = None, 0, 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/_{task.taskAttemptId()}", compression=None)
                    out.write(lead)
                    size = len(lead)
                frame = squeeze.compress(record_bytes(*row))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])

    planned = plan_records(pages).sortWithinPartitions("page_id", "payload_digest", "url")
    manifest = planned.mapInArrow(write, "archive string, records long, bytes long")
    path = new_path(spark, "manifest")
    manifest.write.parquet(path)
    return spark.read.parquet(path).withColumn("folder", F.lit(folder))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError if it is malformed."""
    head, sep, rest = data.partition(END)
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or no end of the headers")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"malformed header {key!r}")
        headers[key] = value.strip()
    if missing := [k for k in REQUIRED if not headers.get(k)]:
        raise ValueError(f"headers missing: {missing}")
    length = headers["Content-Length"]
    if not length.isdecimal() or len(rest) != int(length) + len(END) or not rest.endswith(END):
        raise ValueError(f"Content-Length {length} does not fit the record of {len(rest)} bytes")
    return headers, rest[: -len(END)]


def frames(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(position, content) of every record frame of an archive."""
    import zstandard

    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != SKIPPABLE_MAGIC:
        raise ValueError("no leading dictionary frame")
    at = 8 + struct.unpack("<I", data[4:8])[0]
    if at > len(data):
        raise ValueError("the dictionary frame is cut off")
    dictionary = bytes(data[8:at])
    if dictionary[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):  # a dictionary may itself be compressed
        dictionary = zstandard.decompress(dictionary)
    reader = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    while at < len(data):
        one, parts, start = reader.decompressobj(), [], at
        while not one.eof:
            piece = data[at : at + 65536]
            if not len(piece):
                raise ValueError(f"the frame at {start} is cut off")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield start, b"".join(parts)


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "null") else None


def read_record(data: bytes) -> tuple:
    headers, block = parse_record(data)
    kind, digest, payload = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:"), None
    size = int(headers["X-Payload-Length"]) if headers.get("X-Payload-Length", "").isdecimal() else None
    if kind == "response":
        http, sep, payload = block.partition(END)
        stated = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        if not sep or not http.startswith(b"HTTP/") or stated != b"%d" % len(payload) or size not in (None, len(payload)):
            raise ValueError("the HTTP block or its length is wrong")
        if digest and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("the payload does not have its digest")
        size = len(payload)
    return kind, headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), _page(headers["WARC-Record-ID"]), size, digest, _page(headers.get("WARC-Refers-To")), payload


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the ``.warc.zst`` files in folder. A malformed archive fails the read with its name and position."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                at = 0
                try:
                    for at, data in frames(memoryview(content.as_buffer())):
                        row = read_record(data)
                        rows.append((name, at, *row[:-1], row[-1] if payloads else None))
                        held += len(data) * payloads
                        if held > 16 << 20 or len(rows) >= 10_000:
                            yield table(rows)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{name}, record after position {at}: {e}") from e
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        names, types = zip(*(x.split() for x in ROW.split(", ")), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(read, ROW)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write pages to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, folder = pages.sparkSession, new_path(pages.sparkSession, "warc")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if not write_archives(pages, folder).head(1):
        return spark.createDataFrame([], ROW).select(*columns)
    return read_archives(spark, folder, payloads=False).select(*columns)
