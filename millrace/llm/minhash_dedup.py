"""Near-duplicate groups by HyperMinHash.

1. A document's set is its distinct 5-word shingles. Equal sets are one node from here on, so
   copies are never paired.
2. A HyperMinHash sketch has REGISTERS registers; each keeps the leading-zero count and the
   next MANTISSA bits of the smallest hash in its bucket. Small sets enter every element COPIES
   times under different hashes, which keeps the Jaccard similarity and fills the registers.
3. BANDS bands of compressed registers are hashed to keys. A node is confirmed against the
   smallest node of the key it shares most bands with. Nodes that still share a key across
   components are compared sketch by sketch in blocks, and what may be linked meets again in
   the same blocks with full sets. Only confirmed links that span a block are written, so neither
   a large group of near copies nor a large cloud of half-similar texts becomes rows of pairs.
4. Pairs whose collision-corrected estimate is far below the threshold are dropped; the rest
   are confirmed on the full sets. Components of the confirmed links give the groups.

A pair at exactly the threshold misses all bands with a probability of 5e-6; more similar pairs
less. A hot key is split: its members are dealt to lots, whose smallest nodes are merged, and the
pivot's set is sent to as many places as its members need. A text that many rows repeat under one
doc_id or none is one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_hashing import NOT_SPACE, U, chunks, mix, shingles, text_buffer, words
from millrace.operators.components import connected_components, forest_roots
from millrace.staging import discard, release, stage

WORDS = 5
THRESHOLD = 75  # percent
REGISTERS, MANTISSA, BANDS = 128, 10, 32
EMPTY = 0xFFFF
COPIES = 16
#: Sets up to SMALL_MAX have a sketch of copies, sets from LARGE_MIN on a plain one. LARGE_MIN <= 0.75 * SMALL_MAX, so linked sets share a kind.
SMALL_MAX, LARGE_MIN = 200, 150
#: Chance that two registers with different minima agree (HyperMinHash, Yu and Weber 2017).
COLLISION = 0.169919 / (1 << MANTISSA)
#: An estimate this many standard deviations below the threshold is no link.
DEVIATIONS = 6
#: Members of a pivot that one task compares.
MEMBERS = 512
#: Key buckets whose members are counted. One with more than CROWD members, and CROWDED times the mean, is split into lots of about that many.
BUCKETS, CROWD, CROWDED = 1 << 16, 1 << 18, 4
#: Places to which the copies of one text go before the last one is chosen.
LOTS = 256
#: Members of a key that are compared as one block, and the shingles that they may have in all.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs of sketches that are compared at once, and bytes of sets in one batch.
PAIRS, BATCH_BYTES = 1 << 14, 1 << 25

SET = "doc_id long, row binary, n_shingles long, fp binary, small binary, large binary"


def row_key() -> Column:
    """A key of doc_id and text; rows that repeat both share it."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null")))))


def binary(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of width 64-bit numbers from a binary column of that length without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(-1, width)


def linked(both: int, n: int, m: int) -> bool:
    return 100 * both >= THRESHOLD * (int(n) + int(m) - both)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a shorter text is one shingle, one without words has none."""
    data, ends = text_buffer(column)
    for first, last in chunks(ends):
        part = ends[first : last + 1] - ends[first]
        h, _, _, bounds = words(data[ends[first] : ends[last]], part, NOT_SPACE)
        runs = shingles(h, WORDS)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= WORDS:
                yield np.unique(runs[a : b - WORDS + 1])
            else:
                yield shingles(h[a:b], int(b - a)) if b > a else np.empty(0, U)


def fingerprint(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U).tobytes()


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """Sketch of sorted 64-bit hashes: the top bits choose the bucket, the smallest of the rest is compressed."""
    width = 64 - (REGISTERS.bit_length() - 1)
    first = np.searchsorted(sorted_hashes, np.arange(REGISTERS, dtype=U) << U(width))
    filled = np.append(first[1:], len(sorted_hashes)) > first
    low = sorted_hashes[first[filled]] & U((1 << width) - 1)
    zeros = (width - np.frexp(low.astype(np.float64))[1]).astype(U)
    rest = (low << (zeros + U(1))) & U((1 << width) - 1)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[filled] = (zeros << U(MANTISSA)) | (rest >> U(width - MANTISSA))
    return out


def surplus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The collision-corrected estimates of rows of sketches, less the least that leaves a link possible."""
    filled = (x != EMPTY) | (y != EMPTY)
    seen = np.maximum(filled.sum(axis=1), 1)
    agree = ((x == y) & filled).sum(axis=1)
    least = THRESHOLD / 100 - DEVIATIONS * np.sqrt(THRESHOLD / 100 * (1 - THRESHOLD / 100) / seen)
    return (agree - COLLISION * seen) / ((1 - COLLISION) * seen) - least


_seeds = mix(np.arange(1, COPIES + 1, dtype=U) * U(0x2545F4914F6CDD1D))


def sketches(s: np.ndarray) -> tuple[bytes | None, bytes | None]:
    small = registers(np.sort(mix((s[:, None] ^ _seeds[None, :]).ravel()))).tobytes() if 0 < len(s) <= SMALL_MAX else None
    return small, registers(s).tobytes() if len(s) >= LARGE_MIN else None


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, row (its key), n_shingles, fp (of the set; null if empty) and the sketches of each row of docs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), fingerprint(s) if len(s) else None, *sketches(s)) for s in shingle_sets(batch.column("text"))]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True))], ["doc_id", "row", "n_shingles", "fp", "small", "large"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(read, SET)


def bands(regs: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each band of the sketches, and whether it has a filled register."""
    regs = regs.reshape(-1, BANDS, REGISTERS // BANDS)
    key = np.full(regs.shape[:2], U(kind * BANDS)) + np.arange(BANDS, dtype=U)
    for j in range(regs.shape[2]):
        key = mix(key ^ regs[:, :, j].astype(U)) + U(j)
    return key, (regs != EMPTY).any(axis=2)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp, shingles): each node once for every band that has a filled register; shingles is its set size rounded up to a power of two."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, n = binary(batch.column("fp"), 2), np.array(batch.column("n_shingles"))
            for kind, name in enumerate(("small", "large")):
                has = np.array(batch.column(name).is_valid())
                if not has.any():
                    continue
                key, filled = bands(np.frombuffer(b"".join(x for x in batch.column(name).to_pylist() if x), np.uint16), kind)
                owner = np.repeat(fps[has], BANDS, axis=0).reshape(-1, BANDS, 2)[filled]
                wide = np.repeat(1 << np.ceil(np.log2(n[has])).astype(np.int64), BANDS).reshape(-1, BANDS)[filled]
                size = pa.py_buffer(np.arange(0, 16 * len(owner) + 1, 16, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key[filled].view(np.int64)), pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, size, pa.py_buffer(np.ascontiguousarray(owner))]), pa.array(wide)], ["key", "fp", "shingles"])

    return nodes.select("fp", "n_shingles", "small", "large").mapInArrow(read, "key long, fp binary, shingles long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose collision-corrected estimate leaves a link possible."""
    columns = pairs.columns
    side = lambda c: nodes.select(F.col("fp").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("small").alias(f"small_{c}"), F.col("large").alias(f"large_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for name in ("small", "large"):
                a, b = batch.column(f"{name}_a"), batch.column(f"{name}_b")
                has = np.array(a.is_valid()) & np.array(b.is_valid())
                if has.any():
                    x, y = (np.frombuffer(b"".join(v for v, ok in zip(c.to_pylist(), has, strict=True) if ok), np.uint16).reshape(-1, REGISTERS) for c in (a, b))
                    keep[has] |= surplus(x, y) >= 0
            yield batch.filter(pa.array(keep)).select(columns)

    return both.mapInArrow(read, pairs.schema)


def whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that agree in the integer columns by and follow each other, with the bounds of the groups."""

    def bounds(table: pa.Table) -> np.ndarray:
        k = np.stack([np.asarray(table.column(c)) for c in by])
        return np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [len(table)]])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        if len(table):
            at = bounds(table)
            if len(at) > 2:
                yield table.slice(0, at[-2]), at[:-1]
            rest = table.slice(at[-2])
    if rest is not None:
        yield rest, bounds(rest)


def candidates(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of a block group that may be linked across components, each with its partners.

    members: (key, fp, component, few, many, rare): the most common component of a key has no
    pairs of its own, so only the others (rare) fall into few blocks that all meet; its members
    fall into many blocks that meet these. Every pair of blocks is one group, so no task holds
    more than two blocks. A row is (key, lo, hi, at, fp, component, partners): one per member, at
    its place among those written of its group and partners the places of later ones whose
    estimate leaves a link possible. A pair belongs to the first key that both sketches share.
    """
    h = F.xxhash64("fp")
    placed = members.join(nodes.select("fp", "n_shingles", "small", "large"), "fp").withColumn("block", F.when(F.col("rare"), F.pmod(h, "few")).otherwise(F.col("few") + F.pmod(h, "many")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("rare"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)))
    groups = spread.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp", "component", "n_shingles", "small", "large").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block")

    def compare(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        key, lo, hi, block, n = (np.asarray(table.column(c)) for c in ("key", "lo", "hi", "block", "n_shingles"))
        label = binary(table.column("component"), 2)
        known = [np.asarray(table.column(c).is_valid()) for c in ("small", "large")]
        value = [np.frombuffer(b"".join(x or bytes(2 * REGISTERS) for x in table.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("small", "large")]
        keys, filled = (np.concatenate(x, axis=1) for x in zip(*(bands(v, kind) for kind, v in enumerate(value)), strict=True))
        filled &= np.repeat(np.stack(known, axis=1), BANDS, axis=1)
        end = np.repeat(at[1:], np.diff(at))
        later = end - np.arange(len(table)) - 1
        upto = np.cumsum(later)
        left, right, first = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while first < len(table):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(first, last), later[first:last])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[first:last] - later[first:last] - (upto[first - 1] if first else 0), later[first:last])
            meet = (label[i] != label[j]).any(axis=1) & (100 * np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j])) & ((lo[i] == hi[i]) | (block[i] != block[j]))
            i, j = i[meet], j[meet]
            passes = np.zeros(len(i), bool)
            for k, v in zip(known, value, strict=True):
                both = np.flatnonzero(k[i] & k[j])
                passes[both] |= surplus(v[i[both]], v[j[both]]) >= 0
            i, j = i[passes], j[passes]
            shared = (keys[i] == keys[j]) & filled[i] & filled[j]
            here = keys[i, shared.argmax(axis=1)].view(np.int64) == key[i]
            left.append(i[here])
            right.append(j[here])
            first = last
        i, j = np.concatenate(left), np.concatenate(right)
        rows = np.unique(np.concatenate([i, j]))
        opens = np.searchsorted(rows, at[:-1])
        place = np.arange(len(rows)) - opens[np.searchsorted(at, rows, side="right") - 1]
        order = np.argsort(i, kind="stable")
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(i[order], np.append(rows, len(table))).astype(np.int32)), pa.array(place[np.searchsorted(rows, j[order])].astype(np.int32)))
        kept = table.select(["key", "lo", "hi", "fp", "component"]).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*(kept.column(c).combine_chunks() for c in ("key", "lo", "hi")), pa.array(place.astype(np.int32)), *(kept.column(c).combine_chunks() for c in ("fp", "component")), lists], ["key", "lo", "hi", "at", "fp", "component", "partners"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ("key", "lo", "hi")):
            yield compare(table, at)

    return groups.mapInArrow(read, "key long, lo int, hi int, at int, fp binary, component binary, partners array<int>")


def lots(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """keyed with the lot of each row and the number of lots of its key, and whether any key has several: those of crowded buckets.

    At most a BUCKETS / CROWDED number of buckets can be crowded, so their table is broadcast.
    """
    bucket = F.pmod("key", F.lit(BUCKETS))
    sizes = stage(keyed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "buckets")
    bound = max(CROWD, CROWDED * (sizes.agg(F.sum("n")).first()[0] or 0) // BUCKETS)
    crowded = sizes.where(F.col("n") > bound).select("bucket", F.ceil(F.col("n") / bound).cast("int").alias("dealt"))
    number = F.coalesce("dealt", F.lit(1))
    lot = F.coalesce(F.pmod(F.xxhash64("fp"), number), F.lit(0)).cast("int")
    dealt = keyed.withColumn("bucket", bucket).join(F.broadcast(crowded), "bucket", "left").select("key", "fp", "shingles", lot.alias("lot"), number.alias("lots"))
    return dealt, not crowded.isEmpty()


def with_pivots(keyed: DataFrame) -> DataFrame:
    """(key, fp, shingles, pivot): the rows of keys with several nodes, and the smallest node of their key."""
    dealt, several = lots(keyed)
    dealt = dealt.where("key is not null").repartition("key", "lot", "lots")
    # every use reads all columns of dealt and filters none of them, so that its exchange is reused
    parts = dealt.groupBy("key", "lot", "lots").agg(F.min(F.struct("fp", "shingles")).alias("least"), F.count("*").alias("n"), F.max("lots").alias("all"))
    pivots = parts.where("`all` = 1 and n > 1").select("key", "lot", "lots", F.col("least.fp").alias("pivot"))
    if several:
        split = parts.where("`all` > 1").groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.max("all").alias("lots")).where("n > 1")
        pivots = pivots.unionByName(split.select("key", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "lots", F.col("least.fp").alias("pivot")))
    return dealt.join(pivots, ["key", "lot", "lots"]).select("key", "fp", "shingles", "pivot")


def full_sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame) -> DataFrame:
    """(fp, set), one each, for the wanted (fp, row): their texts again. repeated: the row keys that several rows share."""
    texts = docs.select(row_key().alias("row"), "text")
    rows = texts.join(wanted.join(repeated, "row", "left_anti"), "row").select("fp", "text")
    if not repeated.isEmpty():
        copies = texts.join(wanted.join(repeated, "row", "left_semi"), "row")
        some = copies.groupBy("fp", F.pmod(F.spark_partition_id(), F.lit(LOTS)).alias("lot")).agg(F.first("text").alias("text"))
        rows = rows.unionByName(some.groupBy("fp").agg(F.first("text").alias("text")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, first = batch.column("fp"), 0
            held, size = [], 0
            for s in shingle_sets(batch.column("text")):
                held.append(s.tobytes())
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([fps.slice(first, len(held)), pa.array(held, pa.binary())], ["fp", "set"])
                    first, held, size = first + len(held), [], 0
            yield pa.RecordBatch.from_arrays([fps.slice(first, len(held)), pa.array(held, pa.binary())], ["fp", "set"])

    return rows.mapInArrow(read, "fp binary, set binary")


def confirmed_stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. b's set meets those of at most about MEMBERS a at a time."""
    crowd = pairs.groupBy("b").agg(F.floor((F.count("*") - 1) / MEMBERS).cast("int").alias("last"))
    members = pairs.join(crowd, "b").select(F.col("a").alias("fp"), "b", F.pmod(F.xxhash64("a"), F.col("last") + 1).cast("int").alias("lot"), F.lit(1).alias("role"))
    pivots = crowd.select(F.col("b").alias("fp"), "b", F.explode(F.sequence(F.lit(0), "last")).alias("lot"), F.lit(0).alias("role"))
    met = members.unionByName(pivots).join(sets, "fp").repartition("b", "lot").sortWithinPartitions("b", "lot", "role")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pivot = None, None
        for batch in batches:
            found = []
            for fp, b, lot, role, data in zip(*(batch.column(c).to_pylist() for c in ("fp", "b", "lot", "role", "set")), strict=True):
                s = np.frombuffer(data, U)
                if role == 0:
                    place, pivot = (b, lot), s
                elif place == (b, lot) and linked(len(np.intersect1d(pivot, s, assume_unique=True)), len(pivot), len(s)):
                    found.append((fp, b))
            columns = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    return met.mapInArrow(read, "a binary, b binary")


def confirmed_crossings(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components that a link confirmed on full sets joins, spanning what is linked in each block group of candidates()."""
    met = found.join(sets, "fp").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "at")

    def links(rows: pa.Table) -> Iterator[tuple[int, int]]:
        places, partners = np.asarray(rows.column("at")), rows.column("partners").to_pylist()
        at = {p: i for i, p in enumerate(places.tolist())}
        up = np.unique(binary(rows.column("component"), 2), axis=0, return_inverse=True)[1].ravel().tolist()
        up = {c: c for c in up}, up
        held = [np.frombuffer(x, U) for x in rows.column("set").to_pylist()]
        size = np.array([len(s) for s in held])
        number = np.unique(np.concatenate(held), return_inverse=True)[1]
        parts = np.split(number, np.cumsum(size)[:-1])
        mark = np.zeros(int(number.max()) + 1, bool)

        def root(i: int) -> int:
            parent, x = up[0], up[1][i]
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, others in enumerate(partners):
            js = [j for j in (at[p] for p in others) if root(j) != root(i)]
            if not js:
                continue
            mark[parts[i]] = True
            for j in js:
                if root(i) != root(j) and linked(int(np.count_nonzero(mark[parts[j]])), size[i], size[j]):
                    up[0][root(i)] = root(j)
                    yield i, j
            mark[parts[i]] = False

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ("key", "lo", "hi")):
            a, b = [], []
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = table.slice(first, last - first)
                component = rows.column("component").to_pylist()
                for i, j in links(rows):
                    a.append(component[i])
                    b.append(component[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return met.mapInArrow(read, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the group) and kept of each row of docs.

    Null texts and texts without words have an empty set and are linked with nothing. Rows that
    repeat a doc_id count as documents of their own; component_id is null for a group without
    any doc_id. Rows without doc_id or words are their own component. kept: doc_id = component_id.
    Other columns of docs are ignored. An empty table gives no rows.
    """
    rows, labels = _labelled(docs)
    out = rows.join(labels, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of every group: that with the smallest doc_id, and of rows that repeat it the one with the smallest row key.

    Rows without words stay, all of them. The columns are those of docs, whatever their names.
    """
    rows, labels = _labelled(docs)
    heads = rows.join(labels, "fp").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")).select("head.row")
    worded = F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")
    single = docs.where(worded).select(row_key().alias("row"), carried).join(heads, "row", "left_semi").dropDuplicates(["row"])
    return single.select("carried.*").unionByName(docs.where(~worded))


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged (doc_id, row, n_shingles, fp) rows, and (fp, component, component_id) of every node."""
    spark = docs.sparkSession
    table = stage(sketch_table(docs), "sketches")
    nodes = stage(table.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("small").alias("small"), F.first("large").alias("large")), "nodes")

    repeated = stage(table.where("fp is not null").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "repeated")
    members = stage(with_pivots(band_keys(nodes)), "members")
    release(spark)

    stars = members.where("fp <> pivot").groupBy(F.col("fp").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("bands"))
    best = estimated(stars, nodes).groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("b"))
    best = stage(best, "stars")
    release(spark)

    sets = stage(full_sets(docs, members.select("fp").distinct().join(nodes.select("fp", "row"), "fp"), repeated), "sets")
    release(spark)
    links = stage(confirmed_stars(best, sets), "links")
    release(spark)

    trees = forest_roots(links, "a", "b")
    placed = members.join(trees.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "shingles", F.coalesce("component", "fp").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "component", "s")).alias("most")).where("most.n < n")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    open_keys = whole.select("key", F.col("most.component").alias("common"), blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("few"), blocks(F.col("most.n"), F.col("most.s")).alias("many"))
    crossing = placed.join(open_keys, "key").select("key", "fp", "component", "few", "many", (F.col("component") != F.col("common")).alias("rare"))
    found = stage(candidates(crossing, nodes), "candidates")
    release(spark)
    more = stage(confirmed_crossings(found, sets), "links")
    release(spark)
    groups = connected_components(more, "a", "b")

    in_trees = nodes.select("fp", "doc_id").join(trees.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("tree"))
    joined = in_trees.join(groups.withColumnRenamed("node", "tree"), "tree", "left").select("fp", "doc_id", F.coalesce("component", "tree").alias("component"))
    labels = joined.join(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("fp", "component", "component_id")
    labels = stage(labels, "labels")
    discard(spark, sets, best, members, nodes, repeated, links, trees, more, found, groups)
    release(spark)
    return table.select("doc_id", "row", "n_shingles", "fp"), labels
