"""Removal of byte strings of LENGTH that occur earlier, found by a sample of places that covers equal strings.

This departs from a difference-cover suffix sort (see the README): the sample is chosen by content
and not by position, names are hashes and not ranks, and neither names are recursed on nor orders
of suffixes merged. What it does:

1. Sample: the positions whose GRAM-byte hash is smallest in some run of LENGTH - GRAM + 1. Every
   string of LENGTH bytes holds one, and equal strings hold it at the same place. That is about
   one position in 35.
2. Group the sampled places by the hash of the bytes that all strings through the place share,
   and by their reach (all bytes that such strings cover). Places of equal bytes and reach are one
   as far as LENGTH bytes go: all but the earliest are removed.
3. Where equal bytes have several reaches, which is only at the ends of repeats, the strings
   through the place are dealt into ZONES by their start, each with more bytes in common and a
   shorter reach, and are grouped as before.
4. Zones that still have several reaches are taken apart into their single strings, which are
   grouped by their hash: all but the earliest of a group are removed.

Order is that of doc_id, then of start. Groups are formed by hash partition and sorted streams,
so a task holds one row of a group and never the group. A place whose bytes equal those of an
earlier one of its own input batch is settled before the shuffle and dealt by its place instead
of its hash, so bytes that many copies share send one row a batch and reach to their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_hashing import U, _table, chunks, mix, powers, text_buffer
from millrace.staging import discard, release, stage

LENGTH = 100
GRAM = 32
RUN = LENGTH - GRAM + 1
#: Distances from a string's start to the sampled position, by zone; then the whole range, and a single string.
ZONES = 4
FROM = np.array([RUN * z // ZONES for z in range(ZONES)] + [0, 0])
TO = np.array([RUN * (z + 1) // ZONES - 1 for z in range(ZONES)] + [RUN - 1, 0])
WHOLE, SINGLE = ZONES, ZONES + 1


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every run of width entries, by doubling."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


class Sums:
    """Prefix sums that give the hash of any substring."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _table):
        self.sums = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(table[data] * powers("up", len(data)), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * powers("down", len(self.sums))[start] + (end - start).astype(U))


_second = mix(_table ^ U(0xD6E8FEB86659FD93))


def sample(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the text, name, reach) of the sampled positions of the texts in data."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(U), none.view(U)
    sums = Sums(data)
    at = np.arange(len(data) - GRAM + 1)
    name = sums.hash(at, at + GRAM)
    low = _sliding(name, RUN, np.minimum)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(low)]
    low[at[: len(low)] + LENGTH > ends[row + 1]] = 0  # runs that cross into the next text
    padded = np.concatenate([np.zeros(RUN - 1, U), low, np.zeros(RUN - 1, U)])
    p = np.flatnonzero(_sliding(padded, RUN, np.maximum)[: len(name)] == name)
    row = np.searchsorted(ends, p, side="right") - 1
    return row, p - ends[row], name[p], reach(sums, p, WHOLE, ends[row], ends[row + 1])


def reach(sums: Sums, p: np.ndarray, zone, low, high) -> np.ndarray:
    """Name of all bytes of the text low to high that strings of the zone through p cover."""
    left, right = np.maximum(low, p - TO[zone]), np.minimum(high, p - FROM[zone] + LENGTH)
    with np.errstate(over="ignore"):
        return mix(sums.hash(left, right) + (p - left).astype(U))


def numbered(docs: DataFrame) -> DataFrame:
    """(place, doc_id, text): place orders the documents by doc_id, those without one last.

    Rows that repeat a doc_id with another text are ordered by the md5 of the text; rows that
    repeat both are one document and share its result.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if dict(rows.dtypes)["doc_id"] in ("bigint", "int") and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").cast("long").alias("place"), "doc_id", "text")
    keyed = rows.withColumn("key", F.md5("text"))
    places = stage(keyed.select("doc_id", "key").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "key").withColumn("place", F.monotonically_increasing_id()), "places")
    places = places.select(F.struct("doc_id", "key").alias("row"), "place")
    return keyed.join(places, F.struct("doc_id", "key").eqNullSafe(F.col("row"))).select("place", "doc_id", "text")


#: mark: position * 8 + zone, and SETTLED for what is known to be a repeat; HELD sampled positions are looked at together
SETTLED, HELD = 1 << 62, 1 << 20
SAMPLED = "name long, reach long, place long, mark long"
SPANS = "place long, mark long, open boolean"


def settled(name: np.ndarray, reach: np.ndarray, place: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """Rows of SAMPLED, each position once; those equal to an earlier one here have SETTLED added to their mark and a name from their place."""
    order = np.lexsort((mark, place, reach, name))
    name, reach, place, mark = (x[order] for x in (name, reach, place, mark))
    same = np.zeros(len(name), bool)
    same[1:] = (name[1:] == name[:-1]) & (reach[1:] == reach[:-1])
    once = np.ones(len(name), bool)
    once[1:] = ~(same[1:] & (place[1:] == place[:-1]) & (mark[1:] == mark[:-1]))
    name, reach, place, mark, same = (x[once] for x in (name, reach, place, mark, same))
    name, mark = np.where(same, mix(place.view(U)), name), np.where(same, mark + SETTLED, mark)
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(reach.view(np.int64)), pa.array(place), pa.array(mark)], ["name", "reach", "place", "mark"])


def sampled(texts: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            place, held, size = batch.column("place").to_numpy(zero_copy_only=False), [], 0
            for first, last in chunks(ends):
                row, pos, name, reach = sample(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
                held.append((name, reach, place[first + row], pos * 8 + WHOLE))
                size += len(name)
                if size >= HELD:
                    yield settled(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield settled(*map(np.concatenate, zip(*held, strict=True)))

    return texts.select("place", "text").mapInArrow(read, SAMPLED)


def neighbours(rows: DataFrame) -> DataFrame:
    """Of the sampled positions: spans of those equal to an earlier one, and the open ones, the first of their reach under a name with several."""
    ordered = rows.repartition("name").sortWithinPartitions("name", "reach", "place", "mark")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # name, reach, place and mark of the last row so far
        waiting = None  # (place, mark) of the first reach of that name, until another one comes

        def out(place, mark, is_open):
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(mark, pa.int64()), pa.array(np.full(len(place), is_open))], ["place", "mark", "open"])

        for batch in batches:
            if not len(batch):
                continue
            name, reached, place, mark = (batch.column(c).to_numpy() for c in ("name", "reach", "place", "mark"))
            known = mark >= SETTLED
            if known.any():
                yield out(place[known], mark[known] - SETTLED, False)
                name, reached, place, mark = (x[~known] for x in (name, reached, place, mark))
                if not len(name):
                    continue
            same_name = np.empty(len(name), bool)
            same_name[1:] = name[1:] == name[:-1]
            same_name[0] = held is not None and held[0] == name[0]
            same = same_name.copy()
            same[1:] &= reached[1:] == reached[:-1]
            same[0] = same_name[0] and held[1] == reached[0]
            repeat = same.copy()  # the same position of a repeated row
            repeat[1:] &= (place[1:] == place[:-1]) & (mark[1:] == mark[:-1])
            repeat[0] = same[0] and held[2:] == (place[0], mark[0])
            later = same_name & ~same  # the first of a further reach of its name
            lead = np.flatnonzero(~same_name)
            # the first reach of a name is open if a further one follows
            group = np.cumsum(~same_name)
            further = np.zeros(group[-1] + 1, bool)
            further[group[later]] = True
            opens = later.copy()
            opens[lead] = further[group[lead]]
            if waiting is not None and further[0]:
                yield out([waiting[0]], [waiting[1]], True)
                waiting = None
            if len(lead):
                waiting = None if further[group[-1]] else (place[lead[-1]], mark[lead[-1]])
            same &= ~repeat
            if same.any():
                yield out(place[same], mark[same], False)
            if opens.any():
                yield out(place[opens], mark[opens], True)
            held = (name[-1], reached[-1], place[-1], mark[-1])

    return ordered.mapInArrow(read, SPANS)


def _with_texts(texts: DataFrame, opens: DataFrame) -> DataFrame:
    return texts.join(opens.groupBy("place").agg(F.collect_list("mark").alias("marks")), "place").select("place", "text", "marks")


def zoned(texts: DataFrame, opens: DataFrame) -> DataFrame:
    """The zones of the open positions, named as the samples are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            for i, place in enumerate(batch.column("place").to_pylist()):
                text = data[ends[i] : ends[i + 1]]
                p, zone = np.repeat(batch.column("marks")[i].values.to_numpy() >> 3, ZONES), np.tile(np.arange(ZONES), len(batch.column("marks")[i].values))
                real = (np.maximum(FROM[zone], p + LENGTH - len(text)) <= np.minimum(TO[zone], p))
                p, zone = p[real], zone[real]
                sums = Sums(text)
                with np.errstate(over="ignore"):
                    name = mix(sums.hash(p - FROM[zone], p - TO[zone] + LENGTH) + zone.astype(U))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(reach(sums, p, zone, 0, len(text)).view(np.int64)), pa.array(np.full(len(p), place, np.int64)), pa.array(p * 8 + zone)], ["name", "reach", "place", "mark"])

    return _with_texts(texts, opens).mapInArrow(read, SAMPLED)


def remaining(texts: DataFrame, opens: DataFrame) -> DataFrame:
    """(h1, h2, place, start) of every string of the open zones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            for i, place in enumerate(batch.column("place").to_pylist()):
                text, marks = data[ends[i] : ends[i + 1]], batch.column("marks")[i].values.to_numpy()
                p, zone = marks >> 3, marks & 7
                wanted = np.zeros(len(text) + 1, np.int32)
                np.add.at(wanted, np.maximum(p - TO[zone], 0), 1)
                np.add.at(wanted, np.minimum(p - FROM[zone], len(text) - LENGTH) + 1, -1)
                start = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                one, two = (Sums(text, t).hash(start, start + LENGTH).view(np.int64) for t in (_table, _second))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(start), place, np.int64)), pa.array(start.astype(np.int64))], ["h1", "h2", "place", "start"])

    return _with_texts(texts, opens).mapInArrow(read, "h1 long, h2 long, place long, start long")


def adjacent(strings: DataFrame) -> DataFrame:
    """(place, mark) of the strings equal to their predecessor in the merged order."""
    ordered = strings.repartition("h1").sortWithinPartitions("h1", "h2", "place", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            a, b, place, start = (batch.column(c).to_numpy() for c in ("h1", "h2", "place", "start"))
            same = np.empty(len(a), bool)
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & ((place[1:] != place[:-1]) | (start[1:] != start[:-1]))
            same[0] = held is not None and held[:2] == (a[0], b[0]) and held[2:] != (place[0], start[0])
            held = (a[-1], b[-1], place[-1], start[-1])
            yield pa.RecordBatch.from_arrays([pa.array(place[same]), pa.array(start[same] * 8 + SINGLE)], ["place", "mark"])

    return ordered.mapInArrow(read, "place long, mark long")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the union; runs that touch are one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered texts, and staged (place, spans) of what to remove from them."""
    spark, texts = docs.sparkSession, numbered(docs)
    steps = [stage(neighbours(sampled(texts)), "samples")]
    release(spark)
    steps.append(stage(neighbours(zoned(texts, steps[0].where("open"))), "zones"))
    release(spark)
    again = adjacent(remaining(texts, steps[1].where("open")))
    spans = stage(again.unionByName(steps[0].where("not open").drop("open")).unionByName(steps[1].where("not open").drop("open")).groupBy("place").agg(F.collect_list("mark").alias("spans")), "spans")
    discard(spark, *steps)
    release(spark)
    return texts, spans


def _cut(text: np.ndarray, marks: np.ndarray | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if marks is None or not len(marks):
        return text.tobytes(), 0, 0
    p, zone = marks >> 3, marks & 7
    start, stop = merged(np.maximum(p - TO[zone], 0), np.minimum(p - FROM[zone] + LENGTH, len(text)))
    edge = np.zeros(len(text) + 1, np.int8)
    edge[start] += 1
    edge[stop] -= 1
    return text[np.cumsum(edge[:-1]) == 0].tobytes(), int((stop - start).sum()), len(start)


def _apply(docs: DataFrame, what, schema: str, columns: list[str]) -> DataFrame:
    texts, spans = repeated_spans(docs)
    met = texts.join(spans, "place", "left").select("doc_id", "text", "spans")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            rows = [what(data[ends[i] : ends[i + 1]], *_cut(data[ends[i] : ends[i + 1]], s.values.to_numpy() if s.is_valid else None)) for i, s in enumerate(batch.column("spans"))]
            made = zip(*rows, strict=True) if rows else [[] for _ in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in made)], ["doc_id", *columns])

    return met.mapInArrow(read, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text without the bytes that occur earlier; a cut inside a character leaves a replacement character."""
    return _apply(docs, lambda text, left, removed, runs: (left.decode(errors="replace"),), "text string", ["text"])


def repeats_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts shorter than LENGTH lose nothing. An empty table gives no rows.
    """
    return _apply(docs, lambda text, left, removed, runs: (len(text), removed, runs, hashlib.sha256(left).hexdigest()), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
