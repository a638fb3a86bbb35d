"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of an item, or the whole of a shorter item. Its shingles
(TOKEN words) are ordered by how often they occur in all documents. Full containment leaves a
prefix of one shingle, the rarest: a window can only occur where this one does. Documents send
the places of such shingles; the places are joined with the windows' prefixes, the shingle's
offset fixes where the window would start, windows that would reach over either end of the
document are dropped, and the rest are compared word by word.

What is broadcast is a bitmap with BITS_A_TOKEN bits for each shingle of the benchmark, but no
more than MOST_BITS (16 MB). It may let other shingles through, which the join drops again: one
in BITS_A_TOKEN of the documents' shingles, and more only for a benchmark of over a million
shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_hashing import ALPHANUMERIC, U, chunks, shingles, text_buffer, words
from millrace.staging import discard, stage

WINDOW = 10
TOKEN = 3
BITS_A_TOKEN, LEAST_BITS, MOST_BITS = 128, 1 << 22, 1 << 27

PLACES = "array<struct<token:long,pos:long,first:long,around:array<string>>>"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, tokens): the windows of each item with the hashes of their shingles. Items without words have none; those without id have windows and no id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            h, start, end, bounds = words(data, ends, ALPHANUMERIC)
            spelt = [bytes(data[a:b]).lower().decode(errors="replace") for a, b in zip(start, end, strict=True)]
            out = []
            for item, a, b in zip(batch.column("item_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                size = min(WINDOW, int(b - a))
                for i in range(a, b - size + 1) if size else ():
                    out.append((item, spelt[i : i + size], shingles(h[i : i + size], min(TOKEN, size)).view(np.int64).tolist()))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], ["item_id", "words", "tokens"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(read, "item_id string, words array<string>, tokens array<long>")


def bitmap(tokens: DataFrame) -> np.ndarray:
    """The bitmap of a column ``token``, sized by its distinct values; at most MOST_BITS / 64 rows come back."""
    n = tokens.select(F.approx_count_distinct("token")).first()[0]
    size = min(max(1 << (BITS_A_TOKEN * n).bit_length(), LEAST_BITS), MOST_BITS)
    bit = F.col("token").bitwiseAND(F.lit(size - 1))
    rows = tokens.select((bit / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(size // 64, np.int64)
    for r in rows:
        out[r["at"]] = r["bits"]
    return out.view(U)


def _passing(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens & U(64 * len(bits) - 1)
    return np.flatnonzero((bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1))


def token_places(h: np.ndarray, bounds: np.ndarray, bits: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, word position, row) of the shingles that pass the bitmap and do not cross rows."""
    found = []
    for size in sizes:
        t = shingles(h, size)
        at = _passing(bits, t)
        row = np.searchsorted(bounds, at, side="right") - 1
        inside = at + size <= bounds[row + 1] if len(at) else np.empty(0, bool)
        found.append((t[at][inside], at[inside], row[inside]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def token_frequencies(docs: DataFrame, bits: np.ndarray, sizes: tuple[int, ...]) -> DataFrame:
    """(token, n) over all documents, for the tokens that pass the bitmap."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            seen = []
            for first, last in chunks(ends):
                h, _, _, bounds = words(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], ALPHANUMERIC)
                seen.append(token_places(h, bounds, bits, sizes)[0])
            token, n = np.unique(np.concatenate(seen) if seen else np.empty(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return docs.select("text").mapInArrow(read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def document_places(docs: DataFrame, bits: np.ndarray, sizes: tuple[int, ...]) -> DataFrame:
    """doc_id, key (of the text), n_words and the places of prefix shingles with the words around them."""
    rows = docs.select("doc_id", F.md5(F.col("text")).alias("key"), "text")
    schema = rows.select("doc_id", "key", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(PLACES).alias("places")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            counts = np.zeros(len(batch), np.int64)
            places: list[list | None] = [None] * len(batch)
            for first, last in chunks(ends):
                part = data[ends[first] : ends[last]]
                h, start, end, bounds = words(part, ends[first : last + 1] - ends[first], ALPHANUMERIC)
                counts[first:last] = np.diff(bounds)
                for token, at, row in zip(*(x.tolist() for x in _signed(token_places(h, bounds, bits, sizes))), strict=True):
                    low, high = max(int(bounds[row]), at - WINDOW + 1), min(int(bounds[row + 1]), at + WINDOW)
                    around = [bytes(part[start[i] : end[i]]).lower().decode(errors="replace") for i in range(low, high)]
                    if places[first + row] is None:
                        places[first + row] = []
                    places[first + row].append({"token": token, "pos": at - int(bounds[row]), "first": low - int(bounds[row]), "around": around})
            kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts), pa.array(places, kind)], ["doc_id", "key", "n_words", "places"])

    return rows.mapInArrow(read, schema)


def _signed(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    return found[0].view(np.int64), found[1], found[2]


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, key, n_words) of every row of docs, and (key, n_hit, items) of the contaminated texts.

    key is the md5 of the text, so equal texts are looked at once and neither null nor repeated
    doc_id values matter. A null text has a null key and no words.
    """
    spark = docs.sparkSession
    windows = stage(item_windows(benchmark), "windows")
    tokens = windows.select("words", "tokens").distinct().select("words", F.posexplode("tokens").alias("offset", "token"))
    sizes = tuple(sorted(min(TOKEN, r[0]) for r in windows.select(F.least(F.size("words"), F.lit(TOKEN)).alias("n")).distinct().collect()))  # at most TOKEN values
    sizes = sizes or (TOKEN,)  # an empty benchmark
    frequency = stage(token_frequencies(docs, bitmap(tokens), sizes), "frequency")
    rare = tokens.join(frequency, "token").groupBy("words").agg(F.count("*").alias("found"), F.min_by(F.struct("token", "offset"), F.struct("n", "offset")).alias("prefix"))
    # a window with a shingle that no document has occurs nowhere
    prefixes = stage(rare.where(F.col("found") == F.size("words") - F.least(F.size("words"), F.lit(TOKEN)) + 1).select("words", F.col("prefix.token").alias("token"), F.col("prefix.offset").alias("offset")), "prefixes")
    rows = stage(document_places(docs, bitmap(prefixes), sizes), "places")
    once = rows.where("places is not null").dropDuplicates(["key"])
    place = once.select("key", "n_words", F.explode("places").alias("p")).select("key", "n_words", "p.*")
    start = F.col("pos") - F.col("offset")
    met = place.join(prefixes, "token").where((start >= 0) & (start + F.size("words") <= F.col("n_words")))
    met = met.where(F.slice("around", (start - F.col("first") + 1).cast("int"), F.size("words")) == F.col("words")).select("key", start.alias("start"), "words")
    hits = met.distinct()
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("words")).alias("to")))), zero,
        lambda a, x: F.struct((a["n"] + F.greatest(x["to"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["to"]).alias("end")), lambda a: a["n"],
    )
    spans = hits.groupBy("key").agg(covered.alias("n_hit"))
    items = hits.select("key", "words").distinct().join(windows.select("item_id", "words").distinct(), "words").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = stage(spans.join(items, "key"), "contaminated")
    discard(spark, windows, frequency, prefixes)
    return rows.select("doc_id", "key", "n_words"), found


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Texts of any length are read as a whole. Equal texts, with one id or several, get equal
    figures; of shingles that are equally rare the first of the window is its prefix, which does
    not change the result. The windows of items without id hit words as others do, but such items
    are neither counted nor named. Other columns are ignored. An empty table gives no rows, and without
    items nothing is contaminated.
    """
    rows, found = contamination(docs, benchmark)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, all columns kept."""
    _, found = contamination(docs, benchmark)
    rows = docs.select(F.md5("text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found.select("key"), "key", "left_anti").select("row.*")
