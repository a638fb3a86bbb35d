"""Vector code compression: product quantisation whose codebooks come from a filtering Lloyd.

Every partition sorts its vectors into blocks and plants a kd-tree over each of a block's 16
parts, with the bounding box, sum and count of every node; the trees are staged once. A round
walks them from the root with the codebook's entries as candidates: an entry that is farther
than another one from all of a node's box is eliminated, and a node that one entry is left for
is assigned as a whole by its cached sum and count. All figures are whole numbers, so no result
depends on an order. Of a round, at most one row per part and entry leaves a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vectors import matrix, of_one_width, scaled
from millrace.staging import discard, stage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK, LEAF = 8192, 16
#: Components are saturated here, so that squared distances of up to 8,192 dimensions fit a long.
LIMIT = 1 << 24
TREES = "n int, points binary, perm binary, low binary, high binary, total binary"


def _levels(n: int) -> int:
    return max(0, -(-n // LEAF) - 1).bit_length()


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among n sorted points: every node is halved."""
    return (np.arange((1 << level) + 1) * n) >> level


def plant(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(perm, low, high, total) of the kd-tree over points: the nodes of all levels, root first; a node is a slice of perm."""
    n, perm, nodes = len(points), np.arange(len(points)), []
    for level in range(_levels(n) + 1):
        ends, here = _bounds(n, level), points[perm]
        low, high, total = (f.reduceat(here, ends[:-1]) for f in (np.minimum, np.maximum, np.add))
        nodes.append((low, high, total))
        if level < _levels(n):
            owner = np.repeat(np.arange(1 << level), np.diff(ends))
            widest = (high - low).argmax(1)
            perm = perm[np.lexsort((here[np.arange(n), widest[owner]], owner))]
    return perm, *(np.concatenate([x[i] for x in nodes]) for i in range(3))


def walk(points: np.ndarray, tree: tuple, book: np.ndarray) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
    """Nearest entries, ties to the lower index: (whole nodes as (level, node, entry) arrays, (rows, entry) of the points in the leaves that are left)."""
    perm, low, high, _ = tree
    n, k, entry = len(points), len(book), np.arange(len(book))
    norm, depth = (book * book).sum(1), _levels(len(points))
    live, able, settled = np.zeros(1, np.int64), np.ones((1, k), bool), []
    for level in range(depth + 1):
        at = (1 << level) - 1 + live
        lo, hi = low[at][:, None], high[at][:, None]
        away = 2 * book[None] - (lo + hi)
        best = np.where(able, (away * away).sum(2), np.iinfo(np.int64).max).argmin(1)
        step = book[None] - book[best][:, None]
        # the least of (distance to the entry - distance to the best one) over the box, which is linear in the point
        lead = norm[None] - norm[best][:, None] - 2 * (step * np.where(step > 0, hi, lo)).sum(2)
        able &= (lead < 0) | ((lead == 0) & (entry[None] <= best[:, None]))
        one = able.sum(1) == 1
        settled.append((level, live[one], able[one].argmax(1)))
        live, able = live[~one], able[~one]
        if level < depth:
            live, able = (2 * live[:, None] + np.arange(2)).ravel(), np.repeat(able, 2, axis=0)
    ends = _bounds(n, depth)
    size = ends[live + 1] - ends[live]
    leaf = np.repeat(np.arange(len(live)), size)
    rows = perm[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[live], size)]
    if not len(rows):
        return settled, (rows, rows)
    most = int(able.sum(1).max())
    some = np.argsort(~able, axis=1, kind="stable")[:, :most]  # a leaf's candidates by index, then others
    far = np.zeros((len(rows), most), np.int64)
    for j in range(points.shape[1]):
        gap = points[rows, j][:, None] - book[some, j][leaf]
        far += gap * gap
    far[~np.take_along_axis(able, some, 1)[leaf]] = np.iinfo(np.int64).max
    return settled, (rows, some[leaf, far.argmin(1)])


def tally(points: np.ndarray, tree: tuple, book: np.ndarray) -> np.ndarray:
    """Per entry: the count and the componentwise sum of the points it is nearest to; whole nodes by what they cache."""
    settled, (rows, near) = walk(points, tree, book)
    out = np.zeros((len(book), 1 + points.shape[1]), np.int64)
    for level, node, which in settled:
        ends = _bounds(len(points), level)
        np.add.at(out[:, 0], which, ends[node + 1] - ends[node])
        np.add.at(out[:, 1:], which, tree[3][(1 << level) - 1 + node])
    np.add.at(out[:, 0], near, 1)
    np.add.at(out[:, 1:], near, points[rows])
    return out


def nearest(points: np.ndarray, tree: tuple, book: np.ndarray) -> np.ndarray:
    """The entry of every point."""
    settled, (rows, near) = walk(points, tree, book)
    out = np.empty(len(points), np.int64)
    for level, node, which in settled:
        ends = _bounds(len(points), level)
        size = ends[node + 1] - ends[node]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[node], size)
        out[tree[0][place]] = np.repeat(which, size)
    out[rows] = near
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in blocks of BLOCK, so that trees are of one size whatever the batches are."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, BLOCK - n)
            held, n, batch = [*held, part], n + len(part), batch.slice(len(part))
            if n == BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _plant_blocks(width: int, schema: pa.Schema):
    part = -(-width // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = len(block)
            flat = np.zeros((n, PARTS * part), np.int64)
            flat[:, :width] = matrix(block.column("embedding").combine_chunks(), width, LIMIT)
            trees = [plant(flat[:, p * part : (p + 1) * part]) for p in range(PARTS)]
            perm, low, high, total = (np.stack([t[i] for t in trees]) for i in range(4))
            one = lambda name: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), block.column(name).combine_chunks())
            blobs = [x.tobytes() for x in (flat.astype(np.int32), perm.astype(np.int32), low.astype(np.int32), high.astype(np.int32), total)]
            yield pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([n], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=schema.names)

    return run


def _read(batch: pa.RecordBatch, i: int, part: int) -> tuple[np.ndarray, list[tuple]]:
    """The points and the trees of a staged block, by part."""
    n = batch.column("n")[i].as_py()
    blob = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    points = blob("points", np.int32).reshape(n, PARTS, part).astype(np.int64)
    perm = blob("perm", np.int32).reshape(PARTS, n)
    low, high, total = (blob(name, kind).reshape(PARTS, -1, part).astype(np.int64) for name, kind in (("low", np.int32), ("high", np.int32), ("total", np.int64)))
    return points, [(perm[p], low[p], high[p], total[p]) for p in range(PARTS)]


def _round(books: np.ndarray, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, books.shape[1], 1 + part), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                points, trees = _read(batch, i, part)
                for p in range(PARTS):
                    sums[p] += tally(points[:, p], trees[p], books[p])
        where = np.argwhere(sums[:, :, 0])
        found = sums[where[:, 0], where[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(where[:, 0], pa.int32()), pa.array(where[:, 1], pa.int32()), *[pa.array(found[:, j]) for j in range(1 + part)]], names=["part", "entry", "n", *[f"s{j}" for j in range(part)]])

    return run


def _encode(books: np.ndarray, part: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                points, trees = _read(batch, i, part)
                codes = np.stack([nearest(points[:, p], trees[p], books[p]) for p in range(PARTS)], axis=1)
                off = points - books[np.arange(PARTS)[None], codes]
                text = codes.astype(np.uint8).tobytes().hex()
                code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(code), pa.array((off * off).sum((1, 2)))], names=names)

    return run


def vector_codes(table: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(staged rows of vec_id, label, code and error; the codebooks by part, entry and position).

    Vectors that are null or hold a null or non-finite component are dropped, and those of another
    width than the first one by vec_id. A width that 16 does not divide is filled with zeros; a
    component of more than 65,536 is saturated. Of rows that repeat a vec_id the smaller vector comes
    first, rows without one last. With fewer vectors than entries each is an entry; without any,
    there are no rows. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    spark = table.sparkSession
    rows, first = of_one_width(table, entries)
    width = len(first[0]["embedding"]) if first else 0
    part = max(1, -(-width // PARTS))
    ids, labels = table.schema["vec_id"].dataType.simpleString(), table.schema["label"].dataType.simpleString()
    books = np.zeros((PARTS, len(first), part), np.int64)
    for k, row in enumerate(first):
        filled = np.zeros(PARTS * part, np.int64)
        filled[:width] = scaled(row["embedding"], LIMIT)
        books[:, k] = filled.reshape(PARTS, part)
    coded = f"vec_id {ids}, label {labels}, code string, error long"
    if not first:
        return spark.createDataFrame([], coded), books
    layout = f"vec_id array<{ids}>, label array<{labels}>, {TREES}"
    names = pa.schema([(c.strip().split(" ")[0], pa.null()) for c in layout.split(", ")])
    trees = stage(rows.select("vec_id", "label", "embedding").mapInArrow(_plant_blocks(width, names), layout), "trees")
    sums = ", ".join(["part int", "entry int", "n long", *[f"s{j} long" for j in range(part)]])
    for _ in range(rounds):
        # at most one row per part and entry comes back
        for r in trees.drop("vec_id", "label").mapInArrow(_round(books, part), sums).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{j}" for j in range(part)])]).collect():
            books[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(part)]
    out = stage(trees.mapInArrow(_encode(books, part, ["vec_id", "label", "code", "error"]), coded), "codes")
    discard(spark, trees)
    return out, books


def decode(coded: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """coded with ``approximate``: the entries that its code names, as a vector of the table's scale."""
    flat = books.reshape(PARTS, -1, books.shape[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, PARTS)
            near = flat[np.arange(PARTS)[None], codes].reshape(len(codes), -1)[:, :width] / 256
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.float64()))], names=[*batch.schema.names, "approximate"])

    return coded.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema], "approximate array<double>"]))


def code_report(table: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error (of all vectors of its label, those without one together), codebooks_sha256."""
    coded, books = vector_codes(table)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
