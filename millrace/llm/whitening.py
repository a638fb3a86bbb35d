"""Embedding whitening by matrix-free block subspace iteration.

The covariance matrix is never formed. Each Spark pass multiplies it with a block of vectors,
X'(XQ) on centred rows, task by task; the driver takes the Rayleigh-Ritz values of the block,
the residual of each wanted component, and the QR factor that the next pass starts from. The
passes end when the residuals certify all components. Where eigenvalues lie too close for the
block to converge soon, the block is widened, at the most to the whole space, in which one pass
is exact. What comes back from a pass is a width x block matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vectors import SCALE, matrix, of_one_width, whole
from millrace.staging import discard, stage

COMPONENTS = 4
#: A component is certified when its residual is below this part of the largest eigenvalue.
TOLERANCE = 1e-13
#: The block is widened when it would take more passes than this to certify.
PATIENCE = 4
PASSES = 200
LONG = (1 << 63) - 1
#: Components are saturated here, that is, at 2**54 / 256 of the vectors' scale; beyond, a double has no fractions.
LIMIT = 1 << 54


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list (exact), its total variance, and the components by falling eigenvalue, as columns of ``basis``."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    basis: np.ndarray
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], np.float64)


def _stack(batches: Iterator[pa.RecordBatch], width: int, column: str = "x") -> Iterator[np.ndarray]:
    for batch in batches:
        if len(batch):
            yield batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)


def _summed(fit: DataFrame, width: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(rows) over all tasks: shape[0] x shape[1] values come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for rows in _stack(batches, width):
            total += of(rows)
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(shape[0] * shape[1])
    for r in fit.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _counted(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for rows in _stack(batches, width):
            n += len(rows)
            safe = len(rows) * (int(np.abs(rows).max(initial=0)) + 1) <= LONG
            total += rows.sum(0).astype(object) if safe else rows.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["d", "v"])

    found = {r["d"]: int(r["v"]) for r in fit.mapInArrow(run, "d int, v string").groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}  # one row a dimension
    return found[-1], [found[d] for d in range(width)]


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector of whole numbers once, staged. Copies are combined before the shuffle."""
    x = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    return stage(rows.select(x.alias("x")).distinct(), "fit_list")


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS, seed: int = 7) -> Whitening:
    """The leading components of the covariance of ``vectors`` (x), up to the rank of it."""
    n, sums = _counted(vectors, width)
    mean = np.array([s / n for s in sums], np.float64)
    dice = np.random.default_rng(seed)
    wanted = min(components, width)
    block = np.linalg.qr(dice.standard_normal((width, min(width, 4 * wanted))))[0]
    trace = float(_summed(vectors, width, (1, 1), lambda rows: np.array([[((rows - mean) ** 2).sum()]]))[0, 0]) / n
    before = None
    for passes in range(1, PASSES + 1):

        def product(rows: np.ndarray, q: np.ndarray = block) -> np.ndarray:
            centred = rows - mean
            return centred.T @ (centred @ q)

        out = _summed(vectors, width, block.shape, product) / n
        small = block.T @ out
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        moved, basis = out @ turn, block @ turn
        top = max(float(values[0]), 0.0)
        off = float(np.linalg.norm(moved[:, :wanted] - basis[:, :wanted] * values[:wanted], axis=0).max())
        if off <= TOLERANCE * top or top == 0.0:
            rank = int((values[:wanted] > 1e-12 * top).sum()) if top else 0
            flip = np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
            return Whitening(n, sums, trace, values[:rank], (basis * flip)[:, :rank], off, passes)
        block = np.linalg.qr(moved)[0]
        if before and block.shape[1] < width:
            rate = min(off / before, 1 - 1e-9)
            if np.log(TOLERANCE * top / off) / np.log(rate) > PATIENCE:
                more = dice.standard_normal((width, min(width - block.shape[1], block.shape[1])))
                block, off = np.linalg.qr(np.hstack([block, more]))[0], None
        before = off
    raise RuntimeError(f"the components were not certified in {PASSES} passes")


def whitened(rows: np.ndarray, w: Whitening) -> np.ndarray:
    return (rows - w.mean) @ w.basis / np.sqrt(w.values)


def identity_error(vectors: DataFrame, width: int, w: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, from a pass over it."""
    k = len(w.values)

    def moments(rows: np.ndarray) -> np.ndarray:
        out = whitened(rows, w)
        return np.vstack([out.T @ out, out.sum(0)])

    found = _summed(vectors, width, (k + 1, k), moments) / w.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def _deviation(rows: np.ndarray, w: Whitening) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S) ** 2; null where no long holds it."""
    sums = np.array(w.sums, object)
    reach = w.n * int(np.abs(rows).max(initial=0)) + max(map(abs, w.sums))
    if rows.shape[1] * reach * reach <= LONG:
        off = rows * w.n - sums.astype(np.int64)
        return (off * off).sum(1).tolist()
    found = ((rows.astype(object) * w.n - sums) ** 2).sum(1)
    return [int(v) if v <= LONG else None for v in found]


def whitening_report(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component up to ``components``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite component are dropped, and those of another
    width than the first one by vec_id. Repeated vectors count once in the fit and all have their
    rows. Components without variance (fewer distinct vectors than components, or fewer dimensions)
    have no rows, so a table of one distinct vector or none gives none. Of equal eigenvalues the
    components are one basis of their space. A deviation that no long holds is null. Other columns are not read.
    """
    spark = table.sparkSession
    id_type = table.schema["vec_id"].dataType.simpleString()
    layout = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, first = of_one_width(table, 1)
    width = len(first[0]["embedding"]) if first else 0
    if not width:
        return spark.createDataFrame([], layout)
    vectors = fit_list(rows)
    w = fit(vectors, width, components)
    k = len(w.values)
    error = identity_error(vectors, width, w) if k else 0.0
    discard(spark, vectors)
    if not k:
        return spark.createDataFrame([], layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("embedding"), width, LIMIT)
            each = np.repeat(np.arange(len(x)), k)
            place = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(place + 1, pa.int32()), pa.array(np.full(len(each), w.n)), pa.array(_deviation(x, w), pa.int64()).take(pa.array(each)),
                pa.array(whitened(x, w).ravel()), pa.array((w.values / w.trace)[place]), pa.array(np.full(len(each), error)),
            ], names=[c.split(" ")[0] for c in layout.split(", ")])

    return rows.select("vec_id", "embedding").mapInArrow(run, layout)


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """table's whole vectors, other columns kept, with ``_white``: the array of their whitened components; empty without variance."""
    rows, first = of_one_width(table.where(whole(F.col("embedding"))), 1)
    width = len(first[0]["embedding"]) if first else 0
    w = None
    if width:
        vectors = fit_list(rows)
        w = fit(vectors, width, components)
        discard(table.sparkSession, vectors)
    if w is None or not len(w.values):
        return rows.withColumn("_white", F.array().cast("array<double>"))
    keep = [c for c in table.columns if c != "_white"]
    layout = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name in keep], "_white array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = whitened(matrix(batch.column("embedding"), width, LIMIT), w) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(list(out), pa.list_(pa.float64()))], names=[*keep, "_white"])

    return rows.select(*[f"`{c}`" for c in keep]).mapInArrow(run, layout)
