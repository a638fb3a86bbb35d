"""Vectors of a table as whole numbers: which rows count, and their matrix inside an Arrow task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole(embedding: Column) -> Column:
    """True for a vector that is not null and whose components are neither null nor infinite nor NaN."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, good), F.lit(False))


def of_one_width(table: DataFrame, first: int) -> tuple[DataFrame, list]:
    """(the whole vectors of the width of the first one by vec_id, the first rows of these).

    The rows that come back to the driver are ``first`` in number, ordered by vec_id, those without
    one last, and by vector. A vector of another width has no place among the others and is left out.
    """
    good = table.where(whole(F.col("embedding")))
    ahead = lambda t: t.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(first).collect()
    rows = ahead(good)
    width = len(rows[0]["embedding"]) if rows else 0
    good = good.where(F.size("embedding") == width)
    return good, rows if all(len(r["embedding"]) == width for r in rows) else ahead(good)


def scaled(values, limit: int) -> np.ndarray:
    """floor(256 * c) of every component as a long, saturated at +-limit."""
    return np.clip(np.floor(np.asarray(values, np.float64) * SCALE), -limit, limit).astype(np.int64)


def matrix(column: pa.Array, width: int, limit: int) -> np.ndarray:
    """The whole-number matrix of a column of vectors of one width."""
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return scaled(flat, limit).reshape(len(column), width)
