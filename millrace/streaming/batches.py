"""What the streams' batch functions share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def brief(each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """each, whose errors keep their kind and the first lines of their text.

    A query that is stopped while a batch runs looks for the cause in the error's text with a
    pattern that overflows the stack on long ones, and then never ends.
    """

    @wraps(each)
    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            each(batch, batch_id)
        except Exception as e:
            text = f"batch {batch_id}: {type(e).__name__}: {str(e)[:400]}"
        else:
            return
        raise RuntimeError(text)

    return run
