"""Silence of log sources by timers: an alert comes when a source's cadence has passed, without any new record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "source_id string, state string, before string, at_us long, last_us long"


class SourceWatch(StatefulProcessor):
    """Per source: its cadence, its last delivery and its state.

    awaiting: known, nothing delivered yet; this never becomes silent, as a source that was not
    set up asks for another remedy than one that has stopped. healthy: delivered within its
    cadence. silent: not so. recovered: delivered again after silence, and healthy from the next
    delivery on. A source without a cadence has no timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.source = handle.getValueState("source", "state string, cadence_us long, last_us long")

    def _change(self, key, state, before, at_us, last_us) -> pd.DataFrame:
        return pd.DataFrame([(key[0], state, before, at_us, last_us)], columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"at_us": "Int64", "last_us": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
        before, cadence, last = self.source.get() if self.source.exists() else (None, None, None)
        delivered = False
        for batch in rows:
            known = batch["cadence_us"].dropna()
            cadence = int(known.iloc[-1]) if len(known) else cadence
            delivered = delivered or bool((batch["records"].fillna(0) > 0).any())
        state = before or "awaiting"
        if delivered:
            last, state = now_us, "recovered" if before == "silent" else "healthy"
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None and cadence and state != "silent":
            self.handle.registerTimer((last + cadence) // 1000 + 1)
        self.source.update((state, cadence, last))
        if state != before:
            yield self._change(key, state, before, now_us, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, cadence, last = self.source.get()
        self.source.update(("silent", cadence, last))
        if before != "silent":
            yield self._change(key, "silent", before, timerValues.getCurrentProcessingTimeInMs() * 1000, last)

    def close(self) -> None:
        pass


def source_changes(deliveries: DataFrame) -> DataFrame:
    """CHANGES of a stream of (source_id, cadence_us, records): a row with records is a delivery, one with a cadence makes a source known or changes it.

    Times are those of processing, so a source is silent when it is, whatever its records say.
    Needs the RocksDB state store, and a query that keeps running.
    """
    rows = deliveries.select("source_id", F.col("cadence_us").cast("long"), F.col("records").cast("long"))
    return rows.groupBy("source_id").transformWithStateInPandas(SourceWatch(), CHANGES, "Update", "ProcessingTime")


def silence_alerts(changes: DataFrame) -> DataFrame:
    """Alerts of the changes: one when a source falls silent, one when it is back."""
    return changes.where("state in ('silent', 'recovered')").select("source_id", F.concat_ws("/", F.lit("source_silence"), "source_id").alias("grouping_key"), F.when(F.col("state") == "silent", "high").otherwise("info").alias("severity"), "state", "at_us", "last_us")
