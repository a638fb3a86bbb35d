"""Pull sources: windows of a provider's export, with the watermark as the stream's offset.

``bot_export_slices`` is the one for a cluster: a window is cut into slices that tasks fetch by
themselves, so no record passes the driver, and a lost task fetches its slice again. Spark's
checkpoint holds the watermark, which moves when a batch is done, over empty windows too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

WINDOW = timedelta(minutes=5)


def next_window(watermark: str | None, now: datetime) -> tuple[datetime, datetime]:
    """From the watermark, five minutes back at first, for five minutes at most and never past now."""
    start = datetime.fromisoformat(watermark) if watermark else now - WINDOW
    return start, min(start + WINDOW, now)


class ExportSource(DataSource):
    """Options: ``path``, a JSON-lines export with ``timestamp`` fields; ``now``, fixed in tests."""

    @classmethod
    def name(cls) -> str:
        return "bot_export"

    def schema(self) -> str:
        return "payload string, timestamp string"

    def simpleStreamReader(self, schema) -> ExportReader:
        return ExportReader(self.options)


class ExportReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.fixed = options.get("now")

    def _now(self) -> datetime:
        return datetime.fromisoformat(self.fixed) if self.fixed else datetime.now(timezone.utc)

    def initialOffset(self) -> dict:
        return {"watermark": (self._now() - WINDOW).isoformat()}

    def _between(self, start: datetime, end: datetime) -> Iterator[tuple]:
        with open(self.path) as lines:
            for line in lines:
                at = json.loads(line)["timestamp"]
                if start <= datetime.fromisoformat(at.replace("Z", "+00:00")) < end:
                    yield (line.strip(), at)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        begin, end = next_window(start["watermark"], self._now())
        return self._between(begin, end), {"watermark": end.isoformat()}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(datetime.fromisoformat(start["watermark"]), datetime.fromisoformat(end["watermark"]))


SLICE = timedelta(minutes=1)


class Slice(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class SlicedExport(DataSource):
    """Options: ``folder``, any URI that Arrow's file systems know, with a JSON-lines file a minute (``20240131T2359.jsonl``); ``now``, fixed in tests.

    Another provider, or one that answers over HTTP, is a subclass with its own name and fetch().
    """

    @classmethod
    def name(cls) -> str:
        return "bot_export_slices"

    def schema(self) -> str:
        return "payload string, timestamp string"

    def streamReader(self, schema) -> SlicedReader:
        return SlicedReader(self.options, self.fetch)

    @staticmethod
    def fetch(options: dict, start: datetime, end: datetime) -> Iterator[tuple[str, str]]:
        """(payload, timestamp) of the records from start up to end; a minute without a file has none."""
        store, root = pyarrow.fs.FileSystem.from_uri(options["folder"])
        minute = start.replace(second=0, microsecond=0)
        while minute < end:
            path = f"{root}/{minute:%Y%m%dT%H%M}.jsonl"
            if store.get_file_info(path).type == pyarrow.fs.FileType.File:
                with store.open_input_stream(path) as lines:
                    for line in lines.read().decode("utf-8", "replace").splitlines():
                        at = json.loads(line)["timestamp"]
                        if start <= datetime.fromisoformat(at.replace("Z", "+00:00")) < end:
                            yield line.strip(), at
            minute += SLICE


class SlicedReader(DataSourceStreamReader):
    def __init__(self, options, fetch):
        self.options, self.fetch, self.last = dict(options), fetch, None

    def _now(self) -> datetime:
        return datetime.fromisoformat(self.options["now"]) if self.options.get("now") else datetime.now(timezone.utc)

    def initialOffset(self) -> dict:
        return {"watermark": (self._now() - WINDOW).isoformat()}

    def latestOffset(self) -> dict:
        """A window past the last one, never past now. After a restart, now: what was missed is one batch of more slices."""
        now = self._now()
        self.last = min(self.last + WINDOW, now) if self.last else now
        return {"watermark": self.last.isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        at, until = (datetime.fromisoformat(x["watermark"]) for x in (start, end))
        out = []
        while at < until:
            stop = min((at + SLICE).replace(second=0, microsecond=0), until)
            out.append(Slice(at.isoformat(), stop.isoformat()))
            at = stop
        return out or [Slice(at.isoformat(), at.isoformat())]

    def read(self, partition: Slice) -> Iterator[tuple[str, str]]:
        return self.fetch(self.options, datetime.fromisoformat(partition.start), datetime.fromisoformat(partition.end))

    def commit(self, end: dict) -> None:
        pass
