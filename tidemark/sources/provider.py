"""A bars provider as a data source: spark.read.format("tidemark_bars") over folders of landed JSON bodies.

A body is a line of a text file below ``symbol=<name>/``, as a partitioned text write lays them out. Options: path;
kind, one of rows (exchange rows), chart (parallel arrays with splits), observations (dated values) and pages (bars by
symbol); timeframe; and, all optional, symbols (comma-separated), start and end (ISO, end exclusive), which leave files and
bars out before they reach Spark. Files are dealt out to tasks; a task parses one body at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "symbol string, timeframe string, event_time timestamp, open double, high double, low double, close double, volume double"
_FIGURES = ("open", "high", "low", "close", "volume")
#: Files that one task reads.
FILES = 16


def _at(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def _day(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def _rows(symbol: str, body) -> Iterator[tuple]:
    for ms, *figures in body or ():
        yield symbol, _at(ms / 1000), *map(float, figures)


def _chart(symbol: str, body) -> Iterator[tuple]:
    """Bars with a figure missing go; prices before a split are multiplied by its ratio, volumes divided."""
    for result in (body["chart"]["result"] or [])[:1]:
        quote = result["indicators"]["quote"][0]
        splits = list(((result.get("events") or {}).get("splits") or {}).values())
        for k, at in enumerate(result.get("timestamp") or ()):
            figures = [quote[c][k] for c in _FIGURES]
            if None in figures:
                continue
            factor = 1.0
            for s in splits:
                factor *= s["numerator"] / s["denominator"] if s["date"] > at else 1.0
            yield symbol, _at(at), *[x * factor for x in figures[:4]], figures[4] / factor


def _observations(symbol: str, body) -> Iterator[tuple]:
    for o in body["observations"] or ():
        if o["value"] != ".":
            yield symbol, _day(o["date"]), *[float(o["value"])] * 4, 0.0


def _pages(_: str, body) -> Iterator[tuple]:
    for symbol, bars in (body.get("bars") or {}).items():
        for b in bars or ():
            yield symbol, _day(b["t"]), *[float(b[c[0]]) for c in _FIGURES]


PARSERS = {"rows": _rows, "chart": _chart, "observations": _observations, "pages": _pages}


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if options.get("kind") not in PARSERS:
            raise ValueError(f"kind is one of {sorted(PARSERS)}")
        self.root, self.kind, self.timeframe = options["path"], options["kind"], options.get("timeframe", "1d")
        self.symbols = {s for s in options.get("symbols", "").split(",") if s}
        self.start, self.end = (_day(options[k]) if options.get(k) else None for k in ("start", "end"))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            folder, _, name = info.path[len(root) :].strip("/").rpartition("/")
            symbol = unquote(folder.rpartition("symbol=")[2])
            wanted = self.kind == "pages" or not self.symbols or symbol in self.symbols
            if info.type == fs.FileType.File and not name.startswith(("_", ".")) and wanted:
                found.append((symbol, info.path))
        found.sort()
        return [_Files(found[a : a + FILES]) for a in range(0, len(found), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.root)
        for symbol, path in partition.files:
            with store.open_input_stream(path) as stream:
                for line in stream.read().decode().splitlines():
                    for own, at, *figures in PARSERS[self.kind](symbol, json.loads(line)) if line.strip() else ():
                        if (not self.symbols or own in self.symbols) and (self.start is None or at >= self.start) and (self.end is None or at < self.end):
                            yield own, self.timeframe, at, *figures


class BarsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_bars"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BarsSource)
