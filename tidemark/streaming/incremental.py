"""Structured Streaming forms of what grows by the hour: bars, snapshots, fills and the test ledger."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.operators import gates, paper, pit


class Revisions(StatefulProcessor):
    """The newest revision of one bar: what is fetched is compared with it, not with the table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "close double, volume double, revision int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        newest = initialState.sort_values("revision").iloc[-1]
        self.state.update((float(newest["close"]), float(newest["volume"]), int(newest["revision"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fetched = pd.concat(list(rows)).sort_values(["close", "volume"]).iloc[-1]  # a batch says one thing of a bar
        had = self.state.get() if self.state.exists() else None
        now = tuple(None if pd.isna(fetched[c]) else float(fetched[c]) for c in ("close", "volume"))
        if had is not None and all(a == b or (a is not None and b is not None and round(a, 8) == round(b, 8)) for a, b in zip(now, had)):
            return
        revision = had[2] + 1 if had is not None else 1
        at = fetched["closes"] if had is None else max(fetched["closes"], fetched["now"])
        self.state.update((*now, revision))
        yield pd.DataFrame({"symbol": [key[0]], "timeframe": [key[1]], "event_time": [key[2]], "close": [now[0]], "volume": [now[1]], "revision": [revision], "available_at": [at]})

    def close(self) -> None:
        pass


_BARS = "symbol string, timeframe string, event_time timestamp, close double, volume double, revision int, available_at timestamp"


def revisions(fetched: DataFrame, now=None, stored: DataFrame | None = None) -> DataFrame:
    """A stream of fetched bars -> those that are new (revision 1) or changed at 8 decimals (the next, known from now), once closed.

    The state is one row for each bar, dealt out by bar, so the work of a batch follows from what is fetched and not from
    what is stored. stored (bars with revisions) is what a first batch begins with.
    """
    closed = fetched.withColumns({"closes": pit.available_at(), "now": now if now is not None else F.current_timestamp()}).where("closes <= now")
    first = stored.select(*pit.KEY, "close", "volume", "revision").groupBy(*pit.KEY) if stored is not None else None
    return closed.groupBy(*pit.KEY).transformWithStateInPandas(Revisions(), _BARS, "Append", "None", first)


def ingest(fetched: DataFrame, path: str, checkpoint: str, now=None, stored: DataFrame | None = None) -> StreamingQuery:
    """Append new and corrected bars of a stream to the table at path; late corrections are kept as revisions.

    A batch is a folder that is named by its number: one that runs again, since it failed before its state was kept, writes
    its own folder anew. The table is not read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return revisions(fetched, now, stored).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per (underlying, quote_date, expiry) of a stream with seen_at."""
    return rows.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["underlying", "quote_date", "expiry"])


class Position(StatefulProcessor):
    """Cash, quantity and peak equity of a strategy, updated by its fills."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField(c, DoubleType()) for c in ("cash", "qty", "peak")]
        self.state = handle.getValueState("position", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cash, qty, peak = self.state.get() if self.state.exists() else (1000.0, 0.0, 1000.0)
        fills = pd.concat(list(rows)).sort_values(["filled_at", "id"])
        equity = cash
        for r in fills.itertuples():
            move = r.qty if r.side == "buy" else -r.qty
            cash, qty = cash - move * r.price, qty + move
            equity = cash + qty * r.price
            peak = max(peak, equity)
        self.state.update((cash, qty, peak))
        yield pd.DataFrame({"strategy_id": [key[0]], "cash": [cash], "qty": [qty], "equity": [equity], "peak": [peak]})

    def close(self) -> None:
        pass


def positions(fills: DataFrame) -> DataFrame:
    """A stream of fills -> each strategy's cash, quantity, equity and peak after every batch."""
    schema = StructType([StructField("strategy_id", LongType()), *[StructField(c, DoubleType()) for c in ("cash", "qty", "equity", "peak")]])
    return fills.groupBy("strategy_id").transformWithStateInPandas(Position(), schema, "Update", "None")


class Days(StatefulProcessor):
    """A strategy's fills, held until their day has ended, and its cash, quantity, peak and last equity."""

    def __init__(self, cash: float, fee: float):
        self.cash, self.fee = cash, fee

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("fills", "day date, id long", "side string, price double, qty double, filled_at timestamp")
        self.state = handle.getValueState("position", "cash double, held double, peak double, equity double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).itertuples():
            day = r.filled_at.date()
            self.waiting.updateValue((day, int(r.id)), (r.side, float(r.price), float(r.qty), r.filled_at.to_pydatetime()))
            self.handle.registerTimer(int(pd.Timestamp(day + timedelta(days=1)).timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms").date()
        due = sorted(((day, fill[3], id_, fill) for (day, id_), fill in self.waiting.iterator() if day < ended), key=lambda x: x[:3])
        cash, held, peak, last = self.state.get() if self.state.exists() else (self.cash, 0.0, self.cash, self.cash)
        out, before = [], None
        for day, _, id_, (side, price, qty, at) in due:
            start, before = (last if day != before else start), day
            move = qty if side == "buy" else -qty
            cash, held = cash - move * price - abs(move * price) * self.fee, held + move
            last = cash + held * price
            peak = max(peak, last)
            out.append((key[0], id_, day, at, start, last, peak))
            self.waiting.removeKey((day, id_))
        if out:
            self.state.update((cash, held, peak, last))
            yield pd.DataFrame(out, columns=["strategy_id", "id", "day", "filled_at", "day_start", "equity", "peak"])

    def close(self) -> None:
        pass


def days(fills: DataFrame, late: str = "1 day", cash: float = paper.CASH, fee: float = 0.001) -> DataFrame:
    """A stream of fills -> (strategy_id, id, day, filled_at, day_start, equity, peak) of each fill, once its day has ended.

    A day ends when the watermark, ``late`` behind the newest fill, passes it; fills may come in any order until then. State
    holds the fills of days that have not ended and four numbers for each strategy.
    """
    schema = "strategy_id long, id long, day date, filled_at timestamp, day_start double, equity double, peak double"
    return fills.withWatermark("filled_at", late).groupBy("strategy_id").transformWithStateInPandas(Days(cash, fee), schema, "Append", "EventTime")


def limits(fills: DataFrame, most_drawdown: float, most_loss: float, **how) -> DataFrame:
    """days() with the limit that each fill's equity breaks: the stream of paper.breaches."""
    return paper.breaches(days(fills, **how), most_drawdown, most_loss)


class Gate(StatefulProcessor):
    """The ledger of one stream of tests: place, discoveries, spent wealth and hashes seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", StructType([StructField("t", IntegerType()), StructField("spent", DoubleType()), StructField("found", StringType())]))
        self.seen = handle.getMapState("seen", StructType([StructField("h", StringType())]), StructType([StructField("t", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t, spent, found = self.state.get() if self.state.exists() else (0, 0.0, "")
        tests = pd.concat(list(rows)).sort_values("test_index").drop_duplicates("config_hash")
        tests = tests[[not self.seen.containsKey((h,)) for h in tests["config_hash"]]]
        out, hits, spent, t = gates.fold(tests, [int(x) for x in found.split(",") if x], spent, t)
        for h in tests["config_hash"]:
            self.seen.updateValue((h,), (t,))
        self.state.update((t, spent, ",".join(map(str, hits))))
        yield out[["stream", "test_index", "config_hash", "p_value", "t", "alpha_threshold", "discovery"]]

    def close(self) -> None:
        pass


def gate(tests: DataFrame) -> DataFrame:
    """A stream of tests -> their outcomes, in order within each test stream."""
    schema = StructType([StructField("stream", StringType()), StructField("test_index", IntegerType()), StructField("config_hash", StringType()), StructField("p_value", DoubleType()), StructField("t", IntegerType()), StructField("alpha_threshold", DoubleType()), StructField("discovery", BooleanType())])
    return tests.groupBy("stream").transformWithStateInPandas(Gate(), schema, "Append", "None")
