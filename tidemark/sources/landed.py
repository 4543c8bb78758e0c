"""Readers of landed JSON bodies: exchange rows, chart arrays, macro observations, paged bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHART = "struct<chart:struct<result:array<struct<timestamp:array<bigint>, events:struct<splits:map<string, struct<date:bigint, numerator:double, denominator:double>>>, indicators:struct<quote:array<struct<open:array<double>, high:array<double>, low:array<double>, close:array<double>, volume:array<double>>>>>>>>"
_OHLCV = ("open", "high", "low", "close", "volume")


def exchange_rows(landed: DataFrame) -> DataFrame:
    """(symbol, timeframe, source, body) with rows [ms, o, h, l, c, v] -> typed bars."""
    rows = landed.select("symbol", "timeframe", "source", F.explode(F.from_json("body", "array<array<double>>")).alias("r"))
    return rows.select("symbol", "timeframe", "source", F.timestamp_millis(F.element_at("r", 1).cast("long")).alias("event_time"), *[F.element_at("r", k + 2).alias(c) for k, c in enumerate(_OHLCV)])


def chart(landed: DataFrame) -> DataFrame:
    """(symbol, body) with parallel arrays -> daily bars; rows with a null figure go, later splits are undone."""
    top = landed.select("symbol", F.from_json("body", CHART).alias("b")).select("symbol", F.element_at("b.chart.result", 1).alias("r"))
    quote = F.element_at("r.indicators.quote", 1)
    zipped = F.arrays_zip(F.col("r.timestamp").alias("timestamp"), *[quote[c].alias(c) for c in _OHLCV])
    splits = F.coalesce(F.map_values("r.events.splits"), F.array().cast("array<struct<date:bigint,numerator:double,denominator:double>>"))
    rows = top.select("symbol", splits.alias("splits"), F.explode(zipped).alias("z")).select("symbol", "splits", "z.*").dropna(subset=list(_OHLCV))
    factor = F.aggregate(F.filter("splits", lambda s: s["date"] > F.col("timestamp")), F.lit(1.0), lambda a, s: a * s["numerator"] / s["denominator"])
    rows = rows.withColumn("factor", factor)
    return rows.select("symbol", F.timestamp_seconds("timestamp").alias("event_time"), *[(F.col(c) * F.col("factor")).alias(c) for c in _OHLCV[:4]], (F.col("volume") / F.col("factor")).alias("volume"))


def observations(landed: DataFrame) -> DataFrame:
    """(symbol, body) with dated values -> flat bars; "." is no value."""
    rows = landed.select("symbol", F.explode(F.from_json("body", "struct<observations:array<struct<date:string, value:string>>>")["observations"]).alias("o")).where("o.value <> '.'")
    value = F.col("o.value").cast("double")
    return rows.select("symbol", F.to_timestamp("o.date").alias("event_time"), *[value.alias(c) for c in _OHLCV[:4]], F.lit(0.0).alias("volume"))


def paged(landed: DataFrame) -> DataFrame:
    """(body) with bars by symbol -> bars; a page without bars gives none."""
    rows = landed.select(F.explode(F.map_entries(F.from_json("body", "struct<bars:map<string, array<struct<t:string, o:double, h:double, l:double, c:double, v:double>>>>")["bars"])).alias("e"))
    bars = rows.select(F.col("e.key").alias("symbol"), F.explode("e.value").alias("x"))
    return bars.select("symbol", F.to_timestamp("x.t").alias("event_time"), *[F.col(f"x.{c[0]}").alias(c) for c in _OHLCV])
