"""Option chains: symbols, per-expiry sums, at-the-money volatility, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pit import latest_per

#: Root of any length, date, side, strike in thousandths: read from the right.
OCC = r"^(.+)(\d{6})([CP])(\d{8})$"
CHAIN = "struct<timestamp:string, data:struct<current_price:double, last_trade_time:string, options:array<struct<option:string, bid:double, ask:double, volume:double, open_interest:double, iv:double>>>>"


def parse_occ(option: Column) -> tuple[Column, Column, Column]:
    """(expiry, is_call, strike); all null where the symbol does not match."""
    part = lambda k: F.nullif(F.regexp_extract(option, OCC, k), F.lit(""))
    day = part(2)
    # two-digit years are of this century
    expiry = F.concat(F.lit("20"), F.substring(day, 1, 2), F.lit("-"), F.substring(day, 3, 2), F.lit("-"), F.substring(day, 5, 2)).try_cast("date")
    return expiry, part(3) == "C", part(4).cast("double") / 1000


def parse_chain(landed: DataFrame) -> DataFrame:
    """Contracts of landed bodies (underlying, body): null figures are 0, the session is the last trade's day."""
    body = landed.withColumn("b", F.from_json("body", CHAIN))
    rows = body.select("underlying", F.col("b.data.current_price").alias("spot"), F.to_date("b.data.last_trade_time").alias("quote_date"), F.posexplode("b.data.options").alias("place", "o"))
    return rows.select("underlying", "spot", "quote_date", "place", "o.option", *[F.coalesce(f"o.{c}", F.lit(0.0)).alias(c) for c in ("bid", "ask", "volume", "open_interest", "iv")])


def contracts(rows: DataFrame) -> DataFrame:
    expiry, call, strike = parse_occ(F.col("option"))
    return rows.withColumns({"expiry": expiry, "is_call": call, "strike": strike})


def per_expiry(chain: DataFrame) -> DataFrame:
    """One row per (underlying, quote_date, expiry); chain as contracts() gives it, place = listing order."""
    key = ["underlying", "quote_date", "expiry"]
    money = F.col("volume") * (F.col("bid") + F.col("ask")) / 2 * 100
    side = lambda c, call: F.sum(F.when(F.col("is_call") == call, c).otherwise(0.0))
    away = F.struct(F.abs(F.col("strike") - F.col("spot")).alias("by"), F.col("strike"))
    # the first of a side's nearest contracts that have a volatility; it counts where no contract without one is nearer
    near = lambda call: F.min(F.when((F.col("is_call") == call) & (F.col("iv") > 0), F.struct(away.alias("away"), "place", "iv")))
    sums = chain.groupBy(*key).agg(
        side(F.col("volume"), True).alias("call_volume"), side(F.col("volume"), False).alias("put_volume"), side(F.col("open_interest"), True).alias("call_oi"), side(F.col("open_interest"), False).alias("put_oi"),
        side(money, True).alias("call_premium"), side(money, False).alias("put_premium"), F.min_by("strike", away).alias("atm_strike"), F.count("*").alias("n_contracts"), near(True).alias("near_call"), near(False).alias("near_put"),
    )
    iv = lambda c: F.when(F.col(f"{c}.away.strike") == F.col("atm_strike"), F.col(f"{c}.iv"))
    return sums.withColumns({"atm_call_iv": iv("near_call"), "atm_put_iv": iv("near_put")}).drop("near_call", "near_put")


def new_snapshots(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(stored, ["underlying", "quote_date", "expiry"], "left_anti")


def summary(daily: DataFrame) -> DataFrame:
    """Per underlying: sessions, first and last, and the last session's sums and put/call ratios."""
    per_day = daily.groupBy("underlying", "quote_date").agg(*[F.sum(c).alias(c) for c in ("call_volume", "put_volume", "call_oi", "put_oi")])
    spans = per_day.groupBy("underlying").agg(F.count("*").alias("n_sessions"), F.min("quote_date").alias("first_session"), F.max("quote_date").alias("last_session"))
    last = latest_per(per_day, ["underlying"], F.desc("quote_date")).drop("quote_date")
    return spans.join(last, "underlying").withColumns({"pc_volume": F.try_divide("put_volume", "call_volume"), "pc_oi": F.try_divide("put_oi", "call_oi")})
