"""Market tables of the data model, derived from the relational test tables.

A symbol is a brand; its price on a day comes from the line items shipped on it; see the SQL beside each
derivation for the same table in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ties within a day are settled by these.
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, day, px, qty, o): a price for each line item; o is its place among those of a day."""
    items = table(spark, sf_dir, "lineitem").where("l_shipdate is not null and l_quantity > 0")
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return items.join(brands, F.col("l_partkey") == F.col("p_partkey")).select("symbol", F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"), F.struct(*ORDER).alias("o"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, t, open, high, low, close, volume); t is the day on which a bar closes."""
    return ticks(spark, sf_dir).groupBy("symbol", F.col("day").alias("t")).agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("qty").alias("volume")
    )


TICKS_SQL = """ticks AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, l_quantity AS qty,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL AND l_quantity > 0)"""

BARS_SQL = f"""{TICKS_SQL},
bars AS (
  SELECT symbol, day AS t, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(px) AS high,
         min(px) AS low, last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(qty) AS volume
  FROM ticks GROUP BY symbol, day)"""


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions: each line item of a day is one, an hour after the one before; available a day and 5 minutes on."""
    from pyspark.sql import Window as W

    revision = F.row_number().over(W.partitionBy("symbol", "day").orderBy("o"))
    rows = ticks(spark, sf_dir).withColumn("revision", revision)
    at = F.col("event_time") + F.expr("make_dt_interval(1, revision - 1, 5, 0)")
    rows = rows.withColumn("event_time", F.col("day").cast("timestamp")).withColumn("available_at", at)
    return rows.select("symbol", F.lit("1d").alias("timeframe"), "event_time", "available_at", "revision", F.col("px").alias("close"), F.col("qty").alias("volume"))


RAW_BARS_SQL = f"""{TICKS_SQL},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS revision FROM ticks),
raw_bars AS (
  SELECT symbol, '1d' AS timeframe, CAST(day AS TIMESTAMP) AS event_time,
         CAST(day AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 5 MINUTE + to_hours(CAST(revision - 1 AS INTEGER)) AS available_at,
         revision, px AS close, qty AS volume FROM numbered)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, asset_class, listed_at, delisted_at): half-open intervals."""
    span = ticks(spark, sf_dir).groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    n = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    gone = F.when(n % 7 == 0, F.date_sub("b", 200))
    return span.select("symbol", F.when(n % 2 == 0, "etf").otherwise("equity").alias("asset_class"), F.date_add("a", (n % 5) * 60).alias("listed_at"), gone.alias("delisted_at"))


MEMBERSHIP_SQL = """membership AS (
  SELECT symbol, CASE WHEN n % 2 = 0 THEN 'etf' ELSE 'equity' END AS asset_class, a + CAST((n % 5) * 60 AS INTEGER) AS listed_at,
         CASE WHEN n % 7 = 0 THEN b - 200 END AS delisted_at
  FROM (SELECT symbol, min(day) AS a, max(day) AS b, CAST(regexp_extract(symbol, '(\\d+)', 1) AS INTEGER) AS n FROM ticks GROUP BY symbol))"""
