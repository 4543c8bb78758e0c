"""Landed bodies read through the data source, compared with SQL over the bars that they were made of."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.graph import shared_folder
from tidemark.plans.registry import query
from tidemark.sources import provider
from tidemark.sources.market import BARS_SQL, bars

_SELECT = "symbol, CAST(t AS TIMESTAMP) AS event_time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"


def _read(spark, bodies, **options):
    """bodies (symbol, value) written as landed files and read back by the data source."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    bodies.write.partitionBy("symbol").text(path)
    provider.register(spark)
    out = spark.read.format("tidemark_bars").options(path=path, **options).load()
    return out.select("symbol", "event_time", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], F.round("volume", 6).alias("volume"))


def _seconds():
    return F.unix_timestamp(F.col("t").cast("timestamp"))


def _month():
    return F.date_trunc("month", "t")


@query("landed_rows", f"WITH {BARS_SQL} SELECT {_SELECT}, round(volume, 6) AS volume FROM bars WHERE t >= DATE '1996-01-01' AND t < DATE '1998-01-01'")
def landed_rows(spark, sf_dir):
    """Exchange rows, a body for each symbol and month, two years of them."""
    row = F.array((_seconds() * 1000).cast("double"), "open", "high", "low", "close", F.col("volume").cast("double"))
    bodies = bars(spark, sf_dir).groupBy("symbol", _month().alias("m")).agg(F.to_json(F.collect_list(row)).alias("value")).select("symbol", "value")
    return _read(spark, bodies, kind="rows", start="1996-01-01", end="1998-01-01")


@query("landed_chart", f"""WITH {BARS_SQL},
f AS (SELECT *, CASE WHEN t < DATE '1997-01-01' THEN 2.0 ELSE 1.0 END AS k FROM bars WHERE volume <> 30)
SELECT symbol, CAST(t AS TIMESTAMP) AS event_time, round(open * k, 6) AS open, round(high * k, 6) AS high, round(low * k, 6) AS low, round(close * k, 6) AS close, round(volume / k, 6) AS volume FROM f""")  # fmt: skip
def landed_chart(spark, sf_dir):
    """Chart bodies with a split of 2 at the start of 1997, bars with a volume of 30 lacking their close."""
    one = F.collect_list(F.struct(_seconds().alias("at"), "open", "high", "low", F.when(F.col("volume") != 30, F.col("close")).alias("close"), F.col("volume").cast("double").alias("volume")))
    b = bars(spark, sf_dir).groupBy("symbol", _month().alias("m")).agg(one.alias("b"))
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    split = F.create_map(F.lit("s"), F.struct(F.lit(852076800).alias("date"), F.lit(2.0).alias("numerator"), F.lit(1.0).alias("denominator")))
    result = F.struct(F.col("b.at").alias("timestamp"), F.struct(split.alias("splits")).alias("events"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    bodies = b.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("value"))
    return _read(spark, bodies, kind="chart")


@query("landed_observations", f"""WITH {BARS_SQL} SELECT symbol, CAST(t AS TIMESTAMP) AS event_time, round(close, 6) AS open, round(close, 6) AS high, round(close, 6) AS low, round(close, 6) AS close, 0.0 AS volume FROM bars WHERE volume <> 30""")
def landed_observations(spark, sf_dir):
    o = F.struct(F.date_format("t", "yyyy-MM-dd").alias("date"), F.when(F.col("volume") == 30, ".").otherwise(F.col("close").cast("string")).alias("value"))
    b = bars(spark, sf_dir).groupBy("symbol", _month().alias("m")).agg(F.collect_list(o).alias("observations"))
    return _read(spark, b.select("symbol", F.to_json(F.struct("observations")).alias("value")), kind="observations")


@query("landed_pages", f"WITH {BARS_SQL} SELECT {_SELECT}, round(volume, 6) AS volume FROM bars WHERE symbol IN ('Brand#11', 'Brand#12', 'Brand#3')")
def landed_pages(spark, sf_dir):
    """Pages that hold a day's bars of all symbols, and a null body for each day too; three symbols are asked for."""
    x = F.struct(F.date_format("t", "yyyy-MM-dd'T'00:00:00'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("double").alias("v"))
    pages = bars(spark, sf_dir).groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.array(x)))).alias("bars"))
    full = pages.select(F.date_format("t", "yyyy-MM").alias("symbol"), F.to_json(F.struct("bars")).alias("value"))
    return _read(spark, full.unionByName(full.select("symbol", F.lit('{"bars": null}').alias("value"))), kind="pages", symbols="Brand#11,Brand#12,Brand#3")
