"""Data-quality rules as one table of violations, and routing of batches that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gaps(bars: DataFrame, hours: int) -> DataFrame:
    """Per symbol, how many bars follow the one before by more than so many whole hours."""
    w = W.partitionBy("symbol").orderBy("event_time")
    apart = F.floor((F.unix_seconds("event_time") - F.unix_seconds(F.lag("event_time").over(w))) / 3600)
    return bars.withColumn("h", apart).where(F.col("h") > hours).groupBy("symbol").count()


def duplicates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "timeframe", "event_time").count().where("count > 1").groupBy("symbol").count()


def bad_prices(bars: DataFrame) -> DataFrame:
    return bars.where("open <= 0 or high <= 0 or low <= 0 or close <= 0").groupBy("symbol").count()


def impossible(bars: DataFrame) -> DataFrame:
    return bars.where("high < low or high < open or high < close or low > open or low > close").groupBy("symbol").count()


def volume_spikes(bars: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Distance from the median above threshold times the mean distance; none where that is 0."""
    middle = bars.groupBy("symbol").agg(F.percentile("volume", 0.5).alias("m"))
    far = bars.join(middle, "symbol").withColumn("d", F.abs(F.col("volume") - F.col("m")))
    mean = far.groupBy("symbol").agg(F.avg("d").alias("mad")).where("mad > 0")
    return far.join(mean, "symbol").where(F.col("d") > threshold * F.col("mad")).groupBy("symbol").count()


def stale(bars: DataFrame) -> DataFrame:
    return bars.where("open = high and high = low and low = close").groupBy("symbol").count().where("count > 1")


def report(bars: DataFrame, hours: int, skip_stale: bool = False, spikes: float = 20.0) -> DataFrame:
    """(symbol, rule, severity, n): issues reject a batch, volume spikes only warn."""
    rules = [("gap", "issue", gaps(bars, hours)), ("duplicate", "issue", duplicates(bars)), ("price", "issue", bad_prices(bars)), ("ohlc", "issue", impossible(bars)), ("volume_spike", "warning", volume_spikes(bars, spikes))]
    rules += [] if skip_stale else [("stale", "issue", stale(bars))]
    return reduce(DataFrame.unionByName, [df.select("symbol", F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col("count").alias("n")) for r, s, df in rules])


def route(bars: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): a symbol's batch goes as a whole."""
    bad = found.where("severity = 'issue'").select("symbol").distinct()
    return bars.join(bad, "symbol", "left_anti"), bars.join(bad, "symbol", "left_semi")
