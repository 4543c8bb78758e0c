"""Point-in-time access: revisions, as-of views, membership, holdout split, version hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("symbol", "timeframe", "event_time")
#: Hours of a bar by timeframe, and minutes until it is available.
HOURS, LAG_MINUTES = {"1h": 1, "4h": 4, "1d": 24}, 5


def latest_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def available_at(event_time: str = "event_time", timeframe: str = "timeframe") -> Column:
    """Open plus the bar's length plus the lag; null for an unknown timeframe."""
    minutes = F.create_map(*[F.lit(x) for k, h in HOURS.items() for x in (k, 60 * h + LAG_MINUTES)])
    return F.timestamp_micros(F.unix_micros(event_time) + F.try_element_at(minutes, F.col(timeframe)).cast("long") * 60_000_000)


def as_of(bars: DataFrame, cutoff: Column) -> DataFrame:
    """Rows known at cutoff, the newest revision of each bar; event_time is not shown."""
    known = bars.where(F.col("available_at") <= cutoff)
    newest = latest_per(known, list(KEY), F.desc("revision"), F.desc("available_at"))
    return newest.drop("event_time", "revision")


def as_of_each(bars: DataFrame, cutoffs: DataFrame, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """For each cutoff (column at), each symbol's last known bar: an as-of join.

    Both sides meet in one ordered series per symbol, and the last value before a cutoff is carried on: no
    range join, whose pairs would grow with cutoffs times bars. Of bars known at the same moment the newest counts.
    """
    first = latest_per(bars, list(KEY), F.desc("revision"), F.desc("available_at"))
    facts = first.select("symbol", F.col("available_at").alias("at"), F.lit(0).alias("asked"), F.struct("event_time", "timeframe").alias("bar"), F.struct("available_at", *columns).alias("v"))
    asked = bars.select("symbol").distinct().join(F.broadcast(cutoffs.select("at").distinct()), how="cross")
    asked = asked.select("symbol", "at", F.lit(1).alias("asked"), *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in ("bar", "v")])
    w = W.partitionBy("symbol").orderBy("at", "asked", "bar").rowsBetween(W.unboundedPreceding, 0)
    return facts.unionByName(asked).withColumn("last", F.last("v", True).over(w)).where("asked = 1").select("symbol", "at", "last.*")


def plan_writes(fetched: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Bars to write: closed ones that are new (revision 1) or changed at 8 decimals (next revision, known from now)."""
    closed = fetched.withColumn("closes", available_at()).where(F.col("closes") <= now)
    have = latest_per(stored, list(KEY), F.desc("revision")).select(*KEY, F.col("revision").alias("had"), F.round("close", 8).alias("c0"), F.round("volume", 8).alias("v0"))
    both = closed.join(have, list(KEY), "left")
    same = F.col("c0").eqNullSafe(F.round("close", 8)) & F.col("v0").eqNullSafe(F.round("volume", 8))
    new = F.col("had").isNull()
    at = F.when(new, F.col("closes")).otherwise(F.greatest(F.col("closes"), now))
    return both.where(new | ~same).select(*KEY, "close", "volume", (F.coalesce("had", F.lit(0)) + 1).alias("revision"), at.alias("available_at"))


def append_new(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose (key, revision) is not stored yet."""
    return rows.join(stored.select(*KEY, "revision"), [*KEY, "revision"], "left_anti").dropDuplicates([*KEY, "revision"])


def zones(bars: DataFrame, holdout_start: Column) -> DataFrame:
    """zone: a partition column that keeps the holdout apart."""
    return bars.withColumn("zone", F.when(F.col("event_time") >= holdout_start, "holdout").otherwise("research"))


def members(membership: DataFrame, day: Column, asset_class: str | None = None) -> DataFrame:
    """Symbols listed on a day: listed_at <= day < delisted_at."""
    open_then = (F.col("listed_at") <= day) & (F.col("delisted_at").isNull() | (F.col("delisted_at") > day))
    return membership.where(open_then if asset_class is None else open_then & (F.col("asset_class") == asset_class))


def eligible(specs: DataFrame, dates: DataFrame, membership: DataFrame) -> DataFrame:
    """(spec_id, day, symbol, pos): the universe of each spec on each date, in its order."""
    legs = specs.select("spec_id", F.posexplode("universe").alias("pos", "symbol"))
    dated = legs.join(dates, "spec_id") if "spec_id" in dates.columns else legs.join(F.broadcast(dates), how="cross")
    return dated.join(membership, "symbol").where((F.col("listed_at") <= F.col("day")) & (F.col("delisted_at").isNull() | (F.col("delisted_at") > F.col("day")))).select("spec_id", "day", "symbol", "pos")


def upsert_membership(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values where there are some, by symbol and class."""
    keys = ["symbol", "asset_class"]
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def version(bars: DataFrame) -> DataFrame:
    """(symbol, rows, first, last, hash): the hash does not depend on the order of rows.

    Rows are hashed one by one and combined by day, days by symbol, so that no list holds a whole symbol's rows.
    """
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(bars.columns)]), 256)
    month = F.date_trunc("month", "t")
    parts = bars.groupBy("symbol", month.alias("m")).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h"))
    return parts.groupBy("symbol").agg(F.sum("n").alias("n_rows"), F.min("a").alias("first"), F.max("b").alias("last"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("hash"))


def enough_history(specs: DataFrame, counts: DataFrame, margin: int = 1) -> DataFrame:
    """Specs (spec_id, symbol, min_bars) whose symbol has min_bars + margin bars."""
    return specs.join(counts, "symbol").where(F.col("n_bars") >= F.col("min_bars") + margin).drop("n_bars")


def window(bars: DataFrame, symbols: DataFrame, timeframe: str, start, end) -> DataFrame:
    """Bars of symbols (one column, symbol) and one timeframe from start to end, both included."""
    own = bars.where((F.col("timeframe") == timeframe) & F.col("event_time").between(F.lit(start), F.lit(end)))
    return own.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def combined(research: DataFrame, holdout: DataFrame) -> DataFrame:
    """Research and holdout bars in one frame, the latest revision of each."""
    return latest_per(research.unionByName(holdout), list(KEY), F.desc("revision"))


def new_snapshots(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, content_hash) of files (path, content) that are not stored yet."""
    hashed = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")).dropDuplicates()
    return hashed.join(stored, ["path", "content_hash"], "left_anti")
