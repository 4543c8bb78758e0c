"""Cost-bearing equity curves, the buy-and-hold benchmark, comparison, risk and null signals.

Costs are linear in what is traded and that is a share of equity, so each bar multiplies equity by
(1 - c |change|) (1 + position * return): a curve is a running product, one window per series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Starting capital; fee and slippage in basis points; least observations for a ratio.
CAPITAL, COST, LEAST = 1000.0, 15 / 10_000, 30


def account(rows: DataFrame, by: tuple[str, ...] = ("symbol",), cost: float = COST) -> DataFrame:
    """rows (by, t, close, position) with ret, change, equity, gross, turnover, paid and drawdown."""
    w = W.partitionBy(*by).orderBy("t")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    steps = rows.withColumns({
        "ret": F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)),
        "change": F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))),
    })
    held = 1 + F.col("position") * F.col("ret")
    steps = steps.withColumns({
        "equity": CAPITAL * F.product((1 - cost * F.col("change")) * held).over(so_far),
        "gross": CAPITAL * F.product(held).over(so_far),
        "turnover": F.sum("change").over(so_far),
    })
    steps = steps.withColumns({
        "paid": F.coalesce(F.lag("equity").over(w), F.lit(CAPITAL)) * cost * F.col("change"),
        "drawdown": 1 - F.col("equity") / F.greatest(F.lit(CAPITAL), F.max("equity").over(so_far)),
    })
    return steps


def account_with(rows: DataFrame, model: Callable[[float], float], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """equity under a cost model that is not linear: a fold per series, in pandas."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", equity double"

    def run(s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("t", ignore_index=True)
        equity, held, last, out = CAPITAL, 0.0, None, []
        for close, position in zip(s["close"], s["position"]):
            equity -= model(equity * abs(position - held)) if position != held else 0.0
            equity *= 1 + position * ((close / last - 1) if last else 0.0)
            held, last = position, close
            out.append(equity)
        return s.assign(equity=out)

    return rows.groupBy(*by).applyInPandas(run, schema)


def results(curves: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per curve: bars, net and gross return, greatest drawdown (all in per cent), turnover, costs."""
    pct = lambda c: F.max_by(c, "t") / CAPITAL * 100 - 100
    return curves.groupBy(*by).agg(
        F.count("*").alias("n_bars"), pct("equity").alias("return_pct"), pct("gross").alias("gross_pct"), (F.max("drawdown") * 100).alias("drawdown_pct"),
        F.sum("change").alias("turnover"), F.sum("paid").alias("costs"),
    )


def benchmark(bars: DataFrame, symbols: DataFrame, start: Column | None = None, cost: float = COST) -> DataFrame:
    """(t, equity) of buying symbols (column symbol) in equal shares and holding.

    Each pays its entry once; before its first bar a share is cash, between bars the last close holds.
    """
    own = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    own = own.where(F.col("t") >= start) if start is not None else own
    listed = own.select("symbol").distinct()
    share = CAPITAL / F.count("*").over(W.partitionBy())
    listed = listed.withColumn("share", share)
    # a calendar times a universe: one row for each symbol and day
    grid = own.select("t").distinct().join(F.broadcast(listed), how="cross")
    so_far = W.partitionBy("symbol").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    held = grid.join(own.select("symbol", "t", "close"), ["symbol", "t"], "left")
    held = held.withColumns({"last": F.last("close", True).over(so_far), "entry": F.first("close", True).over(so_far)})
    worth = F.coalesce(F.col("share") * (1 - cost) * F.col("last") / F.col("entry"), F.col("share"))
    return held.groupBy("t").agg(F.sum(worth).alias("equity"))


def hold(bars: DataFrame, cost: float = COST) -> DataFrame:
    """(symbol, t, equity) of each symbol held alone."""
    so_far = W.partitionBy("symbol").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return bars.select("symbol", "t", (CAPITAL * (1 - cost) * F.col("close") / F.first("close").over(so_far)).alias("equity"))


def per_day(curve: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The last equity of each day."""
    return curve.groupBy(*by, F.to_date("t").alias("day")).agg(F.max_by("equity", "t").alias("equity"))


def grown(now: Column, before: Column) -> Column:
    """Return of a curve between two values; not a number once it has run down to 0, null without a value before."""
    return F.when(before != 0, now / before - 1).when(before == 0, float("nan"))


def sharpe(ret: str) -> Column:
    """Annualised ratio of daily returns; null below 30 of them or without variance."""
    sd = F.stddev_samp(ret)
    return F.when((F.count(ret) >= LEAST) & (sd > 0), F.avg(ret) / sd * math.sqrt(252))


def versus(curves: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per curve on shared days: excess return, share of days behind (by more than rounding), relative drawdown, ratio of the excess."""
    days = per_day(curves, by).join(reference.select(*[c for c in by if c in reference.columns], F.to_date("t").alias("day"), F.col("equity").alias("other")), [*[c for c in by if c in reference.columns], "day"])
    w = W.partitionBy(*by).orderBy("day")
    days = days.withColumns({"r": F.col("equity") / F.lag("equity").over(w) - 1, "o": F.col("other") / F.lag("other").over(w) - 1})
    days = days.withColumns({"x": F.col("r") - F.col("o"), "ratio": F.col("equity") / F.col("other")})
    days = days.withColumn("behind", 1 - F.col("ratio") / F.max("ratio").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = lambda c: F.max_by(c, "day") / F.min_by(c, "day")
    return days.groupBy(*by).agg(
        F.count("x").alias("n_periods"), ((total("equity") - total("other")) * 100).alias("excess_pct"), (F.avg((F.col("x") < -1e-12).cast("double")) * 100).alias("behind_pct"),
        (F.max("behind") * 100).alias("relative_drawdown_pct"), sharpe("x").alias("excess_sharpe"),
    )


def risk(curves: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Sharpe ratio, skewness, excess kurtosis and drawdown of a curve's returns; null below 30 of them."""
    w = W.partitionBy(*by).orderBy("t")
    rows = curves.withColumn("r", grown(F.col("equity"), F.lag("equity").over(w)))
    enough = F.count("r") >= LEAST
    return rows.groupBy(*by).agg(
        F.count("r").alias("n_returns"), sharpe("r").alias("sharpe"), F.when(enough, F.skewness("r")).alias("skew"), F.when(enough, F.kurtosis("r")).alias("kurtosis"),
        F.when(enough, F.max("drawdown") * 100).alias("drawdown_pct"),
    )


def classify(outcomes: DataFrame) -> DataFrame:
    """Reason codes and acceptance of outcomes (turnover, return_pct, gross_pct, benchmark_pct)."""
    reasons = F.array_compact(F.array(
        F.when(F.col("turnover") == 0, "NO_TRADES"),
        F.when(F.col("return_pct") <= F.col("benchmark_pct"), "WORSE_THAN_HOLDING"),
        F.when((F.col("return_pct") < 0) & (F.col("gross_pct") > 0), "TRANSACTION_COST_FAILURE"),
    ))
    return outcomes.withColumns({"reasons": reasons, "accepted": F.col("return_pct") > F.col("benchmark_pct")})


def universe_key(symbols: Column) -> Column:
    return F.array_join(F.array_sort(symbols), ",")


def matches(curves: DataFrame, reference: DataFrame, symbols: str = "universe") -> DataFrame:
    """Rows (key, universe) of two sides with first and last day: benchmark_mismatch where they differ."""
    both = curves.alias("a").join(reference.alias("b"), "key", "left")
    same = (universe_key(F.col(f"a.{symbols}")) == universe_key(F.col(f"b.{symbols}"))) & (F.col("a.first_day") == F.col("b.first_day")) & (F.col("a.last_day") == F.col("b.last_day"))
    return both.select("key", (~F.coalesce(same, F.lit(False))).alias("benchmark_mismatch"))


def upserted(stored: DataFrame, curves: DataFrame) -> DataFrame:
    """Benchmark curves (universe_key, date, equity, created_at) with those of curves in place of stored points of the same key and date."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(curves.withColumn("_new", F.lit(1)))
    kept = both.groupBy("universe_key", "date").agg(F.max_by(F.struct("equity", "created_at"), F.struct("_new", "created_at")).alias("s"))
    return kept.select("universe_key", "date", "s.*")


def newest_curve(curves: DataFrame) -> DataFrame:
    """(universe_key, date, equity) of the universe that was recorded last; mixed curves of old days do not count."""
    last = curves.where("universe_key <> 'LEGACY_MIXED'").agg(F.max_by("universe_key", F.struct("created_at", "universe_key")).alias("universe_key"))
    return curves.join(F.broadcast(last), "universe_key", "left_semi").select("universe_key", "date", "equity")


# ---------------------------------------------------------------- null signals
def seed(*parts: Column) -> Column:
    """First 8 hexadecimal digits of the SHA-256 of the parts, joined by a pipe, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def shifted(rows: DataFrame, salt: str = "shift") -> DataFrame:
    """Positions moved in a circle by a seeded offset between a quarter and three quarters of the series."""
    w = W.partitionBy("symbol")
    placed = rows.withColumns({"i": F.row_number().over(w.orderBy("t")) - 1, "size": F.count("*").over(w)})
    offset = F.floor(F.col("size") / 4) + seed(F.col("symbol"), F.lit(salt)) % F.greatest(F.floor(F.col("size") / 2), F.lit(1))
    moved = placed.select("symbol", ((F.col("i") + offset) % F.col("size")).alias("i"), F.col("position").alias("moved"))
    return placed.drop("position", "size").join(moved, ["symbol", "i"]).withColumnRenamed("moved", "position").drop("i")


def flipped(rows: DataFrame, salt: str = "flip") -> DataFrame:
    """Positions with as many changes as before, at seeded random bars (never the first)."""
    w = W.partitionBy("symbol").orderBy("t")
    marked = rows.withColumns({"i": F.row_number().over(w), "moves": (F.col("position") != F.lag("position", 1, 0.0).over(w)).cast("int")})
    marked = marked.withColumn("k", F.sum("moves").over(W.partitionBy("symbol")))
    draw = W.partitionBy("symbol").orderBy(F.col("i") == 1, F.sha2(F.concat_ws("|", "symbol", F.lit(salt), F.col("i")), 256))
    picked = marked.withColumn("flip", ((F.row_number().over(draw) <= F.col("k")) & (F.col("i") > 1)).cast("int"))
    parity = F.sum("flip").over(w.rowsBetween(W.unboundedPreceding, 0)) % 2
    return picked.withColumn("position", parity.cast("double")).drop("i", "moves", "k", "flip")


def noise(rows: DataFrame, salt: str = "noise") -> DataFrame:
    """Positions of a 5/20 crossover of averages on a seeded random walk, one bar late."""
    w = W.partitionBy("symbol").orderBy("t")
    step = (seed(F.col("symbol"), F.lit(salt), F.col("t").cast("string")) / F.lit(2.0**32) - 0.5) * 0.02
    walk = rows.withColumn("walk", F.product(1 + step).over(w.rowsBetween(W.unboundedPreceding, 0)))
    mean = lambda n: F.when(F.count("walk").over(w.rowsBetween(1 - n, 0)) >= n, F.avg("walk").over(w.rowsBetween(1 - n, 0)))
    walk = walk.withColumn("above", (mean(5) > mean(20)).cast("double"))
    return walk.withColumn("position", F.coalesce(F.lag("above").over(w), F.lit(0.0))).drop("walk", "above")
