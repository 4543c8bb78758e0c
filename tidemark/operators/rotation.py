"""Cross-sectional rotation: weights on rebalance days and the cost-bearing portfolio curve.

Prices of a universe are a calendar times its symbols. Trailing measures are windows per symbol, computed
once; ranking is a window per (spec, day). A segment's value is linear in its legs' growth, and costs take
a share of equity, so the curve is a product over segments: no loop over days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.backtest import CAPITAL, COST

def _sym():
    return W.partitionBy("symbol").orderBy("t")


def trailing(k: int) -> Column:
    return F.col("close") / F.lag("close", k).over(_sym()) - 1


def mean(n: int) -> Column:
    w = _sym().rowsBetween(1 - n, 0)
    return F.when(F.count("close").over(w) >= n, F.avg("close").over(w))


def score_13612() -> Column:
    return (12 * trailing(21) + 4 * trailing(63) + 2 * trailing(126) + trailing(252)) / 19


def accelerating() -> Column:
    return (trailing(21) + trailing(63) + trailing(126)) / 3


def near_high(n: int) -> Column:
    w = _sym().rowsBetween(1 - n, 0)
    return F.when(F.count("close").over(w) >= n, F.col("close") / F.max("close").over(w))


def volatility(bars: DataFrame, n: int) -> DataFrame:
    """bars with vol: deviation of the last n returns."""
    r = bars.withColumn("r", trailing(1))
    w = _sym().rowsBetween(1 - n, 0)
    return r.withColumn("vol", F.when(F.count("r").over(w) >= n, F.stddev_samp("r").over(w))).drop("r")


def residual(bars: DataFrame, bench: str, n: int) -> DataFrame:
    """bars with res: sum of the last n returns less beta times the benchmark's."""
    r = bars.withColumn("r", trailing(1))
    b = r.where(F.col("symbol") == bench).select("t", F.col("r").alias("rb"))
    both = r.join(F.broadcast(b), "t")
    w = _sym().rowsBetween(1 - n, 0)
    beta = F.covar_samp("r", "rb").over(w) / F.var_samp("rb").over(w)
    return both.withColumn("res", F.when(F.count("r").over(w) >= n, F.sum("r").over(w) - beta * F.sum("rb").over(w))).drop("r", "rb")


def calendar(bars: DataFrame, warm_up: int, every: int) -> DataFrame:
    """Rebalance days: every so many days of the union calendar, from the warm-up on (one row per day is ordered)."""
    days = bars.select("t").distinct().withColumn("i", F.row_number().over(W.orderBy("t")) - 1)
    return days.where((F.col("i") >= warm_up) & ((F.col("i") - warm_up) % every == 0)).select("t")


def _day():
    return W.partitionBy("t")


def equal_weight(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weight", 1 / F.count("*").over(_day()))


def best(rows: DataFrame, score: str, n: int, worst: bool = False) -> DataFrame:
    """Equal weights on the n best (or worst) of each day; ties in universe order (pos)."""
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    order = F.asc(score) if worst else F.desc(score)
    top = known.withColumn("k", F.row_number().over(_day().orderBy(order, "pos"))).where(F.col("k") <= n)
    return top.withColumn("weight", 1 / F.count("*").over(_day())).drop("k")


def timed(rows: DataFrame, above: Column) -> DataFrame:
    """Each of the day's legs 1/N if above, else cash."""
    return rows.withColumn("n", F.count("*").over(_day())).where(above).withColumn("weight", 1 / F.col("n")).drop("n")


def dual(rows: DataFrame, score: str) -> DataFrame:
    """The best leg but the last, if its score is positive, else the last."""
    last = F.max("pos").over(_day())
    marked = rows.withColumns({"is_last": F.col("pos") == last})
    lead = F.max(F.when(~F.col("is_last") & F.col(score).isNotNull(), F.struct(F.col(score).alias("v"), (-F.col("pos")).alias("p")))).over(_day())
    marked = marked.withColumn("lead", lead)
    chosen = F.when(F.col("lead.v") > 0, F.col("pos") == -F.col("lead.p")).otherwise(F.col("is_last"))
    return marked.where(chosen & F.col("lead").isNotNull()).withColumn("weight", F.lit(1.0)).drop("is_last", "lead")


def inverse_vol(rows: DataFrame) -> DataFrame:
    fine = rows.where("vol > 0")
    return fine.withColumn("weight", (1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(_day()))


def defensive(rows: DataFrame, score: str, n: int, canaries: int = 2) -> DataFrame:
    """The first ``canaries`` positions vote: each without a positive score moves its share to the last leg."""
    bad = F.avg(F.when(F.col("pos") < canaries, (F.coalesce(F.col(score), F.lit(0.0)) <= 0).cast("double"))).over(_day())
    marked = rows.withColumns({"cash": bad, "last": F.max("pos").over(_day())})
    risky = best(marked.where((F.col("pos") >= canaries) & (F.col("pos") < F.col("last")) & (F.col(score) > 0)), score, n).withColumn("weight", F.col("weight") * (1 - F.col("cash")))
    safe = marked.where("pos = last").withColumn("weight", F.col("cash"))
    return risky.unionByName(safe).where("weight > 0").drop("cash", "last")


def protective(rows: DataFrame, score: str, n: int, factor: float = 2.0) -> DataFrame:
    """The share of the last leg is min(1, (N - good) * factor / N); the rest goes to the n best good ones."""
    marked = rows.withColumn("last", F.max("pos").over(_day()))
    marked = marked.withColumns({"size": F.greatest(F.count("*").over(_day()) - 1, F.lit(1)), "good": F.sum(((F.col("pos") < F.col("last")) & (F.col(score) > 0)).cast("int")).over(_day())})
    marked = marked.withColumn("cash", F.least(F.lit(1.0), (F.col("size") - F.col("good")) * factor / F.col("size")))
    risky = best(marked.where((F.col("pos") < F.col("last")) & (F.col(score) > 0)), score, n).withColumn("weight", F.col("weight") * (1 - F.col("cash")))
    safe = marked.where("pos = last").withColumn("weight", F.col("cash"))
    return risky.unionByName(safe).where("weight > 0").drop("last", "size", "good", "cash")


def minimum_variance(bars: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """(t, symbol, weight) from the inverse covariance of the last n common returns; a universe's window is small."""
    r = bars.withColumn("r", trailing(1)).where("r is not null").select(F.col("t").alias("day"), "symbol", "r")
    every = r.withColumn("c", F.count("*").over(W.partitionBy("day"))).crossJoin(F.broadcast(r.agg(F.count_distinct("symbol").alias("all")))).where("c = all").drop("c", "all")
    # a row for each day is ordered
    numbered = every.select("day").distinct().withColumn("i", F.row_number().over(W.orderBy("day")))
    placed = every.join(numbered, "day")
    ends = days.join(numbered.select(F.col("day").alias("t"), F.col("i").alias("end")), "t")
    # each rebalance reads its own n days
    picks = ends.withColumn("i", F.explode(F.sequence(F.greatest(F.col("end") - n + 1, F.lit(1)), F.col("end"))))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="i", columns="symbol", values="r").sort_index(axis=1)
        if len(m) < n:
            return pdf[["t", "symbol"]].iloc[:0].assign(weight=0.0)
        try:
            x = np.linalg.solve(np.cov(m.to_numpy().T), np.ones(m.shape[1])).clip(min=0)
        except np.linalg.LinAlgError:
            x = np.zeros(m.shape[1])
        if x.sum() <= 0:
            x = 1 / m.std(ddof=1).to_numpy()
        return pd.DataFrame({"t": pdf["t"].iloc[0], "symbol": m.columns, "weight": x / x.sum()})

    return picks.join(placed, "i").groupBy("t").applyInPandas(solve, f"t {days.schema['t'].dataType.simpleString()}, symbol string, weight double")


def portfolio(bars: DataFrame, weights: DataFrame, days: DataFrame, cost: float = COST) -> DataFrame:
    """(t, equity, gross, traded): daily curve of target weights (t, symbol, weight) set on days.

    A leg without a bar keeps the value of its last one before its first gap: it is released to cash there.
    """
    dates = bars.select("t").distinct()
    starts = days.select(F.col("t").alias("start"), F.lead("t").over(W.orderBy("t")).alias("stop"))
    held = dates.join(F.broadcast(starts), (F.col("t") >= F.col("start")) & (F.col("stop").isNull() | (F.col("t") <= F.col("stop"))))
    legs = held.join(weights.select(F.col("t").alias("start"), "symbol", "weight"), "start")
    legs = legs.join(bars.select("symbol", "t", "close"), ["symbol", "t"], "left")
    w = W.partitionBy("start", "symbol").orderBy("t")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    legs = legs.withColumn("gap", F.max(F.col("close").isNull().cast("int")).over(so_far))
    legs = legs.withColumn("last", F.last(F.when(F.col("gap") == 0, F.col("close")), True).over(so_far))
    value = F.col("weight") * F.col("last") / F.first("last").over(so_far)
    legs = legs.withColumn("value", value)
    total = held.join(legs.groupBy("start", "t").agg(F.sum("value").alias("legs"), F.sum("weight").alias("put")), ["start", "t"], "left")
    total = total.withColumn("growth", 1 - F.coalesce("put", F.lit(0.0)) + F.coalesce("legs", F.lit(0.0)))
    # what is traded at a start: targets against the drifted legs of the segment before
    ends = legs.where("t = stop and gap = 0").join(total.where("t = stop").select("start", F.col("growth").alias("whole")), "start")
    drifted = ends.select(F.col("stop").alias("start"), "symbol", (F.col("value") / F.col("whole")).alias("drift"))
    moves = weights.select(F.col("t").alias("start"), "symbol", "weight").join(drifted, ["start", "symbol"], "full")
    traded = moves.groupBy("start").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("drift", F.lit(0.0)))).alias("f"))
    segments = starts.join(traded, "start", "left").join(total.where("t = stop").select("start", F.col("growth").alias("g")), "start", "left")
    before = W.orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    f = F.coalesce("f", F.lit(0.0))
    segments = segments.withColumn("f", f).withColumns({
        "base": F.coalesce(F.product((1 - cost * F.col("f")) * F.coalesce("g", F.lit(1.0))).over(before), F.lit(1.0)) * (1 - cost * F.col("f")),
        "gross_base": F.coalesce(F.product(F.coalesce("g", F.lit(1.0))).over(before), F.lit(1.0)),
    })
    inside = total.where("stop is null or t < stop").join(segments.select("start", "f", "base", "gross_base"), "start")
    return inside.select("t", (CAPITAL * F.col("base") * F.col("growth")).alias("equity"), (CAPITAL * F.col("gross_base") * F.col("growth")).alias("gross"), F.when(F.col("t") == F.col("start"), F.col("f")).otherwise(0.0).alias("traded"))


#: What each family must be given.
NEEDS = {
    "EQUAL_WEIGHT_BASELINE": (), "SECTOR_MOMENTUM_ROTATION": ("lookback", "top"), "RELATIVE_STRENGTH_TOP3": ("lookback", "top"), "SECTOR_MEAN_REVERSION": ("lookback", "top"),
    "DUAL_MOMENTUM_GEM": ("lookback",), "GTAA_SMA_TIMING": ("lookback",), "DEFENSIVE_ASSET_ALLOCATION": ("top",), "PROTECTIVE_ASSET_ALLOCATION": ("lookback", "top", "protection"),
    "ACCELERATING_DUAL_MOMENTUM": (), "RISK_PARITY_INVERSE_VOL": ("lookback",), "MINIMUM_VARIANCE": ("lookback",), "FIFTY_TWO_WEEK_HIGH": ("lookback", "top"), "RESIDUAL_MOMENTUM": ("lookback", "top"),
}


def weights_of(family: str, params: dict, universe: list[str], bars: DataFrame, days: DataFrame, eligible: DataFrame) -> DataFrame:
    """(t, symbol, weight) of a family on rebalance days; eligible (t, symbol) are the legs that may be held.

    The dual families need their defensive leg, the universe's last: days on which it is not eligible have no
    weights. An unknown family or a missing parameter raises an error.
    """
    if family not in NEEDS:
        raise ValueError(f"no weights for family {family!r}")
    if missing := [k for k in NEEDS[family] if params.get(k) is None]:
        raise ValueError(f"family {family!r} needs {', '.join(missing)}")
    n, top = int(params.get("lookback") or 0), int(params.get("top") or 0)
    pos = F.array_position(F.array(*map(F.lit, universe)), F.col("symbol")).cast("int") - 1
    own = bars.where(F.col("symbol").isin(*universe)).withColumn("pos", pos)
    legs = eligible.select("t", "symbol").distinct()
    on_days = lambda rows: rows.join(F.broadcast(days), "t").join(legs, ["t", "symbol"])  # noqa: E731  days: a row for each rebalance
    scored = lambda column: on_days(own.withColumn("score", column))
    if family == "EQUAL_WEIGHT_BASELINE":
        out = equal_weight(on_days(own))
    elif family in ("SECTOR_MOMENTUM_ROTATION", "RELATIVE_STRENGTH_TOP3", "SECTOR_MEAN_REVERSION"):
        out = best(scored(trailing(n)), "score", top, family == "SECTOR_MEAN_REVERSION")
    elif family in ("DUAL_MOMENTUM_GEM", "ACCELERATING_DUAL_MOMENTUM"):
        rows = scored(trailing(n) if family == "DUAL_MOMENTUM_GEM" else accelerating())
        guarded = rows.withColumn("_last", F.max("pos").over(_day())).where(F.col("_last") == len(universe) - 1).drop("_last")
        out = dual(guarded, "score")
    elif family == "GTAA_SMA_TIMING":
        rows = scored(mean(n))
        out = timed(rows, F.col("close") > F.col("score"))
    elif family == "DEFENSIVE_ASSET_ALLOCATION":
        out = defensive(scored(score_13612()), "score", top)
    elif family == "PROTECTIVE_ASSET_ALLOCATION":
        out = protective(scored(F.col("close") / mean(n) - 1), "score", top, float(params["protection"]))
    elif family == "RISK_PARITY_INVERSE_VOL":
        out = inverse_vol(on_days(volatility(own, n)))
    elif family == "MINIMUM_VARIANCE":
        out = minimum_variance(own, days, n).join(legs, ["t", "symbol"], "left_semi")
    elif family == "FIFTY_TWO_WEEK_HIGH":
        out = best(scored(near_high(n)), "score", top)
    else:
        out = best(on_days(residual(own, universe[0], n).withColumnRenamed("res", "score")).where("pos > 0"), "score", top)
    return out.select("t", "symbol", "weight")
