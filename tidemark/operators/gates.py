"""Multiple-testing gates: excess-return tests, online false-discovery control, the holdout."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.backtest import LEAST, per_day
from tidemark.operators.metrics import probabilistic_sharpe

#: Fixed values of the online test: level, initial wealth, scale of the spending sequence.
ALPHA, WEALTH, SCALE = 0.05, 0.025, 0.07720838


def gamma(t: int) -> float:
    """Spending sequence, proportional to log(max(t, 2)) / (t exp(sqrt(log t)))."""
    return SCALE * math.log(max(t, 2)) / (t * math.exp(math.sqrt(math.log(t)))) if t >= 1 else 0.0


def threshold(t: int, found: list[int], alpha: float = ALPHA, wealth: float = WEALTH) -> float:
    """LORD++ level of test t after discoveries at the indices found."""
    level = gamma(t) * wealth
    if found:
        level += (alpha - wealth) * gamma(t - found[0]) + alpha * sum(gamma(t - k) for k in found[1:])
    return level


def fold(rows: pd.DataFrame, found: list[int], spent: float, t: int) -> tuple[pd.DataFrame, list[int], float, int]:
    """Tests in order, continued from a state; each level is one sum over a table of the spending sequence."""
    last = t + len(rows)
    spending = np.array([gamma(k) for k in range(last + 1)])
    at, n = np.zeros(len(found) + len(rows), np.int64), len(found)
    at[:n] = found
    out = []
    for p in rows["p_value"]:
        t += 1
        level = spending[t] * WEALTH
        if n:
            level += (ALPHA - WEALTH) * spending[t - at[0]] + ALPHA * spending[t - at[1:n]].sum()
        before = WEALTH + ALPHA * n - (WEALTH if n else 0.0) - spent
        hit = p is not None and p == p and p <= level
        spent += level
        if hit:
            at[n] = t
            n += 1
        out.append((t, level, hit, before, WEALTH + ALPHA * n - (WEALTH if n else 0.0) - spent))
    names = ["t", "alpha_threshold", "discovery", "wealth_before", "wealth_after"]
    return pd.concat([rows.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1), at[:n].tolist(), spent, t


_GATE = "stream string, test_index int, config_hash string, p_value double, t int, alpha_threshold double, discovery boolean, wealth_before double, wealth_after double"


def gate(tests: DataFrame) -> DataFrame:
    """One test per config hash ever, in test_index order; a stream is sequential, streams are not."""
    first = tests.withColumn("_n", F.row_number().over(W.partitionBy("stream", "config_hash").orderBy("test_index"))).where("_n = 1").drop("_n")
    cols = ["stream", "test_index", "config_hash", "p_value"]
    return first.select(*cols).groupBy("stream").applyInPandas(lambda s: fold(s.sort_values("test_index"), [], 0.0, 0)[0], _GATE)


def excess_p(curves: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, n, p): 1 - P(true excess ratio > 0) of daily excess returns on shared days; null below 30 or without variance."""
    shared = [c for c in by if c in reference.columns]
    days = per_day(curves, by).join(reference.select(*shared, F.to_date("t").alias("day"), F.col("equity").alias("other")), [*shared, "day"])
    w = W.partitionBy(*by).orderBy("day")
    x = days.withColumn("x", F.col("equity") / F.lag("equity").over(w) - F.col("other") / F.lag("other").over(w))
    m = x.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.min(F.least("equity", "other")).alias("low"), F.skewness("x").alias("g"), (F.kurtosis("x") + 3).alias("k"))
    # third and fourth moments are about the population, the deviation is the sample's
    shrink = F.sqrt((F.col("n") - 1) / F.col("n"))
    m = m.withColumns({"sr": F.col("m") / F.col("s"), "g": F.col("g") * F.pow(shrink, F.lit(3)), "k": F.col("k") * F.pow(shrink, F.lit(4))})
    fine = (F.col("n") >= LEAST) & (F.col("s") > 1e-12) & (F.col("low") > 0)
    p = 1 - probabilistic_sharpe(F.when(fine, F.col("sr")), F.lit(0.0), F.col("n"), F.col("g"), F.col("k"))
    return m.select(*by, "n", p.alias("p"))


def eligibility(candidates: DataFrame) -> DataFrame:
    """Why a candidate (registered, near_duplicate, aligned, is_representative, tested) may not be tested."""
    why = F.when(F.col("tested"), "TESTED_BEFORE").when(~F.col("registered"), "NOT_REGISTERED").when(F.col("near_duplicate"), "NEAR_DUPLICATE").when(~F.col("aligned"), "NOT_ALIGNED").when(~F.col("is_representative"), "NOT_REPRESENTATIVE")
    return candidates.withColumn("refused", why)


def vault(curves: DataFrame, start) -> DataFrame:
    """The last point before start as base, then all from it on."""
    before = curves.where(F.col("t") < start)
    base = before.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("t")))).where("_n = 1").drop("_n")
    return base.unionByName(curves.where(F.col("t") >= start))


def vault_summary(curves: DataFrame, reference: DataFrame, start) -> DataFrame:
    """(symbol, excess_pct, n, p, passed) on the holdout."""
    own, other = vault(curves.select("symbol", "t", "equity"), start), vault(reference.select("symbol", "t", "equity"), start)
    total = lambda d, n: d.groupBy("symbol").agg(((F.max_by("equity", "t") / F.min_by("equity", "t") - 1) * 100).alias(n))
    return excess_p(own, other).join(total(own, "a"), "symbol").join(total(other, "b"), "symbol").select("symbol", (F.col("a") - F.col("b")).alias("excess_pct"), "n", "p", (F.col("p") < 0.05).alias("passed"))


def needed_days(trades: DataFrame) -> DataFrame:
    """days: trades needed (n_needed) at the pace of n_trades in span_days."""
    return trades.withColumn("days", F.ceil(F.try_divide(F.col("n_needed") * F.col("span_days"), F.col("n_trades"))))


def gauge(ledger: DataFrame) -> DataFrame:
    """One row (tests, discoveries, wealth, next_threshold) of a ledger (test_index, alpha_threshold, discovery), tests 1, 2, ...

    The next level is a sum over the discoveries, in built-in functions.
    """
    n = ledger.agg(F.count("*").alias("tests"), F.count_if("discovery").alias("discoveries"), F.coalesce(F.sum("alpha_threshold"), F.lit(0.0)).alias("spent"), F.min(F.when(F.col("discovery"), F.col("test_index"))).alias("first"))

    def level(t):
        return SCALE * F.log(F.greatest(t, F.lit(2)).cast("double")) / (t * F.exp(F.sqrt(F.log(t.cast("double")))))

    one = F.broadcast(n.select("tests", "first"))  # one row
    found = ledger.where("discovery").crossJoin(one).withColumn("weight", F.when(F.col("test_index") == F.col("first"), ALPHA - WEALTH).otherwise(ALPHA))
    more = found.agg(F.coalesce(F.sum(F.col("weight") * level(F.col("tests") + 1 - F.col("test_index"))), F.lit(0.0)).alias("more"))
    wealth = WEALTH + ALPHA * F.col("discoveries") - F.when(F.col("discoveries") > 0, WEALTH).otherwise(0.0) - F.col("spent")
    return n.crossJoin(more).select("tests", "discoveries", wealth.alias("wealth"), (level(F.col("tests") + 1) * WEALTH + F.col("more")).alias("next_threshold"))


def numbered(tests: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """tests with test_index 1, 2, ... in the order of a whole number that no two share: ranked within stretches of width
    numbers, which start after the tests of those before. A stretch is a task's, the sums are over one row for each."""
    own = tests.withColumn("_s", F.floor(F.col(key) / width))
    sizes = own.groupBy("_s").agg(F.count("*").alias("_c"))
    before = sizes.select("_s", F.coalesce(F.sum("_c").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = own.withColumn("_n", F.row_number().over(W.partitionBy("_s").orderBy(key)))
    return ranked.join(before, "_s").withColumn("test_index", F.col("_before") + F.col("_n")).drop("_s", "_n", "_before")


def regate(promoted: DataFrame, ledger: DataFrame, p_values: DataFrame) -> DataFrame:
    """(id, outcome) of strategies (id, config_hash) promoted before there was a gate: an earlier test of a hash is used again,
    the others are tested once, in order of their hash, after those of the ledger; without a p-value there is no test."""
    earlier = ledger.select("config_hash", F.col("discovery").alias("found"))
    both = promoted.join(earlier, "config_hash", "left").join(p_values, "config_hash", "left")
    todo = both.where("found is null and p_value is not null").select("config_hash", "p_value").distinct()
    so_far = ledger.agg(F.count("*").alias("tests"), F.coalesce(F.sum("alpha_threshold"), F.lit(0.0)).alias("spent"))  # one row
    todo, state = todo.crossJoin(F.broadcast(so_far)), ledger.where("discovery").select("test_index")

    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if new.empty:
            return pd.DataFrame({"config_hash": [], "discovery": []})
        found = sorted(old["test_index"].tolist())
        out, *_ = fold(new.sort_values("config_hash")[["config_hash", "p_value"]], found, float(new["spent"].iloc[0]), int(new["tests"].iloc[0]))
        return out[["config_hash", "discovery"]]

    # one stream of tests is sequential; only tests of promoted strategies and the discoveries before them come here
    one = F.lit(0).alias("k")
    tested = state.select(one, "*").groupBy("k").cogroup(todo.select(one, "*").groupBy("k")).applyInPandas(run, "config_hash string, discovery boolean")
    judged = both.join(tested, "config_hash", "left").withColumn("hit", F.coalesce("found", "discovery"))
    return judged.select("id", F.when(F.col("hit").isNull(), "UNTESTABLE").when(F.col("hit"), "DISCOVERY").otherwise("FAILED").alias("outcome"))


# ---------------------------------------------------------------- the ledger of trials
def record_trials(ledger: DataFrame, trials: DataFrame) -> DataFrame:
    """Rows (config_hash, recorded_at) of trials to append to the ledger: each hash once, at its first time; hashes that the
    ledger has already add nothing, so a batch may be recorded again."""
    first = trials.where("config_hash is not null").groupBy("config_hash").agg(F.min("recorded_at").alias("recorded_at"))
    return first.join(ledger.select("config_hash"), "config_hash", "left_anti")


def trials_to_date(validations: DataFrame, ledger: DataFrame) -> DataFrame:
    """validations (with column at) and n_trials: how many hashes the ledger had at that time, that moment's included.

    Trials are counted by day, days are summed up, and only the trials of a validation's own day are set in order with it.
    """
    day = lambda c: F.to_date(c).alias("day")
    per_day = ledger.groupBy(day("recorded_at")).agg(F.count("*").alias("n"))
    asked = validations.withColumn("_row", F.monotonically_increasing_id())
    days = per_day.unionByName(asked.select(day("at")).distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("day").agg(F.sum("n").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each day
    events = ledger.select(day("recorded_at"), F.col("recorded_at").alias("moment"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("_row"))
    events = events.join(asked.select(day("at")).distinct(), "day", "left_semi").unionByName(asked.select(day("at"), F.col("at").alias("moment"), F.lit(0).alias("one"), "_row"))
    so_far = F.sum("one").over(W.partitionBy("day").orderBy("moment", F.desc("one")).rowsBetween(W.unboundedPreceding, 0))
    counted = events.withColumn("own", so_far).where("_row is not null").join(before, "day").select("_row", (F.col("before") + F.col("own")).alias("n_trials"))
    return asked.join(counted, "_row").drop("_row")
