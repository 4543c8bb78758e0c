"""Paired trials of components: registry, verdicts, best of groups, compositions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt

Component = Callable[[DataFrame], DataFrame]


def arms(signals: DataFrame, components: dict[str, Component]) -> DataFrame:
    """(arm, symbol, return_pct, turnover): the base and each component's positions through one accounting."""
    own = [signals.withColumn("arm", F.lit("base")), *[f(signals).select(*signals.columns).withColumn("arm", F.lit(k)) for k, f in components.items()]]
    rows = own[0]
    for x in own[1:]:
        rows = rows.unionByName(x)
    return bt.results(bt.account(rows, ("arm", "symbol")), ("arm", "symbol")).select("arm", "symbol", "return_pct", "turnover", "costs")


def placebo(signals: DataFrame) -> DataFrame:
    return signals


def compositions(components: dict[str, Component], n: int) -> dict[str, Component]:
    """All n-fold combinations, applied in order."""

    def chain(parts):
        def run(df: DataFrame) -> DataFrame:
            for f in parts:
                df = f(df)
            return df

        return run

    return {"+".join(names): chain([components[k] for k in names]) for names in combinations(sorted(components), n)}


def registry(trials: DataFrame) -> DataFrame:
    """Per component: mean, median, least and greatest paired difference and its 95 % interval.

    The difference is of Sharpe ratios where every trial has both, else of returns.
    """
    key = ["component", "version"]
    both = F.every(F.col("enabled_sharpe").isNotNull() & F.col("disabled_sharpe").isNotNull())
    use = trials.groupBy(*key).agg(both.alias("by_sharpe"))
    d = F.when(F.col("by_sharpe"), F.col("enabled_sharpe") - F.col("disabled_sharpe")).otherwise(F.col("enabled_return_pct") - F.col("disabled_return_pct"))
    rows = trials.join(use, key).withColumn("d", d)
    out = rows.groupBy(*key).agg(
        F.first("by_sharpe").alias("by_sharpe"), F.count("d").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.min("d").alias("least"), F.max("d").alias("most"), F.stddev_samp("d").alias("sd")
    )
    half = 1.96 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half}).drop("sd")


def verdicts(rows: DataFrame, least: int = 30) -> DataFrame:
    verdict = F.when(F.col("n") < least, "UNPROVEN").when(F.col("low") > 0, "VALUABLE").when(F.col("high") < 0, "HARMFUL").otherwise("NEUTRAL")
    return rows.withColumn("verdict", verdict).withColumn("disabled", F.col("verdict") == "HARMFUL")


def best_of(outcomes: DataFrame, component: str, baseline: str) -> DataFrame:
    """Per symbol, the best return of two groups (column group) and their difference."""
    best = outcomes.groupBy("symbol").pivot("group", [component, baseline]).agg(F.max("return_pct"))
    return best.dropna().withColumn("difference", F.col(component) - F.col(baseline))
