"""Walk-forward classifiers: for each symbol and checkpoint a model fitted on trailing bars of that symbol.

At every ``retrain`` bars a model is fitted on the last ``train`` bars and used until the next checkpoint. Checkpoints are
joined to bars by index, so that some neighbouring checkpoints of a symbol are one small group with the bars they learn from
and those they score, whatever the length of the series, and all groups are fitted side by side in Arrow tasks. A checkpoint with fewer
than 20 finite rows or one class leaves its bars flat, and so does a bar whose own features are not finite.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import fits
from tidemark.functions.rolling import OVER, div, ewm, roll, shift
from tidemark.operators.backtest import account, results
from tidemark.operators.graph import stored
from tidemark.operators.signals import REGISTRY

FEATURES = ("ret1", "ret5", "std10", "rsi", "hist", "dvol")
#: Least rows to learn from; windows, intervals and thresholds that are swept.
LEAST_ROWS = 20
GRID = {k: {"train": (120, 250), "retrain": (20, 40), "threshold": (0.5, 0.55)} for k in ("RANDOM_FOREST", "GRADIENT_BOOSTING", "LOGISTIC_REGRESSION")} | {"SVM": {"train": (120,), "retrain": (20, 40), "threshold": (0.5, 0.55)}}
MODELS = {"LOGISTIC_REGRESSION": fits.logistic, "RANDOM_FOREST": fits.forest, "GRADIENT_BOOSTING": fits.boosted, "SVM": fits.radial}


def features(bars: DataFrame) -> DataFrame:
    """bars with FEATURES, n and label (next close above this one; null on the last bar)."""
    rows = bars
    for name, step in REGISTRY.of("RSI", lookback=14).steps:
        rows = ewm(rows, name, step.x, step.alpha) if hasattr(step, "alpha") else rows.withColumn(name, F.expr(step))
    rows = rows.drop("d", "up", "dn", "rs")
    for name, step in REGISTRY.of("MACD").steps:
        rows = ewm(rows, name, step.x, step.alpha) if hasattr(step, "alpha") else rows.withColumn(name, F.expr(step))
    ratio = lambda c, k: F.expr(f"({div(c, shift(c, k))}) - 1")
    rows = rows.withColumns({
        "hist": F.expr("line - sig"), "ret1": ratio("close", 1), "ret5": ratio("close", 5), "std10": F.try_divide(F.expr(roll("stddev_samp", "close", 10)), F.col("close")), "dvol": ratio("volume", 1),
        "label": F.expr(f"CAST(({shift('close', -1)}) > close AS DOUBLE)"), "n": F.expr(f"row_number() OVER ({OVER})"),
    })
    return rows.drop("a", "b", "line", "sig")


def _finite() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300) for c in FEATURES])


#: Checkpoints of a symbol that are fitted in one group.
TOGETHER = 16


def _fitted(kind: str):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("k", "ascending"), ("n", "ascending")])
        k, learns, x, y = group["k"].to_numpy(), group["learns"].to_numpy(), np.column_stack([group[c].to_numpy() for c in FEATURES]), group["label"].to_numpy()
        problems, places = [], []
        for one in np.unique(k):
            known, ahead = np.flatnonzero((k == one) & learns), np.flatnonzero((k == one) & ~learns)
            if len(known) >= LEAST_ROWS and len(np.unique(y[known])) == 2 and len(ahead):
                problems.append((x[known], y[known], x[ahead]))
                places.append(ahead)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        p = np.concatenate(MODELS[kind](problems)) if problems else np.zeros(0)
        return group.select(["symbol", "t"]).take(pa.array(at)).append_column("p", pa.array(p))

    return run


def _dealt(groups: DataFrame) -> DataFrame:
    """groups over four tasks a core: rows that lie by symbol would stay so, and by their bytes, few beside the time of a fit, all
    symbols would meet in one task."""
    return groups.repartition(4 * groups.sparkSession.sparkContext.defaultParallelism, "symbol", "part")


def probabilities(bars: DataFrame, kind: str, train: int, retrain: int) -> DataFrame:
    """(symbol, t, close, n, p): P(up) of every bar, null where no model scores it."""
    # the series is used three times below
    rows = stored(features(bars).withColumn("fine", _finite()), "features")
    # n counts from 1: checkpoint k learns from train bars up to n = train + k retrain, whose labels need the bar after,
    # and scores the retrain bars behind them
    placed = rows.withColumn("size", F.max("n").over(W.partitionBy("symbol"))).where("fine")
    ks = F.sequence(F.expr(f"greatest(0, CAST(ceil((n - {train}) / {retrain}) AS BIGINT))"), F.expr(f"(n - 1) div {retrain}"))
    learning = placed.where("label is not null").withColumn("k", F.explode(ks)).where(f"n > k * {retrain} AND n <= {train} + k * {retrain} AND {train} + k * {retrain} < size")
    scoring = placed.where(f"n > {train}").withColumn("k", F.expr(f"(n - 1 - {train}) div {retrain}"))
    columns = ["symbol", "t", "n", *FEATURES, "label", "k"]
    groups = learning.select(*columns, F.lit(True).alias("learns")).unionByName(scoring.select(*columns, F.lit(False).alias("learns")))
    scored = _dealt(groups.withColumn("part", F.expr(f"k div {TOGETHER}"))).groupBy("symbol", "part").applyInArrow(_fitted(kind), f"symbol string, t {bars.schema['t'].dataType.simpleString()}, p double")
    return rows.select("symbol", "t", "close", "n").join(scored, ["symbol", "t"], "left")


def held(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(symbol, t, close, n, position, strength): P(up) - 1/2 as strength, held where P(up) reached threshold a bar ago; bars
    that no model scores are flat, with strength 0."""
    position = F.expr(f"coalesce(lag(CAST(coalesce(p >= {threshold}, FALSE) AS DOUBLE), 1) OVER ({OVER}), 0.0D)")
    return scored.select("symbol", "t", "close", "n", position.alias("position"), F.coalesce(F.col("p") - 0.5, F.lit(0.0)).alias("strength"))


def walk_forward(bars: DataFrame, kind: str, train: int = 120, retrain: int = 20, threshold: float = 0.5) -> DataFrame:
    return held(probabilities(bars, kind, train, retrain), threshold)


def swept(bars: DataFrame, kind: str) -> DataFrame:
    """(symbol, point, n_bars, return_pct, ...) of every point of a kind's grid after its first window; thresholds share a fit."""
    axes, parts = GRID[kind], []
    for train, retrain in product(axes["train"], axes["retrain"]):
        scored = stored(probabilities(bars, kind, train, retrain), "probabilities")
        for threshold in axes["threshold"]:
            rows = held(scored, threshold).where(F.col("n") > train).withColumn("point", F.lit(f"{kind}|retrain={retrain},threshold={threshold},train={train}"))
            parts.append(results(account(rows, ("symbol", "point")), ("symbol", "point")))
    return reduce(DataFrame.unionByName, parts)
