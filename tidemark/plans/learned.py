"""Feature frame and walk-forward classifiers over all symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import learned
from tidemark.plans.registry import query
from tidemark.sources.market import BARS_SQL, bars


@query("ml_features", f"""WITH {BARS_SQL},
f AS (SELECT symbol, close / lag(close) OVER w - 1 AS ret1, close / lag(close, 5) OVER w - 1 AS ret5, lead(close) OVER w > close AS label,
             CASE WHEN count(close) OVER v >= 10 THEN stddev_samp(close) OVER v / close END AS std10, volume / lag(volume) OVER w - 1 AS dvol
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t), v AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT symbol, count(ret1) AS n1, count(ret5) AS n5, round(avg(std10), 6) AS std10, round(avg(dvol), 6) AS dvol, count(*) FILTER (label) AS n_up FROM f GROUP BY symbol""")  # fmt: skip
def ml_features(spark, sf_dir):
    return learned.features(bars(spark, sf_dir)).groupBy("symbol").agg(F.count("ret1").alias("n1"), F.count("ret5").alias("n5"), F.round(F.avg("std10"), 6).alias("std10"), F.round(F.avg("dvol"), 6).alias("dvol"), F.count_if(F.col("label") == 1).alias("n_up"))


_ROWS = """round(ret1, 8) AS ret1, round(ret5, 8) AS ret5, round(std10, 8) AS std10, round(dvol, 8) AS dvol, round(rsi, 6) AS rsi, round(hist, 4) AS hist"""


def _mean(x: str, alpha: str) -> str:
    """y = (1 - alpha) y' + alpha x, as a fold over all bars so far."""
    seen = f"list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN len({seen}) > 0 THEN list_reduce({seen}, lambda y, v: (1 - {alpha}) * y + {alpha} * v) END"


@query("ml_feature_rows", f"""WITH {BARS_SQL},
f AS (SELECT symbol, t, close, close / lag(close) OVER w - 1 AS ret1, close / lag(close, 5) OVER w - 1 AS ret5, CASE WHEN count(close) OVER v >= 10 THEN stddev_samp(close) OVER v / close END AS std10,
             volume / lag(volume) OVER w - 1 AS dvol, greatest(close - lag(close) OVER w, 0) + 0 * lag(close) OVER w AS gain, greatest(lag(close) OVER w - close, 0) + 0 * lag(close) OVER w AS loss, CAST(lead(close) OVER w > close AS DOUBLE) AS label
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t), v AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, {_mean('gain', '(1 / 14)')} AS up, {_mean('loss', '(1 / 14)')} AS down, {_mean('close', '(2 / 13)')} - {_mean('close', '(2 / 27)')} AS line FROM f),
h AS (SELECT *, line - {_mean('line', '0.2')} AS hist, CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 END AS rsi FROM g)
SELECT symbol, t, {_ROWS}, label FROM h""")  # fmt: skip
def ml_feature_rows(spark, sf_dir):
    """Every bar's features and label, before and without any model."""
    f = learned.features(bars(spark, sf_dir)).withColumn("rsi", F.when(~F.isnan("rsi"), F.col("rsi")))
    digits = {"ret1": 8, "ret5": 8, "std10": 8, "dvol": 8, "rsi": 6, "hist": 4}
    return f.select("symbol", "t", *[F.round(c, d).alias(c) for c, d in digits.items()], "label")


for _kind in learned.MODELS:
    # trained models have no SQL form: tests hold the logistic one against brute force, the others against known cases
    @query(f"signal_{_kind.lower()}")
    def _(spark, sf_dir, kind=_kind):
        out = learned.walk_forward(bars(spark, sf_dir), kind, 120, 20)
        return out.select("symbol", "t", "position", F.round("strength", 6).alias("strength"))


@query("signal_logistic_regression_year")
def signal_logistic_regression_year(spark, sf_dir):
    """The longer of the two windows that are swept."""
    return learned.walk_forward(bars(spark, sf_dir), "LOGISTIC_REGRESSION", 250, 40).select("symbol", "t", "position", F.round("strength", 6).alias("strength"))
