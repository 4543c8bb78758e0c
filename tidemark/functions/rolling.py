"""Rolling and sequential primitives, as SQL expression text over one series per symbol.

Every series is ordered by ``t`` within ``symbol``. Expressions are text so that many of them share one
window stage, and so that a test can run the very same text on another engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVER = "PARTITION BY symbol ORDER BY t"
NAN, INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"


def frame(n: int, lag: int = 0) -> str:
    """The n rows that end ``lag`` rows before the present one."""
    return f"({OVER} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {'CURRENT ROW' if lag == 0 else f'{lag} PRECEDING'})"


def roll(fn: str, x: str, n: int, lag: int = 0) -> str:
    """fn over n values; null until there are n that are not null."""
    return f"CASE WHEN count({x}) OVER {frame(n, lag)} >= {n} THEN {fn}({x}) OVER {frame(n, lag)} END"


def shift(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({OVER})" if k >= 0 else f"lead({x}, {-k}) OVER ({OVER})"


def div(a: str, b: str) -> str:
    """IEEE division: 0/0 is NaN and x/0 is infinite, where the engine would fail or give null."""
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({a}) > 0 AND ({b}) = 0 THEN {INF} WHEN ({a}) < 0 AND ({b}) = 0 THEN -{INF} WHEN ({a}) = 0 AND ({b}) = 0 THEN {NAN} END"


def is_true(condition: str, *values: str) -> str:
    """condition, but null where a value is null and false where one is NaN."""
    null = " OR ".join(f"({v}) IS NULL" for v in values)
    nan = " OR ".join(f"isnan(CAST(({v}) AS DOUBLE))" for v in values)
    return f"CASE WHEN {null} THEN NULL WHEN {nan} THEN FALSE ELSE ({condition}) END"


def persist(event: str) -> str:
    """The last event that is not null, to this row."""
    return f"last_value({event}) IGNORE NULLS OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


TRUE_RANGE = f"greatest(high - low, abs(high - ({shift('close')})), abs(low - ({shift('close')})))"


def ewm(rows: DataFrame, name: str, x: str, alpha: float) -> DataFrame:
    """Adds y0 = x0, y = (1 - alpha) y' + alpha x over the values of x that are not null.

    The recursion is a decayed sum, so within a block it is exp(-kL) times a running sum of values scaled
    by exp(kL), with L = -ln(1 - alpha); a block is short enough (300 / L rows) for the scale to stay in
    range, and what older blocks but the last weigh is below double precision. One shuffle, no recursion.
    """
    if alpha >= 1:
        return rows.withColumn(name, F.expr(x))
    decay = -math.log1p(-alpha)
    block = max(1, int(300 / decay))
    own = f"exp(-_k * {decay!r}) * sum(coalesce(_x * (CASE WHEN _n = 1 THEN 1.0D ELSE {alpha!r}D END) * exp(_k * {decay!r}), 0.0D)) OVER (PARTITION BY symbol, _block ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (
        rows.withColumn("_x", F.expr(x))
        .withColumn("_n", F.expr(f"count(_x) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
        .withColumns({"_block": F.expr(f"(greatest(_n, 1) - 1) div {block}"), "_k": F.expr(f"(greatest(_n, 1) - 1) % {block}")})
        .withColumn("_own", F.expr(own))
        # the last row of the block before: the greatest n in it
        .withColumn("_ends", F.expr(f"CASE WHEN _k = {block - 1} THEN _own END"))
        .withColumn("_carry", F.expr(f"CASE WHEN _block > 0 THEN last_value(CASE WHEN _k = {block - 1} THEN struct(_block AS b, _own AS v) END) IGNORE NULLS OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END"))
        .withColumn(name, F.expr(f"CASE WHEN _n > 0 THEN _own + coalesce(CASE WHEN _carry.b = _block - 1 THEN exp(-(_k + 1) * {decay!r}) * _carry.v END, 0.0D) END"))
        .drop("_x", "_n", "_block", "_k", "_own", "_ends", "_carry")
    )


def rolling_apply(rows: DataFrame, name: str, column: str, n: int, fn: Callable[[np.ndarray], float]) -> DataFrame:
    """Adds fn over the last n values of a column of each symbol, for what has no built-in form; null before there are n or where one is null.

    A series is one group in pandas. Mean deviation, weighted mean, place of an extreme and regression slope have built-in forms.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name) + f", `{name}` double"

    def run(s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("t", ignore_index=True)
        return s.drop(columns=[name], errors="ignore").assign(**{name: s[column].rolling(n).apply(fn, raw=True)})

    return rows.groupBy("symbol").applyInPandas(run, schema)
