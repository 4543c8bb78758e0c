"""Backtests of all symbols against the benchmark, risk, classes and null signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import signals
from tidemark.operators.graph import stored
from tidemark.plans.registry import query
from tidemark.sources.market import BARS_SQL, bars

_TRIM = signals.warm_up("MOMENTUM") - 1
_OVER = "PARTITION BY symbol ORDER BY t"
_FAR = f"({_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _accounting(source: str) -> str:
    return f"""
steps AS (SELECT *, coalesce(close / lag(close) OVER ({_OVER}) - 1, 0.0) AS ret,
                 abs(position - coalesce(lag(position) OVER ({_OVER}), 0.0)) AS change FROM {source}),
grown AS (SELECT *, 1000 * product((1 - 0.0015 * change) * (1 + position * ret)) OVER {_FAR} AS equity,
                 1000 * product(1 + position * ret) OVER {_FAR} AS gross FROM steps),
curves AS (SELECT *, coalesce(lag(equity) OVER ({_OVER}), 1000.0) * 0.0015 * change AS paid,
                  1 - equity / greatest(1000.0, max(equity) OVER {_FAR}) AS drawdown FROM grown)"""


_MOMENTUM = f"{BARS_SQL},\n{signals.oracle('MOMENTUM')},\ntrimmed AS (SELECT * FROM signals WHERE n >= {_TRIM}),{_accounting('trimmed')}"
_RESULTS = """
results AS (SELECT symbol, count(*) AS n_bars, arg_max(equity, t) / 1000 * 100 - 100 AS return_pct,
                   arg_max(gross, t) / 1000 * 100 - 100 AS gross_pct, max(drawdown) * 100 AS drawdown_pct,
                   sum(change) AS turnover, sum(paid) AS costs FROM curves GROUP BY symbol)"""
_HOLD = f"""
hold AS (SELECT symbol, t, 1000 * (1 - 0.0015) * close / first(close) OVER {_FAR} AS equity FROM trimmed)"""


def signalled(spark, sf_dir, name="MOMENTUM"):
    """Signals of a family at every bar, written once: what uses them several times reads the line items once."""
    return stored(signals.apply(bars(spark, sf_dir), name), "signals")


def trimmed(signs, name="MOMENTUM"):
    """Signals after their family's warm-up."""
    return signs.where(F.col("n") >= signals.warm_up(name) - 1)


def traded(spark, sf_dir, name="MOMENTUM"):
    return trimmed(signalled(spark, sf_dir, name), name)


def _rounded(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("backtest_results", f"WITH {_MOMENTUM},{_RESULTS} SELECT symbol, n_bars, round(return_pct, 4) AS return_pct, round(gross_pct, 4) AS gross_pct, round(drawdown_pct, 4) AS drawdown_pct, round(turnover, 4) AS turnover, round(costs, 4) AS costs FROM results")
def backtest_results(spark, sf_dir):
    return _rounded(bt.results(bt.account(traded(spark, sf_dir))))


_VERSUS = """
days AS (SELECT c.symbol, c.t AS day, c.equity, h.equity AS other FROM curves c JOIN hold h ON c.symbol = h.symbol AND c.t = h.t),
moves AS (SELECT *, equity / lag(equity) OVER w - 1 - (other / lag(other) OVER w - 1) AS x, equity / other AS ratio FROM days
          WINDOW w AS (PARTITION BY symbol ORDER BY day)),
falls AS (SELECT *, 1 - ratio / max(ratio) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS behind FROM moves),
versus AS (SELECT symbol, count(x) AS n_periods,
       (arg_max(equity, day) / arg_min(equity, day) - arg_max(other, day) / arg_min(other, day)) * 100 AS excess_pct,
       avg(CASE WHEN x < -1e-12 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) * 100 AS behind_pct, max(behind) * 100 AS relative_drawdown_pct,
       CASE WHEN count(x) >= 30 AND stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252) END AS excess_sharpe
FROM falls GROUP BY symbol)"""


@query("backtest_vs_benchmark", f"WITH {_MOMENTUM},{_HOLD},{_VERSUS} SELECT symbol, n_periods, round(excess_pct, 4) AS excess_pct, round(behind_pct, 4) AS behind_pct, round(relative_drawdown_pct, 4) AS relative_drawdown_pct, round(excess_sharpe, 4) AS excess_sharpe FROM versus")
def backtest_vs_benchmark(spark, sf_dir):
    rows = traded(spark, sf_dir)
    return _rounded(bt.versus(bt.account(rows), bt.hold(rows)))


@query("benchmark_curve", f"""WITH {BARS_SQL},
listed AS (SELECT DISTINCT symbol, 1000.0 / count(*) OVER () AS share FROM (SELECT DISTINCT symbol FROM bars)),
grid AS (SELECT * FROM (SELECT DISTINCT t FROM bars) CROSS JOIN listed),
held AS (SELECT g.symbol, g.t, g.share, last_value(close IGNORE NULLS) OVER w AS last, first_value(close IGNORE NULLS) OVER w AS entry
         FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.t = b.t
         WINDOW w AS (PARTITION BY g.symbol ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT t, round(sum(coalesce(share * (1 - 0.0015) * last / entry, share)), 4) AS equity FROM held GROUP BY t""")  # fmt: skip
def benchmark_curve(spark, sf_dir):
    rows = bars(spark, sf_dir)
    return _rounded(bt.benchmark(rows, rows))


@query("risk_analytics", f"""WITH {_MOMENTUM},
moves AS (SELECT *, equity / lag(equity) OVER ({_OVER}) - 1 AS r FROM curves)
SELECT symbol, count(r) AS n_returns, round(CASE WHEN count(r) >= 30 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) END, 4) AS sharpe,
       round(CASE WHEN count(r) >= 30 THEN max(drawdown) * 100 END, 4) AS drawdown_pct,
       round(CASE WHEN count(r) >= 30 THEN avg(power(r - m, 3)) / power(stddev_pop(r), 3) END, 4) AS skew,
       round(CASE WHEN count(r) >= 30 THEN avg(power(r - m, 4)) / power(stddev_pop(r), 4) - 3 END, 4) AS kurtosis
FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m FROM moves) GROUP BY symbol""")  # fmt: skip
def risk_analytics(spark, sf_dir):
    return _rounded(bt.risk(bt.account(traded(spark, sf_dir))))


@query("result_classes", f"""WITH {_MOMENTUM},{_RESULTS},{_HOLD},
ends AS (SELECT symbol, arg_max(equity, t) / 1000 * 100 - 100 AS benchmark_pct FROM hold GROUP BY symbol)
SELECT symbol, return_pct > benchmark_pct AS accepted,
       concat_ws(',', CASE WHEN turnover = 0 THEN 'NO_TRADES' END, CASE WHEN return_pct <= benchmark_pct THEN 'WORSE_THAN_HOLDING' END,
                 CASE WHEN return_pct < 0 AND gross_pct > 0 THEN 'TRANSACTION_COST_FAILURE' END) AS reasons
FROM results JOIN ends USING (symbol)""")  # fmt: skip
def result_classes(spark, sf_dir):
    rows = traded(spark, sf_dir)
    ends = bt.hold(rows).groupBy("symbol").agg((F.max_by("equity", "t") / bt.CAPITAL * 100 - 100).alias("benchmark_pct"))
    out = bt.classify(bt.results(bt.account(rows)).join(ends, "symbol"))
    return out.select("symbol", "accepted", F.array_join("reasons", ",").alias("reasons"))


_SEED = "CAST(('0x' || substr(sha256(concat_ws('|', {})), 1, 8)) AS BIGINT)"


@query("null_shifted", f"""WITH {BARS_SQL},
{signals.oracle('MOMENTUM')},
placed AS (SELECT *, row_number() OVER ({_OVER}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS size FROM signals),
moved AS (SELECT symbol, (i + size // 4 + {_SEED.format("symbol, 'shift'")} % greatest(size // 2, 1)) % size AS i, position FROM placed),
shifted AS (SELECT p.symbol, p.t, p.close, m.position FROM placed p JOIN moved m ON p.symbol = m.symbol AND p.i = m.i),{_accounting('shifted')},{_RESULTS}
SELECT symbol, n_bars, round(ln(greatest(1 + return_pct / 100, 0.000001)), 6) AS log_growth, round(turnover, 4) AS turnover FROM results""")  # fmt: skip
def null_shifted(spark, sf_dir):
    rows = signals.apply(bars(spark, sf_dir), "MOMENTUM")
    return _rounded(bt.results(bt.account(bt.shifted(rows))).select("symbol", "n_bars", F.log(F.greatest(1 + F.col("return_pct") / 100, F.lit(1e-6))).alias("log_growth"), "turnover"), 6)


@query("null_flipped", f"""WITH {BARS_SQL},
{signals.oracle('MOMENTUM')},
marked AS (SELECT *, CASE WHEN position <> coalesce(lag(position) OVER ({_OVER}), 0.0) THEN 1 ELSE 0 END AS moves FROM signals),
counted AS (SELECT *, sum(moves) OVER (PARTITION BY symbol) AS k,
            row_number() OVER (PARTITION BY symbol ORDER BY n = 1, sha256(concat_ws('|', symbol, 'flip', n))) AS draw FROM marked),
flipped AS (SELECT symbol, t, close, CAST(sum(CASE WHEN draw <= k AND n > 1 THEN 1 ELSE 0 END) OVER {_FAR} % 2 AS DOUBLE) AS position FROM counted),
{_accounting('flipped')},{_RESULTS}
SELECT symbol, n_bars, round(ln(greatest(1 + return_pct / 100, 0.000001)), 6) AS log_growth, round(turnover, 4) AS turnover FROM results""")  # fmt: skip
def null_flipped(spark, sf_dir):
    rows = signals.apply(bars(spark, sf_dir), "MOMENTUM")
    return _rounded(bt.results(bt.account(bt.flipped(rows))).select("symbol", "n_bars", F.log(F.greatest(1 + F.col("return_pct") / 100, F.lit(1e-6))).alias("log_growth"), "turnover"), 6)


@query("null_noise")
def null_noise(spark, sf_dir):
    """The walk's running product differs in its last digits between engines, and so may a crossing."""
    return _rounded(bt.results(bt.account(bt.noise(bars(spark, sf_dir)))).select("symbol", "n_bars", F.log(F.greatest(1 + F.col("return_pct") / 100, F.lit(1e-6))).alias("log_growth"), "turnover"), 6)
