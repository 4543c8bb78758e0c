"""The whole grid on all symbols, and the trials that start from it: evolution, parent choice, components against the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ablation, evolve, learned, specs, sweep
from tidemark.operators.graph import stored
from tidemark.plans.backtest import _accounting
from tidemark.plans.registry import query
from tidemark.sources.market import BARS_SQL, bars

#: Bars over which a strength is held against the return.
HORIZON = 5
GENERATIONS = 3
_ONCE: dict = {}


def _points(*families: str) -> list[sweep.Point]:
    return [sweep.point(f, p) for f, p in specs.points() if not families or f in families]


def _rounded(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _bars(spark, sf_dir):
    return stored(bars(spark, sf_dir), "bars")


def _once(spark, sf_dir, name, build):
    """A table that several queries begin with, written once for each application and folder."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _ONCE:
        _ONCE[key] = stored(build(), name)
    return _ONCE[key]


def scored_grid(spark, sf_dir):
    """The bars and all points' outcomes on them."""
    own = _once(spark, sf_dir, "bars", lambda: bars(spark, sf_dir))
    return own, _once(spark, sf_dir, "grid", lambda: sweep.outcomes(own, _points(), horizon=HORIZON))


@query("grid_backtest")
def grid_backtest(spark, sf_dir):
    """205 points on every symbol; the families below have SQL, tests hold the others against single backtests."""
    return _rounded(scored_grid(spark, sf_dir)[1])


def _close(fn: str, n: int) -> str:
    return f"CASE WHEN i >= {n} THEN {fn}(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


def _back(k: int) -> str:
    return f"lag(close, {k}) OVER (PARTITION BY symbol ORDER BY t)"


#: Definitions as SQL: a condition on closes, and the bars that a point needs.
_PLAIN = {
    "MOMENTUM": lambda fast, slow: (f"({_close('avg', fast)}) > ({_close('avg', slow)})", slow + 2),
    "BOLLINGER": lambda lookback, k: (f"close < ({_close('avg', lookback)}) - {k} * ({_close('stddev_samp', lookback)})", lookback + 2),
    "N_DAY_LOW": lambda lookback: (f"close <= ({_close('min', lookback)})", lookback + 2),
    "SMA200_FILTER": lambda lookback: (f"close > ({_close('avg', lookback)})", lookback + 2),
    "TSMOM": lambda lookback, skip: (f"{_back(skip)} > {_back(lookback)}", lookback + 2),
    "TRIPLE_MA_ALIGNMENT": lambda fast, mid, slow: (f"({_close('avg', fast)}) > ({_close('avg', mid)}) AND ({_close('avg', mid)}) > ({_close('avg', slow)})", slow + 2),
}
#: The points of those families, as in the published grid.
_PLAIN_POINTS = (
    [("MOMENTUM", dict(fast=a, slow=b)) for a, b in ((5, 20), (5, 50), (5, 100), (10, 20), (10, 50), (10, 100), (20, 50), (20, 100))]
    + [("BOLLINGER", dict(lookback=n, k=k)) for n in (10, 20, 30) for k in (1.5, 2.0, 2.5)]
    + [("N_DAY_LOW", dict(lookback=n)) for n in (10, 20, 50)]
    + [("SMA200_FILTER", dict(lookback=n)) for n in (50, 100, 200)]
    + [("TSMOM", dict(lookback=a, skip=b)) for a, b in ((252, 21), (126, 21), (252, 0))]
    + [("TRIPLE_MA_ALIGNMENT", dict(fast=a, mid=b, slow=c)) for a, b, c in ((5, 20, 50), (10, 20, 50), (10, 50, 200))]
)


def _point_sql(family: str, params: dict) -> str:
    condition, least = _PLAIN[family](**params)
    name = f"{family}|" + ",".join(f"{k}={float(v)}" for k, v in sorted(params.items()))
    held = f"coalesce(lag(CAST({condition} AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY t), 0.0)"
    return f"SELECT * FROM (SELECT symbol AS own, t, close, i, size, {held} AS position, '{name}' AS point FROM numbered_(symbol)) WHERE size >= {least} AND i >= {least - 1}".replace("numbered_(symbol)", f"(SELECT *, {condition} AS c_ FROM numbered)").replace(held, "coalesce(lag(CAST(c_ AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY t), 0.0)")


_PLAIN_SQL = f"""WITH {BARS_SQL},
numbered AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, count(*) OVER (PARTITION BY symbol) AS size FROM bars),
held AS ({' UNION ALL '.join(_point_sql(f, p) for f, p in _PLAIN_POINTS)}),
series AS (SELECT own || '~' || point AS symbol, own, point, t, close, position FROM held),{_accounting('series')},
r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM curves)
SELECT own AS symbol, point, count(*) AS n_bars, round(ln(greatest(arg_max(equity, t) / 1000, 0.000001)), 6) AS log_growth, round(ln(greatest(arg_max(gross, t) / 1000, 0.000001)), 6) AS log_gross,
       round(max(drawdown) * 100, 4) AS drawdown_pct, round(sum(change), 4) AS turnover, round(ln(1 + sum(paid)), 6) AS log_costs, round(CASE WHEN count(r) >= 30 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) END, 4) AS sharpe
FROM r GROUP BY own, point"""


@query("grid_backtest_families", _PLAIN_SQL)
def grid_backtest_families(spark, sf_dir):
    """Growth and costs as logarithms, since the test tables' prices jump and some points multiply without bound."""
    out = sweep.outcomes(_bars(spark, sf_dir), _points(*_PLAIN))
    growth = lambda c: F.round(F.log(F.greatest(1 + F.col(c) / 100, F.lit(1e-6))), 6)
    return out.select("symbol", "point", "n_bars", growth("return_pct").alias("log_growth"), growth("gross_pct").alias("log_gross"), *[F.round(c, 4).alias(c) for c in ("drawdown_pct", "turnover", "sharpe")], F.round(F.log1p("costs"), 6).alias("log_costs"))


@query("grid_insufficient", f"""WITH {BARS_SQL},
need AS (SELECT * FROM (VALUES {', '.join(f"('{f}|' || '{','.join(f'{k}={float(v)}' for k, v in sorted(p.items()))}', {_PLAIN[f](**p)[1]})" for f, p in _PLAIN_POINTS)}) AS v(point, min_bars)),
have AS (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol)
SELECT symbol, point, n_bars, min_bars FROM have JOIN need ON n_bars < 8 * min_bars""")  # fmt: skip
def grid_insufficient(spark, sf_dir):
    """Pairs that would lack bars had each symbol an eighth of them: the test tables' symbols all have enough."""
    own = bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_bars"))
    need = spark.createDataFrame([(p.key, p.signal().min_bars) for p in _points(*_PLAIN)], "point string, min_bars int")
    return own.join(F.broadcast(need), F.col("n_bars") < 8 * F.col("min_bars"))  # a few hundred points


def _evolved(spark, sf_dir, salt, rank=None, horizon=None):
    own, grid = scored_grid(spark, sf_dir)
    name = "-".join(["population", salt.split("|")[0], *(rank or [])])
    return _once(spark, sf_dir, name, lambda: evolve.evolve(own, grid, _points(), salt, GENERATIONS, rank, horizon))


def _growth(trials):
    """Returns as log growth: the test tables' prices jump, and returns of their best points overflow an average."""
    both = {c: F.log(F.greatest(1 + F.col(c) / 100, F.lit(1e-6))) for c in ("enabled_return_pct", "disabled_return_pct")}
    return trials.withColumns(both)


def evolution_trials(spark, sf_dir):
    return _growth(evolve.evolution_trials(_evolved(spark, sf_dir, "mutation_evolution|1")))


def parent_trials(spark, sf_dir):
    arms = [_evolved(spark, sf_dir, "icir_parent_fitness|1", rank, HORIZON) for rank in (["icir", "return_pct"], ["return_pct"])]
    return _growth(evolve.parent_trials(*arms))


def _paired(trials):
    return _rounded(trials.select("symbol", F.col("enabled_return_pct").alias("enabled"), F.col("disabled_return_pct").alias("disabled"), (F.col("enabled_return_pct") - F.col("disabled_return_pct")).alias("difference")), 6)


@query("evolution_arm")
def evolution_arm(spark, sf_dir):
    """Best evolved against best of the grid on every symbol, as log growth; a test replays the loop in plain Python."""
    return _paired(evolution_trials(spark, sf_dir))


@query("parent_choice")
def parent_choice(spark, sf_dir):
    """Best child of parents ranked by consistency against that of parents ranked by return, paired by seed."""
    return _paired(parent_trials(spark, sf_dir))


@query("evolution_registry")
def evolution_registry(spark, sf_dir):
    """Both trials' rows in the registry of components, with their verdicts."""
    trials = evolve.registered(evolution_trials(spark, sf_dir), "mutation_evolution").unionByName(evolve.registered(parent_trials(spark, sf_dir), "icir_parent_fitness"))
    return _rounded(ablation.verdicts(ablation.registry(trials)), 6)


@query("component_vs_grid")
def component_vs_grid(spark, sf_dir):
    """Best of a component's own grid against the best of the baseline grid on every symbol, as log growth."""
    own, grid = scored_grid(spark, sf_dir)
    component = learned.swept(own, "LOGISTIC_REGRESSION").withColumn("group", F.lit("LOGISTIC_REGRESSION"))
    both = grid.select("symbol", "return_pct", F.lit("grid").alias("group")).unionByName(component.select("symbol", "return_pct", "group"))
    growth = F.log(F.greatest(1 + F.col("return_pct") / 100, F.lit(1e-6)))
    return _rounded(ablation.best_of(both.withColumn("return_pct", growth), "LOGISTIC_REGRESSION", "grid"), 6)
