"""Rotation weights and portfolios over all symbols, and spec grids."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import rotation as rot
from tidemark.operators import specs
from tidemark.plans.registry import query
from tidemark.sources.market import BARS_SQL, TICKS_SQL, bars

#: Most liquid symbols stand first; the last leg is the defensive one.
UNIVERSE = tuple(f"Brand#{k}" for k in range(1, 26))
_LIST = ", ".join(f"'{s}'" for s in UNIVERSE)


def universe(spark, sf_dir):
    pos = F.array_position(F.array(*map(F.lit, UNIVERSE)), F.col("symbol")).cast("int") - 1
    return bars(spark, sf_dir).where(F.col("symbol").isin(*UNIVERSE)).withColumn("pos", pos)


_DAYS = f"""{BARS_SQL},
u AS (SELECT *, CAST(list_position([{_LIST}], symbol) AS INTEGER) - 1 AS pos FROM bars WHERE symbol IN ({_LIST})),
d AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM u)),
days AS (SELECT t FROM d WHERE i >= 60 AND (i - 60) % 21 = 0),
m AS (SELECT *, close / lag(close, 21) OVER w - 1 AS score, CASE WHEN count(close) OVER f >= 20 THEN avg(close) OVER f END AS sma FROM u
      WINDOW w AS (PARTITION BY symbol ORDER BY t), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT m.* FROM m JOIN days USING (t))"""


def _ranked(spark, sf_dir):
    u = universe(spark, sf_dir)
    days = rot.calendar(u, 60, 21)
    return u, days, u.withColumns({"score": rot.trailing(21), "sma": rot.mean(20)}).join(F.broadcast(days), "t")


def _weights(df):
    return df.select("t", "symbol", F.round("weight", 6).alias("weight"))


@query("rotation_equal", f"WITH {_DAYS} SELECT t, symbol, round(1 / count(*) OVER (PARTITION BY t), 6) AS weight FROM r")
def rotation_equal(spark, sf_dir):
    return _weights(rot.equal_weight(_ranked(spark, sf_dir)[2]))


for _name, _way, _worst in (("momentum_top3", "DESC", False), ("reversion_worst3", "ASC", True)):
    _sql = f"""WITH {_DAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score {_way}, pos) AS k FROM r WHERE score IS NOT NULL)
    SELECT t, symbol, round(1 / count(*) OVER (PARTITION BY t), 6) AS weight FROM k WHERE k <= 3"""
    query(f"rotation_{_name}", _sql)(lambda spark, sf_dir, worst=_worst: _weights(rot.best(_ranked(spark, sf_dir)[2], "score", 3, worst)))


@query("rotation_sma", f"WITH {_DAYS}, c AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM r) SELECT t, symbol, round(1 / n, 6) AS weight FROM c WHERE close > sma")
def rotation_sma(spark, sf_dir):
    return _weights(rot.timed(_ranked(spark, sf_dir)[2], F.col("close") > F.col("sma")))


@query("rotation_dual", f"""WITH {_DAYS}, x AS (SELECT *, pos = max(pos) OVER (PARTITION BY t) AS is_last FROM r),
b AS (SELECT t, arg_max(symbol, (score, -pos)) AS lead, max(score) AS best FROM x WHERE NOT is_last AND score IS NOT NULL GROUP BY t)
SELECT t, symbol, 1.0 AS weight FROM x JOIN b USING (t) WHERE CASE WHEN best > 0 THEN symbol = lead ELSE is_last END""")  # fmt: skip
def rotation_dual(spark, sf_dir):
    return _weights(rot.dual(_ranked(spark, sf_dir)[2], "score"))


@query("rotation_inverse_vol", f"""WITH {_DAYS},
q AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r1 FROM u),
v AS (SELECT *, CASE WHEN count(r1) OVER f >= 20 THEN stddev_samp(r1) OVER f END AS vol FROM q WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT t, symbol, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY t), 6) AS weight FROM v JOIN days USING (t) WHERE vol > 0""")  # fmt: skip
def rotation_inverse_vol(spark, sf_dir):
    u, days, _ = _ranked(spark, sf_dir)
    return _weights(rot.inverse_vol(rot.volatility(u, 20).join(F.broadcast(days), "t")))


_LEGS = """
last AS (SELECT *, max(pos) OVER (PARTITION BY t) AS last FROM r),"""


@query("rotation_defensive", f"""WITH {_DAYS},{_LEGS}
c AS (SELECT *, avg(CASE WHEN pos < 2 THEN CASE WHEN coalesce(score, 0) <= 0 THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY t) AS cash FROM last),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, pos) AS k FROM c WHERE pos >= 2 AND pos < last AND score > 0),
w AS (SELECT t, symbol, 1 / count(*) OVER (PARTITION BY t) * (1 - cash) AS weight FROM k WHERE k <= 3 UNION ALL SELECT t, symbol, cash FROM c WHERE pos = last)
SELECT t, symbol, round(weight, 6) AS weight FROM w WHERE weight > 0""")  # fmt: skip
def rotation_defensive(spark, sf_dir):
    return _weights(rot.defensive(_ranked(spark, sf_dir)[2], "score", 3))


@query("rotation_protective", f"""WITH {_DAYS},{_LEGS}
g AS (SELECT *, greatest(count(*) OVER (PARTITION BY t) - 1, 1) AS size, sum(CASE WHEN pos < last AND score > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY t) AS good FROM last),
c AS (SELECT *, least(1.0, (size - good) * 2.0 / size) AS cash FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, pos) AS k FROM c WHERE pos < last AND score > 0),
w AS (SELECT t, symbol, 1 / count(*) OVER (PARTITION BY t) * (1 - cash) AS weight FROM k WHERE k <= 3 UNION ALL SELECT t, symbol, cash FROM c WHERE pos = last)
SELECT t, symbol, round(weight, 6) AS weight FROM w WHERE weight > 0""")  # fmt: skip
def rotation_protective(spark, sf_dir):
    return _weights(rot.protective(_ranked(spark, sf_dir)[2], "score", 3))


def _scored(spark, sf_dir, **columns):
    u, days, _ = _ranked(spark, sf_dir)
    return u.withColumns(columns).join(F.broadcast(days), "t")


def _back(k: int) -> str:
    return f"(close / lag(close, {k}) OVER w - 1)"


@query("rotation_scores", f"""WITH {_DAYS},
s AS (SELECT t, symbol, (12 * {_back(21)} + 4 * {_back(63)} + 2 * {_back(126)} + {_back(252)}) / 19 AS s13612, ({_back(21)} + {_back(63)} + {_back(126)}) / 3 AS accelerating,
             CASE WHEN count(close) OVER f >= 252 THEN close / max(close) OVER f END AS high52 FROM u
      WINDOW w AS (PARTITION BY symbol ORDER BY t), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT t, symbol, round(s13612, 6) AS s13612, round(accelerating, 6) AS accelerating, round(high52, 6) AS high52 FROM s JOIN days USING (t)""")  # fmt: skip
def rotation_scores(spark, sf_dir):
    out = _scored(spark, sf_dir, s13612=rot.score_13612(), accelerating=rot.accelerating(), high52=rot.near_high(252))
    return out.select("t", "symbol", *[F.round(c, 6).alias(c) for c in ("s13612", "accelerating", "high52")])


@query("rotation_residual", f"""WITH {_DAYS},
q AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r1 FROM u), b AS (SELECT t, r1 AS rb FROM q WHERE symbol = '{UNIVERSE[0]}'),
e AS (SELECT *, CASE WHEN count(r1) OVER f >= 20 THEN sum(r1) OVER f - covar_samp(r1, rb) OVER f / (covar_samp(rb, rb) OVER f) * sum(rb) OVER f END AS res FROM q JOIN b USING (t)
      WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
k AS (SELECT t, symbol, row_number() OVER (PARTITION BY t ORDER BY res DESC, pos) AS k FROM e JOIN days USING (t) WHERE pos > 0 AND res IS NOT NULL)
SELECT t, symbol, round(1 / count(*) OVER (PARTITION BY t), 6) AS weight FROM k WHERE k <= 3""")  # fmt: skip
def rotation_residual(spark, sf_dir):
    u, days, _ = _ranked(spark, sf_dir)
    rows = rot.residual(u, UNIVERSE[0], 20).join(F.broadcast(days), "t").where("pos > 0")
    return _weights(rot.best(rows, "res", 3))


@query("rotation_minimum_variance")
def rotation_minimum_variance(spark, sf_dir):
    """All symbols; a day without a bar has the last close, so that returns are common to all."""
    u, days, _ = _ranked(spark, sf_dir)
    w = W.partitionBy("symbol").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    # a calendar times a universe
    grid = u.select("t").distinct().crossJoin(F.broadcast(u.select("symbol").distinct()))
    filled = grid.join(u.select("symbol", "t", "close"), ["symbol", "t"], "left").withColumn("close", F.last("close", True).over(w)).where("close is not null")
    return _weights(rot.minimum_variance(filled, days, 60))


@query("rotation_portfolio")
def rotation_portfolio(spark, sf_dir):
    u, days, ranked = _ranked(spark, sf_dir)
    out = rot.portfolio(u, rot.best(ranked, "score", 3).select("t", "symbol", "weight"), days)
    return out.select("t", *[F.round(c, 4).alias(c) for c in ("equity", "gross", "traded")])


#: Bars that a family needs before its first tradable one, by the fields of its longest chain of windows.
_WARM_UP = {
    "p['lookback'] + 2": "BOLLINGER ZSCORE BOLLINGER_PCTB RSI STOCHASTIC WILLIAMS_R KELTNER KELTNER_REVERSION CCI N_DAY_LOW CONSECUTIVE_DOWN SMA_DISTANCE MFI TSMOM LINREG_SLOPE CHANDELIER_EXIT SMA200_FILTER ATR_BREAKOUT SUPERTREND",
    "p['lookback'] + 3": "AROON_CROSSOVER VORTEX SQUEEZE_BREAKOUT NR7_BREAKOUT KAMA_TREND",
    "p['slow'] + 2": "MOMENTUM AWESOME_OSCILLATOR EMA_CROSSOVER TRIPLE_MA_ALIGNMENT",
    "p['slow'] + 3": "MA_RIBBON", "2 * p['slow'] + 2": "DEMA_CROSSOVER", "p['slow'] + p['signal'] + 2": "MACD", "3 * p['lookback'] + 2": "TRIX ADX_DI_CROSSOVER",
    "greatest(p['entry'], p['exit']) + 2": "VOL_BREAKOUT", "p['long'] + 2": "ULTIMATE_OSCILLATOR", "p['span'] + p['base'] + 2": "ICHIMOKU_BREAKOUT",
    "p['lookback'] + round(sqrt(p['lookback'])) + 2": "HULL_MA_TREND", "p['vol'] + p['regime'] + p['lookback'] + 2": "VOL_REGIME_SWITCH",
    "p['vol'] + 2 * p['vov'] + p['lookback'] + 2": "VOL_OF_VOL_FILTER", "2": "IBS", "3": "GAP_FADE", "4": "INSIDE_BAR_BREAKOUT PARABOLIC_SAR",
}
_POINTS = ",\n".join("('" + name + "', MAP {" + ", ".join(f"'{k}': {float(v)!r}::DOUBLE" for k, v in params.items()) + "})" for name, params in specs.points())
_NEEDED = " ".join(f"WHEN family IN ({', '.join(repr(f) for f in names.split())}) THEN {bars_}" for bars_, names in _WARM_UP.items())


def _hash(family: str, symbol: str, entries: str) -> str:
    return f"sha256({family} || '|' || {symbol} || '|' || array_to_string(list_transform({entries}, lambda x: x.key || '=' || CAST(x.value AS VARCHAR)), ','))"


def _drawn(*parts: str) -> str:
    return f"CAST(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def _shown(entries: str) -> str:
    """Parameters in millionths, sorted by name."""
    return f"array_to_string(list_transform({entries}, lambda x: x.key || '=' || CAST(CAST(round(x.value * 1000000) AS BIGINT) AS VARCHAR)), ',')"


def shown(params="params"):
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1000000).cast("long").cast("string")))
    return F.array_join(pairs, ",")


_GRID = f"""{TICKS_SQL},
points(family, p) AS (VALUES {_POINTS}),
grid AS (SELECT *, {_hash('family', 'symbol', 'e')} AS spec_id FROM (
  SELECT family, symbol, p, list_sort(map_entries(p)) AS e, CAST(CASE {_NEEDED} END AS INTEGER) AS min_bars FROM points CROSS JOIN (SELECT DISTINCT symbol FROM ticks))),
near AS (
  SELECT a.family, a.symbol, a.spec_id, b.spec_id AS other, a.e AS ea, b.e AS eb FROM grid a JOIN grid b ON a.family = b.family AND a.symbol = b.symbol AND a.spec_id <> b.spec_id
  WHERE len(list_filter(range(1, len(a.e) + 1), lambda k: abs(a.e[k].value - b.e[k].value) > CASE WHEN a.e[k].key IN ('lookback', 'fast', 'slow', 'mid', 'signal', 'entry', 'exit', 'skip', 'top') THEN 1
    ELSE 0.05 * greatest(abs(a.e[k].value), abs(b.e[k].value)) END)) = 0)"""
_RISES = " AND ".join(f"coalesce(p['{a}'] < p['{b}'], TRUE)" for a, b in (("fast", "mid"), ("mid", "slow"), ("fast", "slow"), ("short", "medium"), ("medium", "long"), ("short", "long"), ("step", "most")))


@query("spec_grid", f"WITH {_GRID} SELECT spec_id, family, symbol, {_shown('e')} AS params, min_bars FROM grid")
def spec_grid(spark, sf_dir):
    return specs.grid(spark, bars(spark, sf_dir)).select("spec_id", "family", "symbol", shown().alias("params"), "min_bars")


@query("spec_neighbours", f"WITH {_GRID} SELECT family, symbol, spec_id, other FROM near")
def spec_neighbours(spark, sf_dir):
    return specs.neighbours(specs.grid(spark, bars(spark, sf_dir)))


@query("spec_tuned", f"""WITH {_GRID},
drawn AS (SELECT *, e[CAST({_drawn('spec_id', "'tune'", "'field'")} % len(e) + 1 AS INTEGER)].key AS field, {_drawn('spec_id', "'tune'", "'way'")} % 2 = 0 AS up,
  0.1 + 0.25 * ({_drawn('spec_id', "'tune'", "'size'")} / 4294967296) AS size FROM grid),
moved AS (SELECT spec_id, family, symbol, up, e AS before, list_transform(e, lambda x: {{'key': x.key, 'value': CASE WHEN x.key <> field THEN x.value
    WHEN x.value <> floor(x.value) THEN x.value * CASE WHEN up THEN 1 + size ELSE 1 - size END
    ELSE greatest(round(x.value * CASE WHEN up THEN 1 + size ELSE 1 - size END), 1) END}}) AS e FROM drawn),
made AS (SELECT *, map_from_entries(e) AS p FROM moved WHERE e <> before)
SELECT spec_id AS parent_id, family, symbol, CASE WHEN up THEN 'up' ELSE 'down' END AS direction, {_shown('e')} AS params FROM made WHERE {_RISES}""")  # fmt: skip
def spec_tuned(spark, sf_dir):
    return specs.tuned(specs.grid(spark, bars(spark, sf_dir))).select("parent_id", "family", "symbol", "direction", shown().alias("params"))


@query("spec_canaries", f"""WITH {_GRID},
chosen AS (SELECT * FROM grid WHERE {_drawn('spec_id', "'canary'")} < 0.05 * 4294967296),
moves AS (SELECT c.*, f.key AS field, b.d AS d FROM (SELECT *, unnest(e) AS f FROM chosen) c CROSS JOIN (VALUES (2), (-2)) b(d) WHERE f.value = floor(f.value)),
jitter AS (SELECT spec_id AS origin, family, symbol, field, d, list_transform(e, lambda x: {{'key': x.key, 'value': CASE WHEN x.key = field THEN x.value + d ELSE x.value END}}) AS e FROM moves),
fine AS (SELECT *, {_hash('family', 'symbol', 'e')} AS spec_id FROM jitter WHERE len(list_filter(e, lambda x: x.value <= 0)) = 0)
SELECT origin, spec_id, family, symbol, {_shown('e')} AS params, ['shift', 'flip', 'noise'][CAST({_drawn('origin', "'canary'", "'kind'")} % 3 + 1 AS INTEGER)] AS null_kind
FROM fine WHERE spec_id NOT IN (SELECT spec_id FROM grid) QUALIFY row_number() OVER (PARTITION BY origin ORDER BY field, d DESC) = 1""")  # fmt: skip
def spec_canaries(spark, sf_dir):
    return specs.canaries(specs.grid(spark, bars(spark, sf_dir))).select("origin", "spec_id", "family", "symbol", shown().alias("params"), "null_kind")


@query("spec_crossed", f"""WITH {_GRID},
made AS (SELECT spec_id AS a, other AS b, family, symbol, list_transform(range(1, len(ea) + 1), lambda k: {{'key': ea[k].key, 'value': CASE {_drawn('spec_id', 'other', "'cross'", 'ea[k].key')} % 3 WHEN 0 THEN ea[k].value WHEN 1 THEN eb[k].value
    ELSE CASE WHEN ea[k].value = floor(ea[k].value) AND eb[k].value = floor(eb[k].value) THEN round((ea[k].value + eb[k].value) / 2) ELSE (ea[k].value + eb[k].value) / 2 END END}}) AS e FROM near WHERE spec_id < other)
SELECT a, b, family, symbol, {_shown('e')} AS params FROM made""")  # fmt: skip
def spec_crossed(spark, sf_dir):
    g = specs.grid(spark, bars(spark, sf_dir)).select("family", "symbol", "spec_id", "params")
    n = specs.neighbours(g).where("spec_id < other").select("family", "symbol", F.col("spec_id").alias("a"), F.col("other").alias("b"))
    pairs = n.join(g.select(F.col("spec_id").alias("a"), F.col("params").alias("pa")), "a").join(g.select(F.col("spec_id").alias("b"), F.col("params").alias("pb")), "b")
    return specs.crossed(pairs).select("a", "b", "family", "symbol", shown().alias("params"))
