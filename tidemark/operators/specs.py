"""Parameter grids as data: generation, identity, neighbours, variation."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.backtest import seed
from tidemark.operators.signals import REGISTRY



def _sets(names: str, *points: tuple) -> list[dict]:
    return [dict(zip(names.split(), p)) for p in points]


def _axes(**values) -> list[dict]:
    return [dict(zip(values, p)) for p in product(*values.values())]


#: What is swept for each single-symbol family, 205 points in all (momentum where fast < slow).
GRID: dict[str, list[dict]] = {
    "MOMENTUM": _axes(fast=(5, 10, 20), slow=(20, 50, 100)),
    "BOLLINGER": _axes(lookback=(10, 20, 30), k=(1.5, 2.0, 2.5)),
    "VOL_BREAKOUT": _sets("entry exit", (20, 10), (55, 20), (30, 15)),
    "RSI": _axes(lookback=(7, 14, 21), oversold=(20.0, 25.0, 30.0)) + _axes(lookback=(2,), oversold=(10.0, 5.0)),
    "MACD": _sets("fast slow signal", (12, 26, 9), (8, 17, 9), (5, 13, 5)),
    "STOCHASTIC": _axes(lookback=(7, 14, 21), oversold=(15.0, 20.0, 25.0)),
    "PARABOLIC_SAR": _sets("step most", (0.02, 0.2), (0.01, 0.1), (0.03, 0.3)),
    "KELTNER": _axes(lookback=(10, 20, 30), k=(1.5, 2.0, 2.5)),
    "WILLIAMS_R": _axes(lookback=(7, 14, 21), oversold=(-70.0, -80.0, -90.0)),
    "CCI": _axes(lookback=(10, 20, 30), oversold=(-80.0, -100.0, -150.0)),
    "AWESOME_OSCILLATOR": _sets("fast slow", (5, 34), (3, 21), (8, 55)),
    "SUPERTREND": _axes(lookback=(7, 10, 14), k=(2.0, 3.0, 4.0)),
    "TRIX": _axes(lookback=(9, 15, 21)),
    "KELTNER_REVERSION": _axes(lookback=(10, 20, 30), k=(1.5, 2.0, 2.5)),
    "BOLLINGER_PCTB": _axes(lookback=(10, 20, 30), k=(1.5, 2.0, 2.5), oversold=(0.2, 0.0)),
    "ZSCORE": _axes(lookback=(10, 20, 30), oversold=(-1.5, -2.0, -2.5)),
    "IBS": _axes(oversold=(0.2, 0.1)),
    "N_DAY_LOW": _axes(lookback=(10, 20, 50)),
    "CONSECUTIVE_DOWN": _axes(lookback=(2, 3, 4)),
    "SMA_DISTANCE": _axes(lookback=(50, 100, 200), oversold=(0.05, 0.1)),
    "ULTIMATE_OSCILLATOR": _axes(short=(7,), medium=(14,), long=(28,), oversold=(30.0, 20.0)),
    "MFI": _axes(lookback=(14, 21), oversold=(20.0, 30.0)),
    "GAP_FADE": _axes(threshold=(0.01, 0.02, 0.03)),
    "EMA_CROSSOVER": _sets("fast slow", (9, 21), (12, 26), (20, 50)),
    "TRIPLE_MA_ALIGNMENT": _sets("fast mid slow", (5, 20, 50), (10, 20, 50), (10, 50, 200)),
    "DEMA_CROSSOVER": _sets("fast slow", (9, 21), (12, 26), (20, 50)),
    "HULL_MA_TREND": _axes(lookback=(9, 16, 20)),
    "KAMA_TREND": _sets("lookback fast slow", (10, 2, 30), (20, 2, 30), (10, 2, 60)),
    "TSMOM": _sets("lookback skip", (252, 21), (126, 21), (252, 0)),
    "ADX_DI_CROSSOVER": _axes(lookback=(10, 14, 20)),
    "AROON_CROSSOVER": _axes(lookback=(14, 25, 50)),
    "ICHIMOKU_BREAKOUT": _sets("conversion base span", (9, 26, 52), (7, 22, 44)),
    "VORTEX": _axes(lookback=(10, 14, 21)),
    "LINREG_SLOPE": _axes(lookback=(20, 50, 100)),
    "CHANDELIER_EXIT": _axes(lookback=(14, 22), k=(2.0, 3.0)),
    "SMA200_FILTER": _axes(lookback=(50, 100, 200)),
    "MA_RIBBON": _sets("fast mid slow", (5, 10, 20), (10, 20, 50), (20, 50, 100)),
    "SQUEEZE_BREAKOUT": _axes(lookback=(10, 20, 30)),
    "ATR_BREAKOUT": _axes(lookback=(14,), k=(1.0, 1.5, 2.0)),
    "NR7_BREAKOUT": _axes(lookback=(5, 7, 10)),
    "INSIDE_BAR_BREAKOUT": _axes(buffer=(0.0, 0.001, 0.002)),
    "VOL_REGIME_SWITCH": _sets("vol regime lookback", (20, 100, 20), (20, 200, 20)),
    "VOL_OF_VOL_FILTER": _sets("vol vov lookback", (20, 40, 20), (20, 60, 20)),
}
#: What is swept for each rotation family.
ROTATION: dict[str, dict[str, list]] = {
    "EQUAL_WEIGHT_BASELINE": {},
    "SECTOR_MOMENTUM_ROTATION": {"lookback": [63, 126, 252], "top": [3, 5]},
    "RELATIVE_STRENGTH_TOP3": {"lookback": [63, 126, 252], "top": [3]},
    "SECTOR_MEAN_REVERSION": {"lookback": [21, 63], "top": [3, 5]},
    "DUAL_MOMENTUM_GEM": {"lookback": [252]},
    "GTAA_SMA_TIMING": {"lookback": [210]},
    "DEFENSIVE_ASSET_ALLOCATION": {"top": [1, 2, 6]},
    "PROTECTIVE_ASSET_ALLOCATION": {"lookback": [210], "top": [1, 6], "protection": [0.5, 1.0, 2.0]},
    "ACCELERATING_DUAL_MOMENTUM": {},
    "RISK_PARITY_INVERSE_VOL": {"lookback": [63, 126]},
    "MINIMUM_VARIANCE": {"lookback": [63, 126]},
    "FIFTY_TWO_WEEK_HIGH": {"lookback": [252], "top": [3, 5]},
    "RESIDUAL_MOMENTUM": {"lookback": [63, 126, 252], "top": [3]},
}
#: Bars between two rebalances.
MONTH = 21

#: The mechanism that each family stands for.
MECHANISMS: dict[str, tuple[str, ...]] = {
    "TREND": (
        "MOMENTUM", "EMA_CROSSOVER", "DEMA_CROSSOVER", "TRIPLE_MA_ALIGNMENT", "MA_RIBBON", "HULL_MA_TREND", "KAMA_TREND", "TSMOM", "MACD", "TRIX",
        "ADX_DI_CROSSOVER", "AROON_CROSSOVER", "VORTEX", "LINREG_SLOPE", "PARABOLIC_SAR", "SUPERTREND", "CHANDELIER_EXIT", "SMA200_FILTER", "AWESOME_OSCILLATOR",
    ),
    "MEAN_REVERSION": (
        "BOLLINGER", "BOLLINGER_PCTB", "RSI", "STOCHASTIC", "WILLIAMS_R", "CCI", "ZSCORE", "IBS", "N_DAY_LOW", "CONSECUTIVE_DOWN", "SMA_DISTANCE",
        "ULTIMATE_OSCILLATOR", "MFI", "GAP_FADE", "KELTNER_REVERSION",
    ),
    "BREAKOUT": ("VOL_BREAKOUT", "KELTNER", "ICHIMOKU_BREAKOUT", "SQUEEZE_BREAKOUT", "ATR_BREAKOUT", "NR7_BREAKOUT", "INSIDE_BAR_BREAKOUT"),
    "VOLATILITY_REGIME": ("VOL_REGIME_SWITCH", "VOL_OF_VOL_FILTER"),
    "MACHINE_LEARNING": ("RANDOM_FOREST", "GRADIENT_BOOSTING", "LOGISTIC_REGRESSION", "SVM"),
    "CROSS_SECTIONAL": tuple(ROTATION),
}
#: Statuses of a strategy, the best first.
LIFE = ("CHAMPION", "VALIDATED", "PROMISING", "EXPERIMENTAL", "REGIME_SPECIALIST", "DORMANT", "QUARANTINED", "REJECTED", "RETIRED")


#: Fields that must rise in this order, where a family has more than one of them.
_RISING = (("fast", "mid", "slow"), ("short", "medium", "long"), ("step", "most"))


def _valid(params: dict) -> bool:
    return all(x < y for names in _RISING for own in [[params[c] for c in names if c in params]] for x, y in zip(own, own[1:]))


def is_valid(params: str = "params") -> Column:
    """Whether the fields of a map of parameters rise as they must."""
    value = lambda c: F.try_element_at(params, F.lit(c))
    out = F.lit(True)
    for x, y in (p for names in _RISING for p in combinations(names, 2)):
        out = out & F.coalesce(value(x) < value(y), F.lit(True))
    return out


def points(values: dict[str, list[dict]] | None = None) -> list[tuple[str, dict]]:
    """(family, params) of every valid point of the grids, params whole."""
    out = []
    for name, swept in (GRID if values is None else values).items():
        for point in swept:
            params = {**REGISTRY.defaults.get(name, {}), **point}
            if _valid(params):
                out.append((name, params))
    return out


def grid(spark: SparkSession, symbols: DataFrame, values: dict[str, list[dict]] | None = None) -> DataFrame:
    """(spec_id, family, symbol, params, min_bars) of every family's grid for every symbol."""
    rows = [(name, {k: float(v) for k, v in params.items()}, REGISTRY.of(name, **params).min_bars if name in REGISTRY.builders else 0) for name, params in points(values)]
    specs = spark.createDataFrame(rows, "family string, params map<string,double>, min_bars int")
    return identified(symbols.select("symbol").distinct().join(F.broadcast(specs), how="cross"))  # a few hundred points


def identity(family: str = "family", where: str = "symbol", params: str = "params") -> Column:
    """SHA-256 of the identity fields in fixed order."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.sha2(F.concat_ws("|", family, where, F.array_join(pairs, ",")), 256)


def identified(specs: DataFrame) -> DataFrame:
    return specs.withColumn("spec_id", identity())


def _near(a: str, b: str, whole: Column) -> Column:
    """Same keys; every value within one step: 1 for whole numbers, 5 % of the larger for others."""
    close = F.transform(F.map_keys(a), lambda k: F.abs(F.col(a)[k] - F.col(b)[k]) <= F.when(F.array_contains(whole, k), 1.0).otherwise(0.05 * F.greatest(F.abs(F.col(a)[k]), F.abs(F.col(b)[k]))))
    return (F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))) & F.forall(close, lambda x: x)


def neighbours(specs: DataFrame, whole: tuple[str, ...] = ("lookback", "fast", "slow", "mid", "signal", "entry", "exit", "skip", "top")) -> DataFrame:
    """(spec_id, other) one step apart, within (family, symbol); grids bound a group."""
    a = specs.select("family", "symbol", "spec_id", F.col("params").alias("pa"))
    b = specs.select("family", "symbol", F.col("spec_id").alias("other"), F.col("params").alias("pb"))
    return a.join(b, ["family", "symbol"]).where("spec_id <> other").where(_near("pa", "pb", F.array(*map(F.lit, whole)))).select("family", "symbol", "spec_id", "other")


def near_duplicates(specs: DataFrame, others: DataFrame) -> DataFrame:
    """specs with a neighbour among others."""
    both = specs.unionByName(others.select(*specs.columns))
    return specs.join(neighbours(both).join(others.select(F.col("spec_id").alias("other")), "other"), "spec_id", "left_semi")


def laplace(tests: Column, discoveries: Column) -> Column:
    return (discoveries + 1) / (tests + 2)


def tuned(specs: DataFrame, salt: str = "tune") -> DataFrame:
    """Each spec with one field, chosen by seed, moved 10 to 35 % up or down; direction tells which."""
    keys = F.array_sort(F.map_keys("params"))
    pick = F.element_at(keys, (seed(F.col("spec_id"), F.lit(salt), F.lit("field")) % F.size(keys) + 1).cast("int"))
    size = 0.10 + 0.25 * seed(F.col("spec_id"), F.lit(salt), F.lit("size")) / F.lit(2.0**32)
    up = seed(F.col("spec_id"), F.lit(salt), F.lit("way")) % 2 == 0
    moved = specs.withColumns({"field": pick, "factor": F.when(up, 1 + size).otherwise(1 - size)})
    value = lambda k, v: F.when(k == F.col("field"), F.when(v == F.floor(v), F.greatest(F.round(v * F.col("factor")), F.lit(1.0))).otherwise(v * F.col("factor"))).otherwise(v)
    out = moved.withColumns({"parent_id": F.col("spec_id"), "params": F.transform_values("params", value), "direction": F.when(F.col("factor") > 1, "up").otherwise("down")})
    return identified(out).where("spec_id <> parent_id").where(is_valid()).drop("field", "factor")


def crossed(pairs: DataFrame, salt: str = "cross") -> DataFrame:
    """Children of (family, symbol, a, b, pa, pb): each field from one parent, the other or their mean, by seed."""
    kind = lambda k: seed(F.col("a"), F.col("b"), F.lit(salt), k) % 3
    mixed = F.map_zip_with("pa", "pb", lambda k, x, y: F.when(kind(k) == 0, x).when(kind(k) == 1, y).otherwise(F.when((x == F.floor(x)) & (y == F.floor(y)), F.round((x + y) / 2)).otherwise((x + y) / 2)))
    return identified(pairs.withColumn("params", mixed)).drop("pa", "pb")


def canaries(specs: DataFrame, salt: str = "canary", share: float = 0.05) -> DataFrame:
    """About share of the grid by seed, one whole-number field two steps off and not in the grid; a null kind by seed."""
    chosen = specs.where(seed(F.col("spec_id"), F.lit(salt)) < share * 2**32)
    moves = chosen.select("*", F.explode(F.map_keys("params")).alias("field")).select("*", F.explode(F.array(F.lit(2.0), F.lit(-2.0))).alias("by")).where(F.col("params")[F.col("field")] == F.floor(F.col("params")[F.col("field")]))
    jitter = identified(moves.withColumn("origin", F.col("spec_id")).withColumn("params", F.transform_values("params", lambda k, v: F.when(k == F.col("field"), v + F.col("by")).otherwise(v))))
    fine = jitter.where(F.forall(F.map_values("params"), lambda v: v > 0)).join(specs.select("spec_id"), "spec_id", "left_anti")
    first = fine.withColumn("_n", F.row_number().over(W.partitionBy("origin").orderBy("field", F.desc("by")))).where("_n = 1").drop("_n", "field", "by")
    kinds = F.element_at(F.array(F.lit("shift"), F.lit("flip"), F.lit("noise")), (seed(F.col("origin"), F.lit(salt), F.lit("kind")) % 3 + 1).cast("int"))
    return first.withColumn("null_kind", kinds)


def not_run(specs: DataFrame, done: DataFrame, days: int) -> DataFrame:
    """specs with an idempotency key that is not among done."""
    key = F.sha2(F.concat_ws("|", F.lit("backtest"), "spec_id", F.lit(str(days))), 256)
    return specs.withColumn("key", key).join(done.select("key"), "key", "left_anti")


def rotation_grid(spark: SparkSession, universe: list[str], values: dict[str, dict[str, list]] | None = None) -> DataFrame:
    """(spec_id, family, universe, params, every) of every rotation family over a universe, whose order counts."""
    values = ROTATION if values is None else values
    rows = [(name, universe, {k: float(v) for k, v in zip(axes, point)}, MONTH) for name, axes in values.items() for point in product(*axes.values())]
    specs = spark.createDataFrame(rows, "family string, universe array<string>, params map<string,double>, every int")
    return specs.withColumn("where", F.array_join("universe", ",")).withColumn("spec_id", identity(where="where")).drop("where")


def mechanism(family: Column) -> Column:
    """The mechanism of a family; an unknown family raises an error."""
    known = F.create_map(*[F.lit(x) for kind, names in MECHANISMS.items() for name in names for x in (name, kind)])
    return F.coalesce(F.try_element_at(known, family), F.raise_error(F.concat(F.lit("no mechanism for family "), F.coalesce(family, F.lit("null")))).cast("string"))


def aligned(hypotheses: DataFrame) -> DataFrame:
    """hypotheses (family, mechanism) with mechanism_aligned: whether a family's own mechanism was claimed."""
    return hypotheses.withColumn("mechanism_aligned", mechanism(F.col("family")).eqNullSafe(F.col("mechanism")))


def swapped(specs: DataFrame, templates: DataFrame, salt: str = "swap") -> DataFrame:
    """A child of each spec: a template of another family, chosen by seed, for the same symbol; templates (family, params).

    A spec has no child only where there is no template of another family.
    """
    order = W.orderBy("family", F.to_json("params"))  # templates are a grid's points, a few hundred
    numbered = templates.select("family", "params", (F.row_number().over(order) - 1).alias("k"))
    of = numbered.groupBy("family").agg(F.min("k").alias("first"), F.count("*").alias("own"))
    listed = specs.select("spec_id", "symbol", "family").join(F.broadcast(of), "family", "left").crossJoin(F.broadcast(numbered.agg(F.count("*").alias("all"))))
    others = F.col("all") - F.coalesce("own", F.lit(0))
    draw = F.when(others > 0, seed(F.col("spec_id"), F.lit(salt)) % others)
    # numbers of a family follow one another, so a draw among the others skips them
    listed = listed.withColumn("k", draw + F.when(draw >= F.col("first"), F.col("own")).otherwise(0)).where("k is not null")
    child = listed.select(F.col("spec_id").alias("parent_id"), "symbol", "k").join(F.broadcast(numbered), "k").drop("k")
    return identified(child)


def information_value(candidates: DataFrame, penalty: float = 1.0) -> DataFrame:
    """candidates (params, parent_status, mode) with value: the parent's rank from 1 (best) to 0, half without one;
    1 more for those that fill a gap; less a penalty for each parameter."""
    rank = F.array_position(F.array(*map(F.lit, LIFE)), F.col("parent_status"))
    term = F.when(rank > 0, 1 - (rank - 1) / (len(LIFE) - 1)).otherwise(0.5)
    gap = F.when(F.col("mode") == "diversification", 1.0).otherwise(0.0)
    return candidates.withColumn("value", term + gap - penalty * F.size("params"))
