"""Single-symbol signal families: bars in, position (held from the next bar on) and strength out.

A family is a builder from parameters to steps: columns as expression text (see functions.rolling), of
which the last two give the condition and the strength. Steps that depend on earlier windows are stages
of their own; each stage is one window pass over series that are already partitioned by symbol. New
families register with ``@family``. The three recursions without a closed form run per symbol in pandas.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import OVER, TRUE_RANGE, div, ewm, frame, is_true, persist, roll, shift


@dataclass(frozen=True)
class Ewm:
    """A step that is an exponentially weighted mean of x."""

    x: str
    alpha: float


@dataclass(frozen=True)
class Signal:
    steps: tuple[tuple[str, str | Ewm], ...]
    condition: str
    strength: str = "CAST(NULL AS DOUBLE)"
    min_bars: int = 2
    series: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    made: str = ""


@dataclass
class Registry:
    builders: dict[str, Callable[..., Signal]] = field(default_factory=dict)
    defaults: dict[str, dict[str, float]] = field(default_factory=dict)

    def family(self, name: str, **defaults):
        def keep(build):
            self.builders[name], self.defaults[name] = build, defaults
            return build

        return keep

    def of(self, name: str, **params) -> Signal:
        if name not in self.builders:
            raise ValueError(f"unknown signal family: {name}")
        if extra := params.keys() - self.defaults[name].keys():
            raise ValueError(f"{name} takes no {sorted(extra)}")
        return self.builders[name](**{**self.defaults[name], **params})


REGISTRY = Registry()
family = REGISTRY.family


def _span(n: int) -> float:
    return 2.0 / (n + 1)


def _sma(n: int) -> str:
    return roll("avg", "close", n)


@family("MOMENTUM", fast=5, slow=20)
def momentum(fast, slow):
    return Signal((("a", _sma(fast)), ("b", _sma(slow))), "a > b", "a - b", slow + 2)


def _bands(n: int):
    return ("m", _sma(n)), ("sd", roll("stddev_samp", "close", n))


@family("BOLLINGER", lookback=20, k=2.0)
def bollinger(lookback, k):
    return Signal((*_bands(lookback), ("z", div("m - close", "sd"))), is_true(f"close < m - {k} * sd", "m", "sd"), "z", lookback + 2)


@family("ZSCORE", lookback=20, oversold=-1.5)
def zscore(lookback, oversold):
    return Signal((*_bands(lookback), ("z", div("close - m", "sd"))), is_true(f"z < {oversold}", "z"), "-z", lookback + 2)


@family("BOLLINGER_PCTB", lookback=20, k=2.0, oversold=0.1)
def percent_b(lookback, k, oversold):
    return Signal((*_bands(lookback), ("pb", div(f"close - (m - {k} * sd)", f"2 * {k} * sd"))), is_true(f"pb < {oversold}", "pb"), "0.5 - pb", lookback + 2)


@family("VOL_BREAKOUT", entry=20, exit=10)
def donchian(entry, exit):
    hi, lo = roll("max", "high", entry, 1), roll("min", "low", exit, 1)
    return Signal((("hi", hi), ("lo", lo), ("e", "CASE WHEN close > hi THEN 1.0D WHEN close < lo THEN 0.0D END"), ("s", persist("e"))), "s > 0", min_bars=max(entry, exit) + 2)


def _rsi_steps(n: int):
    change = f"close - ({shift('close')})"
    return (
        ("d", change), ("up", Ewm("greatest(d, 0.0D) + 0 * d", 1 / n)), ("dn", Ewm("greatest(-d, 0.0D) + 0 * d", 1 / n)),
        ("rs", div("up", "dn")), ("rsi", "CASE WHEN rs IS NULL THEN NULL WHEN isnan(rs) THEN rs ELSE 100 - 100 / (1 + rs) END"),
    )


@family("RSI", lookback=14, oversold=30)
def rsi(lookback, oversold):
    return Signal(_rsi_steps(lookback), is_true(f"rsi < {oversold}", "rsi"), "50 - rsi", lookback + 2)


@family("MACD", fast=12, slow=26, signal=9)
def macd(fast, slow, signal):
    return Signal((("a", Ewm("close", _span(fast))), ("b", Ewm("close", _span(slow))), ("line", "a - b"), ("sig", Ewm("line", _span(signal)))), "line > sig", "line - sig", slow + signal + 2)


@family("STOCHASTIC", lookback=14, oversold=20)
def stochastic(lookback, oversold):
    return Signal((("hi", roll("max", "high", lookback)), ("lo", roll("min", "low", lookback)), ("k", div("100 * (close - lo)", "hi - lo"))), is_true(f"k < {oversold}", "k"), "50 - k", lookback + 2)


@family("WILLIAMS_R", lookback=14, oversold=-80)
def williams_r(lookback, oversold):
    return Signal((("hi", roll("max", "high", lookback)), ("lo", roll("min", "low", lookback)), ("r", div("-100 * (hi - close)", "hi - lo"))), is_true(f"r < {oversold}", "r"), "-50 - r", lookback + 2)


def _keltner(n: int):
    return ("tr", TRUE_RANGE), ("mid", Ewm("close", _span(n))), ("atr", Ewm("tr", 1 / n))


@family("KELTNER", lookback=20, k=2.0)
def keltner(lookback, k):
    event = f"CASE WHEN close > mid + {k} * atr THEN 1.0D WHEN close < mid THEN 0.0D END"
    return Signal((*_keltner(lookback), ("e", event), ("s", persist("e")), ("x", div("close - mid", "atr"))), "s > 0", "x", lookback + 2)


@family("KELTNER_REVERSION", lookback=20, k=2.0)
def keltner_reversion(lookback, k):
    return Signal((*_keltner(lookback), ("lower", f"mid - {k} * atr"), ("x", div("lower - close", "atr"))), "close < lower", "x", lookback + 2)


@family("CCI", lookback=20, oversold=-100)
def cci(lookback, oversold):
    window = f"collect_list(tp) OVER {frame(lookback)}"
    spread = f"CASE WHEN count(tp) OVER {frame(lookback)} >= {lookback} THEN aggregate(transform(w, x -> abs(x - m)), 0.0D, (a, x) -> a + x) / {lookback} END"
    return Signal((("tp", "(high + low + close) / 3"), ("m", roll("avg", "tp", lookback)), ("w", window), ("mad", spread), ("cci", div("tp - m", "0.015D * mad"))), is_true(f"cci < {oversold}", "cci"), "-cci", lookback + 2)


@family("AWESOME_OSCILLATOR", fast=5, slow=34)
def awesome(fast, slow):
    return Signal((("mp", "(high + low) / 2"), ("ao", f"({roll('avg', 'mp', fast)}) - ({roll('avg', 'mp', slow)})")), "ao > 0", "ao", slow + 2)


@family("TRIX", lookback=15)
def trix(lookback):
    a = _span(lookback)
    return Signal((("e1", Ewm("close", a)), ("e2", Ewm("e1", a)), ("e3", Ewm("e2", a)), ("p", shift("e3")), ("trix", div("100 * (e3 - p)", "p"))), is_true("trix > 0", "trix"), "trix", 3 * lookback + 2)


@family("IBS", oversold=0.2)
def ibs(oversold):
    return Signal((("ibs", div("close - low", "high - low")),), is_true(f"ibs < {oversold}", "ibs"), "0.5 - ibs", 2)


@family("N_DAY_LOW", lookback=10)
def n_day_low(lookback):
    return Signal((("lo", roll("min", "close", lookback)), ("m", _sma(lookback)), ("x", div("m - close", "m"))), "close <= lo", "x", lookback + 2)


@family("CONSECUTIVE_DOWN", lookback=3)
def consecutive_down(lookback):
    return Signal((("down", f"CASE WHEN close < {shift('close')} THEN 1.0D WHEN {shift('close')} IS NOT NULL THEN 0.0D END"), ("run", roll("sum", "down", lookback))), f"run >= {lookback}", "run", lookback + 2)


@family("SMA_DISTANCE", lookback=20, oversold=0.03)
def sma_distance(lookback, oversold):
    return Signal((("m", _sma(lookback)), ("x", div("m - close", "m"))), is_true(f"x > {oversold}", "x"), "x", lookback + 2)


@family("ULTIMATE_OSCILLATOR", short=7, medium=14, long=28, oversold=30)
def ultimate(short, medium, long, oversold):
    parts = [(f"q{n}", div(roll("sum", "bp", n), roll("sum", "tr", n))) for n in (short, medium, long)]
    uo = f"100 * (4 * q{short} + 2 * q{medium} + q{long}) / 7"
    return Signal((("pc", shift("close")), ("bp", "close - least(low, pc)"), ("tr", "greatest(high, pc) - least(low, pc)"), *parts, ("uo", uo)), is_true(f"uo < {oversold}", "uo"), "50 - uo", long + 2)


@family("MFI", lookback=14, oversold=20)
def mfi(lookback, oversold):
    up = f"CASE WHEN tp > ({shift('tp')}) THEN tp * volume ELSE 0.0D END"
    dn = f"CASE WHEN tp > ({shift('tp')}) THEN 0.0D ELSE tp * volume END"
    ratio = div(roll("sum", "up", lookback), roll("sum", "dn", lookback))
    return Signal((("tp", "(high + low + close) / 3"), ("up", up), ("dn", dn), ("r", ratio), ("mfi", "CASE WHEN r IS NULL OR isnan(r) THEN r ELSE 100 - 100 / (1 + r) END")), is_true(f"mfi < {oversold}", "mfi"), "50 - mfi", lookback + 2)


@family("GAP_FADE", threshold=0.02)
def gap_fade(threshold):
    return Signal((("pc", shift("close")), ("gap", div("open - pc", "pc"))), is_true(f"gap < -{threshold}", "gap"), "-gap", 3)


@family("EMA_CROSSOVER", fast=12, slow=26)
def ema_crossover(fast, slow):
    return Signal((("a", Ewm("close", _span(fast))), ("b", Ewm("close", _span(slow)))), "a > b", "a - b", slow + 2)


@family("TRIPLE_MA_ALIGNMENT", fast=5, mid=10, slow=20)
def triple_ma(fast, mid, slow):
    return Signal((("a", _sma(fast)), ("b", _sma(mid)), ("c", _sma(slow))), "a > b AND b > c", "a - c", slow + 2)


@family("DEMA_CROSSOVER", fast=10, slow=20)
def dema(fast, slow):
    return Signal((("a", Ewm("close", _span(fast))), ("aa", Ewm("a", _span(fast))), ("b", Ewm("close", _span(slow))), ("bb", Ewm("b", _span(slow))), ("x", "(2 * a - aa) - (2 * b - bb)")), "x > 0", "x", 2 * slow + 2)


def _wma(x: str, n: int) -> str:
    """Weights 1 to n, the newest the heaviest."""
    terms = " + ".join(f"{n - k} * ({shift(x, k) if k else x})" for k in range(n))
    return f"({terms}) / {n * (n + 1) / 2}"


@family("HULL_MA_TREND", lookback=16)
def hull(lookback):
    raw = f"2 * ({_wma('close', max(1, lookback // 2))}) - ({_wma('close', lookback)})"
    return Signal((("raw", raw), ("hma", _wma("raw", round(math.sqrt(lookback)))), ("x", f"hma - ({shift('hma')})")), "x > 0", "x", lookback + round(math.sqrt(lookback)) + 2)


@family("TSMOM", lookback=120, skip=20)
def tsmom(lookback, skip):
    return Signal((("a", shift("close", skip)), ("b", shift("close", lookback)), ("x", div("a - b", "b"))), is_true("x > 0", "x"), "x", lookback + 2)


@family("ADX_DI_CROSSOVER", lookback=14)
def adx(lookback):
    """The smoothing of DX starts at its first finite value."""
    a = 1 / lookback
    up, dn = f"high - ({shift('high')})", f"({shift('low')}) - low"
    return Signal((
        ("up", up), ("dn", dn), ("tr", TRUE_RANGE), ("atr", Ewm("tr", a)),
        ("p", Ewm("CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0D END", a)), ("m", Ewm("CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0D END", a)),
        ("pdi", div("100 * p", "atr")), ("mdi", div("100 * m", "atr")), ("dx", "CASE WHEN NOT isnan(pdi + mdi) AND pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END"), ("adx", Ewm("dx", a)),
    ), is_true("pdi > mdi AND adx > 25", "pdi", "mdi", "adx"), "pdi - mdi", 3 * lookback + 2)


@family("AROON_CROSSOVER", lookback=25)
def aroon(lookback):
    """The first extreme of a window counts."""
    hi = f"max(struct(high AS v, -rn AS r)) OVER {frame(lookback + 1)}"
    lo = f"min(struct(low AS v, rn AS r)) OVER {frame(lookback + 1)}"
    full = f"rn > {lookback}"
    return Signal((("rn", f"row_number() OVER ({OVER})"), ("hs", hi), ("ls", lo), ("x", f"CASE WHEN {full} THEN 100.0D * ((-hs.r) - ls.r) / {lookback} END")), "x > 0", "x", lookback + 3)


@family("ICHIMOKU_BREAKOUT", conversion=9, base=26, span=52)
def ichimoku(conversion, base, span):
    mid = lambda n: f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2"
    return Signal((("cv", mid(conversion)), ("bs", mid(base)), ("sb", mid(span)), ("a", f"lag((cv + bs) / 2, {base}) OVER ({OVER})"), ("b", shift("sb", base)), ("top", "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END")), "close > top", "close - top", span + base + 2)


@family("VORTEX", lookback=14)
def vortex(lookback):
    vp, vm = f"abs(high - ({shift('low')}))", f"abs(low - ({shift('high')}))"
    return Signal((("vp", vp), ("vm", vm), ("tr", TRUE_RANGE), ("p", div(roll("sum", "vp", lookback), roll("sum", "tr", lookback))), ("m", div(roll("sum", "vm", lookback), roll("sum", "tr", lookback)))), is_true("p > m", "p", "m"), "p - m", lookback + 3)


@family("LINREG_SLOPE", lookback=20)
def linreg(lookback):
    slope = f"CASE WHEN rn >= {lookback} THEN regr_slope(close, rn) OVER {frame(lookback)} END"
    return Signal((("rn", f"CAST(row_number() OVER ({OVER}) AS DOUBLE)"), ("x", slope)), "x > 0", "x", lookback + 2)


@family("CHANDELIER_EXIT", lookback=22, k=3.0)
def chandelier(lookback, k):
    return Signal((("tr", TRUE_RANGE), ("atr", Ewm("tr", 1 / lookback)), ("stop", f"({roll('max', 'high', lookback)}) - {k} * atr"), ("x", div("close - stop", "atr"))), "close > stop", "x", lookback + 2)


@family("SMA200_FILTER", lookback=200)
def sma_filter(lookback):
    return Signal((("m", _sma(lookback)), ("x", div("close - m", "m"))), "close > m", "x", lookback + 2)


@family("MA_RIBBON", fast=10, mid=20, slow=50)
def ribbon(fast, mid, slow):
    return Signal((("a", _sma(fast)), ("b", _sma(mid)), ("c", _sma(slow)), ("spread", "a - c")), f"a > b AND b > c AND spread > ({shift('spread')})", "spread", slow + 3)


@family("SQUEEZE_BREAKOUT", lookback=20)
def squeeze(lookback):
    steps = (*_bands(lookback), ("tr", TRUE_RANGE), ("atr", Ewm("tr", 1 / lookback)), ("sq", "m + 2 * sd < m + 1.5D * atr AND m - 2 * sd > m - 1.5D * atr"))
    return Signal(steps, f"({shift('sq')}) AND NOT sq AND close > m", min_bars=lookback + 3)


@family("ATR_BREAKOUT", lookback=14, k=1.0)
def atr_breakout(lookback, k):
    return Signal((("tr", TRUE_RANGE), ("atr", Ewm("tr", 1 / lookback)), ("pc", shift("close")), ("x", div("close - pc", "atr"))), f"close > pc + {k} * atr", "x", lookback + 2)


@family("NR7_BREAKOUT", lookback=7)
def narrow_range(lookback):
    return Signal((("rg", "high - low"), ("narrow", roll("min", "rg", lookback)), ("nr", "rg <= narrow")), f"({shift('nr')}) AND close > ({shift('high')})", min_bars=lookback + 3)


@family("INSIDE_BAR_BREAKOUT", buffer=0.0)
def inside_bar(buffer):
    inside = f"high < ({shift('high')}) AND low > ({shift('low')})"
    return Signal((("ib", inside),), f"({shift('ib')}) AND close > ({shift('high')}) * (1 + {buffer})", min_bars=4)


def _median(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n} THEN percentile({x}, 0.5D) OVER {frame(n)} END"


@family("VOL_REGIME_SWITCH", vol=20, regime=100, lookback=20)
def vol_regime(vol, regime, lookback):
    steps = (("r", f"close / ({shift('close')}) - 1"), ("vol", roll("stddev_samp", "r", vol)), ("md", _median("vol", regime)), ("m", _sma(lookback)), ("tr_", f"close > ({shift('close', lookback)})"))
    return Signal(steps, "CASE WHEN vol IS NULL OR md IS NULL THEN NULL WHEN vol <= md THEN tr_ ELSE close < m END", min_bars=vol + regime + lookback + 2)


@family("VOL_OF_VOL_FILTER", vol=20, vov=40, lookback=20)
def vol_of_vol(vol, vov, lookback):
    steps = (("r", f"close / ({shift('close')}) - 1"), ("vol", roll("stddev_samp", "r", vol)), ("vv", roll("stddev_samp", "vol", vov)), ("md", _median("vv", vov)), ("tr_", f"close > ({shift('close', lookback)})"))
    return Signal(steps, "vv <= md AND tr_", min_bars=vol + 2 * vov + lookback + 2)


# ---------------------------------------------------------------- recursions per symbol
def _psar(step: float, most: float):
    def run(s: pd.DataFrame) -> pd.DataFrame:
        hi, lo, n = s["high"].to_numpy(), s["low"].to_numpy(), len(s)
        up, sar, far, speed = True, lo[0] if n else 0.0, hi[0] if n else 0.0, step
        flags, line = [True] * min(n, 1), [sar] * min(n, 1)
        for i in range(1, n):
            sar += speed * (far - sar)
            bound = lo[max(0, i - 2) : i].min() if up else hi[max(0, i - 2) : i].max()
            sar = min(sar, bound) if up else max(sar, bound)
            if (lo[i] < sar) if up else (hi[i] > sar):
                up, sar, far, speed = not up, far, (lo[i] if up else hi[i]), step
            elif (hi[i] > far) if up else (lo[i] < far):
                far, speed = (hi[i] if up else lo[i]), min(most, speed + step)
            flags.append(up)
            line.append(sar)
        return s.assign(made=flags, made_x=s["close"].to_numpy() - line)

    return run


@family("PARABOLIC_SAR", step=0.02, most=0.2)
def psar(step, most):
    return Signal((), "made", "made_x", 4, series=_psar(step, most), made="made boolean, made_x double")


def _supertrend(k: float):
    def run(s: pd.DataFrame) -> pd.DataFrame:
        close, mid, atr = s["close"].to_numpy(), ((s["high"] + s["low"]) / 2).to_numpy(), s["atr"].to_numpy()
        flags, line, top, bottom, up = [None] * len(s), [None] * len(s), None, None, True
        for i in range(len(s)):
            if not atr[i] == atr[i]:
                continue
            new_top, new_bottom = mid[i] + k * atr[i], mid[i] - k * atr[i]
            if top is not None:
                new_top = new_top if new_top < top or close[i - 1] > top else top
                new_bottom = new_bottom if new_bottom > bottom or close[i - 1] < bottom else bottom
                up = close[i] >= new_bottom if up else close[i] > new_top
            top, bottom = new_top, new_bottom
            flags[i], line[i] = up, bottom if up else top
        x = (s["close"] - pd.Series(line, s.index, dtype=float)) / s["atr"].where(s["atr"] != 0)
        return s.assign(made=pd.array(flags, "boolean"), made_x=x)

    return run


@family("SUPERTREND", lookback=10, k=3.0)
def supertrend(lookback, k):
    return Signal((("tr", TRUE_RANGE), ("atr", roll("avg", "tr", lookback))), "made", "made_x", lookback + 2, series=_supertrend(k), made="made boolean, made_x double")


def _kama(n: int, fast: int, slow: int):
    def run(s: pd.DataFrame) -> pd.DataFrame:
        c = s["close"].to_numpy()
        k = [0.0] * len(c)
        if len(c) > n:
            moves = abs(pd.Series(c).diff()).rolling(n).sum().to_numpy()
            k[n] = c[n]
            for i in range(n + 1, len(c)):
                ratio = abs(c[i] - c[i - n]) / moves[i] if moves[i] else 0.0
                k[i] = k[i - 1] + (ratio * (_span(fast) - _span(slow)) + _span(slow)) ** 2 * (c[i] - k[i - 1])
        x = pd.Series(k, s.index).diff()
        return s.assign(made=pd.array((x > 0).where(x.notna(), None), "boolean"), made_x=x)

    return run


@family("KAMA_TREND", lookback=10, fast=2, slow=30)
def kama(lookback, fast, slow):
    return Signal((), "made", "made_x", lookback + 3, series=_kama(lookback, fast, slow), made="made boolean, made_x double")


# ---------------------------------------------------------------- application
def apply(bars: DataFrame, name: str, **params) -> DataFrame:
    """bars with position (0 or 1, one bar after the condition) and strength (of the bar itself)."""
    signal = REGISTRY.of(name, **params)
    rows = bars
    for column, step in signal.steps:
        rows = ewm(rows, column, step.x, step.alpha) if isinstance(step, Ewm) else rows.withColumn(column, F.expr(step))
    if signal.series:
        run = signal.series
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + signal.made
        rows = rows.groupBy("symbol").applyInPandas(lambda s: run(s.sort_values("t", ignore_index=True)), schema)
    held = f"coalesce(lag(CAST(_c AS DOUBLE), 1) OVER ({OVER}), 0.0D)"
    rows = rows.withColumns({"_c": F.expr(f"CAST(({signal.condition}) AS INT)"), "strength": F.expr(signal.strength)}).withColumn("position", F.expr(held))
    return rows.select(*bars.columns, "position", "strength", F.expr(f"row_number() OVER ({OVER})").alias("n"))


def warm_up(name: str, **params) -> int:
    """Bars that a family needs before its first tradable one, which is the last of them."""
    return REGISTRY.of(name, **params).min_bars


def oracle(name: str, **params) -> str:
    """The steps of a family as common table expressions over ``bars`` for an engine with list functions."""
    signal, out, last = REGISTRY.of(name, **params), [], "bars"
    if signal.series:
        raise ValueError(f"{name} is a recursion")
    plain = lambda text: text.replace("0.0D", "0.0").replace("1.0D", "1.0").replace("0.015D", "0.015").replace("1.5D", "1.5").replace("0.5D", "0.5").replace("last_value(e) IGNORE NULLS", "last_value(e IGNORE NULLS)")
    for k, (column, step) in enumerate(signal.steps):
        if isinstance(step, Ewm):
            seen = f"list({plain(step.x)}) FILTER (({plain(step.x)}) IS NOT NULL) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            text = f"list_reduce({seen}, lambda a, x: (1 - {step.alpha!r}::DOUBLE) * a + {step.alpha!r}::DOUBLE * x)"
            text = f"CASE WHEN len({seen}) > 0 THEN {text} END"
        else:
            text = plain(step)
        out.append(f"s{k} AS (SELECT *, {text} AS {column} FROM {last})")
        last = f"s{k}"
    out.append(f"raw AS (SELECT *, CAST(({plain(signal.condition)}) AS INTEGER) AS c_, {plain(signal.strength)} AS strength FROM {last})")
    out.append(f"signals AS (SELECT symbol, t, close, coalesce(lag(CAST(c_ AS DOUBLE), 1) OVER ({OVER}), 0.0) AS position, strength, row_number() OVER ({OVER}) AS n FROM raw)")
    return ",\n".join(out)
