"""Paper-trading analytics over tables of orders and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CASH, DUST = 1000.0, 1e-8


def signed(qty: str = "qty") -> Column:
    return F.when(F.col("side") == "buy", F.col(qty)).otherwise(-F.col(qty))


def positions(fills: DataFrame) -> DataFrame:
    return fills.groupBy("strategy_id", "symbol").agg(F.sum(signed()).alias("net_qty"))


def open_positions(fills: DataFrame) -> DataFrame:
    return positions(fills).where(F.abs("net_qty") > DUST)


def clamped(qty: Column, price: Column, most_notional: float, most_qty: float, most_share: float, equity: Column) -> Column:
    """qty within three caps of its own sign: notional, quantity and share of equity."""
    cap = F.least(F.lit(most_notional) / price, F.lit(most_qty), most_share * equity / price)
    return F.greatest(F.least(qty, cap), -cap)


def decide(targets: DataFrame, fills: DataFrame, sent: DataFrame) -> DataFrame:
    """Orders for targets (strategy_id, symbol, at, target_qty): the latest target less what is held.

    The client id is a hash of what is decided, so an order is sent once; nothing below dust is sent.
    """
    last = targets.groupBy("strategy_id", "symbol").agg(F.max_by("target_qty", "at").alias("target_qty"), F.max("at").alias("at"))
    both = last.join(positions(fills), ["strategy_id", "symbol"], "left").withColumn("delta", F.col("target_qty") - F.coalesce("net_qty", F.lit(0.0)))
    key = F.substring(F.sha2(F.concat_ws("|", "strategy_id", "symbol", F.col("at").cast("string")), 256), 1, 32)
    orders = both.where(F.abs("delta") >= DUST).select(key.alias("client_id"), "strategy_id", "symbol", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("qty"))
    return orders.join(sent, "client_id", "left_anti")


def fill_price(side: Column, reference: Column, bps: float = 5.0) -> Column:
    return reference * (1 + F.when(side == "buy", bps).otherwise(-bps) / 10_000)


def reconcile(orders: DataFrame) -> DataFrame:
    """Price and quantity deviations and latency of filled orders."""
    done = orders.where("status = 'FILLED' and avg_fill_price is not null and filled_qty is not null")
    return done.select(
        "id", "strategy_id", (F.try_divide(F.col("avg_fill_price") - F.col("expected_price"), F.col("expected_price")) * 100).alias("price_pct"),
        (F.try_divide(F.col("filled_qty") - F.col("expected_qty"), F.col("expected_qty")) * 100).alias("qty_pct"), (F.unix_millis(F.col("filled_at").cast("timestamp")) - F.unix_millis(F.col("submitted_at").cast("timestamp"))).alias("latency_ms"),
    )


def equity_curve(fills: DataFrame, marks: DataFrame | None = None, cash: float = CASH, fee: float = 0.001) -> DataFrame:
    """Equity after each fill at its price, and at a final mark (strategy_id, price): running sums per strategy."""
    w = W.partitionBy("strategy_id").orderBy("filled_at", "id")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    value = signed() * F.col("price")
    rows = fills.withColumns({"cash": F.lit(cash) - F.sum(value + F.abs(value) * fee).over(so_far), "held": F.sum(signed()).over(so_far)})
    curve = rows.select("strategy_id", "filled_at", (F.col("cash") + F.col("held") * F.col("price")).alias("equity"), "cash", "held")
    if marks is None:
        return curve.drop("cash", "held")
    last = rows.groupBy("strategy_id").agg(F.max_by(F.struct("cash", "held"), F.struct("filled_at", "id")).alias("s"))
    final = last.join(marks, "strategy_id").select("strategy_id", F.col("at").alias("filled_at"), (F.col("s.cash") + F.col("s.held") * F.col("price")).alias("equity"))
    return curve.drop("cash", "held").unionByName(final)


def divergence(deviations: DataFrame, assumed: float) -> DataFrame:
    """material: the assumed slippage lies outside the 95 % interval of the adverse ones (price_pct)."""
    rows = deviations.groupBy("strategy_id").agg(F.count("price_pct").alias("n"), F.avg("price_pct").alias("mean"), F.stddev_samp("price_pct").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    off = F.abs(F.col("mean") - assumed)
    return rows.withColumn("material", F.when(F.col("n") < 2, False).when(F.col("sd") == 0, off > 1e-9).otherwise(off > half))


def breaches(equity: DataFrame, most_drawdown: float, most_loss: float) -> DataFrame:
    """Which limit a row (equity, peak, day_start) breaks: drawdown before daily loss."""
    fall, loss = 1 - F.col("equity") / F.col("peak"), 1 - F.col("equity") / F.col("day_start")
    return equity.withColumn("breach", F.when((F.col("peak") > 0) & (fall >= most_drawdown), "DRAWDOWN").when((F.col("day_start") > 0) & (loss >= most_loss), "DAILY_LOSS"))


def once_a_day(findings: DataFrame, stored: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["strategy_id", "type", "day"]).join(stored, ["strategy_id", "type", "day"], "left_anti")


def latest_marks(marks: DataFrame, bars: DataFrame) -> DataFrame:
    """The newest paper mark of a symbol, else its newest bar."""
    both = marks.select("symbol", F.lit(0).alias("pref"), "at", "close").unionByName(bars.select("symbol", F.lit(1).alias("pref"), F.col("t").alias("at"), "close"))
    return both.groupBy("symbol").agg(F.min_by("close", F.struct("pref", -F.unix_micros(F.col("at").cast("timestamp")))).alias("close"))


def recent(orders: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("strategy_id").orderBy(F.desc("submitted_at"), F.desc("id"))
    return orders.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def day_start(curve: DataFrame) -> DataFrame:
    """(strategy_id, day, equity before the day's first fill)."""
    per_day = curve.groupBy("strategy_id", F.to_date("filled_at").alias("day")).agg(F.max_by("equity", "filled_at").alias("close"))
    return per_day.select("strategy_id", "day", F.coalesce(F.lag("close").over(W.partitionBy("strategy_id").orderBy("day")), F.lit(CASH)).alias("day_start"))


def worse_than_holding(curve: DataFrame, bars: DataFrame, traded: DataFrame, cost: float = 15 / 10_000) -> DataFrame:
    """(strategy_id, paper_final, benchmark_final) of strategies whose last paper equity is below holding their symbol.

    traded (strategy_id, symbol); a symbol is bought at its first bar from the day of the first fill on.
    """
    paper = curve.groupBy("strategy_id").agg(F.to_date(F.min("filled_at")).alias("start"), F.max_by("equity", "filled_at").alias("paper_final"))
    window = paper.join(traded, "strategy_id").join(bars.select("symbol", "t", "close"), "symbol").where("t >= start")
    growth = F.max_by("close", "t") / F.min_by("close", "t")
    ends = window.groupBy("strategy_id").agg(F.first("paper_final").alias("paper_final"), (CASH * (1 - cost) * growth).alias("benchmark_final"))
    return ends.where("paper_final < benchmark_final")
