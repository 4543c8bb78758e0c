"""Validation: forward returns, rank correlations, folds, decay, regimes, overfitting, scores and verdicts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import normal_cdf, normal_inverse, t_two_sided
from tidemark.operators.backtest import sharpe

#: Horizons of the decay, Euler-Mascheroni constant.
HORIZONS, EULER = (1, 2, 3, 5, 10, 20, 30, 50, 100), 0.5772156649015329


def hit_rate(curves: DataFrame) -> DataFrame:
    """Share of bars on which equity rose, by more than rounding."""
    w = W.partitionBy("symbol").orderBy("t")
    return curves.withColumn("up", F.col("equity") > F.lag("equity").over(w) * (1 + 1e-12)).groupBy("symbol").agg(F.avg(F.col("up").cast("double")).alias("hit_rate"))


def forward(rows: DataFrame, horizons: tuple[int, ...] = (5,)) -> DataFrame:
    """(symbol, t, n, strength, horizon, fwd): returns over the next h bars, one row per horizon."""
    w = W.partitionBy("symbol").orderBy("t")
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(w) / F.col("close") - 1).alias("fwd")) for h in horizons])
    return rows.withColumn("ahead", ahead).select("symbol", "t", "n", "strength", F.explode("ahead").alias("a")).select("symbol", "t", "n", "strength", "a.horizon", "a.fwd")


def rank_correlation(rows: DataFrame, by: list[str]) -> DataFrame:
    """Spearman correlation of strength and fwd with average ranks; null below 3 rows, with NaN or without variance."""
    known = rows.where("strength is not null and fwd is not null")

    def rank(c: str) -> Column:
        ties = F.count("*").over(W.partitionBy(*by, c))
        return F.rank().over(W.partitionBy(*by).orderBy(c)) + (ties - 1) / 2

    ranked = known.withColumns({"ra": rank("strength"), "rb": rank("fwd"), "bad": (F.isnan("strength") | F.isnan("fwd")).cast("int")})
    fine = (F.count("*") >= 3) & (F.max("bad") == 0) & (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(fine, F.covar_pop("ra", "rb") / (F.stddev_pop("ra") * F.stddev_pop("rb"))).alias("ic"))


def with_p(rows: DataFrame) -> DataFrame:
    """ic with the two-sided p-value of its t statistic."""
    df = (F.col("n") - 2).cast("double")
    t = F.when(F.abs("ic") < 1 - 1e-12, F.col("ic") * F.sqrt(df / (1 - F.col("ic") * F.col("ic"))))
    return rows.withColumn("p", F.when(F.abs("ic") >= 1 - 1e-12, 0.0).otherwise(t_two_sided(t, df)))


def decay(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, ic_by_horizon, power): rank correlations by horizon, and those below 0.05."""
    ic = with_p(rank_correlation(forward(rows, horizons), ["symbol", "horizon"]))
    return ic.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", "ic")))).alias("ic_by_horizon"), F.sort_array(F.collect_list(F.when(F.col("p") < 0.05, F.col("horizon")))).alias("power"))


def folds(rows: DataFrame, horizon: int, groups: int = 6, test: int = 2) -> DataFrame:
    """(symbol, fold, n, role): purged combinatorial folds over equal blocks of bars; two growing ones on short series.

    Train rows keep a distance of horizon to every test block.
    """
    spark = rows.sparkSession
    sets = spark.createDataFrame([(k, list(c)) for k, c in enumerate(combinations(range(groups), test))], "fold int, blocks array<int>")
    sized = rows.select("symbol", "n").withColumn("size", F.max("n").over(W.partitionBy("symbol")))
    long = F.col("size") >= 2 * groups + 2 * horizon
    width = F.col("size") / groups
    full = sized.where(long).crossJoin(F.broadcast(sets)).withColumn("block", F.floor((F.col("n") - 1) / width).cast("int"))
    inside = F.array_contains("blocks", F.col("block"))
    close = F.exists("blocks", lambda b: (F.col("n") > F.floor(b * width) - horizon) & (F.col("n") <= F.ceil((b + 1) * width) + horizon))
    full = full.withColumn("role", F.when(inside, "test").when(~close, "train")).where("role is not null").select("symbol", "fold", "n", "role")
    third = F.ceil(F.col("size") / 3)
    short = sized.where(~long).crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "fold int")))
    edge = third * (F.col("fold") + 1)
    short = short.withColumn("role", F.when((F.col("n") > edge) & (F.col("n") <= edge + third), "test").when(F.col("n") <= edge - horizon, "train")).where("role is not null").select("symbol", "fold", "n", "role")
    return full.unionByName(short)


def icir(rows: DataFrame, horizon: int) -> DataFrame:
    """Mean over deviation of the test folds' rank correlations; null below two folds or without deviation."""
    tests = folds(rows, horizon).where("role = 'test'")
    ic = rank_correlation(forward(rows, (horizon,)).join(tests, ["symbol", "n"]), ["symbol", "fold"])
    return ic.groupBy("symbol").agg(F.count("ic").alias("n_folds"), F.when((F.count("ic") >= 2) & (F.stddev_samp("ic") > 0), F.avg("ic") / F.stddev_samp("ic")).alias("icir"))


def regimes(bars: DataFrame, n: int = 20) -> DataFrame:
    """The current regime of each symbol by exact quantiles of its own volatility and trend."""
    w = W.partitionBy("symbol").orderBy("t")
    f = w.rowsBetween(1 - n, 0)
    r = bars.withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    r = r.withColumns({"vol": F.when(F.count("r").over(f) >= n, F.stddev_samp("r").over(f)), "trend": F.col("close") / F.lag("close", n).over(w) - 1})
    cuts = r.groupBy("symbol").agg(*[F.percentile(c, q).alias(f"{c}{int(q * 100)}") for c, q in (("vol", 0.25), ("vol", 0.75), ("vol", 0.95), ("trend", 0.25), ("trend", 0.75))])
    last = r.groupBy("symbol").agg(F.max_by(F.struct("vol", "trend"), "t").alias("s")).join(cuts, "symbol")
    vol, trend = F.col("s.vol"), F.col("s.trend")
    label = (
        F.when(vol.isNull() | trend.isNull(), "UNKNOWN").when((vol >= F.col("vol95")) & (trend <= F.col("trend25")), "CRISIS").when(vol >= F.col("vol75"), "HIGH_VOL").when(vol <= F.col("vol25"), "LOW_VOL")
        .when((trend >= F.col("trend75")) & (trend > 0), "BULL").when((trend <= F.col("trend25")) & (trend < 0), "BEAR").when(F.abs(trend) < F.abs(F.col("trend75")) / 2, "RANGING").otherwise("TRENDING")
    )
    return last.select("symbol", label.alias("regime"))


def regime_breakdown(curves: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, tercile, sharpe, n) by volatility tercile, and whether all signs agree."""
    w = W.partitionBy("symbol").orderBy("t")
    f = w.rowsBetween(1 - n, 0)
    r = curves.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    # ties but for the last digits are ties
    r = r.withColumn("vol", F.round(F.when(F.count("r").over(f) >= n, F.stddev_samp("r").over(f)), 12)).where("vol is not null")
    out = r.withColumn("tercile", F.ntile(3).over(W.partitionBy("symbol").orderBy("vol", "t"))).groupBy("symbol", "tercile").agg(F.count("r").alias("n"), sharpe("r").alias("sharpe"))
    sign = F.signum(F.coalesce("sharpe", F.lit(0.0)))
    per = W.partitionBy("symbol")
    return out.withColumn("consistent", F.min(sign).over(per) == F.max(sign).over(per))


# ---------------------------------------------------------------- Sharpe ratios under many trials
def probabilistic_sharpe(sr: Column, target: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    """P(true ratio > target) for a per-period ratio; kurtosis is not excess; null for n < 2 or no variance."""
    under = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return normal_cdf(F.when((n >= 2) & (under > 0), (sr - target) * F.sqrt(n - 1) / F.sqrt(under)))


def expected_max(trials: Column, sd: Column) -> Column:
    """Expected greatest ratio of that many trials without edge."""
    return F.when(trials > 1, sd * ((1 - EULER) * normal_inverse(1 - 1 / trials.cast("double")) + EULER * normal_inverse(1 - 1 / (trials * 2.718281828459045)))).otherwise(0.0)


def track_record(sr: Column, target: Column, skew: Column, kurtosis: Column, confidence: float = 0.95) -> Column:
    under = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    z = normal_inverse(F.lit(confidence))
    return F.when(sr > target, F.greatest(F.lit(2), F.ceil(1 + under * F.pow(z / (sr - target), F.lit(2)))))


def deflated(moments: DataFrame) -> DataFrame:
    """dsr of rows (sr, n, skew, kurtosis, n_trials): the deviation of sr over the batch, and each row's number of trials so far."""
    batch = moments.agg(F.stddev_samp("sr").alias("_sd"))
    rows = moments.crossJoin(F.broadcast(batch)).withColumn("bar", expected_max(F.col("n_trials"), F.col("_sd"))).drop("_sd")  # one row
    return rows.withColumn("dsr", probabilistic_sharpe(F.col("sr"), F.col("bar"), F.col("n"), F.col("skew"), F.col("kurtosis")))


def overfitting(returns: DataFrame, most: int = 16) -> DataFrame:
    """One row (n_combinations, pbo): share of splits whose best trial in sample ranks in the lower half out of it.

    returns (symbol = trial, i = order in time, r), aligned on the last rows of the shortest trial, its whole
    length; splits are the largest even number up to ``most`` and half that length. Blocks keep counts, sums and
    squares only; combinations are a small table. Below two splits or trials there is none, and pbo is null.
    """
    spark = returns.sparkSession
    sizes = returns.groupBy("symbol").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("trials")).first()
    least = sizes["least"] or 0
    splits = min(most, least // 2) // 2 * 2
    last = returns.withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("i")))).where(F.col("place") <= least)
    blocks = last.withColumn("block", F.ntile(max(2, splits)).over(W.partitionBy("symbol").orderBy("i"))).groupBy("symbol", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    # a combination is the number whose bits tell the blocks in sample
    combos = spark.range(1 << splits).where(F.bit_count("id") == splits // 2) if splits >= 2 and sizes["trials"] >= 2 else spark.range(0)
    halves = combos.select(F.col("id").alias("combo"), F.explode(F.sequence(F.lit(1), F.lit(max(2, splits)))).alias("block")).withColumn("inside", F.expr("(combo >> (block - 1)) & 1 = 1"))
    both = halves.join(F.broadcast(blocks), "block").groupBy("combo", "symbol", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    both = both.withColumn("sr", F.when(var > 0, F.col("s") / F.col("n") / F.sqrt(var)).otherwise(0.0))
    sides = both.groupBy("combo", "symbol").agg(F.max(F.when(F.col("inside"), F.col("sr"))).alias("a"), F.max(F.when(~F.col("inside"), F.col("sr"))).alias("b"))
    w = W.partitionBy("combo")
    ranked = sides.withColumns({"best": F.row_number().over(w.orderBy(F.desc("a"), "symbol")), "rank": F.rank().over(w.orderBy("b")), "size": F.count("*").over(w)}).where("best = 1")
    return ranked.agg(F.count("*").alias("n_combinations"), F.avg((F.col("rank") / (F.col("size") + 1) <= 0.5).cast("double")).alias("pbo"))


def failures(metrics: DataFrame, names: list[str], failed: dict[str, Column]) -> DataFrame:
    """metrics with metric_failures: name -> message for each of names that could not be computed (failed: its message, null if fine).

    A metric that failed is null; the others keep their values.
    """
    said = F.map_from_entries(F.array_compact(F.array(*[F.when(failed[n].isNotNull(), F.struct(F.lit(n).alias("key"), failed[n].alias("value"))) for n in names])))
    return metrics.withColumn("metric_failures", said).withColumns({n: F.when(failed[n].isNull(), F.col(n)) for n in names})


def score(evidence: DataFrame) -> DataFrame:
    """score (0 to 100), worse_than_holding and score_reasons of (excess_return, excess_sharpe, pbo, dsr, has_power).

    The mean of the parts at hand: pbo from 1 at 0 down to 0 at one half, and whether deflated Sharpe and
    excess Sharpe are positive and the claimed horizon has power. What is worse than holding gets 0.
    """
    yes = lambda c: F.when(c.isNotNull(), c.cast("double"))
    of_pbo = F.when(F.col("pbo").isNotNull(), F.greatest(F.lit(0.0), 1 - 2 * F.col("pbo")))
    every = F.array(of_pbo, yes(F.col("dsr") > 0), yes(F.col("excess_sharpe") > 0), yes(F.col("has_power")))
    parts = F.array_compact(every)
    worse = (F.col("excess_return") <= 0) & (F.col("excess_sharpe").isNull() | (F.col("excess_sharpe") <= 0))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    reasons = F.when(worse, F.array(F.lit("WORSE_THAN_HOLDING"))).when(F.size(parts) < 4, F.array(F.lit("SCORE_PARTIAL_EVIDENCE"))).otherwise(F.array().cast("array<string>"))
    return evidence.withColumns({"score": F.when(worse | (F.size(parts) == 0), 0.0).otherwise(100 * mean), "worse_than_holding": worse, "score_reasons": reasons})


def verdict(evidence: DataFrame) -> DataFrame:
    """verdict and reason_codes of scored evidence; the first rule that applies decides.

    Further columns: benchmark_mismatch, previous_verdict, turnover, consistent (null: unknown), n_failures.
    """
    codes = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    rules = [
        (F.col("benchmark_mismatch"), "CONTINUE_RESEARCH", codes("BENCHMARK_MISMATCH")),
        (F.col("worse_than_holding") & (F.col("previous_verdict") == "PROMOTE"), "RETIRE", codes("WORSE_THAN_HOLDING", "RETIRE_FROM_PROMOTE")),
        (F.col("worse_than_holding"), "REJECT", codes("WORSE_THAN_HOLDING")),
        (F.col("turnover") == 0, "DORMANT", codes("NO_TRADES")),
        (F.col("pbo") > 0.5, "REJECT", codes("OVERFITTING")),
        (~F.col("consistent"), "REGIME_SPECIALIST", codes("REGIME_INCONSISTENT")),
        (F.col("dsr").isNotNull() & (F.col("n_failures") > 0), "CONTINUE_RESEARCH", codes("INCOMPLETE_EVIDENCE")),
        (F.col("dsr").isNotNull(), "PROMOTE", codes()),
        (F.col("score") >= 50, "PROMISING", F.col("score_reasons")),
    ]
    out, why = F.lit("CONTINUE_RESEARCH"), F.col("score_reasons")
    for when, name, reasons in reversed(rules):
        hit = F.coalesce(when, F.lit(False))
        out, why = F.when(hit, name).otherwise(out), F.when(hit, reasons).otherwise(why)
    return evidence.withColumns({"verdict": out, "reason_codes": why})


#: The status that a verdict leads to.
STATUS = {
    "PROMOTE": "VALIDATED", "PROMISING": "PROMISING", "CONTINUE_RESEARCH": "EXPERIMENTAL", "REGIME_SPECIALIST": "REGIME_SPECIALIST",
    "DORMANT": "DORMANT", "QUARANTINE": "QUARANTINED", "REJECT": "REJECTED", "RETIRE": "RETIRED",
}


def status(column: str = "verdict") -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce(F.col(column), F.lit("null")))).cast("string"))
