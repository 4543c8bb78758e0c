"""Validation metrics and gates over the momentum signal of all symbols."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import gates, metrics, signals
from tidemark.operators.graph import stored
from tidemark.plans.backtest import _HOLD, _MOMENTUM, signalled, traded, trimmed
from tidemark.plans.registry import query
from tidemark.sources.experiments import VALIDATIONS_SQL, validations
from tidemark.sources.market import BARS_SQL, bars, table

_SIG = f"{BARS_SQL},\n{signals.oracle('MOMENTUM')}"


def _curves(spark, sf_dir):
    return bt.account(traded(spark, sf_dir))


@query("hit_rate", f"WITH {_MOMENTUM}, u AS (SELECT symbol, equity > lag(equity) OVER (PARTITION BY symbol ORDER BY t) * (1 + 1e-12) AS up FROM curves) SELECT symbol, round(avg(CAST(up AS INTEGER)), 6) AS hit_rate FROM u GROUP BY symbol")
def hit_rate(spark, sf_dir):
    return metrics.hit_rate(_curves(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


_IC = f"""WITH {_SIG},
ahead AS (SELECT symbol, strength, h, CASE h WHEN 1 THEN f1 WHEN 5 THEN f5 ELSE f20 END AS fwd FROM (
  SELECT symbol, strength, lead(close, 1) OVER w / close - 1 AS f1, lead(close, 5) OVER w / close - 1 AS f5, lead(close, 20) OVER w / close - 1 AS f20 FROM signals
  WINDOW w AS (PARTITION BY symbol ORDER BY t)) CROSS JOIN (SELECT unnest([1, 5, 20]) AS h)),
ranked AS (SELECT symbol, h, rank() OVER (PARTITION BY symbol, h ORDER BY strength) + (count(*) OVER (PARTITION BY symbol, h, strength) - 1) / 2 AS ra,
                  rank() OVER (PARTITION BY symbol, h ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, h, fwd) - 1) / 2 AS rb
           FROM ahead WHERE strength IS NOT NULL AND fwd IS NOT NULL)
SELECT symbol, h AS horizon, count(*) AS n, round(corr(ra, rb), 6) AS ic FROM ranked GROUP BY symbol, h"""


@query("information_coefficient", _IC)
def information_coefficient(spark, sf_dir):
    out = metrics.rank_correlation(metrics.forward(signalled(spark, sf_dir), (1, 5, 20)), ["symbol", "horizon"])
    return out.withColumn("ic", F.round("ic", 6))


@query("ic_decay")
def ic_decay(spark, sf_dir):
    return metrics.decay(signalled(spark, sf_dir))


_FOLDS = """
sized AS (SELECT symbol, n, max(n) OVER (PARTITION BY symbol) AS size FROM signals),
sets AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS fold, i, j FROM range(6) AS a(i), range(6) AS b(j) WHERE i < j),
placed AS (SELECT symbol, fold, n, size, CAST(floor((n - 1) / (size / 6)) AS INTEGER) AS block, i, j FROM sized CROSS JOIN sets WHERE size >= 22),
roles AS (SELECT symbol, fold, n, CASE WHEN block = i OR block = j THEN 'test'
    WHEN NOT ((n > floor(i * (size / 6)) - 5 AND n <= ceil((i + 1) * (size / 6)) + 5) OR (n > floor(j * (size / 6)) - 5 AND n <= ceil((j + 1) * (size / 6)) + 5)) THEN 'train' END AS role FROM placed)"""


@query("fold_roles", f"WITH {_SIG},{_FOLDS} SELECT symbol, fold, role, count(*) AS n FROM roles WHERE role IS NOT NULL GROUP BY ALL")
def fold_roles(spark, sf_dir):
    return metrics.folds(signalled(spark, sf_dir), 5).groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"))


@query("icir", f"""WITH {_SIG},{_FOLDS},
ahead AS (SELECT symbol, n, strength, lead(close, 5) OVER (PARTITION BY symbol ORDER BY t) / close - 1 AS fwd FROM signals),
tests AS (SELECT symbol, fold, strength, fwd FROM ahead JOIN roles USING (symbol, n) WHERE role = 'test' AND strength IS NOT NULL AND fwd IS NOT NULL),
ranked AS (SELECT symbol, fold, rank() OVER (PARTITION BY symbol, fold ORDER BY strength) + (count(*) OVER (PARTITION BY symbol, fold, strength) - 1) / 2 AS ra,
                  rank() OVER (PARTITION BY symbol, fold ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, fold, fwd) - 1) / 2 AS rb FROM tests),
ic AS (SELECT symbol, fold, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS ic FROM ranked GROUP BY ALL)
SELECT symbol, count(ic) AS n_folds, round(CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END, 6) AS icir FROM ic GROUP BY symbol""")  # fmt: skip
def icir(spark, sf_dir):
    return metrics.icir(signalled(spark, sf_dir), 5).withColumn("icir", F.round("icir", 6))


@query("regimes", f"""WITH {BARS_SQL},
r AS (SELECT *, close / lag(close) OVER w - 1 AS r, close / lag(close, 20) OVER w - 1 AS trend FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
v AS (SELECT *, CASE WHEN count(r) OVER f >= 20 THEN stddev_samp(r) OVER f END AS vol FROM r WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c AS (SELECT symbol, quantile_cont(vol, 0.25) AS v25, quantile_cont(vol, 0.75) AS v75, quantile_cont(vol, 0.95) AS v95, quantile_cont(trend, 0.25) AS t25, quantile_cont(trend, 0.75) AS t75 FROM v GROUP BY symbol),
l AS (SELECT symbol, vol, trend FROM v QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1)
SELECT symbol, CASE WHEN vol IS NULL OR trend IS NULL THEN 'UNKNOWN' WHEN vol >= v95 AND trend <= t25 THEN 'CRISIS' WHEN vol >= v75 THEN 'HIGH_VOL' WHEN vol <= v25 THEN 'LOW_VOL'
  WHEN trend >= t75 AND trend > 0 THEN 'BULL' WHEN trend <= t25 AND trend < 0 THEN 'BEAR' WHEN abs(trend) < abs(t75) / 2 THEN 'RANGING' ELSE 'TRENDING' END AS regime FROM l JOIN c USING (symbol)""")  # fmt: skip
def regimes(spark, sf_dir):
    return metrics.regimes(bars(spark, sf_dir))


@query("regime_breakdown", f"""WITH {_MOMENTUM},
moves AS (SELECT symbol, t, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM curves),
vols AS (SELECT *, round(CASE WHEN count(r) OVER f >= 20 THEN stddev_samp(r) OVER f END, 12) AS vol FROM moves WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
thirds AS (SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY vol, t) AS tercile FROM vols WHERE vol IS NOT NULL),
s AS (SELECT symbol, tercile, count(r) AS n, CASE WHEN count(r) >= 30 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) END AS sharpe FROM thirds GROUP BY ALL)
SELECT symbol, tercile, n, round(sharpe, 4) AS sharpe, min(sign(coalesce(sharpe, 0))) OVER (PARTITION BY symbol) = max(sign(coalesce(sharpe, 0))) OVER (PARTITION BY symbol) AS consistent FROM s""")  # fmt: skip
def regime_breakdown(spark, sf_dir):
    return metrics.regime_breakdown(_curves(spark, sf_dir)).withColumn("sharpe", F.round("sharpe", 4))


def _moments(curves):
    w = W.partitionBy("symbol").orderBy("t")
    r = curves.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    return r.groupBy("symbol").agg(F.count("r").alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurtosis"))


_MOMENTS = f"""WITH {_MOMENTUM},
moves AS (SELECT symbol, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM curves),
moments AS (SELECT symbol, count(r) AS n, avg(r) / stddev_samp(r) AS sr, avg(power(r - m, 3)) / power(stddev_pop(r), 3) AS skew, avg(power(r - m, 4)) / power(stddev_pop(r), 4) AS kurtosis
            FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m FROM moves) GROUP BY symbol)"""


def _tried(spark, sf_dir):
    """(fingerprint, first, last): the first time of every fingerprint that was ever validated and its newest validation."""
    return validations(spark, sf_dir).groupBy("fingerprint").agg(F.min("created_at").alias("first"), F.max(F.struct("created_at", "id", "verdict")).alias("last"))


def _ledger(tried):
    """The trials recorded so far: every fingerprint that was ever validated, at its first time."""
    rows = tried.select(F.col("fingerprint").alias("config_hash"), F.col("first").cast("timestamp").alias("recorded_at"))
    return gates.record_trials(rows.limit(0), rows)


def _judged(signs, curves, ledger):
    """Each symbol's moments with the number of trials that the ledger had on the day of its last bar."""
    last = signs.groupBy("symbol").agg(F.max("t").cast("timestamp").alias("at"))
    return gates.trials_to_date(_moments(curves).join(last, "symbol"), ledger)


@query("trials_to_date", f"""WITH {BARS_SQL}, {VALIDATIONS_SQL},
ledger AS (SELECT fingerprint, CAST(min(created_at) AS TIMESTAMP) AS recorded_at FROM validations GROUP BY fingerprint),
asked AS (SELECT symbol, CAST(t AS TIMESTAMP) AS moment FROM bars)
SELECT symbol, moment, (SELECT count(*) FROM ledger WHERE recorded_at <= moment) AS n_trials FROM asked""")  # fmt: skip
def trials_to_date(spark, sf_dir):
    """The count at every bar of every symbol."""
    asked = bars(spark, sf_dir).select("symbol", F.col("t").cast("timestamp").alias("at"))
    return gates.trials_to_date(asked, _ledger(_tried(spark, sf_dir))).select("symbol", F.col("at").alias("moment"), "n_trials")


@query("deflated_sharpe")
def deflated_sharpe(spark, sf_dir):
    signs = signalled(spark, sf_dir)
    return metrics.deflated(_judged(signs, bt.account(trimmed(signs)), _ledger(_tried(spark, sf_dir)))).drop("at")


@query("track_record", f"""{_MOMENTS}
SELECT symbol, CASE WHEN sr > -1 THEN greatest(2, CAST(ceil(1 + (1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) * power(1.6448536269514722 / (sr + 1), 2)) AS BIGINT)) END AS n_needed FROM moments""")  # fmt: skip
def track_record(spark, sf_dir):
    return _moments(_curves(spark, sf_dir)).select("symbol", metrics.track_record(F.col("sr"), F.lit(-1.0), F.col("skew"), F.col("kurtosis")).alias("n_needed"))


@query("overfitting_probability")
def overfitting_probability(spark, sf_dir):
    return _overfitting(_curves(spark, sf_dir))


def _overfitting(curves):
    w = W.partitionBy("symbol").orderBy("t")
    r = curves.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1).where("r is not null")
    return metrics.overfitting(r.select("symbol", F.col("t").alias("i"), "r"))


def _cdf(z: str) -> str:
    """The normal distribution as a power series, for engines that have none; good to 7 digits."""
    series = f"list_sum(list_transform(range(0, 100), lambda k: power(-1.0, k) * power({z}, 2 * k + 1) / (power(2.0, k) * gamma(k + 1) * (2 * k + 1))))"
    return f"CASE WHEN {z} > 6 THEN 1.0 WHEN {z} < -6 THEN 0.0 ELSE 0.5 + {series} / sqrt(2 * pi()) END"


def _excess(curves: str, hold: str) -> str:
    """x (symbol, n, z) of daily excess returns of two curves; z is null below 30 days or without variance."""
    return f"""
x AS (SELECT c.symbol, c.equity / lag(c.equity) OVER w - h.equity / lag(h.equity) OVER w AS x, least(c.equity, h.equity) AS low FROM {curves} c JOIN {hold} h ON c.symbol = h.symbol AND c.t = h.t WINDOW w AS (PARTITION BY c.symbol ORDER BY c.t)),
y AS (SELECT symbol, count(x) AS n, avg(x) AS m, stddev_samp(x) AS s, min(low) AS low, avg(power(x - a, 3)) / power(stddev_samp(x), 3) AS g, avg(power(x - a, 4)) / power(stddev_samp(x), 4) AS k
      FROM (SELECT *, avg(x) OVER (PARTITION BY symbol) AS a FROM x) GROUP BY symbol),
tested AS (SELECT symbol, n, CASE WHEN n >= 30 AND s > 1e-12 AND low > 0 AND 1 - g * (m / s) + (k - 1) / 4 * (m / s) * (m / s) > 0
                  THEN (m / s) * sqrt(n - 1) / sqrt(1 - g * (m / s) + (k - 1) / 4 * (m / s) * (m / s)) END AS z FROM y)"""


_P = f"WITH {_MOMENTUM},{_HOLD},{_excess('curves', 'hold')} SELECT symbol, n, round(1 - ({_cdf('z')}), 5) AS p FROM tested"


@query("excess_p_values", _P)
def excess_p_values(spark, sf_dir):
    rows = traded(spark, sf_dir)
    return gates.excess_p(bt.account(rows), bt.hold(rows)).withColumn("p", F.round("p", 5))


@query("excess_p_full", _P)
def excess_p_full(spark, sf_dir):
    return excess_p_values(spark, sf_dir)


@query("fdr_gate", """WITH RECURSIVE tests AS (
  SELECT event_type || (user_id % 16) AS stream, CAST(event_id AS INTEGER) AS test_index, 'h' || event_id AS config_hash,
         fmod(value * 7, 1.0) * CASE WHEN event_id % 9 = 0 THEN 0.0001 ELSE 1.0 END AS p_value, row_number() OVER (PARTITION BY event_type || (user_id % 16) ORDER BY event_id) AS t FROM events),
run AS (
  SELECT stream, 0::BIGINT AS t, []::BIGINT[] AS found, NULL::INTEGER AS test_index, NULL::DOUBLE AS level, NULL::BOOLEAN AS hit FROM (SELECT DISTINCT stream FROM tests)
  UNION ALL
  SELECT stream, t, CASE WHEN p_value <= level THEN list_append(found, t) ELSE found END, test_index, level, p_value <= level FROM (
    SELECT r.stream, x.t, r.found, x.test_index, x.p_value,
           0.025 * 0.07720838 * ln(greatest(x.t, 2)) / (x.t * exp(sqrt(ln(x.t)))) + coalesce(list_sum(list_transform(r.found, lambda k, i: (CASE WHEN i = 1 THEN 0.025 ELSE 0.05 END) * 0.07720838 * ln(greatest(x.t - k, 2)) / ((x.t - k) * exp(sqrt(ln(x.t - k)))))), 0) AS level
    FROM run r JOIN tests x ON x.stream = r.stream AND x.t = r.t + 1))
SELECT stream, test_index, CAST(t AS INTEGER) AS t, round(level, 9) AS alpha_threshold, hit AS discovery FROM run WHERE t > 0""")  # fmt: skip
def fdr_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stream = F.concat("event_type", (F.col("user_id") % 16).cast("string"))
    p = F.pmod(F.col("value") * 7, F.lit(1.0)) * F.when(F.col("event_id") % 9 == 0, 0.0001).otherwise(1.0)
    tests = e.select(stream.alias("stream"), F.col("event_id").cast("int").alias("test_index"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("config_hash"), p.alias("p_value"))
    return gates.gate(tests).select("stream", "test_index", "t", F.round("alpha_threshold", 9).alias("alpha_threshold"), "discovery")


@query("vault_summary", f"""WITH {_MOMENTUM},{_HOLD},
a AS (SELECT * FROM curves WHERE t >= DATE '1999-01-01' UNION ALL SELECT * FROM (SELECT * FROM curves WHERE t < DATE '1999-01-01' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1)),
b AS (SELECT * FROM hold WHERE t >= DATE '1999-01-01' UNION ALL SELECT * FROM (SELECT * FROM hold WHERE t < DATE '1999-01-01' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1)),
{_excess('a', 'b').strip()},
ra AS (SELECT symbol, arg_max(equity, t) / arg_min(equity, t) AS r FROM a GROUP BY symbol), rb AS (SELECT symbol, arg_max(equity, t) / arg_min(equity, t) AS r FROM b GROUP BY symbol),
j AS (SELECT symbol, n, 1 - ({_cdf('z')}) AS p FROM tested)
SELECT symbol, round((ra.r - rb.r) * 100, 4) AS excess_pct, n, round(p, 5) AS p, p < 0.05 AS passed FROM j JOIN ra USING (symbol) JOIN rb USING (symbol)""")  # fmt: skip
def vault_summary(spark, sf_dir):
    rows = traded(spark, sf_dir)
    out = gates.vault_summary(bt.account(rows), bt.hold(rows), F.lit("1999-01-01").cast("date"))
    return out.select("symbol", F.round("excess_pct", 4).alias("excess_pct"), "n", F.round("p", 5).alias("p"), "passed")


@query("verdicts")
def verdicts(spark, sf_dir):
    """Evidence as computed: the batch's overfitting probability, deflated ratios over the trials recorded so far, power at the claimed
    horizon of 5 bars, regimes, the benchmark's own span and the symbol's last stored validation."""
    signs, tried = signalled(spark, sf_dir), stored(_tried(spark, sf_dir), "tried")
    curves, held = stored(bt.account(trimmed(signs)), "curves"), bt.hold(trimmed(signs))
    days = lambda d: d.groupBy(F.col("symbol").alias("key"), F.array("symbol").alias("universe")).agg(F.min("t").alias("first_day"), F.max("t").alias("last_day"))
    out = bt.results(curves).select("symbol", "turnover").join(bt.versus(curves, held), "symbol").withColumnRenamed("excess_pct", "excess_return")
    out = out.join(metrics.deflated(_judged(signs, curves, _ledger(tried))).select("symbol", "dsr"), "symbol")
    out = out.join(metrics.regime_breakdown(curves).groupBy("symbol").agg(F.first("consistent").alias("consistent")), "symbol", "left")
    out = out.join(metrics.decay(signs).select("symbol", F.array_contains("power", 5).alias("has_power")), "symbol", "left")
    out = out.join(metrics.icir(signs, 5).select("symbol", "icir"), "symbol", "left")
    out = out.join(bt.matches(days(curves), days(held)).withColumnRenamed("key", "symbol"), "symbol").crossJoin(_overfitting(curves).select("pbo"))  # one row
    before = tried.withColumn("symbol", F.concat(F.lit("Brand#"), (F.substring("fingerprint", 2, 9).cast("int") % 25 + 1).cast("string")))
    out = out.join(before.groupBy("symbol").agg(F.max("last")["verdict"].alias("previous_verdict")), "symbol", "left")
    out = metrics.failures(out, ["icir"], {"icir": F.when(F.col("icir").isNull(), "no information ratio")}).withColumn("n_failures", F.size("metric_failures"))
    judged = metrics.verdict(metrics.score(out))
    return judged.select("symbol", F.round("score", 4).alias("score"), "verdict", F.array_join("reason_codes", ",").alias("reasons"), metrics.status().alias("status"))


@query("verdict_rules", """WITH e AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 1000 - l_quantity AS excess_return, CASE WHEN l_linenumber <> 2 THEN l_discount - 0.05 END AS excess_sharpe, CASE WHEN l_suppkey % 5 <> 0 THEN l_tax * 10 END AS pbo,
         CASE WHEN l_partkey % 7 <> 0 THEN l_discount END AS dsr, CASE WHEN l_linenumber <> 3 THEN l_quantity > 25 END AS has_power, l_orderkey % 53 = 0 AS benchmark_mismatch, l_returnflag = 'R' AS was_promoted,
         CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS turnover, CASE WHEN l_partkey % 11 <> 0 THEN l_suppkey % 3 <> 0 END AS consistent, l_orderkey % 4 = 0 AS incomplete FROM lineitem),
w AS (SELECT *, excess_return <= 0 AND coalesce(excess_sharpe, 0) <= 0 AS worse,
        list_filter([CASE WHEN pbo IS NOT NULL THEN CASE WHEN pbo < 0.5 THEN 1 - 2 * pbo ELSE 0 END END, CAST(dsr > 0 AS INTEGER), CAST(excess_sharpe > 0 AS INTEGER), CAST(has_power AS INTEGER)], lambda x: x IS NOT NULL) AS parts FROM e),
s AS (SELECT *, CASE WHEN worse OR len(parts) = 0 THEN 0 ELSE 100 * list_avg(parts) END AS score, CASE WHEN worse THEN 'WORSE_THAN_HOLDING' WHEN len(parts) < 4 THEN 'SCORE_PARTIAL_EVIDENCE' ELSE '' END AS why FROM w),
v AS (SELECT id, score, CASE WHEN benchmark_mismatch THEN 'CONTINUE_RESEARCH|BENCHMARK_MISMATCH' WHEN worse AND was_promoted THEN 'RETIRE|WORSE_THAN_HOLDING,RETIRE_FROM_PROMOTE' WHEN worse THEN 'REJECT|WORSE_THAN_HOLDING'
        WHEN turnover = 0 THEN 'DORMANT|NO_TRADES' WHEN pbo > 0.5 THEN 'REJECT|OVERFITTING' WHEN NOT consistent THEN 'REGIME_SPECIALIST|REGIME_INCONSISTENT' WHEN dsr IS NOT NULL AND incomplete THEN 'CONTINUE_RESEARCH|INCOMPLETE_EVIDENCE'
        WHEN dsr IS NOT NULL THEN 'PROMOTE|' WHEN score >= 50 THEN 'PROMISING|' || why ELSE 'CONTINUE_RESEARCH|' || why END AS said FROM s)
SELECT id, round(score, 4) AS score, split_part(said, '|', 1) AS verdict, split_part(said, '|', 2) AS reasons,
       CASE split_part(said, '|', 1) WHEN 'CONTINUE_RESEARCH' THEN 'EXPERIMENTAL' WHEN 'RETIRE' THEN 'RETIRED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'PROMOTE' THEN 'VALIDATED' ELSE split_part(said, '|', 1) END AS status FROM v""")  # fmt: skip
def verdict_rules(spark, sf_dir):
    """The rules over evidence from line items, one row each."""
    r = table(spark, sf_dir, "lineitem")
    evidence = r.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("excess_return"), F.when(F.col("l_linenumber") != 2, F.col("l_discount") - 0.05).alias("excess_sharpe"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_tax") * 10).alias("pbo"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount")).alias("dsr"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") > 25).alias("has_power"),
        (F.col("l_orderkey") % 53 == 0).alias("benchmark_mismatch"), F.when(F.col("l_returnflag") == "R", "PROMOTE").alias("previous_verdict"), F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity")).alias("turnover"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_suppkey") % 3 != 0).alias("consistent"), (F.col("l_orderkey") % 4 == 0).cast("int").alias("n_failures"),
    )
    out = metrics.verdict(metrics.score(evidence))
    return out.select("id", F.round("score", 4).alias("score"), "verdict", F.array_join("reason_codes", ",").alias("reasons"), metrics.status().alias("status"))
