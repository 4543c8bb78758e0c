"""What may be stored, run and tested: option bodies and new snapshots, near-duplicate specs, runs not yet made, refusals, tests made again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates, options, specs
from tidemark.plans.desk import _LEDGER, _ledger
from tidemark.plans.market import _CHAIN, chain
from tidemark.plans.registry import query
from tidemark.plans.rotation import _GRID
from tidemark.sources.experiments import STRATEGIES_SQL, strategies
from tidemark.sources.market import bars, table


# ---------------------------------------------------------------- option chains as they are landed
def bodies(spark, sf_dir):
    """A body for each underlying and session; contracts without trades have no volume in it."""
    one = F.struct("place", "option", "bid", "ask", F.when(F.col("volume") > 10, F.col("volume")).alias("volume"), "open_interest", "iv", "spot")
    rows = chain(spark, sf_dir).groupBy("underlying", "quote_date").agg(F.sort_array(F.collect_list(one)).alias("cs"))  # array_sort compares in an interpreted function
    listed = F.transform("cs", lambda c: F.struct(*[c[n].alias(n) for n in ("option", "bid", "ask", "volume", "open_interest", "iv")]))
    data = F.struct(F.col("cs")[0]["spot"].alias("current_price"), F.date_format("quote_date", "yyyy-MM-dd'T'16:00:00").alias("last_trade_time"), listed.alias("options"))
    return rows.select("underlying", F.to_json(F.struct(F.lit("").alias("timestamp"), data.alias("data"))).alias("body"))


@query("option_contracts", f"""WITH {_CHAIN}
SELECT underlying, quote_date, CAST(row_number() OVER (PARTITION BY underlying, quote_date ORDER BY place) - 1 AS INTEGER) AS place, expiry, is_call, strike,
       CAST(round(bid * 1000000) AS BIGINT) AS bid, CASE WHEN volume > 10 THEN volume ELSE 0 END AS volume, open_interest, iv FROM chain""")  # fmt: skip
def option_contracts(spark, sf_dir):
    out = options.contracts(options.parse_chain(bodies(spark, sf_dir)))
    return out.select("underlying", "quote_date", "place", "expiry", "is_call", "strike", F.round(F.col("bid") * 1000000).cast("long").alias("bid"), "volume", "open_interest", "iv")


_STORED = "2006-01-01"


@query("option_snapshots_new", f"WITH {_CHAIN} SELECT underlying, quote_date, expiry, n_contracts, atm_strike FROM sums WHERE quote_date >= DATE '{_STORED}'")
def option_snapshots_new(spark, sf_dir):
    """Every session comes again; those before a day are stored already."""
    rows = options.per_expiry(options.contracts(chain(spark, sf_dir)))
    return options.new_snapshots(rows.where(F.col("quote_date") < _STORED), rows).select("underlying", "quote_date", "expiry", "n_contracts", "atm_strike")


# ---------------------------------------------------------------- specs before they run
@query("spec_near_duplicates", f"WITH {_GRID} SELECT DISTINCT family, symbol, spec_id FROM near")
def spec_near_duplicates(spark, sf_dir):
    """Points of a grid with a sibling one step away."""
    grid = specs.grid(spark, bars(spark, sf_dir))
    return specs.near_duplicates(grid, grid).select("family", "symbol", "spec_id")


@query("specs_to_run", f"""WITH {_GRID}, keyed AS (SELECT *, sha256('backtest|' || spec_id || '|365') AS key FROM grid)
SELECT family, symbol, spec_id, key FROM keyed WHERE min_bars >= 50""")  # fmt: skip
def specs_to_run(spark, sf_dir):
    """Specs with short windows were run over a year before."""
    grid = specs.grid(spark, bars(spark, sf_dir))
    done = specs.not_run(grid.where("min_bars < 50"), spark.createDataFrame([], "key string"), 365)
    return specs.not_run(grid, done, 365).select("family", "symbol", "spec_id", "key")


# ---------------------------------------------------------------- tests
@query("gate_refusals", f"""WITH {STRATEGIES_SQL}
SELECT id, CASE WHEN status = 'VALIDATED' THEN 'TESTED_BEFORE' WHEN score IS NULL THEN 'NOT_REGISTERED' WHEN id > min(id) OVER (PARTITION BY config_hash, family) THEN 'NEAR_DUPLICATE'
  WHEN family = 'BUILDING' THEN 'NOT_ALIGNED' WHEN id > min(id) OVER (PARTITION BY config_hash) THEN 'NOT_REPRESENTATIVE' END AS refused FROM strategies""")  # fmt: skip
def gate_refusals(spark, sf_dir):
    s = strategies(spark, sf_dir)
    least = lambda *by: s.groupBy(*by).agg(F.min("id").alias("_".join(["least", *by])))
    both = s.join(least("config_hash"), "config_hash").join(least("config_hash", "family"), ["config_hash", "family"])
    candidates = both.select(
        "id", F.col("score").isNotNull().alias("registered"), (F.col("id") > F.col("least_config_hash_family")).alias("near_duplicate"), (F.col("family") != "BUILDING").alias("aligned"),
        (F.col("id") == F.col("least_config_hash")).alias("is_representative"), (F.col("status") == "VALIDATED").alias("tested"),
    )
    return gates.eligibility(candidates).select("id", "refused")


@query("days_needed", """WITH t AS (SELECT o_custkey AS strategy_id, count(*) AS n_trades, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS span_days FROM orders GROUP BY o_custkey)
SELECT strategy_id, n_trades, span_days, CAST(ceil((30 + strategy_id % 400) * span_days / n_trades) AS BIGINT) AS days FROM t""")  # fmt: skip
def days_needed(spark, sf_dir):
    """Days until a strategy has the trades it needs at its pace so far."""
    day = F.to_date("o_orderdate")
    trades = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("strategy_id")).agg(F.count("*").alias("n_trades"), F.date_diff(F.max(day), F.min(day)).cast("long").alias("span_days"))
    return gates.needed_days(trades.withColumn("n_needed", 30 + F.col("strategy_id") % 400)).select("strategy_id", "n_trades", "span_days", F.col("days").cast("long").alias("days"))


def _level(t: str) -> str:
    return f"(0.07720838 * ln(greatest({t}, 2)) / (({t}) * exp(sqrt(ln({t})))))"


@query("regated", f"""WITH RECURSIVE {STRATEGIES_SQL}, {_LEDGER},
promoted AS (SELECT id, config_hash, CAST(substr(config_hash, 2) AS BIGINT) AS k FROM strategies WHERE status IN ('PROMISING', 'VALIDATED')),
known AS (SELECT 'h' || (3 * test_index) AS config_hash, discovery FROM ledger),
todo AS (SELECT *, row_number() OVER (ORDER BY config_hash) AS n FROM (SELECT DISTINCT config_hash, pow(10.0, -(k % 12)) AS p FROM promoted WHERE k % 7 <> 0 AND config_hash NOT IN (SELECT config_hash FROM known))),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, (SELECT count(*) FROM ledger) AS t, (SELECT coalesce(list(test_index ORDER BY test_index), []) FROM ledger WHERE discovery) AS found, CAST(NULL AS VARCHAR) AS config_hash, FALSE AS hit
  UNION ALL
  SELECT n, t, CASE WHEN hit THEN list_append(found, t) ELSE found END, config_hash, hit FROM (
    SELECT d.n, w.t + 1 AS t, w.found, d.config_hash,
           d.p <= 0.025 * {_level('w.t + 1')} + CASE WHEN len(w.found) > 0 THEN 0.025 * {_level('w.t + 1 - w.found[1]')} + 0.05 * coalesce(list_sum(list_transform(w.found[2:], lambda f: {_level('w.t + 1 - f')})), 0) ELSE 0 END AS hit
    FROM walk w JOIN todo d ON d.n = w.n + 1))
SELECT id, CASE WHEN coalesce(o.discovery, w.hit) IS NULL THEN 'UNTESTABLE' WHEN coalesce(o.discovery, w.hit) THEN 'DISCOVERY' ELSE 'FAILED' END AS outcome
FROM promoted p LEFT JOIN known o ON o.config_hash = p.config_hash LEFT JOIN walk w ON w.config_hash = p.config_hash""")  # fmt: skip
def regated(spark, sf_dir):
    """Promoted strategies against the ledger: a test of their hash stands, others are tested once after it."""
    promoted = strategies(spark, sf_dir).where(F.col("status").isin("PROMISING", "VALIDATED")).select("id", "config_hash")
    k = F.substring("config_hash", 2, 20).cast("long")
    p_values = promoted.select("config_hash", F.pow(F.lit(10.0), -(k % 12).cast("double")).alias("p_value")).where(k % 7 != 0).distinct()
    known = _ledger(spark, sf_dir).withColumn("config_hash", F.concat(F.lit("h"), (3 * F.col("test_index")).cast("string")))
    return gates.regate(promoted, known, p_values)
