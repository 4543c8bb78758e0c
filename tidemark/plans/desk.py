"""Strategy lists, gates, promotions, data windows, paper-trading decisions and rotation grids over the derived tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import gates, paper, pit, rotation, specs, store
from tidemark.plans.backtest import _HOLD, _MOMENTUM, traded
from tidemark.plans.registry import query
from tidemark.plans.research import _FILLS, fills
from tidemark.plans.rotation import shown
from tidemark.sources.experiments import DECISIONS_SQL, RESULTS_SQL, RUNS_SQL, STRATEGIES_SQL, VALIDATIONS_SQL, decisions, results, runs, strategies, validations
from tidemark.sources.market import BARS_SQL, MEMBERSHIP_SQL, RAW_BARS_SQL, TICKS_SQL, bars, membership, raw_bars, table

# ---------------------------------------------------------------- data windows and membership
@query("window_load", f"""WITH {RAW_BARS_SQL}
SELECT symbol, event_time, revision, round(close, 6) AS close FROM raw_bars
WHERE timeframe = '1d' AND event_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND symbol IN (SELECT p_brand FROM part WHERE p_size > 10)""")  # fmt: skip
def window_load(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_brand").alias("symbol"))
    out = pit.window(raw_bars(spark, sf_dir), wanted, "1d", F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))
    return out.select("symbol", "event_time", "revision", F.round("close", 6).alias("close"))


@query("zones_combined", f"""WITH {RAW_BARS_SQL}
SELECT symbol, event_time, revision, round(close, 6) AS close FROM raw_bars QUALIFY row_number() OVER (PARTITION BY symbol, event_time ORDER BY revision DESC) = 1""")  # fmt: skip
def zones_combined(spark, sf_dir):
    parts = pit.zones(raw_bars(spark, sf_dir), F.lit("1997-01-01").cast("timestamp"))
    out = pit.combined(parts.where("zone = 'research'"), parts.where("zone = 'holdout'"))
    return out.select("symbol", "event_time", "revision", F.round("close", 6).alias("close"))


@query("stored_bars", f"""WITH {RAW_BARS_SQL}
SELECT symbol, count(*) AS n FROM raw_bars WHERE revision > 1 GROUP BY symbol""")  # fmt: skip
def stored_bars(spark, sf_dir):
    """All revisions come twice; the first ones are stored already."""
    rows = raw_bars(spark, sf_dir)
    return pit.append_new(rows.where("revision = 1"), rows.unionByName(rows)).groupBy("symbol").agg(F.count("*").alias("n"))


@query("membership_upsert", f"""WITH {TICKS_SQL}, {MEMBERSHIP_SQL},
config AS (SELECT symbol, asset_class, listed_at + 10 AS listed_at, CAST(NULL AS DATE) AS delisted_at FROM membership WHERE asset_class = 'etf' UNION ALL SELECT 'NEW', 'etf', DATE '1999-01-01', NULL)
SELECT coalesce(m.symbol, c.symbol) AS symbol, coalesce(m.asset_class, c.asset_class) AS asset_class, coalesce(c.listed_at, m.listed_at) AS listed_at, coalesce(c.delisted_at, m.delisted_at) AS delisted_at
FROM membership m FULL JOIN config c ON m.symbol = c.symbol AND m.asset_class = c.asset_class""")  # fmt: skip
def membership_upsert(spark, sf_dir):
    old = membership(spark, sf_dir)
    new = old.where("asset_class = 'etf'").select("symbol", "asset_class", F.date_add("listed_at", 10).alias("listed_at"), F.lit(None).cast("date").alias("delisted_at"))
    return pit.upsert_membership(old, new.unionByName(spark.sql("select 'NEW' symbol, 'etf' asset_class, date'1999-01-01' listed_at, cast(null as date) delisted_at")))


@query("membership_windows", f"WITH {TICKS_SQL}, {MEMBERSHIP_SQL} SELECT symbol, listed_at, delisted_at FROM membership WHERE asset_class = 'etf' AND symbol IN (SELECT p_brand FROM part WHERE p_size > 20)")
def membership_windows(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_brand").alias("symbol")).distinct()
    return membership(spark, sf_dir).where("asset_class = 'etf'").join(wanted, "symbol", "left_semi").select("symbol", "listed_at", "delisted_at")


@query("eligible_legs", f"""WITH {TICKS_SQL}, {MEMBERSHIP_SQL},
legs AS (SELECT p_type AS spec_id, p_brand AS symbol, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS pos FROM (SELECT DISTINCT p_type, p_brand FROM part)),
days AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders)
SELECT spec_id, day, symbol, pos FROM legs JOIN membership USING (symbol) CROSS JOIN days WHERE listed_at <= day AND (delisted_at IS NULL OR delisted_at > day)""")  # fmt: skip
def eligible_legs(spark, sf_dir):
    own = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("spec_id")).agg(F.array_sort(F.collect_set("p_brand")).alias("universe"))
    days = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("day")).distinct()
    return pit.eligible(own, days, membership(spark, sf_dir))


@query("enough_history", f"""WITH {BARS_SQL}, n AS (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol),
specs AS (SELECT p_partkey AS spec_id, p_brand AS symbol, p_size * 60 AS min_bars FROM part)
SELECT spec_id, symbol, min_bars FROM specs JOIN n USING (symbol) WHERE n_bars >= min_bars + 1""")  # fmt: skip
def enough_history(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("spec_id"), F.col("p_brand").alias("symbol"), (F.col("p_size") * 60).alias("min_bars"))
    return pit.enough_history(own, bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_bars")))


@query("config_snapshots", """WITH f AS (SELECT DISTINCT lang AS path, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL)
SELECT path, content_hash FROM f EXCEPT SELECT lang, sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL""")  # fmt: skip
def config_snapshots(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("lang").alias("path"), F.col("text").alias("content"))
    stored = files.where("doc_id % 2 = 0").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return pit.new_snapshots(files.drop("doc_id"), stored)


# ---------------------------------------------------------------- strategies, runs and validations
_JUDGED = """judged AS (SELECT fingerprint, verdict, score, pbo, icir FROM validations QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, id DESC) = 1)"""
_RUN = """run AS (SELECT strategy_id, config_hash, label FROM runs QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY created_at DESC, id DESC) = 1)"""


@query("strategy_list", f"""WITH {STRATEGIES_SQL}, {RUNS_SQL}, {VALIDATIONS_SQL}, {_JUDGED}, {_RUN}
SELECT s.id, family, status, label, run.config_hash AS fingerprint, verdict, j.score, pbo FROM (SELECT * FROM strategies ORDER BY created_at DESC, id DESC LIMIT 500) s
LEFT JOIN run ON run.strategy_id = s.id LEFT JOIN judged j ON j.fingerprint = run.config_hash""")  # fmt: skip
def strategy_list(spark, sf_dir):
    return store.strategy_list(strategies(spark, sf_dir), runs(spark, sf_dir), validations(spark, sf_dir))


@query("mutation_labels", f"WITH {RUNS_SQL} SELECT label, count(*) AS n FROM runs GROUP BY label")
def mutation_labels(spark, sf_dir):
    return runs(spark, sf_dir).groupBy(store.mutation_label(F.col("change_set")).alias("label")).agg(F.count("*").alias("n"))


@query("experiment_scatter", f"""WITH {RESULTS_SQL}, {RUNS_SQL}, {STRATEGIES_SQL}, {DECISIONS_SQL},
last AS (SELECT r.config_hash, r.id, r.strategy_id, x.total_return_pct FROM results x JOIN runs r ON x.experiment_id = r.id
         QUALIFY row_number() OVER (PARTITION BY r.config_hash ORDER BY x.created_at DESC, x.id DESC, r.id DESC) = 1)
SELECT l.config_hash, l.id, family, round(total_return_pct, 6) AS total_return_pct, decision FROM last l JOIN strategies s ON s.id = l.strategy_id LEFT JOIN decisions d ON d.experiment_id = l.id""")  # fmt: skip
def experiment_scatter(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("id", F.struct("id", "experiment_id"))
    out = store.scatter(rows, runs(spark, sf_dir), strategies(spark, sf_dir), decisions(spark, sf_dir))
    return out.withColumn("total_return_pct", F.round("total_return_pct", 6))


@query("cluster_members", f"""WITH {RUNS_SQL}, {VALIDATIONS_SQL},
last AS (SELECT fingerprint, cluster, score FROM validations WHERE cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, id DESC) = 1),
one AS (SELECT config_hash, strategy_id FROM runs QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY created_at DESC, id DESC) = 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM last LEFT JOIN one ON fingerprint = config_hash)
SELECT cluster, size, fingerprint, strategy_id, score FROM sized WHERE size > 1""")  # fmt: skip
def cluster_members(spark, sf_dir):
    return store.cluster_view(validations(spark, sf_dir), runs(spark, sf_dir)).select("cluster", "size", F.explode("members").alias("m")).select("cluster", "size", "m.*")


@query("breedable_scores", f"""WITH {STRATEGIES_SQL}, {RUNS_SQL}, {VALIDATIONS_SQL}, {_JUDGED}, {_RUN}
SELECT s.id, run.config_hash, j.score, j.icir FROM strategies s JOIN run ON run.strategy_id = s.id JOIN judged j ON j.fingerprint = run.config_hash
WHERE NOT s.is_canary AND s.status IN ('VALIDATED', 'CHAMPION', 'PROMISING')""")  # fmt: skip
def breedable_scores(spark, sf_dir):
    s = strategies(spark, sf_dir)
    return store.breedable_scores(s, s.where("is_canary").select(F.col("id").alias("strategy_id")), runs(spark, sf_dir), validations(spark, sf_dir))


_CROWNED = "crowned AS (SELECT * REPLACE (CASE WHEN is_champion THEN 'CHAMPION' ELSE status END AS status) FROM strategies)"


def _crowned(spark, sf_dir):
    return strategies(spark, sf_dir).withColumn("status", F.when(F.col("is_champion"), "CHAMPION").otherwise(F.col("status")))


@query("paper_eligible", f"""WITH {STRATEGIES_SQL}, {_CROWNED},
waiting AS (SELECT config_hash FROM crowned WHERE score > 40 EXCEPT SELECT config_hash FROM crowned WHERE status = 'QUARANTINED'),
own AS (SELECT id, family FROM crowned WHERE status = 'PROMISING' AND NOT is_canary AND config_hash IN (SELECT config_hash FROM waiting)
        QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY created_at DESC, id DESC) = 1)
SELECT id, family, 'AWAITING_HOLDOUT' AS label FROM own UNION ALL SELECT id, family, 'CHAMPION' FROM crowned WHERE status = 'CHAMPION'""")  # fmt: skip
def paper_eligible(spark, sf_dir):
    s = _crowned(spark, sf_dir)
    return store.paper_eligible(s.select("config_hash", (F.col("score") > 40).alias("discovery")), s.where("status = 'QUARANTINED'"), s)


@query("champions_to_restore", f"""WITH {STRATEGIES_SQL},
crowned AS (SELECT * REPLACE (CASE WHEN is_champion AND c_nationkey < 2 THEN 'CHAMPION' ELSE status END AS status) FROM strategies),
traded AS (SELECT o_custkey AS id, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey)
SELECT family, id FROM crowned JOIN traded USING (id) WHERE status = 'VALIDATED' AND family NOT IN (SELECT family FROM crowned WHERE status = 'CHAMPION')
QUALIFY row_number() OVER (PARTITION BY family ORDER BY last_at DESC, id DESC) = 1""")  # fmt: skip
def champions_to_restore(spark, sf_dir):
    s = strategies(spark, sf_dir).withColumn("status", F.when(F.col("is_champion") & (F.col("c_nationkey") < 2), "CHAMPION").otherwise(F.col("status")))
    return store.to_restore(s, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("strategy_id"), F.col("o_orderdate").alias("at")))


@query("status_changes", f"""WITH {STRATEGIES_SQL},
asked AS (SELECT id, status, is_canary, ['PROMISING', 'VALIDATED', 'CHAMPION'][c_nationkey % 3 + 1] AS wanted, c_nationkey = 7 AS halted, coalesce(score, 0) > 20 AS discovered, coalesce(score, 0) > 50 AS passed FROM strategies)
SELECT id, CASE WHEN NOT (CASE wanted WHEN 'VALIDATED' THEN 1 WHEN 'CHAMPION' THEN 2 ELSE 0 END > CASE status WHEN 'VALIDATED' THEN 1 ELSE 0 END) THEN NULL
  WHEN is_canary THEN 'CANARY' WHEN halted THEN 'HALTED' WHEN wanted = 'VALIDATED' AND NOT discovered THEN 'NO_DISCOVERY' WHEN NOT passed THEN 'NO_HOLDOUT' END AS refused FROM asked""")  # fmt: skip
def status_changes(spark, sf_dir):
    s = strategies(spark, sf_dir)
    wanted = F.element_at(F.array(F.lit("PROMISING"), F.lit("VALIDATED"), F.lit("CHAMPION")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    score = F.coalesce("score", F.lit(0))
    asked = s.withColumns({"wanted": wanted, "halted": F.col("c_nationkey") == 7, "discovered": score > 20, "holdout_passed": score > 50})
    return store.transitions(asked).select("id", "refused")


@query("holdout_repeats", "SELECT CAST(user_id AS VARCHAR) AS fingerprint, count(*) AS n, min(ts) AS first_at FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING count(*) > 1")
def holdout_repeats(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fingerprint"), (F.col("event_type") != "view").alias("granted"), F.col("ts").alias("accessed_at"))
    return store.repeated_access(log)


@query("month_spend", """WITH c AS (SELECT date_trunc('month', o_orderdate) AS month, sum(CAST(round(o_totalprice * 100) AS BIGINT) * CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) AS cost FROM orders GROUP BY ALL)
SELECT month, cost, CASE WHEN cost >= 2500000000 THEN 'STOP' WHEN cost >= 0.8 * 2500000000 THEN 'ECONOMY' ELSE 'NORMAL' END AS tier FROM c""")  # fmt: skip
def month_spend(spark, sf_dir):
    usage = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderdate").alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("tokens"))
    return store.spend(usage, spark.createDataFrame([("F", 2), ("O", 1)], "model string, per_token long"), 2_500_000_000).withColumn("cost", F.col("cost").cast("long"))


# ---------------------------------------------------------------- gates, canaries, benchmark curves
_LEDGER = """ledger AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS test_index, 0.001 / (1 + o_orderkey % 50) AS alpha_threshold, o_orderkey % 211 = 0 AS discovery FROM (SELECT DISTINCT o_orderkey FROM orders))"""


def _ledger(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return gates.numbered(keys, "o_orderkey").select("test_index", (0.001 / (1 + F.col("o_orderkey") % 50)).alias("alpha_threshold"), (F.col("o_orderkey") % 211 == 0).alias("discovery"))


@query("gate_gauge", f"""WITH {_LEDGER},
n AS (SELECT count(*) AS tests, count(*) FILTER (discovery) AS discoveries, sum(alpha_threshold) AS spent, min(test_index) FILTER (discovery) AS first FROM ledger),
g AS (SELECT tests + 1 - test_index AS t, CASE WHEN test_index = first THEN 0.025 ELSE 0.05 END AS w FROM ledger, n WHERE discovery),
more AS (SELECT coalesce(sum(w * 0.07720838 * ln(greatest(t, 2)) / (t * exp(sqrt(ln(t))))), 0) AS more FROM g)
SELECT tests, discoveries, round(0.025 + 0.05 * discoveries - CASE WHEN discoveries > 0 THEN 0.025 ELSE 0 END - spent, 8) AS wealth,
       round(0.025 * 0.07720838 * ln(greatest(tests + 1, 2)) / ((tests + 1) * exp(sqrt(ln(tests + 1)))) + more, 8) AS next_threshold FROM n, more""")  # fmt: skip
def gate_gauge(spark, sf_dir):
    out = gates.gauge(_ledger(spark, sf_dir))
    return out.select("tests", "discoveries", F.round("wealth", 8).alias("wealth"), F.round("next_threshold", 8).alias("next_threshold"))


@query("canary_statistics", f"""WITH {STRATEGIES_SQL}, c AS (SELECT * FROM strategies WHERE is_canary), b AS (SELECT * FROM c WHERE score > 70)
SELECT (SELECT count(*) FROM c) AS registered, (SELECT count(DISTINCT config_hash) FROM c WHERE score IS NOT NULL) AS evaluated, (SELECT count(DISTINCT config_hash) FROM b) AS breached,
       (SELECT max(id) FROM b) AS last_breach_at, (SELECT arg_max(event_type, event_id) FROM events) AS latest_halt_event,
       (SELECT count(DISTINCT config_hash) FROM b) / (SELECT count(DISTINCT config_hash) FROM c WHERE score IS NOT NULL) AS false_pass_rate""")  # fmt: skip
def canary_statistics(spark, sf_dir):
    c = strategies(spark, sf_dir).where("is_canary")
    halts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("event"))
    return store.canary_statistics(c, c.where("score is not null"), c.where("score > 70").withColumn("created_at", F.col("id")), halts)


_CURVES = """points AS (SELECT o_orderpriority AS universe_key, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS equity, o_orderkey AS created_at FROM orders),
kept AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY universe_key, date ORDER BY created_at % 2 DESC, created_at DESC) = 1)"""


def _upserted(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("universe_key"), F.to_date("o_orderdate").alias("date"), F.round("o_totalprice", 2).alias("equity"), F.col("o_orderkey").alias("created_at"))
    return bt.upserted(points.where("created_at % 2 = 0"), points.where("created_at % 2 = 1"))


@query("benchmark_upsert", f"WITH {_CURVES} SELECT universe_key, date, equity, created_at FROM kept")
def benchmark_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)


@query("benchmark_newest", f"WITH {_CURVES} SELECT universe_key, date, equity FROM kept WHERE universe_key = (SELECT arg_max(universe_key, (created_at, universe_key)) FROM kept WHERE universe_key <> 'LEGACY_MIXED')")
def benchmark_newest(spark, sf_dir):
    return bt.newest_curve(_upserted(spark, sf_dir))


@query("benchmark_matches", f"""WITH {_MOMENTUM}, {_HOLD.strip()},
a AS (SELECT symbol AS key, min(t) AS f, max(t) AS l FROM curves GROUP BY symbol), b AS (SELECT symbol AS key, min(t) AS f, max(t) AS l FROM hold WHERE symbol NOT LIKE '%3' OR t > DATE '1993-06-01' GROUP BY symbol)
SELECT key, coalesce(NOT (a.f = b.f AND a.l = b.l), TRUE) AS benchmark_mismatch FROM a LEFT JOIN b USING (key)""")  # fmt: skip
def benchmark_matches(spark, sf_dir):
    rows = traded(spark, sf_dir)
    days = lambda d: d.groupBy(F.col("symbol").alias("key"), F.array("symbol").alias("universe")).agg(F.min("t").alias("first_day"), F.max("t").alias("last_day"))
    other = bt.hold(rows).where("symbol not like '%3' or t > date'1993-06-01'")
    return bt.matches(days(bt.account(rows)), days(other))


# ---------------------------------------------------------------- paper trading
@query("paper_decisions", f"""WITH {_FILLS},
held AS (SELECT strategy_id, symbol, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS net FROM fills GROUP BY ALL),
targets AS (SELECT strategy_id, symbol, arg_max(id % 5, id) * 1.0 AS target, max(id) AS last_id FROM fills GROUP BY ALL),
d AS (SELECT *, target - coalesce(net, 0) AS delta, substr(sha256(concat_ws('|', strategy_id, symbol, last_id)), 1, 32) AS client_id FROM targets LEFT JOIN held USING (strategy_id, symbol))
SELECT client_id, strategy_id, symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, abs(delta) AS qty FROM d WHERE abs(delta) >= 1e-8""")  # fmt: skip
def paper_decisions(spark, sf_dir):
    f = fills(spark, sf_dir)
    targets = f.select("strategy_id", "symbol", F.col("id").alias("at"), (F.col("id") % 5).cast("double").alias("target_qty"))
    return paper.decide(targets, f, spark.createDataFrame([], "client_id string"))


@query("paper_clamped", """SELECT l_orderkey * 10 + l_linenumber AS id, round(greatest(least(q, cap), -cap), 6) AS qty FROM (
  SELECT *, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END AS q, least(20000 / px, 25.0, 0.3 * 40000 / px) AS cap FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem))""")  # fmt: skip
def paper_clamped(spark, sf_dir):
    px, q = F.col("l_extendedprice") / F.col("l_quantity"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(paper.clamped(q, px, 20_000, 25.0, 0.3, F.lit(40_000.0)), 6).alias("qty"))


@query("paper_fill_prices", f"WITH {_FILLS} SELECT id, round(price * (1 + CASE WHEN side = 'buy' THEN 5 ELSE -5 END / 10000), 6) AS fill_price FROM fills")
def paper_fill_prices(spark, sf_dir):
    return fills(spark, sf_dir).select("id", F.round(paper.fill_price(F.col("side"), F.col("price")), 6).alias("fill_price"))


_LEVELS = "levels AS (SELECT o_custkey AS strategy_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS equity, max(o_totalprice) OVER w AS peak, coalesce(lag(o_totalprice) OVER w, 1000) AS day_start FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_BREACH = "CASE WHEN 1 - equity / peak >= 0.5 THEN 'DRAWDOWN' WHEN 1 - equity / day_start >= 0.2 THEN 'DAILY_LOSS' END"


def _breaches(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("strategy_id"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("equity"),
        F.max("o_totalprice").over(w).alias("peak"), F.coalesce(F.lag("o_totalprice").over(w), F.lit(1000.0)).alias("day_start"),
    )
    return paper.breaches(rows, 0.5, 0.2)


@query("paper_breaches", f"WITH {_LEVELS} SELECT id, {_BREACH} AS breach FROM levels")
def paper_breaches(spark, sf_dir):
    return _breaches(spark, sf_dir).select("id", "breach")


@query("paper_findings", f"WITH {_LEVELS}, f AS (SELECT DISTINCT strategy_id, {_BREACH} AS type, day FROM levels) SELECT strategy_id, type, day FROM f WHERE type IS NOT NULL AND NOT (strategy_id % 2 = 0 AND type = 'DRAWDOWN')")
def paper_findings(spark, sf_dir):
    found = _breaches(spark, sf_dir).where("breach is not null").select("strategy_id", F.col("breach").alias("type"), "day")
    return paper.once_a_day(found, found.where("strategy_id % 2 = 0 and type = 'DRAWDOWN'").distinct())


@query("paper_marks", f"""WITH {BARS_SQL},
marks AS (SELECT p_brand AS symbol, CAST(p_partkey AS DOUBLE) AS close, p_partkey AS seen FROM part WHERE p_brand LIKE '%1'),
a AS (SELECT symbol, arg_max(close, seen) AS close FROM marks GROUP BY symbol), b AS (SELECT symbol, arg_max(close, t) AS close FROM bars GROUP BY symbol)
SELECT symbol, round(coalesce(a.close, b.close), 6) AS close FROM a FULL JOIN b USING (symbol)""")  # fmt: skip
def paper_marks(spark, sf_dir):
    marks = table(spark, sf_dir, "part").where("p_brand like '%1'").select(F.col("p_brand").alias("symbol"), F.timestamp_seconds("p_partkey").alias("at"), F.col("p_partkey").cast("double").alias("close"))
    return paper.latest_marks(marks, bars(spark, sf_dir)).withColumn("close", F.round("close", 6))


@query("paper_versus_holding", f"""WITH {BARS_SQL},
c AS (SELECT l_suppkey AS strategy_id, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / 30) AS equity FROM lineitem GROUP BY ALL),
p AS (SELECT strategy_id, min(day) AS start, arg_max(equity, day) AS paper_final FROM c GROUP BY strategy_id),
w AS (SELECT p.strategy_id, paper_final, b.t, b.close FROM p JOIN bars b ON b.symbol = 'Brand#' || (1 + p.strategy_id % 25) AND b.t >= p.start),
e AS (SELECT strategy_id, any_value(paper_final) AS paper_final, 1000 * (1 - 0.0015) * (arg_max(close, t) / arg_min(close, t)) AS benchmark_final FROM w GROUP BY strategy_id)
SELECT strategy_id, round(paper_final, 4) AS paper_final, round(benchmark_final, 4) AS benchmark_final FROM e WHERE paper_final < benchmark_final""")  # fmt: skip
def paper_versus_holding(spark, sf_dir):
    curve = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("strategy_id"), F.to_date("l_shipdate").alias("filled_at")).agg(F.max(F.col("l_extendedprice") / 30).alias("equity"))
    own = curve.select("strategy_id").distinct().withColumn("symbol", F.concat(F.lit("Brand#"), (1 + F.col("strategy_id") % 25).cast("string")))
    out = paper.worse_than_holding(curve, bars(spark, sf_dir), own)
    return out.select("strategy_id", *[F.round(c, 4).alias(c) for c in ("paper_final", "benchmark_final")])


# ---------------------------------------------------------------- specs
def _places(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_brand")).alias("u")).first()["u"]


@query("rotation_grids", """WITH axes AS (SELECT * FROM (VALUES
  ('EQUAL_WEIGHT_BASELINE', [NULL], [NULL], [NULL]), ('SECTOR_MOMENTUM_ROTATION', [63, 126, 252], [3, 5], [NULL]), ('RELATIVE_STRENGTH_TOP3', [63, 126, 252], [3], [NULL]), ('SECTOR_MEAN_REVERSION', [21, 63], [3, 5], [NULL]),
  ('DUAL_MOMENTUM_GEM', [252], [NULL], [NULL]), ('GTAA_SMA_TIMING', [210], [NULL], [NULL]), ('DEFENSIVE_ASSET_ALLOCATION', [NULL], [1, 2, 6], [NULL]), ('PROTECTIVE_ASSET_ALLOCATION', [210], [1, 6], [0.5, 1.0, 2.0]),
  ('ACCELERATING_DUAL_MOMENTUM', [NULL], [NULL], [NULL]), ('RISK_PARITY_INVERSE_VOL', [63, 126], [NULL], [NULL]), ('MINIMUM_VARIANCE', [63, 126], [NULL], [NULL]), ('FIFTY_TWO_WEEK_HIGH', [252], [3, 5], [NULL]),
  ('RESIDUAL_MOMENTUM', [63, 126, 252], [3], [NULL])) AS v(family, a, b, c)),
x AS (SELECT family, unnest(a) AS lookback, b, c FROM axes), y AS (SELECT family, lookback, unnest(b) AS top, c FROM x)
SELECT family, CAST(lookback AS DOUBLE) AS lookback, CAST(top AS DOUBLE) AS top, CAST(unnest(c) AS DOUBLE) AS protection, 21 AS every, (SELECT count(DISTINCT p_brand) FROM part) AS size FROM y""")  # fmt: skip
def rotation_grids(spark, sf_dir):
    g = specs.rotation_grid(spark, _places(spark, sf_dir))
    return g.select("family", *[F.try_element_at("params", F.lit(k)).alias(k) for k in ("lookback", "top", "protection")], "every", F.size("universe").cast("long").alias("size"))


@query("mechanisms", """WITH h AS (SELECT ['MOMENTUM', 'RSI', 'KELTNER', 'SVM', 'VOL_REGIME_SWITCH'][c_custkey % 5 + 1] AS family, ['TREND', 'MEAN_REVERSION', 'BREAKOUT', 'MACHINE_LEARNING'][c_nationkey % 4 + 1] AS mechanism FROM customer)
SELECT family, mechanism, count(*) FILTER (CASE family WHEN 'MOMENTUM' THEN 'TREND' WHEN 'RSI' THEN 'MEAN_REVERSION' WHEN 'KELTNER' THEN 'BREAKOUT' WHEN 'SVM' THEN 'MACHINE_LEARNING' ELSE 'VOLATILITY_REGIME' END = mechanism) AS n_aligned, count(*) AS n FROM h GROUP BY ALL""")  # fmt: skip
def mechanisms(spark, sf_dir):
    one_of = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    c = table(spark, sf_dir, "customer")
    h = c.select(one_of(("MOMENTUM", "RSI", "KELTNER", "SVM", "VOL_REGIME_SWITCH"), F.col("c_custkey") % 5).alias("family"), one_of(("TREND", "MEAN_REVERSION", "BREAKOUT", "MACHINE_LEARNING"), F.col("c_nationkey") % 4).alias("mechanism"))
    return specs.aligned(h).groupBy("family", "mechanism").agg(F.count_if("mechanism_aligned").alias("n_aligned"), F.count("*").alias("n"))


@query("information_values", """WITH c AS (SELECT c_custkey AS id, ['CHAMPION', 'VALIDATED', 'PROMISING', 'EXPERIMENTAL', 'REGIME_SPECIALIST', 'DORMANT', 'QUARANTINED', 'REJECTED', 'RETIRED'][c_custkey % 10 + 1] AS parent_status, c_nationkey % 2 = 0 AS gap, c_nationkey AS k FROM customer)
SELECT id, round(CASE WHEN parent_status IS NULL THEN 0.5 ELSE 1 - (id % 10) / 8 END + CASE WHEN gap THEN 1 ELSE 0 END - (1 + k % 3), 6) AS value FROM c""")  # fmt: skip
def information_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    status = F.try_element_at(F.array(*map(F.lit, specs.LIFE)), (F.col("c_custkey") % 10 + 1).cast("int"))
    params = F.map_from_entries(F.transform(F.sequence(F.lit(0), (F.col("c_nationkey") % 3).cast("int")), lambda i: F.struct(i.cast("string"), F.lit(1.0))))
    rows = c.select(F.col("c_custkey").alias("id"), status.alias("parent_status"), F.when(F.col("c_nationkey") % 2 == 0, "diversification").otherwise("exploration").alias("mode"), params.alias("params"))
    return specs.information_value(rows).select("id", F.round("value", 6).alias("value"))


@query("spec_swapped")
def spec_swapped(spark, sf_dir):
    """Templates are drawn by the seed of a spec's hash, whose text no other engine prints alike; tests hold the rules."""
    grid = specs.grid(spark, bars(spark, sf_dir))
    templates = grid.groupBy("family").agg(F.min_by("params", "spec_id").alias("params"))
    return specs.swapped(grid, templates).select("parent_id", "spec_id", "family", "symbol", shown().alias("params"))


@query("rotation_dispatch", f"""WITH {BARS_SQL}, {MEMBERSHIP_SQL},
u AS (SELECT *, dense_rank() OVER (ORDER BY symbol) - 1 AS pos FROM bars), size AS (SELECT max(pos) AS last FROM u),
d AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM u)), days AS (SELECT t FROM d WHERE i >= 60 AND (i - 60) % 21 = 0),
m AS (SELECT *, close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY t) - 1 AS score FROM u),
r AS (SELECT m.t, m.symbol, m.pos, m.score FROM m JOIN days USING (t) JOIN membership s ON s.symbol = m.symbol AND s.listed_at <= m.t AND (s.delisted_at IS NULL OR s.delisted_at > m.t)),
g AS (SELECT * FROM r WHERE t IN (SELECT t FROM r WHERE pos = (SELECT last FROM size))),
b AS (SELECT t, arg_max(symbol, (score, -pos)) AS lead, max(score) AS best FROM g WHERE pos < (SELECT last FROM size) AND score IS NOT NULL GROUP BY t)
SELECT t, symbol, 1.0 AS weight FROM g JOIN b USING (t) WHERE CASE WHEN best > 0 THEN symbol = lead ELSE pos = (SELECT last FROM size) END""")  # fmt: skip
def rotation_dispatch(spark, sf_dir):
    own = bars(spark, sf_dir)
    universe = [r["symbol"] for r in own.select("symbol").distinct().orderBy("symbol").collect()]  # a universe is a parameter, tens of symbols
    days = rotation.calendar(own, 60, 21)
    legs = own.select("t", "symbol").join(F.broadcast(days), "t").join(membership(spark, sf_dir), "symbol").where("listed_at <= t and (delisted_at is null or delisted_at > t)")
    return rotation.weights_of("DUAL_MOMENTUM_GEM", {"lookback": 21}, universe, own, days, legs)
