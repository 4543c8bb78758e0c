"""Point-in-time, quality and option queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import options, pit, quality
from tidemark.plans.registry import query
from tidemark.sources.market import BARS_SQL, MEMBERSHIP_SQL, RAW_BARS_SQL, TICKS_SQL, bars, membership, raw_bars, table

_CUT = "1997-06-15 12:00:00"


@query("as_of_view", f"""WITH {RAW_BARS_SQL}
SELECT symbol, timeframe, available_at, close, volume FROM raw_bars WHERE available_at <= TIMESTAMP '{_CUT}'
QUALIFY row_number() OVER (PARTITION BY symbol, event_time ORDER BY revision DESC) = 1""")  # fmt: skip
def as_of_view(spark, sf_dir):
    return pit.as_of(raw_bars(spark, sf_dir), F.lit(_CUT).cast("timestamp"))


@query("as_of_many", f"""WITH {RAW_BARS_SQL},
cutoffs AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-31', TIMESTAMP '1998-01-31', INTERVAL 31 DAY)) AS at),
latest AS (SELECT * FROM raw_bars QUALIFY row_number() OVER (PARTITION BY symbol, event_time ORDER BY revision DESC) = 1)
SELECT s.symbol, c.at, l.available_at, l.close
FROM (SELECT DISTINCT symbol FROM raw_bars) s CROSS JOIN cutoffs c
ASOF LEFT JOIN latest l ON s.symbol = l.symbol AND c.at >= l.available_at""")  # fmt: skip
def as_of_many(spark, sf_dir):
    cutoffs = spark.sql("select explode(sequence(timestamp'1996-01-31', timestamp'1998-01-31', interval 31 days)) as at")
    return pit.as_of_each(raw_bars(spark, sf_dir), cutoffs)


@query("latest_revisions", f"""WITH {RAW_BARS_SQL}
SELECT symbol, event_time, max(revision) AS revision, arg_max(close, revision) AS close FROM raw_bars GROUP BY symbol, event_time""")  # fmt: skip
def latest_revisions(spark, sf_dir):
    out = pit.latest_per(raw_bars(spark, sf_dir), list(pit.KEY), F.desc("revision"))
    return out.select("symbol", "event_time", F.col("revision").cast("long").alias("revision"), "close")


@query("revision_plan", f"""WITH {RAW_BARS_SQL},
stored AS (SELECT * FROM raw_bars WHERE revision = 1 AND dayofmonth(event_time) > 3),
fetched AS (SELECT * FROM raw_bars QUALIFY row_number() OVER (PARTITION BY symbol, event_time ORDER BY revision DESC) = 1),
closed AS (SELECT *, event_time + INTERVAL 1 DAY + INTERVAL 5 MINUTE AS closes FROM fetched WHERE event_time + INTERVAL 1 DAY + INTERVAL 5 MINUTE <= TIMESTAMP '{_CUT}')
SELECT f.symbol, f.event_time, coalesce(s.revision, 0) + 1 AS revision,
       CASE WHEN s.revision IS NULL THEN closes ELSE greatest(closes, TIMESTAMP '{_CUT}') END AS available_at
FROM closed f LEFT JOIN stored s ON f.symbol = s.symbol AND f.event_time = s.event_time
WHERE s.revision IS NULL OR round(s.close, 8) <> round(f.close, 8) OR round(s.volume, 8) <> round(f.volume, 8)""")  # fmt: skip
def revision_plan(spark, sf_dir):
    raw = raw_bars(spark, sf_dir)
    stored = raw.where((F.col("revision") == 1) & (F.dayofmonth("event_time") > 3))
    fetched = pit.latest_per(raw, list(pit.KEY), F.desc("revision")).drop("revision", "available_at")
    out = pit.plan_writes(fetched, stored, F.lit(_CUT).cast("timestamp"))
    return out.select("symbol", "event_time", F.col("revision").cast("long").alias("revision"), "available_at")


@query("holdout_zones", f"""WITH {RAW_BARS_SQL}
SELECT symbol, CASE WHEN event_time >= TIMESTAMP '2000-01-01' THEN 'holdout' ELSE 'research' END AS zone, count(*) AS n FROM raw_bars GROUP BY ALL""")  # fmt: skip
def holdout_zones(spark, sf_dir):
    return pit.zones(raw_bars(spark, sf_dir), F.lit("2000-01-01").cast("timestamp")).groupBy("symbol", "zone").agg(F.count("*").alias("n"))


@query("membership_as_of", f"""WITH {TICKS_SQL}, {MEMBERSHIP_SQL}
SELECT symbol, asset_class FROM membership WHERE asset_class = 'etf' AND listed_at <= DATE '1996-06-30' AND (delisted_at IS NULL OR delisted_at > DATE '1996-06-30')""")  # fmt: skip
def membership_as_of(spark, sf_dir):
    return pit.members(membership(spark, sf_dir), F.lit("1996-06-30").cast("date"), "etf").select("symbol", "asset_class")


@query("bar_counts", f"WITH {BARS_SQL} SELECT symbol, count(*) AS n_bars FROM bars WHERE t >= DATE '1997-01-01' GROUP BY symbol")
def bar_counts(spark, sf_dir):
    return bars(spark, sf_dir).where("t >= date'1997-01-01'").groupBy("symbol").agg(F.count("*").alias("n_bars"))


@query("data_versions")
def data_versions(spark, sf_dir):
    return pit.version(bars(spark, sf_dir))


def _timed(spark, sf_dir):
    return bars(spark, sf_dir).withColumns({"event_time": F.col("t").cast("timestamp"), "timeframe": F.lit("1d")})


@query("quality_report", f"""WITH {BARS_SQL},
apart AS (SELECT symbol, date_diff('day', lag(t) OVER (PARTITION BY symbol ORDER BY t), t) * 24 AS h FROM bars),
middle AS (SELECT symbol, median(volume) AS m FROM bars GROUP BY symbol),
far AS (SELECT b.symbol, abs(volume - m) AS d FROM bars b JOIN middle USING (symbol)),
mean AS (SELECT symbol, avg(d) AS mad FROM far GROUP BY symbol HAVING avg(d) > 0)
SELECT symbol, 'gap' AS rule, 'issue' AS severity, count(*) AS n FROM apart WHERE h > 100 GROUP BY symbol
UNION ALL SELECT symbol, 'price', 'issue', count(*) FROM bars WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 GROUP BY symbol
UNION ALL SELECT symbol, 'ohlc', 'issue', count(*) FROM bars WHERE high < low OR high < open OR high < close OR low > open OR low > close GROUP BY symbol
UNION ALL SELECT symbol, 'volume_spike', 'warning', count(*) FROM far JOIN mean USING (symbol) WHERE d > 3 * mad GROUP BY symbol
UNION ALL SELECT symbol, 'stale', 'issue', count(*) FROM bars WHERE open = high AND high = low AND low = close GROUP BY symbol HAVING count(*) > 1""")  # fmt: skip
def quality_report(spark, sf_dir):
    return quality.report(_timed(spark, sf_dir), 100, spikes=3.0)


@query("quarantine", f"""WITH {BARS_SQL},
apart AS (SELECT symbol, date_diff('day', lag(t) OVER (PARTITION BY symbol ORDER BY t), t) * 24 AS h FROM bars),
bad AS (SELECT DISTINCT symbol FROM apart WHERE h > 24 * 8)
SELECT symbol, symbol IN (SELECT symbol FROM bad) AS quarantined, count(*) AS n FROM bars GROUP BY symbol""")  # fmt: skip
def quarantine(spark, sf_dir):
    rows = _timed(spark, sf_dir)
    good, bad = quality.route(rows, quality.report(rows, 24 * 8, skip_stale=True))
    return good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True))).groupBy("symbol", "quarantined").agg(F.count("*").alias("n"))


def chain(spark, sf_dir):
    """Contracts made of line items: root by brand, expiry at the end of the next month, side by return flag."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    root = F.upper(F.regexp_replace("p_brand", "#", ""))
    day = F.add_months(F.to_date("l_shipdate"), 120)  # two-digit years are of this century
    expiry = F.last_day(F.date_add(day, 30))
    strike = F.col("l_quantity") * 2
    code = F.concat(root, F.date_format(expiry, "yyMMdd"), F.when(F.col("l_returnflag") == "R", "P").otherwise("C"), F.lpad((strike * 1000).cast("long").cast("string"), 8, "0"))
    return items.select(
        root.alias("underlying"), code.alias("option"), F.last_day(day).alias("quote_date"), F.lit(50.0).alias("spot"), (F.col("l_extendedprice") / 10000).alias("bid"), (F.col("l_extendedprice") / 10000 + 0.1).alias("ask"),
        F.col("l_quantity").alias("volume"), (F.col("l_quantity") * 10).alias("open_interest"), F.col("l_discount").alias("iv"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("place"),
    )


_CHAIN = """chain AS (
  SELECT upper(replace(p_brand, '#', '')) AS underlying, last_day(CAST(l_shipdate AS DATE) + INTERVAL 10 YEAR) AS quote_date,
         last_day(CAST(CAST(l_shipdate AS DATE) + INTERVAL 10 YEAR AS DATE) + 30) AS expiry, l_returnflag <> 'R' AS is_call, l_quantity * 2 AS strike, 50.0 AS spot,
         l_extendedprice / 10000 AS bid, l_extendedprice / 10000 + 0.1 AS ask, l_quantity AS volume, l_quantity * 10 AS open_interest,
         l_discount AS iv, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sums AS (
  SELECT underlying, quote_date, expiry, sum(CASE WHEN is_call THEN volume ELSE 0 END) AS call_volume, sum(CASE WHEN NOT is_call THEN volume ELSE 0 END) AS put_volume,
         sum(CASE WHEN is_call THEN open_interest ELSE 0 END) AS call_oi, sum(CASE WHEN NOT is_call THEN open_interest ELSE 0 END) AS put_oi,
         sum(CASE WHEN is_call THEN volume * (bid + ask) / 2 * 100 ELSE 0 END) AS call_premium, arg_min(strike, (abs(strike - spot), strike)) AS atm_strike, count(*) AS n_contracts
  FROM chain GROUP BY ALL)"""


@query("options_per_expiry", f"""WITH {_CHAIN},
iv AS (SELECT c.underlying, c.quote_date, c.expiry, arg_min(iv, place) FILTER (is_call) AS atm_call_iv, arg_min(iv, place) FILTER (NOT is_call) AS atm_put_iv
       FROM chain c JOIN sums s ON c.underlying = s.underlying AND c.quote_date = s.quote_date AND c.expiry = s.expiry AND c.strike = s.atm_strike WHERE c.iv > 0 GROUP BY ALL)
SELECT s.underlying, s.quote_date, s.expiry, call_volume, put_volume, call_oi, put_oi, CAST(floor(call_premium + 1e-6) AS BIGINT) AS call_premium, atm_strike, n_contracts, atm_call_iv, atm_put_iv
FROM sums s LEFT JOIN iv i ON s.underlying = i.underlying AND s.quote_date = i.quote_date AND s.expiry = i.expiry""")  # fmt: skip
def options_per_expiry(spark, sf_dir):
    return options.per_expiry(options.contracts(chain(spark, sf_dir))).withColumn("call_premium", F.floor(F.col("call_premium") + 1e-6)).drop("put_premium")


@query("options_summary", f"""WITH {_CHAIN},
per_day AS (SELECT underlying, quote_date, sum(call_volume) AS call_volume, sum(put_volume) AS put_volume, sum(call_oi) AS call_oi, sum(put_oi) AS put_oi FROM sums GROUP BY ALL)
SELECT underlying, count(*) AS n_sessions, min(quote_date) AS first_session, max(quote_date) AS last_session,
       arg_max(call_volume, quote_date) AS call_volume, arg_max(put_volume, quote_date) AS put_volume,
       round(arg_max(put_volume, quote_date) / nullif(arg_max(call_volume, quote_date), 0), 6) AS pc_volume FROM per_day GROUP BY underlying""")  # fmt: skip
def options_summary(spark, sf_dir):
    out = options.summary(options.per_expiry(options.contracts(chain(spark, sf_dir))))
    return out.select("underlying", "n_sessions", "first_session", "last_session", "call_volume", "put_volume", F.round("pc_volume", 6).alias("pc_volume"))
