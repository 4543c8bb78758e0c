"""Paper trading, ablation and research papers over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ablation, paper, papers
from tidemark.operators import backtest as bt
from tidemark.plans.backtest import _MOMENTUM, traded
from tidemark.plans.registry import query
from tidemark.sources.market import table

def _whole(x):
    """Whole units: cents end in halves here, which sums in another order round the other way."""
    return F.floor(x + 1e-6)


_FILLS = """fills AS (
  SELECT event_id AS id, user_id AS strategy_id, 'S' || (event_id % 3) AS symbol, CASE WHEN event_type IN ('click', 'signup') THEN 'sell' ELSE 'buy' END AS side,
         value AS price, 1.0 + event_id % 4 AS qty, ts AS filled_at FROM events WHERE event_type <> 'error')"""


def fills(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("strategy_id"), F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("symbol"), F.when(F.col("event_type").isin("click", "signup"), "sell").otherwise("buy").alias("side"), F.col("value").alias("price"), (F.lit(1.0) + F.col("event_id") % 4).alias("qty"), F.col("ts").alias("filled_at"))


_SIGNED = "CASE WHEN side = 'buy' THEN qty ELSE -qty END"


@query("paper_positions", f"WITH {_FILLS} SELECT strategy_id, symbol, sum({_SIGNED}) AS net_qty FROM fills GROUP BY ALL HAVING abs(sum({_SIGNED})) > 1e-8")
def paper_positions(spark, sf_dir):
    return paper.open_positions(fills(spark, sf_dir))


@query("paper_equity", f"""WITH {_FILLS},
run AS (SELECT *, 1000 - sum({_SIGNED} * price + qty * price * 0.001) OVER w AS cash, sum({_SIGNED}) OVER w AS held FROM fills
        WINDOW w AS (PARTITION BY strategy_id ORDER BY filled_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT strategy_id, count(*) AS n, CAST(floor(arg_max(cash + held * price, (filled_at, id)) + 1e-6) AS BIGINT) AS last, CAST(floor(min(cash + held * price) + 1e-6) AS BIGINT) AS least FROM run GROUP BY strategy_id""")  # fmt: skip
def paper_equity(spark, sf_dir):
    out = paper.equity_curve(fills(spark, sf_dir))
    return out.groupBy("strategy_id").agg(F.count("*").alias("n"), _whole(F.max_by("equity", "filled_at")).alias("last"), _whole(F.min("equity")).alias("least"))


_ORDERS = """orders_ AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS strategy_id, l_extendedprice / l_quantity AS expected_price, l_quantity AS expected_qty,
         CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / l_quantity * (1 + l_tax / 100) END AS avg_fill_price,
         CASE WHEN l_linestatus = 'F' THEN 'FILLED' ELSE 'OPEN' END AS status, l_quantity AS filled_qty FROM lineitem),
dev AS (SELECT id, strategy_id, (avg_fill_price - expected_price) / expected_price * 100 AS price_pct FROM orders_ WHERE status = 'FILLED' AND avg_fill_price IS NOT NULL)"""


def _deviations(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    rows = r.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("strategy_id"), px.alias("expected_price"), F.col("l_quantity").alias("expected_qty"),
        F.when(F.col("l_returnflag") != "R", px * (1 + F.col("l_tax") / 100)).alias("avg_fill_price"), F.when(F.col("l_linestatus") == "F", "FILLED").otherwise("OPEN").alias("status"),
        F.col("l_quantity").alias("filled_qty"), F.col("l_shipdate").alias("submitted_at"), (F.col("l_shipdate") + F.expr("interval 3 seconds")).alias("filled_at"),
    )
    return paper.reconcile(rows)


@query("paper_reconciliation", f"WITH {_ORDERS} SELECT strategy_id, count(*) AS n, round(sum(price_pct), 6) AS price_pct, 0.0 AS qty_pct, 3000.0 AS latency_ms FROM dev GROUP BY strategy_id")
def paper_reconciliation(spark, sf_dir):
    return _deviations(spark, sf_dir).groupBy("strategy_id").agg(F.count("*").alias("n"), F.round(F.sum("price_pct"), 6).alias("price_pct"), F.avg("qty_pct").alias("qty_pct"), F.avg("latency_ms").alias("latency_ms"))


@query("paper_divergence", f"""WITH {_ORDERS}, s AS (SELECT strategy_id, count(price_pct) AS n, avg(price_pct) AS mean, stddev_samp(price_pct) AS sd FROM dev GROUP BY strategy_id)
SELECT strategy_id, n, round(mean, 6) AS mean, CASE WHEN n < 2 THEN FALSE WHEN sd = 0 THEN abs(mean - 0.035) > 1e-9 ELSE abs(mean - 0.035) > 1.96 * sd / sqrt(n) END AS material FROM s""")  # fmt: skip
def paper_divergence(spark, sf_dir):
    return paper.divergence(_deviations(spark, sf_dir), 0.035).select("strategy_id", "n", F.round("mean", 6).alias("mean"), "material")


@query("paper_recent", f"WITH {_FILLS} SELECT strategy_id, id FROM fills QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY filled_at DESC, id DESC) <= 3")
def paper_recent(spark, sf_dir):
    return paper.recent(fills(spark, sf_dir).withColumnRenamed("filled_at", "submitted_at"), 3).select("strategy_id", "id")


@query("paper_day_start", f"""WITH {_FILLS},
run AS (SELECT *, 1000 - sum({_SIGNED} * price + qty * price * 0.001) OVER w + sum({_SIGNED}) OVER w * price AS equity FROM fills
        WINDOW w AS (PARTITION BY strategy_id ORDER BY filled_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
days AS (SELECT strategy_id, CAST(filled_at AS DATE) AS day, arg_max(equity, filled_at) AS close FROM run GROUP BY ALL)
SELECT strategy_id, day, CAST(floor(coalesce(lag(close) OVER (PARTITION BY strategy_id ORDER BY day), 1000.0) + 1e-6) AS BIGINT) AS day_start FROM days""")  # fmt: skip
def paper_day_start(spark, sf_dir):
    return paper.day_start(paper.equity_curve(fills(spark, sf_dir))).withColumn("day_start", _whole(F.col("day_start")))


_TRIALS = """trials AS (
  SELECT p_type AS component, 1 AS version, l_extendedprice / 1000 AS enabled_return_pct, l_quantity AS disabled_return_pct,
         CASE WHEN p_type <> 'ECONOMY' OR l_linenumber <> 1 THEN l_discount END AS enabled_sharpe, l_tax AS disabled_sharpe
  FROM lineitem JOIN part ON l_partkey = p_partkey),
used AS (SELECT component, bool_and(enabled_sharpe IS NOT NULL AND disabled_sharpe IS NOT NULL) AS by_sharpe FROM trials GROUP BY component),
d AS (SELECT t.component, by_sharpe, CASE WHEN by_sharpe THEN enabled_sharpe - disabled_sharpe ELSE enabled_return_pct - disabled_return_pct END AS d FROM trials t JOIN used u USING (component))"""


@query("ablation_registry", f"""WITH {_TRIALS},
r AS (SELECT component, any_value(by_sharpe) AS by_sharpe, count(d) AS n, avg(d) AS mean, median(d) AS median, 1.96 * stddev_samp(d) / sqrt(count(d)) AS half FROM d GROUP BY component)
SELECT component, by_sharpe, n, round(mean, 6) AS mean, round(median, 6) AS median, round(mean - half, 6) AS low, round(mean + half, 6) AS high,
       CASE WHEN n < 30 THEN 'UNPROVEN' WHEN mean - half > 0 THEN 'VALUABLE' WHEN mean + half < 0 THEN 'HARMFUL' ELSE 'NEUTRAL' END AS verdict FROM r""")  # fmt: skip
def ablation_registry(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    trials = rows.select(
        F.col("p_type").alias("component"), F.lit(1).alias("version"), (F.col("l_extendedprice") / 1000).alias("enabled_return_pct"), F.col("l_quantity").alias("disabled_return_pct"),
        F.when((F.col("p_type") != "ECONOMY") | (F.col("l_linenumber") != 1), F.col("l_discount")).alias("enabled_sharpe"), F.col("l_tax").alias("disabled_sharpe"),
    )
    out = ablation.verdicts(ablation.registry(trials))
    return out.select("component", "by_sharpe", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "low", "high")], "verdict")


@query("ablation_arms", f"WITH {_MOMENTUM}, ends AS (SELECT symbol, arg_max(equity, t) / 1000 * 100 - 100 AS return_pct, sum(change) AS turnover FROM curves GROUP BY symbol) SELECT arm, symbol, round(return_pct, 4) AS return_pct, turnover FROM ends CROSS JOIN (SELECT unnest(['base', 'placebo']) AS arm)")
def ablation_arms(spark, sf_dir):
    rows = traded(spark, sf_dir).select("symbol", "t", "close", "position")
    return ablation.arms(rows, {"placebo": ablation.placebo}).select("arm", "symbol", F.round("return_pct", 4).alias("return_pct"), "turnover")


@query("ablation_pairs")
def ablation_pairs(spark, sf_dir):
    rows = traded(spark, sf_dir).select("symbol", "t", "close", "position")
    parts = {"invert": lambda d: d.withColumn("position", 1 - F.col("position")), "shift": lambda d: bt.shifted(d)}
    return ablation.arms(rows, ablation.compositions(parts, 2)).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("return_pct"), 4).alias("return_pct"))


# ---------------------------------------------------------------- papers: documents as abstracts, frequent words as concepts
_WORDS = r"""tags AS (
  SELECT DISTINCT doc_id AS claim_id, source AS paper_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS concept FROM documents)"""
_CLAIMS = r"""tags AS (
  SELECT DISTINCT doc_id AS claim_id, source AS paper_id, concept FROM (
    SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS concept FROM documents) WHERE length(concept) BETWEEN 7 AND 9)"""


def words(spark, sf_dir):
    """Every word of a document as a concept of its claim."""
    d = table(spark, sf_dir, "documents")
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return d.select(F.col("doc_id").alias("claim_id"), F.col("source").alias("paper_id"), F.explode(own).alias("concept")).distinct()


def tags(spark, sf_dir):
    """Words of 7 to 9 letters, for links: a link joins claims that share a telling concept."""
    return words(spark, sf_dir).where(F.length("concept").between(7, 9))


@query("papers_relevant", r"SELECT lang, count(*) FILTER (regexp_matches(text, '(?i)\b(?:that|with|from)\b')) AS n_relevant, count(*) AS n FROM documents GROUP BY lang")
def papers_relevant(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(papers.relevant(F.col("text"), ("that", "with", "from"))).alias("n_relevant"), F.count("*").alias("n"))


@query("papers_abstracts", """WITH w AS (SELECT page_id AS id, unnest(string_split(trim(url), '/')) AS word, generate_subscripts(string_split(trim(url), '/'), 1) AS pos FROM pages)
SELECT id, string_agg(word, ' ' ORDER BY pos, word) AS abstract FROM w GROUP BY id""")  # fmt: skip
def papers_abstracts(spark, sf_dir):
    parts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.posexplode(F.split(F.trim("url"), "/")).alias("pos", "word"))
    inverted = parts.groupBy("id", "word").agg(F.collect_list("pos").alias("at")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("inverted"))
    return papers.abstracts(inverted)


@query("papers_titles_match", r"""WITH n AS (SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '([a-z0-9]+)', 1), ' ') AS title FROM part) SELECT title, count(*) AS n FROM n GROUP BY title""")
def papers_titles_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select(papers.normal_title(F.col("p_name")).alias("title")).groupBy("title").agg(F.count("*").alias("n"))


@query("claim_concepts", f"WITH {_WORDS} SELECT concept, count(*) AS n FROM tags GROUP BY concept HAVING count(*) > 3")
def claim_concepts(spark, sf_dir):
    return words(spark, sf_dir).groupBy("concept").agg(F.count("*").alias("n")).where("n > 3")


_LINKS = "links AS (SELECT l_orderkey AS claim_a, l_partkey AS claim_b, CASE WHEN l_returnflag = 'A' THEN 'SUPPORTS' WHEN l_returnflag = 'R' THEN 'CONTRADICTS' ELSE 'EXTENDS' END AS relation FROM lineitem)"


def links(spark, sf_dir):
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_a"), F.col("l_partkey").alias("claim_b"), F.when(f == "A", "SUPPORTS").when(f == "R", "CONTRADICTS").otherwise("EXTENDS").alias("relation"))


@query("links_by_relation", f"WITH {_LINKS} SELECT relation, count(*) AS n FROM links GROUP BY relation")
def links_by_relation(spark, sf_dir):
    return papers.by_relation(links(spark, sf_dir))


@query("claims_untested", f"""WITH {_LINKS},
n AS (SELECT id, count(*) AS supports FROM (SELECT claim_a AS id FROM links WHERE relation = 'SUPPORTS' UNION ALL SELECT claim_b FROM links WHERE relation = 'SUPPORTS') GROUP BY id)
SELECT p_partkey AS id, coalesce(supports, 0) AS supports FROM part LEFT JOIN n ON p_partkey = id
WHERE p_size % 2 = 0 AND p_type IN ('ECONOMY', 'STANDARD') AND p_partkey NOT IN (SELECT o_custkey FROM orders)""")  # fmt: skip
def claims_untested(spark, sf_dir):
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("testable"), F.col("p_brand").alias("family_hint"), F.col("p_type").alias("asset_class"))
    hypotheses = table(spark, sf_dir, "orders").select(F.array("o_custkey").alias("claim_ids"))
    return papers.untested(claims, hypotheses, links(spark, sf_dir), ["ECONOMY", "STANDARD"]).select("id", "supports")
