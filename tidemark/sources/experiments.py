"""Experiment-store tables derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.market import table


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parent is the order of half its key, where there is one."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").dropDuplicates(["o_orderkey"])
    keys = rows.select(F.col("o_orderkey").alias("k"))
    parent = F.when(F.col("o_orderkey") > 1, F.floor(F.col("o_orderkey") / 2))
    both = rows.withColumn("p", parent).join(keys, F.col("p") == F.col("k"), "left")
    return both.select(F.col("o_orderkey").alias("id"), F.col("k").alias("parent"), F.col("o_orderdate").alias("created_at"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("change_set"))


EXPERIMENTS_SQL = """experiments AS (
  SELECT o.o_orderkey AS id, k.o_orderkey AS parent, o.o_orderdate AS created_at, o.o_orderpriority AS priority
  FROM (SELECT DISTINCT ON (o_orderkey) * FROM orders) o LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) k ON k.o_orderkey = CASE WHEN o.o_orderkey > 1 THEN o.o_orderkey // 2 END)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each line item; returns come from its price and discount."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("experiment_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_shipdate").alias("created_at"),
        (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("total_return_pct"), F.col("l_quantity").alias("benchmark_return_pct"), (F.col("l_discount") * 100).alias("max_drawdown_pct"),
    )


RESULTS_SQL = """results AS (
  SELECT l_orderkey AS experiment_id, (l_linenumber, l_partkey, l_suppkey) AS id, l_shipdate AS created_at,
         l_extendedprice / 1000 - l_quantity AS total_return_pct, l_quantity AS benchmark_return_pct, l_discount * 100 AS max_drawdown_pct
  FROM lineitem),
latest AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY created_at DESC, id DESC) = 1)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"])
    reasons = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "NO_TRADES"), F.when(F.col("o_orderpriority").like("1%"), "WORSE_THAN_HOLDING"), F.when(F.col("o_totalprice") > 300000, "TRANSACTION_COST_FAILURE")))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("experiment_id"), F.when(F.col("o_orderstatus") == "O", "accept").otherwise("reject").alias("decision"), reasons.alias("reason_codes"), (F.col("o_orderdate") + F.expr("make_dt_interval(20)")).alias("created_at"))


DECISIONS_SQL = """decisions AS (
  SELECT DISTINCT ON (o_orderkey) o_orderkey AS experiment_id, CASE WHEN o_orderstatus = 'O' THEN 'accept' ELSE 'reject' END AS decision,
         list_filter([CASE WHEN o_orderstatus = 'F' THEN 'NO_TRADES' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'WORSE_THAN_HOLDING' END,
                      CASE WHEN o_totalprice > 300000 THEN 'TRANSACTION_COST_FAILURE' END], lambda x: x IS NOT NULL) AS reason_codes,
         o_orderdate + INTERVAL 20 DAY AS created_at FROM orders)"""


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    n = F.col("c_custkey") % 5
    status = F.element_at(F.array(*map(F.lit, ("CANDIDATE", "PROMISING", "VALIDATED", "DORMANT", "QUARANTINED"))), (n + 1).cast("int"))
    return rows.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("family"), status.alias("status"), F.when(F.col("c_custkey") % 11 != 0, F.floor(F.col("c_acctbal") / 100)).alias("score"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") / 10000).alias("icir"), (F.col("c_custkey") % 97 == 0).alias("is_champion"), (F.col("c_custkey") % 13 == 0).alias("is_canary"),
        F.concat(F.lit("h"), (F.col("c_custkey") % 400).cast("string")).alias("config_hash"), F.timestamp_seconds(F.col("c_custkey") * 3600).alias("created_at"), "c_acctbal", "c_nationkey",
    )


STRATEGIES_SQL = """strategies AS (
  SELECT c_custkey AS id, c_mktsegment AS family, ['CANDIDATE', 'PROMISING', 'VALIDATED', 'DORMANT', 'QUARANTINED'][c_custkey % 5 + 1] AS status,
         CASE WHEN c_custkey % 11 <> 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS score, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 10000 END AS icir,
         c_custkey % 97 = 0 AS is_champion, c_custkey % 13 = 0 AS is_canary, 'h' || (c_custkey % 400) AS config_hash, c_acctbal, c_nationkey, c_custkey AS created_at
  FROM customer)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a run of its customer's strategy; what was changed comes from its key."""
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    kind = F.when(k == 0, "PARAMETER_TUNE").when(k == 1, "SWAP_FAMILY").when(k == 2, "CROSSOVER").when(k == 3, "LLM_HYPOTHESIS")
    change = F.when(kind.isNotNull(), F.create_map(F.lit("mutation_type"), kind, F.lit("field"), F.lower("o_orderstatus")))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("strategy_id"), F.concat(F.lit("h"), (F.col("o_custkey") % 400).cast("string")).alias("config_hash"), change.alias("change_set"), F.col("o_orderdate").alias("created_at"))


RUNS_SQL = """runs AS (
  SELECT o_orderkey AS id, o_custkey AS strategy_id, 'h' || (o_custkey % 400) AS config_hash, o_orderdate AS created_at,
         CASE o_orderkey % 5 WHEN 0 THEN 'tune ' || lower(o_orderstatus) WHEN 1 THEN 'swap family' WHEN 2 THEN 'crossover' WHEN 3 THEN 'LLM hypothesis' END AS label FROM orders)"""


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation for each line item: its order's customer is the fingerprint."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("h"), (F.col("o_custkey") % 400).cast("string")).alias("fingerprint"), F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("PROMISING").alias("verdict"),
        (F.col("l_quantity") * 2).alias("score"), (F.col("l_discount") * 8).alias("pbo"), F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("icir")).alias("metrics"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"))).alias("cluster"), F.col("l_shipdate").alias("created_at"),
    )


VALIDATIONS_SQL = """validations AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, 'h' || (o_custkey % 400) AS fingerprint, CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'PROMISING' END AS verdict, l_quantity * 2 AS score,
         l_discount * 8 AS pbo, CASE WHEN l_linenumber <> 3 THEN l_tax END AS icir, CASE WHEN o_custkey % 3 <> 0 THEN 'c' || (o_custkey % 40) END AS cluster, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
