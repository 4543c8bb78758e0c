"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, once for each turn that it had grown by. The hash of each
prefix of turns is a running combination of hashes of (place, role, text); a conversation whose whole
hash is the hash of a proper prefix of another, or which equals another of smaller id, is left out by an
anti-join, and the rest are rendered.

Defined cases: turns are ordered by (turn, role, text), null turns first; a turn row that is repeated in
all four columns counts once; a null role is rendered as "unknown", a null text as an empty one; rows
without conv_id belong to no conversation and are dropped; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, place, n, h1, h2): h1 and h2 identify the turns up to this one."""
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    placed = clean.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(W.partitionBy("conv_id"))})
    own = [F.xxhash64(F.lit(k), "place", "role", "text") for k in (1, 2)]
    return placed.withColumns({"h1": F.bit_xor(own[0]).over(so_far), "h2": F.bit_xor(own[1]).over(so_far)})


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no prefix of a longer one, the smallest id of equal ones."""
    hashes = prefix_hashes(turns).select("conv_id", "place", "n", "h1", "h2")
    whole = hashes.where("place = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = hashes.where("place < n").groupBy("h1", "h2").agg(F.max("n").alias("longest"))
    return whole.join(inner, ["h1", "h2"], "left_anti").select("conv_id", "n_equal")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, text) of the maximal conversations."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    rows = prefix_hashes(turns).select("conv_id", "place", line.alias("line"))
    kept = rows.join(maximal(turns), "conv_id")
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first("n_equal").alias("n_equal"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS n_turns,
         list('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10)
              ORDER BY turn NULLS FIRST, role, text) AS lines,
         list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS said
  FROM turns GROUP BY conv_id),
distinct_convs AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_equal, said,
         any_value(lines) AS lines
  FROM convs GROUP BY said),
prefixes AS (
  SELECT DISTINCT said[1:i] AS said FROM distinct_convs, unnest(range(1, n_turns)) AS p(i))
SELECT d.conv_id, d.n_turns, d.n_equal, array_to_string(d.lines, '') AS text
FROM distinct_convs d LEFT JOIN prefixes p ON d.said = p.said
WHERE p.said IS NULL
"""
