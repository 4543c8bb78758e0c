"""Nearest neighbours by a block matrix join with int8 tiles.

Candidates are cut into blocks and queries into blocks; each pair of blocks is one tile. Vectors are
quantised to int8 with a scale of their own, and the norm of what that loses is kept. A tile's integer
products give distances between quantised vectors; the true distance lies within the sum of the two
losses of it. A query's k-th smallest upper bound in the tile rules out all candidates with a larger
lower bound; the survivors are recomputed in double precision from the original vectors, and a heap per
query keeps the best k as tiles pass. At last the tiles' lists are merged per query.

The work is that of the stated queries against all rows. Query blocks are copied once for each group of
candidates, candidates once for each block of queries. Products of int8 values are formed in float32, where they are exact for up to 1,040
dimensions; longer vectors go by slices of their dimensions.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller vec_id; rows that repeat a query's vec_id are
the query's own; a repeated candidate row counts each time; a query has fewer than k rows where there
are fewer candidates; no rows give no rows; other columns are not returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions

K = 10
_SLACK = 1e-5


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of what is lost) of the rows of x."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + _SLACK)


def products(a: np.ndarray, b: np.ndarray, wide: int = 1024) -> np.ndarray:
    """Exact integer products of int8 rows, as doubles."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], wide):
        out += a[:, k : k + wide].astype(np.float32) @ b[:, k : k + wide].astype(np.float32).T
    return out


def _norms(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (codes.astype(np.float64) ** 2).sum(axis=1) * scale**2


def search_tile(q_ids, q, c_ids, c, k: int, heaps: list[list], rows: int = 256) -> None:
    """Push each query's nearest of one candidate block on its heap of (-distance, -vec_id)."""
    cc, cs, ce = quantise(c)
    cn = _norms(cc, cs)
    for a in range(0, len(q), rows):
        qc, qs, qe = quantise(q[a : a + rows])
        square = _norms(qc, qs)[:, None] + cn - 2 * products(qc, cc) * qs[:, None] * cs
        near = np.sqrt(np.maximum(square, 0))
        # the difference of squares loses a little where it is small
        margin = qe[:, None] + ce + _SLACK * (near + np.sqrt(_norms(qc, qs))[:, None] * 1e-2)
        upper, lower = near + margin, near - margin
        own = q_ids[a : a + rows, None] == c_ids
        upper[own], lower[own] = np.inf, np.inf
        top = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(qc), np.inf)
        for i in range(len(qc)):
            heap = heaps[a + i]
            bound = min(top[i], -heap[0][0] if len(heap) == k else np.inf)
            at = np.flatnonzero((lower[i] <= bound) & ~own[i])
            if len(at):
                d = np.sqrt(np.add.accumulate((c[at] - q[a + i]) ** 2, axis=1)[:, -1])
                for x in zip((-d).tolist(), (-c_ids[at]).tolist()):
                    if len(heap) < k:
                        heapq.heappush(heap, x)
                    elif x > heap[0]:
                        heapq.heapreplace(heap, x)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _search(d: int, k: int, block: int):
    """Searches tiles one after another; a tile's queries come before its candidates."""

    def lists(q_ids, heaps) -> pa.RecordBatch:
        out = [(int(a), -i, -s) for a, heap in zip(q_ids, heaps) for s, i in heap]
        columns = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, vectors, heaps = None, [], [], []
        for batch in batches:
            of, candidate = np.asarray(batch.column("tile")), np.asarray(batch.column("candidate").cast(pa.int8()))
            cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (candidate[1:] != candidate[:-1])]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(of)]):
                own, v = np.asarray(batch.column("vec_id"))[a:b], _matrix(batch.column("v").slice(a, b - a), d)
                if of[a] != tile:
                    if heaps:
                        yield lists(np.concatenate(ids), heaps)
                    tile, ids, vectors, heaps = of[a], [], [], []
                if not candidate[a]:
                    ids.append(own)
                    vectors.append(v)
                    heaps += [[] for _ in own]
                elif heaps:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for c in range(0, len(own), block):
                        search_tile(ids[0], vectors[0], own[c : c + block], v[c : c + block], k, heaps)
        if heaps:
            yield lists(np.concatenate(ids), heaps)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = 4096, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows of vectors by Euclidean distance.

    vectors and queries have vec_id and embedding.
    """
    spark = vectors.sparkSession
    all_rows, asked = usable(vectors), usable(queries)
    dims = all_rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = dims["d"]
    asked = asked.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = 1 + asked.count() // query_block
    # groups of 1,024 candidates or more, of 16 blocks at most: each gives k rows per query
    n_groups = max(1, min(2 * partitions(spark), dims["count"] // 1024), dims["count"] // (16 * block))
    # a tile is one block of queries against one group of candidates, which streams past it
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = asked.select(part(n_queries, "vec_id").alias("qb"), each(n_groups).alias("cb"), F.lit(False).alias("candidate"), "vec_id", "v")
    c = all_rows.where(F.size("v") == d).select(each(n_queries).alias("qb"), part(n_groups, "vec_id", "v").alias("cb"), F.lit(True).alias("candidate"), "vec_id", "v")
    tiles = q.unionByName(c).withColumn("tile", F.col("qb") * n_groups + F.col("cb"))
    dealt = tiles.repartition(n_groups, "tile").sortWithinPartitions("tile", "candidate")
    lists = dealt.select("tile", "candidate", "vec_id", "v").mapInArrow(_search(d, k, block), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


OP3_SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[2] - z[1]) * (z[2] - z[1])), lambda a, b: a + b)) AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
