"""Places of rows within groups of any size, without one task taking a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize, partitions


def runs_of(key: pa.Array) -> np.ndarray:
    """Where runs of equal neighbours begin in an array without nulls."""
    if isinstance(key, pa.ChunkedArray):
        key = key.combine_chunks()
    if not len(key):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))])


def _numbered(key: str):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            start = runs_of(keys)
            size = np.diff(start, append=len(keys))
            at = np.arange(len(keys)) - np.repeat(start, size)
            if keys[0].as_py() == last:
                at[: size[0]] += seen
            last, seen = keys[-1].as_py(), int(at[-1]) + 1
            extra = [pa.array(np.full(len(keys), task, np.int32)), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "_part", "_at"])

    return number


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with idx, the place of each among the rows of its key (not null) in the given order, from 0.

    Rows are sorted by (key, order) over all tasks and counted within each. A key that goes on in later tasks
    needs how many of its rows came before: one number a task, whatever the number of keys. Rows that agree in
    everything are told apart by where they are read, so that copies do not meet in one task either.
    """
    spark = rows.sparkSession
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [key, *order, "_tie"]
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])
    dealt = told.repartitionByRange(2 * partitions(spark), *by).sortWithinPartitions(*by).drop("_tie")
    placed = materialize(dealt.mapInArrow(_numbered(key), schema), name)
    ends = placed.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key, "_at")).alias("last")).orderBy("_part").collect()  # a row for each task
    before, seen, running = [], 0, None
    for e in ends:
        before.append((e["_part"], e["first"], seen if e["first"] == running else 0))
        alone = e["first"] == e["last"][key] == running
        running, seen = e["last"][key], e["last"]["_at"] + 1 + (seen if alone else 0)
    known = spark.createDataFrame(before, StructType([StructField("_part", IntegerType()), StructField("_first", rows.schema[key].dataType), StructField("_before", LongType())]))
    joined = placed.join(F.broadcast(known), "_part")  # as many rows as tasks
    idx = F.col("_at") + F.when(F.col(key) == F.col("_first"), F.col("_before")).otherwise(F.lit(0))
    return joined.select(*rows.columns, idx.alias("idx"))
