"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents that go on.

The last stage returns packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Parts
and copies that the mix takes of a document share its doc_id.

Defined cases, for every stage: no rows give no rows; further columns pass through the first four stages.
Rows that share a doc_id are one document: near-duplicate removal keeps or drops all of them, and none removes
another's passages. Rows without a doc_id are documents of their own that no stage drops as copies. A null
text counts as an empty one: it is scored, never a duplicate, has no passages, takes no part in the mix (which
counts words) and so is not packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, packing, substring, toxicity
from tidemark.llm.common import join_small, materialize


#: Rows in a batch that a stage hands to Python: texts are some kilobytes, and a batch is held several times.
BATCH_ROWS = 2_000


def _in_small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; each row is scored by its own text."""
    _in_small_batches(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five words and 0.8, the document with the smallest doc_id stays (all rows with that id)."""
    _in_small_batches(spark)
    gone = materialize(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return join_small(docs, gone, "doc_id", "left_anti", F.lit(16).cast("long"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document with a smaller doc_id has go, and documents of which nothing is left."""
    _in_small_batches(spark)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("document")  # may be named like the new columns
    found = substring.remove_repeats(docs.select("doc_id", "text", others)).where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("document.n_chars"))}
    return found.select(*[(new[c] if c in new else F.col(f"document.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and parts of documents such that sources come near their weights."""
    _in_small_batches(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as can be found."""
    _in_small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Boosted trees and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
