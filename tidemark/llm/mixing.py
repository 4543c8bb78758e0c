"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt to shards of bounded size by a seeded hash and laid end to end in hash
order; a shard's line of words is cut into blocks of ``block`` words (the last may be shorter). Blocks
are apportioned to sources, and each source's blocks to its shards, by highest quotients
target / (2k + 1). A shard with quota q of its n blocks takes the whole line q // n times and then
q % n consecutive blocks (in a circle) from a seeded start, so that few documents are cut.

Defined cases: null source is a source of its own, behind all others; null text has size 0 and takes
nothing; repeated rows are mixed one by one; no rows give no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, NO_ID, materialize, words_expr

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3


def size_expr(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.size(words_expr(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: all sizes shared by weight, none above most times its size.

    The end of resharing is known in closed form: sources are filled in order of cap / weight, and those
    before the first that can hold its share of the rest are capped. One row per source passes here.
    """
    w = W.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(w) - 1) % len(weights) + 1)
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    return (
        sizes.withColumn("weight", given)
        .withColumn("cap", F.col("source_size") * most)
        .withColumns({"rest": rest, "left": left})
        .withColumn("capped", F.col("cap") * F.col("left") <= F.col("weight") * F.col("rest"))
        # once one source holds its share, so do all after it
        .withColumn("open", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rest"), F.col("left")))).over(W.partitionBy()))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("open.rest").cast("double") / F.col("open.left")))
        .select("source", "source_size", "target")
    )


def apportion(seats: DataFrame, group: list[str], key: list[str], value: str, total: str, limit: str) -> DataFrame:
    """Sainte-Laguë: within each group, give ``total`` blocks to keys by highest quotients value / (2k + 1).

    Every key first gets what it surely has (its share less one, rounded down: the method's divisor lies
    close to value / total); the rest go by rank of the next quotients, of which no key needs more than
    its slack. Keys get no more than ``limit`` blocks.
    """
    g = W.partitionBy(*group)
    share = F.col(value) / F.when(F.sum(value).over(g) > 0, F.sum(value).over(g)).otherwise(1.0) * F.col(total)
    keys = F.count("*").over(g)
    slack = share * keys / (2 * F.greatest(F.col(total), F.lit(1)))
    seen = (
        seats.withColumn("sure", F.least(F.greatest(F.floor(share - slack - 0.5), F.lit(0)), F.col(limit)).cast("long"))
        .withColumn("open", F.least(F.ceil(share + slack + 0.5).cast("long"), F.col(limit)) - F.col("sure"))
        .withColumn("free", F.col(total) - F.sum("sure").over(g))
        .withColumn("k", F.explode_outer(F.when(F.col("open") > 0, F.sequence(F.col("sure"), F.col("sure") + F.col("open") - 1))))
    )
    order = W.partitionBy(*group).orderBy((F.col(value) / (2 * F.col("k") + 1)).desc_nulls_last(), *key, "k")
    won = (F.col("k").isNotNull() & (F.col("rank") <= F.col("free"))).cast("long")
    ranked = seen.withColumn("rank", F.row_number().over(order))
    return ranked.groupBy(*seats.columns, "sure").agg(F.sum(won).alias("more")).select(*seats.columns, (F.col("sure") + F.col("more")).alias("quota"))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, block: int = 32, shard_words: int = 1 << 20, seed: int = 7, carry: bool = False) -> DataFrame:
    """Per row of docs: (doc_id, source, size, source_size, target, taken, whole, first, last, first2, last2).

    ``whole`` full copies are taken, and besides the words [first, last) and [first2, last2) of the text
    (the second only where the circle closes inside one document). carry: also ``row``, all columns of docs.
    """
    # rows without an id are told apart by their text, so that they do not meet in one shard
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))))
    own = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_expr(F.col(text)).alias("size"), mark.alias("mark")]
    rows = materialize(docs.select(*own), "sizes")  # narrow; else each use below would split all texts again
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    sources = materialize(sources, "sources")
    size_of = sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 48).alias("n")).first()["n"] or 0
    few = F.broadcast if size_of <= BROADCAST_BYTES else lambda df: df  # a row for each source
    n_shards = F.ceil(F.col("source_size") / F.lit(shard_words)).cast("long")

    def deal(rows: DataFrame) -> DataFrame:
        known = rows.join(few(sources), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        return known.withColumn("shard", F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.greatest(n_shards, F.lit(1))))

    dealt = deal(rows)
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / F.lit(block)).cast("long"))
    total = F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")
    quotas = shards.groupBy("source").agg(F.first("target").alias("target"), (MOST * F.sum("blocks")).alias("most")).withColumn("total", total)
    quotas = apportion(quotas.withColumn("all", F.lit(0)), ["all"], ["source"], "target", "total", "most").select(F.col("source").alias("of"), F.col("quota").alias("source_quota"))
    shards = shards.join(few(quotas), F.col("source").eqNullSafe(F.col("of"))).withColumn("most", MOST * F.col("blocks"))
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "source_quota", "most")
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "shard", F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long"), F.greatest(F.col("blocks"), F.lit(1)))
    shards = shards.select(
        F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size",
        F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).alias("whole"),
        F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).alias("part"), "blocks", start.alias("from"),
    )
    # a row for each million words; joined by shuffling it would move all texts once more
    shards = materialize(shards, "shards")
    size_of = shards.agg(F.sum(F.coalesce(F.octet_length("s"), F.lit(0)) + 96).alias("n")).first()["n"] or 0
    few = F.broadcast if size_of <= BROADCAST_BYTES else lambda df: df
    line = W.partitionBy("source", "shard").orderBy("mark", F.coalesce("doc_id", F.lit(NO_ID)), "size")
    if carry:
        dealt = deal(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own))
    placed = dealt.withColumn("at", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(few(shards), F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    a = F.col("from") * block
    b = F.least((F.col("from") + F.least(F.col("part"), F.col("blocks") - F.col("from"))) * block, F.col("shard_size"))
    c = F.least(F.greatest(F.col("from") + F.col("part") - F.col("blocks"), F.lit(0)) * block, F.col("shard_size"))
    cut = lambda x: F.least(F.greatest(x - F.col("at"), F.lit(0)), F.col("size"))
    placed = placed.withColumns({"first": cut(a), "last": F.greatest(cut(b), cut(a)), "first2": F.lit(0).cast("long"), "last2": cut(c)})
    taken = F.col("whole") * F.col("size") + F.col("last") - F.col("first") + F.col("last2")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("whole").cast("int").alias("whole"), "first", "last", "first2", "last2", *["row"] * carry)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = 32, seed: int = 7) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each copy or part that the mix takes.

    Whole copies keep their text; parts are the taken words joined by one space. n_chars, where there is
    such a column, is set anew. docs must have doc_id, text and source.
    """
    joined = mix_plan(docs, weights=weights, block=block, seed=seed, carry=True).where("taken > 0").withColumn("text", F.coalesce("row.text", F.lit("")))
    words = words_expr(F.col("text"))
    piece = lambda x, y: F.when((x == 0) & (y == F.col("size")), F.col("text")).otherwise(F.array_join(F.slice(words, (x + 1).cast("int"), (y - x).cast("int")), " "))
    nothing = F.array().cast("array<string>")
    parts = F.concat(
        F.array_repeat(F.col("text"), F.col("whole")),
        F.when(F.col("last") > F.col("first"), F.array(piece(F.col("first"), F.col("last")))).otherwise(nothing),
        F.when(F.col("last2") > 0, F.array(piece(F.lit(0).cast("long"), F.col("last2")))).otherwise(nothing),
    )
    out = joined.withColumn("_part", F.explode(parts))
    cols = {"text": F.col("_part")} | ({"n_chars": F.length("_part").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[cols[c].alias(c) if c in cols else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")
