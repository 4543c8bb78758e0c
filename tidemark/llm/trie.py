"""Prefix trie of conversations by whole-sequence collapse.

Conversations are first rebuilt from the turns of another one and their own. Those that are rebuilt alike are one
weighted sequence with a list of the conversations that end there; prefixes are formed of the distinct sequences
alone. A sequence that is a proper prefix of another is found by an anti-join; the others are the leaves. Nodes are
then sums of weighted prefixes.

A turn is known by role, the text's md5 and place, a prefix by two exclusive ors of hashes of its turns, so no text
is shuffled. What a node's subtree holds follows from sums over the sequences s that pass through it, without a
step from nodes to all their ancestors: with w members, T code points in all and P before the node's last text, the
members' texts from the node on have sum(w T) - n P code points. Distinct nodes are counted once by giving each to
the sequence of its smallest member; the nodes that a sequence has been given are the end of its path, U code points
in all, so the subtree's distinct texts have sum(U) + (T - U of the node's own sequence) - P.

Defined cases: rows without conv_id are dropped; turns are ordered by turn, null first, then role, then md5 of
the text; rows repeated in all columns are turns of their own; null roles and texts are empty; no rows give no
rows, since without members there is no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, materialize, partitions
from .ranks import ranked

#: A conversation is rebuilt from so many turns at most of the one whose id is a multiple of HUNDRED.
HEADS, HUNDRED = 5, 100
#: Turns within one window, and conversations within one part of an end list.
STRETCH, PART = 4096, 512
_KEY = ["h1", "h2", "depth"]


def _joined(rows: DataFrame, small: DataFrame, on: str, how: str) -> DataFrame:
    """A join whose smaller side has rows of 48 bytes at most."""
    return join_small(rows, small, on, how, F.lit(48).cast("long"))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the other: crc32 of its id modulo 6."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEADS + 1)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, said, chars, idx): turns in order, idx from 0."""
    text = F.coalesce("text", F.lit(""))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("said"), F.char_length(text).cast("long").alias("chars")
    )
    return ranked(materialize(narrow, "trie-turns"), "conv_id", ["turn", "role", "said"], "trie-placed").drop("turn")


def _mark(seed: int, depth: Column, turn: Column | None = None) -> Column:
    role, said = (turn["role"], turn["said"]) if turn is not None else (F.col("role"), F.col("said"))
    return F.xxhash64(F.lit(seed), depth.cast("long"), role, said)


def _head_sums(n: Column) -> Column:
    """(h1, h2, chars) over the first n of the column heads."""
    start = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("chars"))

    def add(so_far: Column, turn: Column) -> Column:
        own = [_mark(k, turn["idx"] + 1, turn) for k in (1, 2)]
        return F.struct(so_far["h1"].bitwiseXOR(own[0]).alias("h1"), so_far["h2"].bitwiseXOR(own[1]).alias("h2"), (so_far["chars"] + turn["chars"]).alias("chars"))

    return F.aggregate(F.slice("heads", F.lit(1), n), start, add)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_own, lent, taken, heads), heads being the turns taken, and their own turns behind those:
    (conv_id, part, depth, m1, m2, chars)."""
    head = F.sort_array(F.collect_list(F.when(F.col("idx") < HEADS, F.struct("idx", "role", "said", "chars"))))
    first = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n"), head.alias("head")), "trie-firsts")
    lenders = first.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("lender"), F.col("head").alias("lent_head"))
    h = borrowed(F.col("conv_id"))
    heads = F.coalesce(F.slice("lent_head", F.lit(1), F.col("lent").cast("int")), F.slice("head", 1, 0))
    convs = first.withColumns({"lent": h, "lender": F.col("conv_id") - F.col("conv_id") % HUNDRED}).join(lenders, "lender", "left")
    convs = convs.select("conv_id", F.greatest(F.col("n") - F.col("lent"), F.lit(0)).alias("n_own"), "lent", heads.alias("heads")).withColumn("taken", F.size("heads"))
    convs = materialize(convs, "trie-conversations")
    own = _joined(turns, convs.select("conv_id", "lent", "taken"), "conv_id", "inner").where("idx >= lent")
    depth = F.col("idx") - F.col("lent") + F.col("taken") + 1
    own = own.withColumn("depth", depth).select("conv_id", F.expr(f"idx div {STRETCH}").alias("part"), "depth", _mark(1, F.col("depth")).alias("m1"), _mark(2, F.col("depth")).alias("m2"), "chars")
    return convs, materialize(own, "trie-own")


def collapsed(convs: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, h1, h2, depth) of all conversations as wholes, and the distinct sequences: (seq, h1, h2, depth, w, total)."""
    sums = own.groupBy("conv_id").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.sum("chars").alias("x3"))
    begun = convs.select("conv_id", (F.col("taken") + F.col("n_own")).alias("depth"), _head_sums(F.col("taken")).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    wholes = begun.join(sums, "conv_id", "left").select(
        "conv_id", F.col("s.h1").bitwiseXOR(zero("x1")).alias("h1"), F.col("s.h2").bitwiseXOR(zero("x2")).alias("h2"), "depth", (F.col("s.chars") + zero("x3")).alias("total")
    )
    wholes = materialize(wholes, "trie-wholes")
    sequences = wholes.groupBy(*_KEY).agg(F.min("conv_id").alias("seq"), F.count("*").alias("w"), F.first("total").alias("total"))
    return wholes.drop("total"), materialize(sequences, "trie-sequences")


def prefixes(convs: DataFrame, own: DataFrame, sequences: DataFrame) -> DataFrame:
    """A row for each prefix of each distinct sequence: (seq, depth, h1, h2, p1, p2, chars, before), p of the prefix without
    its last turn, chars of the last turn, before of all before it."""
    seqs = sequences.select(F.col("seq").alias("conv_id"), F.lit(True).alias("some"))
    of = lambda rows: _joined(rows, seqs, "conv_id", "left_semi")
    heads = of(convs).select("conv_id", "taken", "heads")
    n = F.explode(F.sequence(F.lit(0), F.col("taken")))
    led = heads.withColumn("depth", n).withColumns({"s": _head_sums(F.col("depth")), "b": _head_sums(F.greatest(F.col("depth") - 1, F.lit(0)))})
    led = led.select(F.col("conv_id").alias("seq"), F.col("depth").cast("long").alias("depth"), "s.h1", "s.h2", F.col("b.h1").alias("p1"), F.col("b.h2").alias("p2"), (F.col("s.chars") - F.col("b.chars")).alias("chars"), F.col("b.chars").alias("before"))
    # running values within stretches of own turns, then those of the stretches before and of the heads
    so_far = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = of(own).withColumns({"x1": F.bit_xor("m1").over(so_far), "x2": F.bit_xor("m2").over(so_far), "x3": F.sum("chars").over(so_far)})
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = of(own).groupBy("conv_id", "part").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"), F.sum("chars").alias("chars"))
    lead = heads.select("conv_id", _head_sums(F.col("taken")).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    start = parts.join(lead, "conv_id").select(
        "conv_id", "part", F.col("s.h1").bitwiseXOR(zero(F.bit_xor("m1").over(earlier))).alias("s1"), F.col("s.h2").bitwiseXOR(zero(F.bit_xor("m2").over(earlier))).alias("s2"), (F.col("s.chars") + zero(F.sum("chars").over(earlier))).alias("s3")
    )
    h1, h2 = (F.col(f"s{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2))
    mine = run.join(start, ["conv_id", "part"]).select(
        F.col("conv_id").alias("seq"), "depth", h1.alias("h1"), h2.alias("h2"), h1.bitwiseXOR(F.col("m1")).alias("p1"), h2.bitwiseXOR(F.col("m2")).alias("p2"), "chars", (F.col("s3") + F.col("x3") - F.col("chars")).alias("before")
    )
    return materialize(led.unionByName(mine), "trie-prefixes")


def end_hashes(wholes: DataFrame) -> DataFrame:
    """(h1, h2, depth, ends_sha256): hash of the sorted, comma-joined ids of the conversations that end at a node.

    A list is written in parts, in parallel; parts are hashed one after the other as they stream by, never held whole.
    """
    placed = ranked(wholes.withColumn("key", F.concat_ws(",", *_KEY)), "key", ["conv_id"], "trie-ends")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = placed.groupBy(*_KEY, F.expr(f"idx div {PART}").alias("part")).agg(ids.alias("ids"))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["h1"], r["h2"], r["depth"])
                if own != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(r["ids"].encode())
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return parts.repartition(partitions(wholes.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "part").mapInArrow(hashed, "h1 long, h2 long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node."""
    convs, own = rebuilt(turns_of(conversations))
    wholes, sequences = collapsed(convs, own)
    paths = prefixes(convs, own, sequences)

    ends_at = sequences.select("seq", F.col("depth").alias("last"))
    inner = _joined(paths.select("seq", *_KEY), ends_at, "seq", "inner").where("depth < last").select(*_KEY).distinct()
    leaf = sequences.join(materialize(inner, "trie-inner"), _KEY, "left_anti").select("seq", F.lit(1).cast("long").alias("leaf"))

    owned = paths.groupBy(*_KEY).agg(F.min("seq").alias("seq"), F.first("chars").alias("chars")).groupBy("seq").agg(F.sum("chars").alias("u"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    known = sequences.select("seq", "w", "total").join(leaf, "seq", "left").join(owned, "seq", "left")
    known = materialize(known.select("seq", "w", "total", zero("leaf").alias("leaf"), zero("u").alias("u")), "trie-known")

    through = _joined(paths, known, "seq", "inner")
    sums = through.groupBy(*_KEY).agg(
        F.min("seq").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("before").alias("before"), F.sum("w").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("w") * F.col("total")).alias("texts"), F.sum("u").alias("us"), F.min(F.struct("seq", "total", "u")).alias("o"),
    )
    saved = F.col("texts") - F.col("n_convs") * F.col("before") - (F.col("us") - F.col("o.u") + F.col("o.total") - F.col("before"))
    nodes = materialize(sums.select(*_KEY, "conv_id", "p1", "p2", "n_convs", "n_leaves", saved.alias("saved_tokens")), "trie-nodes")

    up = [F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    ends = join_ends(nodes.join(children, _KEY, "left"), end_hashes(wholes))
    # both tables are written, so that adaptive execution can split the children of a node that has very many
    parent = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = materialize(ends, "trie-ended").join(parent, ["p1", "p2", "depth"], "left")
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*[zero(c).alias(c) if c == "n_children" else F.col(c).cast("long").alias(c) for c in numbers], "ends_sha256")


def join_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends, _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
