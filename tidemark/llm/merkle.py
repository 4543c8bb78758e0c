"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; per lang the leaves, and over all langs the subroots, are the leaves of binary trees. A
node's label is its level and its place in it, so children come before parents. A sweep takes nodes in the
order of labels from a priority queue into which every node has put its digest for its parent, until the root
is met; the reversed sweep takes them in falling order and hands each child its sibling together with all that
its parent was handed: the suffix of its proof.

The queue is external. Labels are dealt out in blocks of 2**``height`` neighbours; within a block the queue is
a heap in one task's memory, and what goes beyond it, the digest of the block's top or the suffix that the top is
handed, is a row of a table in the shared folder, ordered by label for the next round. Rounds grow with the
logarithm of the largest tree, each 2**height times smaller than the one before.

Defined cases: in a tree leaves ascend by doc_id, null first, rows that share a doc_id by their leaf; a null
doc_id is not tampered with; n_chars that is null stays null when tampered with; no rows give no rows; a lone
row's subroot is its leaf and, if there is no other lang, also the root, and its proof is empty; columns other
than the five are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, materialize, partitions
from .ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels within one block: its 1,024 leaves and their proofs are held by one task at a time.
HEIGHT = 10
_LEVEL = 48  # bits of a label that hold the place within a level
_NODE = "tree string, idx long, n long, digest binary"
_HANDED = "subroot binary, root binary, suffix binary"


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row: each field is "-" if null, else its UTF-8 byte count, ":" and its value."""
    shown = [fields[c].cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in shown]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, digest, tampered): tampered is the leaf with n_chars + 1 where 7 divides crc32(doc_id), else null.

    tree is the lang, marked such that a null one sorts first.
    """
    own = {c: F.col(c) for c in FIELDS}
    more = own | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(own).alias("digest"), F.when(hit, leaf(more)).alias("tampered"))


# ---------------------------------------------------------------- the two sweeps within a block
def _joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _levels(n: int, height: int) -> int:
    """Levels above a block of a tree that has n nodes on the block's lowest one."""
    return height if n > 1 << height else max(n - 1, 0).bit_length()


def sweep_up(at: int, digests: list[bytes], levels: int) -> dict[int, bytes]:
    """Digests by label of a block whose lowest nodes are at, at + 1, ...; the top's label is the greatest."""
    known: dict[int, bytes] = {}
    queue = [(at + k, 0, d) for k, d in enumerate(digests)]  # (label, the child's place, digest): in order, so a heap
    while queue:
        label, _, digest = heappop(queue)
        level, place = label >> _LEVEL, label & ((1 << _LEVEL) - 1)
        if level:
            parts = [digest]
            while queue and queue[0][0] == label:
                parts.append(heappop(queue)[2])
            digest = _joined(parts)
        known[label] = digest
        if level < levels:
            heappush(queue, (((level + 1) << _LEVEL) + (place >> 1), place, digest))
    return known


def sweep_down(known: dict[int, bytes], suffix: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, suffix) of the lowest nodes, given what the top was handed.

    A suffix is a run of steps towards the root: R or L and the sibling on that side, or - where there is none.
    """
    queue = [(-max(known), suffix)]
    mask = (1 << _LEVEL) - 1
    while queue:
        label, suffix = heappop(queue)
        level, place = -label >> _LEVEL, -label & mask
        if not level:
            yield place, suffix
            continue
        left = ((level - 1) << _LEVEL) + 2 * place
        if left + 1 in known:
            heappush(queue, (-left, b"R" + known[left + 1] + suffix))
            heappush(queue, (-left - 1, b"L" + known[left] + suffix))
        else:
            heappush(queue, (-left, b"-" + suffix))


def steps(suffix: bytes) -> Iterator[tuple[int, bytes]]:
    k = 0
    while k < len(suffix):
        side = suffix[k]
        end = k + 1 if side == ord("-") else k + 33
        yield side, suffix[k + 1 : end]
        k = end


def proof(suffix: bytes) -> str:
    return hashlib.sha256("".join(d.hex() for _, d in steps(suffix)).encode()).hexdigest()


def fold(digest: bytes, suffix: bytes) -> bytes:
    """The root that follows from a leaf and its proof."""
    for side, other in steps(suffix):
        digest = _joined([other, digest] if side == ord("L") else [digest, other] if side == ord("R") else [digest])
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each (tree, block), which lie next to each other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _dealt(rows: DataFrame, height: int) -> DataFrame:
    """Rows in the order of their labels, with the rows of a block in one task; a block has at most 2**height nodes."""
    return rows.withColumn("block", F.shiftright("idx", height)).repartition(partitions(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "kind", "idx")


# ---------------------------------------------------------------- rounds
def rise(nodes: DataFrame, height: int) -> DataFrame:
    """The next round's nodes: the tops of all blocks of (tree, idx, n, digest)."""
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _blocks(batches):
            n = rows[0]["n"]
            known = sweep_up(rows[0]["idx"], [r["digest"] for r in rows], _levels(n, height))
            out.append((rows[0]["tree"], rows[0]["block"], -(-n // (1 << height)), known[max(known)]))
            if len(out) == 4096:
                yield _sent(out, schema)
                out = []
        if out:
            yield _sent(out, schema)

    return _dealt(nodes.select("tree", "idx", "n", "digest", F.lit(1).alias("kind")), height).mapInArrow(up, _NODE)


def fall(nodes: DataFrame, handed: DataFrame, kept: list[str], height: int) -> DataFrame:
    """What each of nodes is handed: (tree, idx, kept, digest, subroot, root, suffix), given what the tops of their blocks were."""
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), *[(c, pa.int64() if c == "doc_id" else pa.binary()) for c in kept], *[(c, pa.binary()) for c in ("digest", "subroot", "root", "suffix")]])
    blank = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in (*kept, "n")]
    own = nodes.select("tree", "idx", *kept, "n", "digest", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), F.lit(1).alias("kind"))
    tops = handed.select("tree", F.shiftleft("idx", height).alias("idx"), *blank, F.col("suffix").alias("digest"), "subroot", "root", F.lit(0).alias("kind"))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (top, *rows) in _blocks(batches):
            first = rows[0]["idx"]
            known = sweep_up(first, [r["digest"] for r in rows], _levels(rows[0]["n"], height))
            given = [(rows[at - first], suffix) for at, suffix in sweep_down(known, top["digest"])]
            yield _sent([(r["tree"], r["idx"], *[r[c] for c in kept], r["digest"], top["subroot"], top["root"], suffix) for r, suffix in given], schema)

    types = ", ".join(["tree string, idx long", *[f"{c} {nodes.schema[c].dataType.simpleString()}" for c in kept], "digest binary", _HANDED])
    return _dealt(own.unionByName(tops), height).mapInArrow(down, types)


def _forest(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The nodes that each round begins with, the last of which are the roots."""
    rounds = [nodes]
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        rounds.append(materialize(rise(rounds[-1], height), name))
        most = -(-most // (1 << height))
    return rounds


def _with_sizes(nodes: DataFrame, name: str) -> DataFrame:
    sizes = materialize(nodes.groupBy("tree").agg(F.count("*").alias("n")), f"{name}-sizes")
    return join_small(nodes, sizes, "tree", "inner", F.octet_length("tree") + F.lit(16))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as lowercase hex."""
    hashed = materialize(leaves(docs), "merkle-hashed")
    level0 = materialize(_with_sizes(ranked(hashed, "tree", ["doc_id", "digest"], "merkle-leaves"), "merkle"), "merkle-level")
    below = _forest(level0, height, "merkle-level")
    subroots = below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    top0 = materialize(_with_sizes(ranked(subroots, "tree", ["lang"], "merkle-langs"), "merkle-langs"), "merkle-top")
    above = _forest(top0, height, "merkle-top")

    none = F.lit(b"")
    handed = above[-1].select("tree", "idx", none.alias("subroot"), F.col("digest").alias("root"), none.alias("suffix"))
    for nodes in above[-2::-1]:
        handed = materialize(fall(nodes, handed, [], height), "merkle-handed")
    lang = top0.select("idx", F.col("lang").alias("own"), F.col("digest").alias("top"))
    first = materialize(handed.join(lang, "idx").select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("top").alias("subroot"), "root", "suffix"), "merkle-handed")
    handed, kept = first, ["doc_id", "tampered"]
    for nodes in below[-2:0:-1]:
        handed = materialize(fall(nodes, handed, [], height), "merkle-handed")
    if len(below) > 1:
        return _checked(fall(level0, handed, kept, height))
    alone = level0.join(handed.drop("idx"), "tree")
    return _checked(alone.select("tree", "idx", *kept, level0["digest"], "subroot", "root", "suffix"))


def _checked(given: DataFrame) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                folded = fold(r["tampered"] or r["digest"], r["suffix"])
                rows.append((r["doc_id"], r["digest"].hex(), r["subroot"].hex(), r["root"].hex(), proof(r["suffix"]), folded.hex(), folded == r["root"]))
            if rows:
                yield _sent(rows, out)

    return given.select("doc_id", "digest", "tampered", "subroot", "root", "suffix").mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
