"""MinHash near-duplicates with tensored banding.

Two small collections of half keys (``halves`` each, of ``rows`` minimum hashes) are computed for each
document; the tables' keys are all pairs of one half from either, so halves**2 tables cost 2 * halves
half keys. Pairs are only formed of half keys that another document shares, so most documents form none.

Documents with equal shingle sets are one node. In each table all nodes are first compared with the least
one, and pairs are confirmed on full sets. Then the nodes of tables that still hold several components are
compared across components, all of them: the tables of one half key are taken together, so that a node is
copied once for each of its half keys and not for each table. Such a pair first meets a bound that cannot
reject a link (bits that differ between two parity sketches are at most the shingles that differ); those
that pass are confirmed on full sets. Groups of more than ``block`` nodes are compared block by block in
separate tasks. Components are the connected ones of confirmed links (alternating stars, checkpointed). A
pair at the bound misses every table once in about 6,000 times (0.85) or 1,400 times (0.8), one 0.05 above
it practically never.

Defined cases: documents without words have an empty set, link with nothing and stay; fewer words than a
shingle make one shingle; a null doc_id takes no part (component null, kept); rows that share a doc_id are
one document, which has the links of all its texts; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import B2, join_small, materialize, mix, partitions, prefix, text_bytes, windows, word_hashes, word_stretches, lean

_U = np.uint64


def _shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row of a batch; A-Z count as a-z."""
    data, offsets = text_bytes(batch.column("text"))
    held: list[np.ndarray] = []  # of a row that comes in stretches
    for a, bounds, _, more in word_stretches(data, offsets, size - 1):
        h, _, _, first = word_hashes(data, bounds, lower=True)
        sums = prefix(h, B2)
        at = np.arange(max(0, len(h) - size + 1))
        g = windows(sums, B2, at, at + size)
        for r in range(len(bounds) - 1):
            x, y = int(first[r]), int(first[r + 1])
            if y - x >= size:
                found = np.unique(g[x : y - size + 1])
            elif y > x and not held:
                found = mix(windows(sums, B2, np.array([x]), np.array([y])) + _U(y - x))
            else:
                found = g[:0]
            if held or more:
                held = [np.union1d(held[0], found)] if held else [found]
                if more:
                    continue
                found, held = held[0], []
            yield a + r, found


def _signer(size: int, halves: int, rows: int, seed: int):
    n = 2 * halves * rows
    rng = np.random.default_rng(seed)
    mult, flip = rng.integers(0, 2**63, n, np.uint64) * _U(2) + _U(1), rng.integers(0, 2**63, n, np.uint64)
    powers = rng.integers(0, 2**63, rows, np.uint64) * _U(2) + _U(1)
    side = np.repeat(np.array([0, 1], np.uint64), halves)
    salt = np.arange(1, 2 * halves + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)

    def sign(s: np.ndarray) -> np.ndarray:
        least = np.full(n, ~_U(0))
        for a in range(0, len(s), 1024):
            np.minimum(least, ((s[a : a + 1024, None] ^ flip) * mult).min(axis=0), out=least)
        keys = mix((least.reshape(2 * halves, rows) * powers).sum(axis=1) + salt)
        return (keys & ~_U(1)) | side  # the last bit tells the collection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            count, whole, keys = [], [], []
            for _, s in _shingle_sets(batch, size):
                count.append(len(s))
                whole.append(_node(s))
                keys.append(sign(s).view(np.int64) if len(s) else none)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(whole, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "keys"])

    return run


#: Bits of a sketch.
BITS = 2048


def _node(s: np.ndarray) -> int:
    """Hash of a set of shingles; 0 for the empty one."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s + _U(1))) + _U(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


def _sketch(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall in each of BITS places."""
    return np.packbits((np.bincount((mix(s + _U(2)) % _U(BITS)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, nodes, held = [], batch.column("node").to_pylist(), 0
            for r, s in _shingle_sets(batch, size):
                if _node(s) == nodes[r]:  # else another text of this doc_id
                    found.append((nodes[r], s.view(np.int64), _sketch(s)))
                    held += len(s)
                if held > 1 << 17:
                    yield _set_rows(found)
                    found, held = [], 0
            yield _set_rows(found)

    return run


def _set_rows(found: list) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(s) for _, s, _ in found)], dtype=np.int32)
    items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s, _ in found)])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.int64()), items, pa.array([b for _, _, b in found], pa.binary())], names=["node", "items", "bits"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= percent * union, on full sets."""
    of = lambda name: sets.select(F.col("node").alias(name), F.col("items").alias(f"{name}s"))
    both = pairs.join(of("x"), "x").join(of("y"), "y")
    common = F.size(F.array_intersect("xs", "ys"))
    return both.where(100 * common >= percent * (F.size("xs") + F.size("ys") - common)).select("x", "y").distinct()


@cache
def _half(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def _across(percent: int, many: int = 1 << 15):
    """Pairs across components within a group (key, i, j) that the bound lets pass; rows come sorted by group."""

    def passed(n: np.ndarray, bits: np.ndarray, component: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = n[p] + n[q]
        ok = (component[p] != component[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
        p, q, total = np.broadcast_to(p, ok.shape)[ok], np.broadcast_to(q, ok.shape)[ok], total[ok]
        keep = np.zeros(len(p), bool)
        for k in range(0, len(p), many):
            differ = np.bitwise_count(bits[p[k : k + many]] ^ bits[q[k : k + many]]).sum(axis=1, dtype=np.int64)
            keep[k : k + many] = (total[k : k + many] - differ) * (100 + percent) >= 2 * percent * total[k : k + many]
        return p[keep], q[keep]

    def pairs_of(part: pa.Table) -> pa.RecordBatch:
        key, i, j, node, component, n, side = (part.column(c).to_numpy() for c in ("key", "i", "j", "node", "component", "n", "side"))
        bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(len(part), BITS // 64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found, waiting, held = [(np.zeros(0, np.int64),) * 2], [], 0
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(part)].tolist()):
            if i[a] == j[a] and b - a <= 64:
                p, q = _half(b - a)
                waiting.append((p + a, q + a))
                held += len(p)
                if held > many:
                    found.append(passed(n, bits, component, *(np.concatenate(x) for x in zip(*waiting))))
                    waiting, held = [], 0
                continue
            # two nodes of the most common component need not be compared
            names, times = np.unique(component[a:b], return_counts=True)
            rest = np.flatnonzero(component[a:b] != names[times.argmax()]) + a
            main = np.flatnonzero(component[a:b] == names[times.argmax()]) + a
            sides = (rest, np.arange(a, b)), (main, rest)
            for left, right in sides if i[a] != j[a] else sides[:1]:
                if i[a] != j[a]:
                    left, right = left[side[left] == 0], right[side[right] == 1]
                step = max(1, many // max(1, len(right)))
                for k in range(0, len(left), step):
                    p, q = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
                    found.append(passed(n, bits, component, p, q))
        if waiting:
            found.append(passed(n, bits, component, *(np.concatenate(x) for x in zip(*waiting))))
        p, q = (node[np.concatenate(x)] for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            same = np.ones(len(held), bool)
            for c in ("key", "i", "j"):
                values = held.column(c).to_numpy()
                same &= values == values[-1:]
            last = int(same.argmax()) if len(held) else 0  # where the last group, which may go on, begins
            if last:
                yield pairs_of(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield pairs_of(held)

    return run


def across_components(groups: DataFrame, sketches: DataFrame, percent: int, block: int) -> DataFrame:
    """Distinct pairs (x, y) across components of groups (key, node, n, component) that may link: all of a group with all."""
    sizes = materialize(groups.groupBy("key").agg((F.ceil(F.count("*") / block)).cast("int").alias("blocks")).where("blocks > 1"), "large")
    dealt = join_small(groups, sizes, "key", "left", F.lit(16).cast("long")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    tiles = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    tiles = tiles.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "n", side)
    placed = tiles.join(sketches, "node").repartition(partitions(groups.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(lean(_across(percent)), "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (x, y) lead to; nodes without edges are left out.

    Large and small stars alternate until nothing changes; each round is written to shared storage.
    """
    now = materialize(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v").distinct(), "stars")
    state = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = new
        near = now.union(now.select("v", "u"))
        # a table of its own, so that adaptive execution can split the neighbours of a node that has very many
        least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-stars")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialize(small.where("u > v").distinct(), "stars")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, halves: int = 20, rows: int | None = None, seed: int = 11, block: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    rows = rows or (6 if percent >= 85 else 5)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(texts.mapInArrow(lean(_signer(size, halves, rows, seed)), "doc_id long, n long, node long, keys array<long>"), "signatures")
    known = signed.where("n > 0 and doc_id is not null")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "keys"), "doc_id").alias("s"))
    nodes = materialize(nodes.select("node", "doc_id", "s.n", "s.keys"), "nodes")

    held = nodes.select("node", F.explode("keys").alias("key"))
    shared = materialize(held.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "halves")
    own = join_small(held, shared, "key", "left_semi", F.lit(16).cast("long")).groupBy("node").agg(F.collect_set("key").alias("keys"))
    side = lambda b: F.filter("keys", lambda k: F.pmod(k, F.lit(2)) == b)
    tensor = own.select("node", F.explode(side(0)).alias("a"), side(1).alias("bs")).select("node", "a", F.explode("bs").alias("b"))
    tensor = materialize(tensor.select("node", "a", F.xxhash64("a", "b").alias("key")), "tables")

    tops = tensor.groupBy("key").agg(F.min("node").alias("top"), F.max("node").alias("last")).where("top < last").drop("last")
    tops = materialize(tops, "tops")
    sizes = nodes.select("node", "n")
    stars = tensor.join(tops, "key").where("node > top").select(F.col("node").alias("x"), F.col("top").alias("y")).distinct()
    stars = materialize(stars, "pairs")
    some = materialize(stars.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node"), "compared")
    sets = join_small(texts, some, "doc_id", "inner", F.lit(24).cast("long")).select("node", "text")
    sets = materialize(sets.mapInArrow(lean(_sets(size)), "node long, items array<long>, bits binary"), "sets")
    if sets.count() > some.count():  # rows that are repeated with their doc_id
        sets = materialize(sets.groupBy("node").agg(F.first("items").alias("items"), F.first("bits").alias("bits")), "sets")
    sized = lambda name: sizes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"))
    close = stars.join(sized("x"), "x").join(sized("y"), "y").where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)").select("x", "y")
    links = materialize(confirmed(close, sets, percent), "links")
    # the texts of one doc_id are one document
    texts_of = known.groupBy("doc_id").agg(F.min("node").alias("y"), F.max("node").alias("z")).where("y < z").select("doc_id", "y")
    twins = known.join(texts_of, "doc_id").where("node > y").select(F.col("node").alias("x"), "y")
    links = materialize(links.union(twins).distinct(), "links")
    found = components(links)

    # tables that still hold several components; those of one half key together
    placed = tensor.join(found, "node", "left").select("key", "a", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key")
    groups = placed.join(split, "key", "left_semi").select(F.col("a").alias("key"), "node", "component").distinct().join(sizes, "node")
    across = across_components(materialize(groups, "groups"), sets.select("node", "bits"), percent, block)
    more = materialize(confirmed(across.join(stars, ["x", "y"], "left_anti"), sets, percent), "links")
    found = components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).union(more))

    placed = nodes.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = placed.join(least, "component").select("node", "component_id")
    out = signed.select("doc_id", "n", "node").join(classes, "node", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)
