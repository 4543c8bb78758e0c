"""Suffix-array dedup of bytes: a prefix-free parse, and shard transforms of its dictionary merged by interleave refinement.

Each document is parsed at anchors: of every ``length`` consecutive bytes, the place of the 64-byte gram
with the least hash. The choice depends on those bytes alone, so equal strings of ``length`` bytes have
equal anchors at equal places. A phrase is the stretch of bytes that holds all windows (strings of
``length`` bytes) of one anchor; neighbouring phrases overlap, as in a prefix-free parse, so every window
lies in one phrase. The parse is some 140 times shorter than the bytes.

1. Phrases are counted. All windows of a phrase that stands in several places are repeated. A phrase that
   shares no anchor gram with a different one has no other repeats. What is left is the dictionary: one
   copy of each distinct phrase, with its count, of symbols (anchor grams) that have several.
2. Suffixes of the dictionary are sorted to depth ``length``, a task's symbols at a time. Each shard (some
   phrases) has its suffixes in order of their first 8 bytes. Shards are merged by iterative interleave
   refinement: their orders are merged, then within each block of still equal suffixes the interleave is
   refined by the blocks of the suffixes half a depth further on (depths 16, 32, ..., 256, ``length``).
   A suffix alone in its block is never touched again, and no depth compares bytes anew.
3. The blocks at the last depth are the repeated intervals with a common prefix of ``length`` bytes: their
   windows are repeated if the counts of their phrases sum to more than one.

A symbol with more than ``most`` distinct phrases would not fit a task. Its phrases are halved by where the
anchor stands in their windows, which gives every half a longer symbol, and counted again, until all symbols
fit; a half with one window left is a symbol of ``length`` bytes, so this ends after nine rounds. Whole copies
of a text are settled first: all their bytes are repeated, and one stands for them.

Defined cases: a null text is an empty one; texts shorter than ``length`` keep everything; repeated rows
are copies of each other, whatever their doc_ids; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import B1, B2, B3, join_small, materialize, mix, owners, partitions, prefix, stretches, text_bytes, text_chunks, windows
from .substring import KEY, bytes_of, keyed, unpacked

LENGTH = 400
GRAM = 64
_U = np.uint64


class _Slice:
    """Byte windows of some consecutive rows: p, the places where one starts, and own, their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.data, self.first = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        sizes = np.diff(self.first)
        fit = np.flatnonzero(sizes >= length)
        n = len(self.data)
        sums = prefix(self.data.astype(np.uint64) + _U(1), B1)
        at = np.arange(max(0, n - gram + 1))
        self.gram = windows(sums, B1, at, at + gram)
        own = owners(self.gram, length - gram + 1)
        many = sizes[fit] - length + 1
        self.row = np.repeat(fit, many)
        self.p = np.repeat(self.first[fit] - np.cumsum(many) + many, many) + np.arange(many.sum())
        self.own = own[self.p]


def _parse(length: int, gram: int):
    """Phrases: (sym, c1, c2, doc, rk, lo, hi, at); their windows start at lo, ..., hi, c1 and c2 identify their bytes, the anchor stands at lo + at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc, rk = (np.asarray(batch.column(c)) for c in KEY)
            for a, bounds, base in stretches(offsets, length - 1):
                s = _Slice(data, bounds, length, gram)
                new = np.ones(len(s.own), bool)
                new[1:] = (s.own[1:] != s.own[:-1]) | (s.row[1:] != s.row[:-1])
                at = np.flatnonzero(new)
                lo, hi = s.p[at], s.p[np.r_[at[1:], len(s.own)] - 1] if len(at) else s.p[at]
                r, sym = s.row[at], s.gram[s.own[at]]
                whole = [windows(prefix(s.data.astype(np.uint64) + _U(1), key), key, lo, hi + length) ^ (hi - lo).astype(np.uint64) for key in (B2, B3)]
                columns = [sym.view(np.int64), *(x.view(np.int64) for x in whole), doc[a + r], rk[a + r], (lo - s.first[r] + base).astype(np.int32), (hi - s.first[r] + base).astype(np.int32), (s.own[at] - lo).astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["sym", "c1", "c2", *KEY, "lo", "hi", "at"])

    return run


def _phrase_bytes(length: int):
    """(sym, n, doc, rk, lo, at, ctx) of the phrases listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                data, offsets = text_bytes(part.column("text"))
                held = part.column("phrases")
                flat = held.flatten()
                lo, hi = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "hi"))
                row = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(held)))
                start = offsets[row] + lo
                sizes = hi - lo + length
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(0, len(row), 2000):
                    m = slice(k, k + 2000)
                    n = sizes[m]
                    took = data[np.repeat(start[m] - (ends[:-1][m] - ends[k]), n) + np.arange(n.sum())]
                    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    ctx = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(took)])
                    at = pa.array(row[m])
                    yield pa.RecordBatch.from_arrays([flat.field("sym").slice(k, len(n)), flat.field("n").slice(k, len(n)), *(part.column(c).take(at) for c in KEY), flat.field("lo").slice(k, len(n)), flat.field("at").slice(k, len(n)), ctx], names=["sym", "n", *KEY, "lo", "at", "ctx"])

    return run


# ---------------------------------------------------------------- transforms and their merge
def first_keys(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number that sorts like them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << _U(8)) | padded[k : k + len(data)]
    return out


def shard_transform(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A shard's suffixes (at) in order of their first 8 bytes."""
    return at[np.argsort(keys[at], kind="stable")]


def merge_transforms(data: np.ndarray, ends: np.ndarray, length: int, shard_bytes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of all suffixes with length bytes, sorted to that depth, and the block of equal ones that each is in.

    ends: where each phrase ends within data. A shard is some phrases of about shard_bytes.
    """
    size = np.diff(ends, prepend=0)
    left = np.repeat(ends, size) - np.arange(len(data))  # bytes from a place to its phrase's end
    keys = first_keys(data)
    cuts = np.unique(np.r_[0, ends[np.searchsorted(ends, np.arange(shard_bytes, len(data), shard_bytes))], len(data)])
    shards = [shard_transform(keys, x + np.flatnonzero(left[x:y] >= 8)) for x, y in zip(cuts[:-1], cuts[1:])]
    order = np.concatenate(shards) if shards else np.zeros(0, np.int64)
    order = order[np.argsort(keys[order], kind="stable")]  # runs that are sorted already are merged
    of = keys[order]
    block = np.cumsum(np.r_[False, of[1:] != of[:-1]]) if len(of) else order
    rank = np.zeros(len(data), np.int64)
    rank[order] = block
    depth = 8
    while depth < length:
        deeper = min(2 * depth, length)
        stay = left[order] >= deeper
        order, block = order[stay], block[stay]
        further = rank[order + deeper - depth]
        alone = np.ones(len(order) + 1, bool)
        alone[1:-1] = block[1:] != block[:-1]
        active = np.flatnonzero(~(alone[:-1] & alone[1:]))
        key = (block[active] << 32) | further[active]
        move = np.argsort(key, kind="stable")
        order[active], key = order[active[move]], key[move]
        split = alone[:-1].copy()
        if len(active):
            split[active[1:]] |= key[1:] != key[:-1]
        block = np.cumsum(split) - 1 if len(order) else block
        rank[order] = block
        depth = deeper
    return order, block


def _merge(length: int, most_bytes: int = 1 << 20):
    """Runs that repeated intervals cover in phrases that stand once; rows come sorted by symbol."""

    def spans_of(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        data, offsets = text_bytes(part.column("ctx").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        data, ends = data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
        n, lo = part.column("n").to_numpy(), part.column("lo").to_numpy().astype(np.int64)
        doc, rk = (part.column(c).to_numpy() for c in KEY)
        order, block = merge_transforms(data, ends, length)
        own = np.searchsorted(ends, order, "right")
        times = np.bincount(block, n[own], minlength=1)
        hit = (times[block] > 1) & (n[own] == 1)
        p = np.sort(order[hit])
        own = np.searchsorted(ends, p, "right")
        p = p - (ends - np.diff(ends, prepend=0))[own] + lo[own]
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (np.diff(p) > length)]) if len(p) else own
        k, last = own[cut], np.r_[cut[1:], len(p)][: len(cut)] - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(rk[k]), pa.array(p[cut].astype(np.int32)), pa.array((p[last] + length).astype(np.int32))], names=[*KEY, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # whole symbols of about most_bytes are merged at a time; the batch's last symbol may go on in the next
            sym = np.asarray(batch.column("sym"))
            size = np.cumsum(np.asarray(pc.binary_length(batch.column("ctx"))).astype(np.int64))
            heads = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]]) if len(sym) else np.zeros(0, np.int64)
            if held and len(sym) and held[-1].column("sym")[-1].as_py() != int(sym[0]):
                yield spans_of(pa.Table.from_batches(held))
                held = []
            start = 0
            for head in heads.tolist():
                if head > start and size[head - 1] - (size[start - 1] if start else 0) > most_bytes:
                    yield spans_of(pa.Table.from_batches([*held, batch.slice(start, head - start)]))
                    held, start = [], head
            if len(sym) and heads[-1] > start:
                yield spans_of(pa.Table.from_batches([*held, batch.slice(start, heads[-1] - start)]))
                held, start = [], int(heads[-1])
            if start < len(sym):
                held.append(batch.slice(start))
        if held:
            yield spans_of(pa.Table.from_batches(held))

    return run


# ---------------------------------------------------------------- symbols with very many phrases
_PIECE = "sym long, c1 long, c2 long, n int, doc long, rk long, lo int, at int, d0 int, d1 int, ctx binary"


def _halved(length: int):
    """Each phrase as two, with the windows whose anchor stands in either half of [d0, d1) from their start.

    All windows of a half hold the same stretch around the anchor; its hash is the new symbol, so windows that
    are equal stay together and phrases that differ there part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                data, offsets = text_bytes(part.column("ctx").cast(pa.large_binary()).view(pa.large_string()))
                data, first = data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]
                many = np.diff(offsets) - length + 1
                at, d0, d1, lo = (np.asarray(part.column(c)).astype(np.int64) for c in ("at", "d0", "d1", "lo"))
                values = data.astype(np.uint64) + _U(1)
                sums = [prefix(values, base) for base in (B1, B2, B3)]
                middle = (d0 + d1) // 2
                for x, y in ((d0, middle), (middle, d1)):
                    s0, s1 = np.maximum(0, at - y + 1), np.minimum(many - 1, at - x)
                    r = np.flatnonzero((s0 <= s1) & (x < y))
                    s0, s1, own = s0[r], s1[r], first[r]
                    sym = windows(sums[0], B1, own + at[r] - x[r], own + at[r] - y[r] + 1 + length) ^ mix(x[r].astype(np.uint64))
                    whole = [windows(h, base, own + s0, own + s1 + length) ^ mix((at[r] - s0).astype(np.uint64)) for h, base in zip(sums[1:], (B2, B3))]
                    n = s1 - s0 + length
                    bounds = np.concatenate([[0], np.cumsum(n)])
                    took = data[np.repeat(own + s0 - bounds[:-1], n) + np.arange(bounds[-1])]
                    ctx = pa.BinaryArray.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(took)])
                    rest = [part.column(c).take(pa.array(r)) for c in ("n", *KEY)]
                    numbers = [pa.array(z.astype(np.int32)) for z in (lo[r] + s0, at[r] - s0, x[r], y[r])]
                    yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)) for z in (sym, *whole)] + rest + numbers + [ctx], names=["sym", "c1", "c2", "n", *KEY, "lo", "at", "d0", "d1", "ctx"])

    return run


def _settled(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of phrases (one row each) that have become equal: spans of those that stand once, and one row for all of them."""
    key = ["sym", "c1", "c2"]
    again = materialize(pieces.groupBy(*key).agg(F.min(F.struct(*KEY, "lo")).alias("one"), F.count("*").alias("rows")).where("rows > 1"), "again")
    both = join_small(pieces, again, key, "left", F.lit(48).cast("long"))
    spans = both.where("rows is not null and n = 1").select(*KEY, F.col("lo").alias("a"), (F.col("lo") + F.octet_length("ctx")).cast("int").alias("b"))
    ones = both.where(F.col("rows").isNull() | (F.struct(*KEY, "lo") == F.col("one")))
    return spans, ones.withColumn("n", F.when(F.col("rows").isNull(), F.col("n")).otherwise(2)).select(*pieces.columns)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [])
        for spans in batch.column("spans").to_pylist():
            a, b = np.array(sorted((x["a"], x["b"]) for x in spans)).T
            top = np.maximum.accumulate(b)
            cut = np.flatnonzero(np.r_[True, a[1:] > top[:-1]])
            out[0].append(a[cut].astype(np.int32))
            out[1].append(top[np.r_[cut[1:], len(a)] - 1].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rk"), *[pa.array(x, pa.list_(pa.int32())) for x in out]], names=[*KEY, "starts", "ends"])


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = 2_000) -> DataFrame:
    """(doc, rk, starts, ends): maximal runs of bytes that repeated windows cover, for rows with distinct texts."""
    n = 2 * partitions(rows.sparkSession)
    small = F.lit(24).cast("long")
    parse = materialize(rows.select(*KEY, "text").mapInArrow(_parse(length, gram), "sym long, c1 long, c2 long, doc long, rk long, lo int, hi int, at short"), "parse")
    shared = materialize(parse.groupBy("sym").agg(F.count("*").alias("c")).where("c > 1").select("sym"), "symbols")
    alive = join_small(parse, shared, "sym", "left_semi", small)
    phrases = alive.groupBy("sym", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "lo", "hi", "at")).alias("one"))
    phrases = materialize(phrases, "phrases")
    # every window of a phrase that stands several times
    again = materialize(phrases.where("n > 1").select("sym", "c1", "c2"), "again")
    spans = join_small(parse, again, ["sym", "c1", "c2"], "left_semi", small).select(*KEY, F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    # the dictionary: symbols with several phrases, one of which stands once
    several = phrases.groupBy("sym").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("sym", "k")
    several = materialize(several, "several")
    wanted = join_small(phrases, several, "sym", "inner", small).select("one.doc", "one.rk", F.struct("sym", F.least("n", F.lit(2)).cast("int").alias("n"), "one.lo", "one.hi", F.col("one.at").cast("int").alias("at")).alias("p"))
    wanted = materialize(wanted.groupBy(*KEY).agg(F.collect_list("p").alias("phrases")), "wanted")
    texts = join_small(rows.select(*KEY, "text"), wanted, KEY, "inner", bytes_of("phrases") + F.size("phrases") * 16)
    dictionary = materialize(texts.mapInArrow(_phrase_bytes(length), "sym long, n int, doc long, rk long, lo int, at int, ctx binary"), "dictionary")
    pieces = dictionary.withColumns({"d0": F.lit(0), "d1": F.lit(length - gram + 1)})
    fitting: list[DataFrame] = []
    while True:
        counts = pieces.groupBy("sym").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1")
        hot = materialize(counts.where(F.col("k") > most).select("sym"), "hot")
        fits = counts.where(F.col("k") <= most).select("sym") if fitting else counts.select("sym")
        if hot.isEmpty():
            fitting.append(join_small(pieces, materialize(fits, "fits"), "sym", "left_semi", small) if fitting else pieces)
            break
        fitting.append(join_small(pieces, materialize(fits.join(hot, "sym", "left_anti"), "fits"), "sym", "left_semi", small))
        halves = join_small(pieces, hot, "sym", "left_semi", small).mapInArrow(_halved(length), _PIECE)
        found, pieces = _settled(materialize(halves, "halves"))
        spans = spans.union(found)
        pieces = materialize(pieces.drop("c1", "c2"), "pieces")
    bucketed = fitting[0].select("sym", "n", *KEY, "lo", "ctx")
    for part in fitting[1:]:
        bucketed = bucketed.union(part.select("sym", "n", *KEY, "lo", "ctx"))
    spans = spans.union(bucketed.repartition(n, "sym").sortWithinPartitions("sym").mapInArrow(_merge(length), "doc long, rk long, a int, b int"))
    grouped = spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return materialize(grouped.mapInArrow(_merged, "doc long, rk long, starts array<int>, ends array<int>"), "spans")


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                data, offsets = text_bytes(part.column("text"))
                data, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                n = np.diff(bounds)
                copy = np.asarray(part.column("is_copy").cast(pa.int8())).astype(bool) & (n >= length)
                gone = np.zeros(len(data) + 1, np.int8)
                for name, step in (("starts", 1), ("ends", -1)):
                    held = part.column(name)
                    np.add.at(gone, np.repeat(bounds[:-1], np.asarray(pc.fill_null(pc.list_value_length(held), 0))) + np.asarray(held.flatten()), step)
                many = np.where(copy, 1, np.asarray(pc.fill_null(pc.list_value_length(part.column("starts")), 0)))
                stays = (np.cumsum(gone[:-1], dtype=np.int8) == 0) & ~np.repeat(copy, n)
                ends = np.searchsorted(np.flatnonzero(stays), bounds)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[stays])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), *[pa.array(x, pa.int64()) for x in (n, n - np.diff(ends), many)], kept], names=["row", "text", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    rows = keyed(docs)
    by_doc = rows.groupBy("rk", "t2", "doc").agg(F.count("*").alias("c"))
    copied = by_doc.groupBy("rk", "t2").agg(F.min("doc").alias("first_doc"), F.min_by("c", "doc").alias("firsts"), F.sum("c").alias("c"))
    copied = materialize(copied.where("c > 1").drop("c"), "copied")
    marked = join_small(rows, copied, ["rk", "t2"], "left", F.lit(32).cast("long")).withColumn("is_copy", F.col("first_doc").isNotNull())
    # one row for each text; only texts that one doc_id has several times are regrouped for it
    ones = marked.where("not is_copy or (doc = first_doc and firsts = 1)").select(*KEY, "text")
    if not copied.where("firsts > 1").isEmpty():
        ones = ones.union(marked.where("doc = first_doc and firsts > 1").groupBy(*KEY).agg(F.first("text").alias("text")))
    found = repeated_spans(ones, length)
    joined = join_small(marked, found, KEY, "left", bytes_of("starts", "ends")).select("row", "text", "is_copy", "starts", "ends")
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    schema = f"row {joined.schema['row'].dataType.simpleString()}, text string, n_bytes long, n_removed long, n_spans long, kept binary"
    return unpacked(joined.mapInArrow(_keep(length), schema), docs.columns, added)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
