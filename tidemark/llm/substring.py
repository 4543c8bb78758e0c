"""Substring dedup by level-wise doubling: windows of words that repeat at one length alone are extended to twice it.

Levels are 25, 50, 100, 200, ... words, until no candidate survives.

1. Level 25 counts, of the windows of 25 words, the anchor of each window of 50: the least-hashed one within it.
   Equal windows have equal anchors at equal places, so an anchor that no other document has rules out every
   window that it stands for. Where an anchor repeats, its windows are extended.
2. Level 50 (``window``) hashes every extended window in 96 bits. A window goes if its hash also occurs in a
   document with a smaller doc_id; longer levels remove nothing more.
3. From 50 on, windows that repeat are extended to twice the length and counted, until none repeats. Only those
   that begin at an anchor of level 50 go on, some two of fifty; a passage of 50 words more than a level has
   one in each of its places. Their hashes at all lengths are taken with the text at hand, so no level reads
   or shuffles texts again. ``longest`` tells the last level at which a document still shares such a window
   with another one, so about how long its repeats are (texts of more than half a megabyte: within a stretch).

Whole copies of a text are settled first by the text's own hash, so thousands of copies add no windows; one
stands for them, and all of them repeat at every level that fits their length.

Counts are pre-aggregated per hash before they are shuffled, and the joins back to windows are broadcast
where the repeated hashes are few and otherwise ordinary joins that adaptive execution can split.

Defined cases: a null text has no words; null doc_ids rank behind all others; rows with the same doc_id
never remove each other's words; documents shorter than the window keep everything; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import B2, B3, NO_ID, SPACE_BYTES, join_small, materialize, owners, prefix, runs, spans, text_bytes, text_chunks, windows, word_hashes, word_stretches, lean

WINDOW = 50
#: What identifies a row: its doc_id (null: last) and its text.
KEY = ["doc", "rk"]


def keyed(docs: DataFrame) -> DataFrame:
    """(row, text, doc, rk, t2): row holds the other columns of docs, so that no name of theirs can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    return docs.select(row, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("rk"), F.xxhash64(F.lit(1), "text").alias("t2"))


def unpacked(rows: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The columns that docs had, then those added; where names clash, the added one stays."""
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns if c not in added], *added)


def text_copies(rows: DataFrame) -> DataFrame:
    """(rk, t2, first_doc) of texts that several doc_ids have."""
    copied = rows.groupBy("rk", "t2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc")
    return materialize(copied.drop("last_doc"), "copied")


def bytes_of(*arrays: str) -> Column:
    """Bytes that a row takes, its arrays of 4-byte numbers included."""
    return sum((F.coalesce(F.size(a), F.lit(0)) * 4 for a in arrays), F.lit(40)).cast("long")


class _Slice:
    """Word windows of some consecutive rows of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, half: int):
        self.h, _, _, self.first = word_hashes(data, offsets)
        n, sizes = len(self.h), np.diff(self.first)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.sums = prefix(self.h, B2)
        at = np.arange(max(0, n - half + 1))
        self.half = windows(self.sums, B2, at, at + half)
        own = owners(self.half, window - half + 1)
        p = np.arange(len(own))
        self.p = p[p + window <= self.first[1:][self.row[: len(own)]]] if len(own) else p
        self.own = own[self.p]


def _listed(a: int, first: np.ndarray, base: int, pos: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the slice, with their rows) of the positions that are listed for rows a, ...; a stretch begins base words into its row."""
    n = len(first) - 1
    r = np.repeat(np.arange(n), np.diff(ends[a : a + n + 1]))
    p = pos[ends[a] : ends[a + n]].astype(np.int64) - base
    here = (p >= 0) & (p < np.diff(first)[r])
    return (first[r] + p)[here], r[here]


def _anchors(window: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc, rk = (np.asarray(batch.column(c)) for c in KEY)
            for a, bounds, base, _ in word_stretches(data, offsets, window - 1):
                s = _Slice(data, bounds, window, half)
                at = np.unique(s.own)
                r = s.row[at]
                yield pa.RecordBatch.from_arrays([pa.array(s.half[at].view(np.int64)), pa.array(doc[a + r]), pa.array(rk[a + r]), pa.array((at - s.first[r] + base).astype(np.int32))], names=["h", *KEY, "pos"])

    return run


def _extended(window: int, half: int):
    """Full windows of surviving anchors (pos), with 96 bits of hash; at anchors of the full length, also more: hashes of the
    windows of 2, 4, 8, ... times the length that begin there."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc", pa.int64()), ("rk", pa.int64()), ("pos", pa.int32()), ("more", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc, rk = (np.asarray(batch.column(c)) for c in KEY)
            held = batch.column("pos")
            pos, ends = np.asarray(held.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(held)))])
            for a, bounds, base, _ in word_stretches(data, offsets, window - 1):
                s = _Slice(data, bounds, window, half)
                alive = np.zeros(len(s.h) + 1, bool)
                alive[_listed(a, s.first, base, pos, ends)[0]] = True
                p = s.p[alive[s.own]]
                r = s.row[p]
                # anchors of the full length: where a window is the least-hashed of those in some 2 * window words
                at = np.arange(max(0, len(s.h) - window + 1))
                own = owners(windows(s.sums, B2, at, at + window), window + 1)
                anchor = np.zeros(len(s.h) + 1, bool)
                anchor[own[np.arange(len(own)) + 2 * window <= s.first[1:][s.row[: len(own)]]]] = True
                room = (s.first[1:][r] - p) // (2 * window)
                levels = np.where(anchor[p] & (room > 0), np.floor(np.log2(np.maximum(room, 1))).astype(np.int64) + 1, 0)
                bound = np.concatenate([[0], np.cumsum(levels)])
                q = np.repeat(p, levels)
                length = 2 * window << (np.arange(bound[-1]) - np.repeat(bound[:-1], levels))
                lists = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(windows(s.sums, B2, q, q + length).view(np.int64)))
                second = windows(prefix(s.h, B3), B3, p, p + window) >> np.uint64(33)
                columns = [windows(s.sums, B2, p, p + window).view(np.int64), second.astype(np.int32), doc[a + r], rk[a + r], (p - s.first[r] + base).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], schema=schema)

    return run


def _to_runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(np.sort(np.asarray(x.values)), window) for x in batch.column("at")]
            lists = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rk"), *lists], names=[*KEY, "starts", "ends"])

    return run


def firsts(marks: DataFrame, key: list[str]) -> DataFrame:
    """The keys that several doc_ids have, with the smallest one of each."""
    return marks.groupBy(*key).agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")


def repeated_runs(rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """For rows that are no copies: (doc, rk, starts, ends), the runs of words that windows of a smaller doc cover,
    and (doc, rk, longest), the last level at which each has a window that another doc has."""
    half, small = window // 2, F.lit(32).cast("long")
    anchors = materialize(rows.select(*KEY, "text").mapInArrow(lean(_anchors(window, half)), "h long, doc long, rk long, pos int"), "anchors")
    alive = join_small(anchors, materialize(firsts(anchors, ["h"]), "again"), "h", "left_semi", small)
    alive = materialize(alive.groupBy(*KEY).agg(F.collect_set("pos").alias("pos")), "alive")
    candidates = join_small(rows.select(*KEY, "text"), alive, KEY, "inner", bytes_of("pos"))
    full = materialize(candidates.mapInArrow(lean(_extended(window, half)), "h1 long, h2 int, doc long, rk long, pos int, more array<long>"), "windows")
    # windows are many, so this join shuffles at every size; both sides are tables, so adaptive execution splits hot windows
    found = full.join(materialize(firsts(full, ["h1", "h2"]), "first-docs"), ["h1", "h2"])
    marks = F.collect_set(F.when(F.size("more") > 0, F.struct("pos", "more"))).alias("marks")
    at = materialize(found.groupBy(*KEY).agg(F.collect_set(F.when(F.col("doc") > F.col("first_doc"), F.col("pos"))).alias("gone"), marks), "places")
    removed = at.where(F.size("gone") > 0).select(*KEY, F.col("gone").alias("at")).mapInArrow(lean(_to_runs(window)), "doc long, rk long, starts array<int>, ends array<int>")
    removed = materialize(removed, "runs")
    level, longest = window, at.select(*KEY, F.lit(window).alias("level"))
    going = materialize(at.select(*KEY, F.explode("marks").alias("m")).select(*KEY, "m.more"), "marks")
    while not going.isEmpty():
        level *= 2
        wide = going.select(*KEY, "more", F.element_at("more", 1).alias("h"))
        again = join_small(wide, materialize(firsts(wide, ["h"]), "firsts"), "h", "left_semi", small)
        again = materialize(again.select(*KEY, F.slice("more", 2, 64).alias("more")), "marks")
        longest = longest.union(again.select(*KEY, F.lit(level).alias("level")))
        going = again.where(F.size("more") > 0)
    return removed, materialize(longest.groupBy(*KEY).agg(F.max("level").alias("longest")), "longest")


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                data, offsets = text_bytes(part.column("text"))
                data, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                start, end = spans(~SPACE_BYTES[data], bounds)
                first = np.searchsorted(start, bounds)
                n = np.diff(first)
                gone = np.zeros(len(start) + 1, np.int64)  # +1 where a run begins, -1 where it ends
                for name, step in (("starts", 1), ("ends", -1)):
                    held = part.column(name)
                    at = np.repeat(first[:-1], np.asarray(pc.fill_null(pc.list_value_length(held), 0))) + np.asarray(held.flatten())
                    np.add.at(gone, at, step)
                copy = np.asarray(part.column("is_copy").cast(pa.int8())).astype(bool) & (n >= window)
                stays = (np.cumsum(gone)[:-1] == 0) & ~np.repeat(copy, n)
                row = np.repeat(np.arange(len(n)), n)[stays]
                begin, stop = start[stays], end[stays]
                # a word keeps the space behind it, unless it is its row's last
                stop = stop + np.r_[row[1:] == row[:-1], np.zeros(min(1, len(row)), bool)]
                step = np.zeros(len(data) + 1, np.int8)
                step[begin] += 1
                np.subtract.at(step, stop, 1)
                inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
                out = np.where(SPACE_BYTES[data], np.uint8(32), data)[inside]
                ends = np.searchsorted(np.flatnonzero(inside), bounds)
                kept = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(n, pa.int64()), pa.array(n - np.bincount(row, minlength=len(n)), pa.int64()), kept], names=["row", "text", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, kept (the words that stay, joined by one space) and longest (0: no window repeats).

    docs has doc_id and text; further columns pass through, but for those named like the new ones.
    """
    rows = keyed(docs)
    copied = text_copies(rows)
    marked = join_small(rows, copied, ["rk", "t2"], "left", F.lit(24).cast("long"))
    marked = marked.withColumn("is_copy", F.coalesce(F.col("doc") > F.col("first_doc"), F.lit(False)))
    removed, longest = repeated_runs(marked.where("not is_copy"), window)
    joined = join_small(marked, removed, KEY, "left", bytes_of("starts", "ends"))
    joined = join_small(joined, longest, KEY, "left", F.lit(24).cast("long")).select(F.struct("row", "first_doc", "longest").alias("row"), "text", "is_copy", "starts", "ends")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long, kept string"
    kept = joined.mapInArrow(lean(_keep(window)), schema)
    # a text that has copies repeats as a whole
    whole = F.when(F.col("row.first_doc").isNotNull() & (F.col("n_words") >= window), (window * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_words") / window)))).cast("int"))
    kept = kept.withColumn("longest", F.coalesce(F.greatest("row.longest", whole), F.lit(0))).withColumn("row", F.col("row.row"))
    return unpacked(kept, docs.columns, ["n_words", "n_removed", "kept", "longest"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
