"""Best-fit packing of tokenised documents into sequences by bin completion.

Only the number of pieces of each length matters to the packing, so the search runs on that histogram
(at most ``capacity`` entries, whatever the corpus) and yields patterns of lengths with multiplicities.
Pieces are then ranked within their length across the cluster and a pattern's slots take ranges of ranks.

Defined cases: a null text is an empty one, whose document is the end id alone; repeated rows are packed
one by one; a null doc_id stays null; no rows give no rows; further columns are not returned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Encoder, materialize, release, text_chunks

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than capacity are cut into pieces of
    capacity ids, of which the first takes what is left over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, False)
        try:
            for batch in batches:
                for part in text_chunks(batch):
                    out: list[list] = [[], [], [], [], []]
                    texts = part.column("text").fill_null("").to_pylist()
                    for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                        ids = np.append(ids, end_id).astype("<u4")
                        first = (len(ids) - 1) % capacity + 1
                        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                            piece = ids[a : first if k == 0 else a + capacity]
                            for column, x in zip(out, (doc, k, a, len(piece), zlib.crc32(piece.tobytes()))):
                                column.append(x)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


# ---------------------------------------------------------------- the search, on a histogram of lengths
def fillings(room: int, have: list[int], counts: Counter, wide: int = 8) -> list[tuple[int, ...]]:
    """Fillings of room with lengths at hand (have, ascending), least waste first, at most ``wide``.

    For each length there is the fullest filling of which it is the longest item, with as many items as room
    allows: sums that can be reached are bits of a whole number, so none is searched twice. Among equally
    full ones, longer items come first.
    """
    have = have[: bisect_right(have, room)]
    mask, reach, full = (1 << (room + 1)) - 1, [1], []
    for k, x in enumerate(have):
        sums, more, step = reach[-1], min(counts[x], room // x) - 1, 1
        while more > 0:  # up to so many further copies
            step = min(step, more)
            sums |= sums << (step * x) & mask
            more, step = more - step, step * 2
        with_x = sums << x & mask
        full.append((with_x.bit_length() - 1, k))
        reach.append(reach[-1] | with_x)
    out = []
    for total, k in sorted(full, reverse=True)[:wide]:
        chosen, left = [have[k]], total - have[k]
        for i in range(k, -1, -1):
            x = have[i]
            n = min(counts[x] - (i == k), left // x)
            while not reach[i] >> (left - n * x) & 1:
                n -= 1
            chosen += [x] * n
            left -= n * x
            if not left:
                break
        out.append(tuple(chosen))
    return out


def best_fit_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: bins as (lengths, multiplicity); equal bins are handled together."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: tuple[int, ...], n: int) -> None:
        if n and room not in by_room:
            rooms.insert(bisect_right(rooms, room), room)
            by_room[room] = []
        if n:
            by_room[room].append((bins, n))

    for x, n in sorted(((x, n) for x, n in histogram.items() if n > 0), reverse=True):
        while n:
            i = bisect_right(rooms, x - 1)
            room = rooms[i] if i < len(rooms) else capacity
            bins, m = by_room[room].pop() if i < len(rooms) else ((), n)
            if i < len(rooms) and not by_room[room]:
                del by_room[room], rooms[i]
            # the fullest bin is filled before the next: each takes k, then one what is left over
            k = room // x
            whole = min(m, n // k)
            some = n - whole * k if whole < m else 0
            put(room - k * x, bins + (x,) * k, whole)
            put(room - some * x, bins + (x,) * some, int(some > 0))
            if bins:
                put(room, bins, m - whole - (some > 0))
            n -= whole * k + some
    return [b for found in by_room.values() for b in found]


def best_fit(items: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing: the incumbent of the search."""
    return [b for b, n in best_fit_patterns(Counter(items), capacity) for _ in range(n)]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each a, items over capacity - a share a bin with none of a or more."""
    sizes = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        sizes[x] += n
    count, total = np.cumsum(sizes), np.cumsum(sizes * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for a in range(1, half + 1):
        large, mid = count[-1] - count[half], (count[capacity - a] - count[half]) * capacity - (total[capacity - a] - total[half])
        best = max(best, int(large) + max(0, -(-int(total[half] - total[a - 1] - mid) // capacity)))
    return best


def search(histogram: dict[int, int], capacity: int, nodes: int = 5_000, tail: int = 1500) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion with branch and bound over patterns with multiplicities.

    The largest length is filled up in the least wasteful ways, each for as many bins as its lengths allow
    or for half of them, and for one bin where ``tail`` items or fewer are left. A branch ends when its
    waste leaves no room for fewer bins than the incumbent has; the search ends at the lower bound or
    after ``nodes`` steps. The incumbent starts as best fit of all items. One histogram is kept: a branch
    takes its items out and puts them back when it is done.
    """
    counts = Counter({k: v for k, v in histogram.items() if v > 0})
    best = best_fit_patterns(counts, capacity)
    fewest, least, total = sum(n for _, n in best), lower_bound(counts, capacity), sum(k * v for k, v in counts.items())
    left, used, waste, steps = sum(counts.values()), 0, 0, 0

    def branches():
        top = max(counts)
        counts[top] -= 1
        have = sorted(x for x, n in counts.items() if n)
        found = (fillings(capacity - top, have, counts, 3) if have else []) or [()]
        counts[top] += 1
        for f in found:
            bin_ = (top, *f)
            most = min(counts[x] // k for x, k in Counter(bin_).items())
            for n in (1,) if left <= tail else dict.fromkeys((most, (most + 1) // 2)):
                yield bin_, n

    path: list[tuple[tuple[int, ...], int]] = []
    stack = [branches()] if left else []
    while stack and fewest > least and steps < nodes:
        chosen = next(stack[-1], None)
        if chosen is None:
            stack.pop()
            if path:
                bin_, n = path.pop()
                counts.update({x: n * k for x, k in Counter(bin_).items()})
                left, used, waste = left + n * len(bin_), used - n, waste - n * (capacity - sum(bin_))
            continue
        bin_, n = chosen
        wasted = waste + n * (capacity - sum(bin_))
        if wasted > (fewest - 1) * capacity - total:
            continue
        steps += 1
        for x, k in Counter(bin_).items():
            counts[x] -= n * k
            if not counts[x]:
                del counts[x]
        path.append(chosen)
        left, used, waste = left - n * len(bin_), used + n, wasted
        if not left and used < fewest:
            best, fewest = list(path), used
        stack.append(branches() if left else iter(()))
    return best


def complete(items: list[int], capacity: int, nodes: int = 5_000) -> list[tuple[int, ...]]:
    """The search over single items; at least as good as best fit."""
    return [b for b, n in search(Counter(items), capacity, nodes, len(items)) for _ in range(n)]


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, tail: int = 1500) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, multiplicity) for a histogram of lengths; never more bins than best fit of all items."""
    found: Counter = Counter()
    for lengths, n in search(histogram, capacity, tail=tail):
        found[tuple(sorted(lengths, reverse=True))] += n
    return list(found.items())


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_salt: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (which must be materialised)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, base = [], 0
    used: Counter = Counter()
    for lengths, n in patterns(histogram, capacity):
        offset = 0
        for x, k in Counter(lengths).items():  # equal lengths stand side by side
            slots.append((x, used[x], used[x] + n * k, base, offset, n))
            used[x] += n * k
            offset += x * k
        base += n
    table = spark.createDataFrame(slots, "slot_length int, low long, high long, base long, first long, bins long")
    salts = max(1, sum(histogram.values()) // per_salt)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the slots are at most a few for each of the lengths below capacity
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    offset = F.col("first") + F.floor(k / F.col("bins")) * F.col("slot_length")
    return placed.select(*pieces.columns, (F.col("base") + k % F.col("bins")).alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack: a row per piece."""
    return pack(materialize(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity).withColumn("length", F.col("length").cast("long"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
