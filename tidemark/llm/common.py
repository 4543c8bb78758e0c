"""Helpers shared by the corpus operators: shared storage, size-checked joins, rolling hashes, encoding."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words everywhere in this package.
SPACES = "\x20\x09-\x0d"
#: Rows for which no id is given sort behind all others.
NO_ID = 2**63 - 1
#: A joined side is broadcast only below this many bytes; above, the join shuffles.
BROADCAST_BYTES = 24 << 20
#: Rows with more bytes are hashed in stretches.
LONG = 1 << 19
_U = np.uint64


# ---------------------------------------------------------------- shared storage and joins
def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset on one machine (tests), an own temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: str, how: str, bytes_of: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join on one key, broadcasting small only if the sum of bytes_of over it (one number) is below limit.

    small must be materialised. Beyond the limit the same join shuffles, with adaptive skew handling.
    """
    n = small.agg(F.sum(bytes_of).alias("n")).first()["n"] or 0
    return big.join(F.broadcast(small) if n <= limit else small, on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_expr(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def release() -> None:
    """Give memory that a batch or task is done with back to the system: workers are used again by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hold_less() -> None:
    """Let this worker's C library keep little of what is freed: one arena. Blocks mapped on their own cost page faults each time."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-8, 1)  # fixed value: M_ARENA_MAX
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function over batches whose task gives its memory back when it ends."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


# ---------------------------------------------------------------- rolling hashes over batches
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit polynomial value over all its bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i <= n."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) <= n:
        m = max(1 << 19, 1 << (n + 1).bit_length())
        one = np.ones(m, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:] = _U(base)
        down[1:] = _U(pow(base, -1, 1 << 64))
        have = _TABLES[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, from which any window's hash follows."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def windows(sums: np.ndarray, base: int, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[at:end], independent of where it stands."""
    return mix((sums[end] - sums[at]) * powers(base, len(sums))[1][at])


B1, B2, B3 = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5, 0xD6E8FEB86659FD93 | 5
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and each row's offset; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    held = column.buffers()[1]
    if held is None or not len(column):  # no rows
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(held, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = 1 << 18):
    """Ranges of whole rows with about most bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes inside, none of which goes over a row's bound."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive rows: (hash, start byte, end byte, index of each row's first word, then the total).

    offsets are the rows' bounds within data.
    """
    data = data[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    start, end = spans(~SPACE_BYTES[data], bounds)
    h = windows(prefix(data.astype(np.uint64) + _U(1), B1), B1, start, end)
    return h, start, end, np.searchsorted(start, bounds)


def stretches(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, bounds, base): slices of whole rows, and of a row of more than LONG bytes stretches that begin base
    bytes into it, each with the last ``overlap`` bytes of the one before."""
    for a, b in slices(offsets):
        x, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - x <= LONG:
            yield a, offsets[a : b + 1], 0
            continue
        step = max(LONG, 2 * overlap) - overlap
        for at in range(x, max(x + 1, end - overlap), step):
            yield a, np.array([at, min(at + step + overlap, end)]), at - x


def word_stretches(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray, int, bool]]:
    """(row, bounds, base, more): as stretches, but cut at spaces, with base and overlap in words; more: the row goes on."""
    for a, b in slices(offsets):
        x, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - x <= LONG:
            yield a, offsets[a : b + 1], 0, False
            continue
        base, size = 0, max(LONG, 16 * overlap)
        while True:
            y = min(x + size, end)
            while y < end and not SPACE_BYTES[data[y]]:
                gap = np.flatnonzero(SPACE_BYTES[data[y : y + LONG]])
                y = y + int(gap[0]) if len(gap) else min(y + LONG, end)
            yield a, np.array([x, y]), base, y < end
            if y == end:
                break
            start, _ = spans(~SPACE_BYTES[data[x:y]], np.array([0, y - x]))
            if len(start) <= overlap:  # very long words: the same again, and more
                size *= 2
                continue
            base, x = base + len(start) - overlap, x + int(start[len(start) - overlap])


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys."""
    m, have = keys, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == w else np.minimum(m[: len(m) - (w - have)], m[w - have :])


def owners(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w consecutive hashes, the index of its least one (the first among equals).

    It depends on the window's own content alone, so equal windows choose the same place in it.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    keys = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(keys, w) & _U(0xFFFFFFFF)).astype(np.int64)


def runs(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [p, p + length) over sorted starts p, as maximal runs (starts, ends)."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]] + length


# ---------------------------------------------------------------- encoding
#: What the quick path leaves to the library: rare spaces, controls, special tokens, numbers that are
#: not decimal digits, letters whose lower case depends on place or language, and all from U+0590 on.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbe\u0130\u03a3\u0590-\U0010ffff]|<\\|")
#: How the two vocabularies split a text before their merges. Words are split together, with
#: a zero byte between them, which no plain text holds.
_SPLIT = {
    False: re.compile("\0|'s|'t|'re|'ve|'m|'ll|'d| ?[^\\W\\d_]+| ?\\d+| ?(?:[^\\s\\w\0]|_)+|\\s+(?![^\\s\0])|\\s+"),
    True: re.compile("\0|'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\s\\w\0]|_)+"),
}
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: Byte-level vocabularies show each byte as one character: printable ones as they are, others from U+0100 on.
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


#: Bytes of which a text must be free, or else _ODD looks at it.
_RARE = np.zeros(256, bool)
_RARE[[*range(9), *range(14, 32), 0x3C, 0x7F, 0xC2, 0xC4, 0xCE, *range(0xD6, 256)]] = True


class _Numbered(dict):
    """Numbers new keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Runs:
    """Numbered runs of ids in one growing array."""

    def __init__(self):
        self.ids, self.ends, self.used, self.n = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

    def taken(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs k, one after the other, and where each run ends (from 0)."""
        a = self.ends[k]
        n = self.ends[k + 1] - a
        after = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(a - after[:-1], n) + np.arange(after[-1])], after


class Encoder:
    """Encodes texts with a tokenizers file, each distinct word of them once.

    A text is cut before its spaces, its words at the vocabulary's own bounds, and the pieces are merged
    by the library's model. Texts with anything unusual (see _ODD; double spaces) go through the library
    whole. The memory of words is emptied when it is full, and a worker's next task goes on with it. drops_space: the vocabulary lowers case and
    drops white space.
    """

    _made: dict = {}

    def __init__(self, path: str, drops_space: bool, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.drops, self.most = Tokenizer.from_file(path), drops_space, most
        self.findall = _SPLIT[drops_space].findall
        self.forget()

    @classmethod
    def of(cls, path: str, drops_space: bool) -> Encoder:
        """One for each Python worker, which reads the file once."""
        if path not in cls._made:
            hold_less()
            cls._made[path] = cls(path, drops_space)
        return cls._made[path]

    def forget(self) -> None:
        self.words, self.word_ids = _Numbered(), _Runs()
        self.pieces, self.piece_ids = _Numbered(), _Runs()
        self.pieces["\0"]  # the first piece parts words and has no ids
        self.piece_ids.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def merged(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_CHARS))]

    def learn(self, n: int) -> None:
        """Encode the words numbered from n on."""
        new = "\0".join(list(islice(reversed(self.words), len(self.words) - n))[::-1])
        found, known = self.findall(new.lower() if self.drops else new), len(self.pieces)
        k = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        if len(self.pieces) > known:
            gc.disable()  # many small lists come and go here
            ids = list(map(self.merged, list(islice(reversed(self.pieces), len(self.pieces) - known))[::-1]))
            self.piece_ids.add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
            del ids
            gc.enable()
        ids, ends = self.piece_ids.taken(k)
        last = ends[np.concatenate([np.flatnonzero(k == 0), [len(k)]])]
        self.word_ids.add(ids, np.diff(last, prepend=0))

    def is_plain(self, text: str, rare: bool) -> bool:
        if rare and _ODD.search(text):
            return False
        return unicodedata.is_normalized("NFC", text) if self.drops else "  " not in text

    def cut(self, text: str) -> list[str]:
        if self.drops:
            return text.split()
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        rare = np.concatenate([[0], np.cumsum(_RARE[data])])[offsets]
        plain = [self.is_plain(t, x) for t, x in zip(texts, np.diff(rare) > 0)]
        odd = [t for t, x in zip(texts, plain) if not x]
        # one at a time and without offsets: what the library holds of a text is many times its ids
        whole = (np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in odd)
        lists = [self.cut(t) for t, x in zip(texts, plain) if x]
        if max(len(self.words), len(self.pieces)) > self.most:
            self.forget()
        n, counts = len(self.words), np.array([len(x) for x in lists], np.int64)
        k = np.fromiter(map(self.words.__getitem__, chain.from_iterable(lists)), np.int64, counts.sum())
        if len(self.words) > n:
            self.learn(n)
        ids, after = self.word_ids.taken(k)
        bounds = after[np.concatenate([[0], np.cumsum(counts)])]
        parts = iter([ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])])
        return [next(parts) if x else next(whole) for x in plain]


def text_chunks(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20):
    """Slices of a batch with about most bytes of text each."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(name)))
    for a, b in slices(offsets, most):
        yield batch.slice(a, b - a)
