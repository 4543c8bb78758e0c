"""Quality scores by supervised subword embeddings.

A text is a bag of hashed features: its words, the character n-grams of its words (3 to 5 bytes, and again with a mark
where they begin or end a word), a word that one of the ``BACK`` words before it repeats, and one feature that every text
has. Each feature has a learned vector; a text's vector is their mean, and a linear layer with softmax gives the
probability of label 1. Vectors and layer are learned together by stochastic gradient descent in numpy, on
labelled rows of which at most ``sample`` are used, chosen by hash of doc_id: tasks each take steps on their own rows,
their models are averaged, and the next round begins with the average. Of a text only the ``most`` features with the
greatest counts are learned from; scores use all features of whole texts.

Since the layer is linear, a text's logit is the mean of one number per feature, the layer's product with its vector;
scoring looks these up.

Defined cases: null and empty texts have the one feature alone; rows without a usable label (null, not 0 or 1) and
labels without a document are not learned from; rows that share a doc_id are learned from once (the text with the
least hash), labels that do by their greatest; where the labels hold one class or none, every score is that class's
share or 0; rows are scored one by one; a null doc_id is not held out; no rows give no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import B1, B2, SPACE_BYTES, mix, new_path, prefix, spans, text_bytes, windows, word_stretches

#: Buckets of hashed features, and the length of a vector.
BUCKETS, DIM = 1 << 16, 8
GRAMS = (3, 4, 5)
#: A word repeats another if that is one of so many before it.
BACK = 8
_U = np.uint64
_BEGINS, _ENDS = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: The buckets of the feature that every text has and of repeated words; hashes go to the others.
EVERY, REPEATED, _FIRST = 0, 1, 2


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(32)).astype(np.int64) % (BUCKETS - _FIRST) + _FIRST


def hashed(data: np.ndarray, offsets: np.ndarray):
    """(row, bounds, buckets) for slices of rows: buckets[bounds[k]:bounds[k + 1]] are features of row + k; a very long
    row comes in several slices. Every text's own feature is left out."""
    for row, edges, base, _ in word_stretches(data, offsets, BACK):
        part = data[edges[0] : edges[-1]]
        start, end = spans(~SPACE_BYTES[part], edges - edges[0])
        at_row = np.searchsorted(edges - edges[0], start, "right") - 1
        old = min(BACK, len(start)) if base else 0  # words of the stretch before
        ids, rows = [], []
        if len(start):
            words = windows(prefix(part.astype(np.uint64) + _U(1), B1), B1, start, end)
            again = np.zeros(len(words), bool)
            for back in range(1, min(BACK, len(words) - 1) + 1):
                again[back:] |= (words[back:] == words[:-back]) & (at_row[back:] == at_row[:-back])
            again[:old] = False
            ids += [_bucket(words[old:]), np.full(again.sum(), REPEATED)]
            rows += [at_row[old:], at_row[again]]
            sums = prefix(part.astype(np.uint64) + _U(1), B2)
            length = end[old:] - start[old:]
            inside = np.repeat(start[old:] - np.cumsum(length) + length, length) + np.arange(length.sum())
            word = np.repeat(np.arange(old, len(start)), length)
            for n in GRAMS:
                fits = inside + n <= end[word]
                at, of = inside[fits], word[fits]
                h = windows(sums, B2, at, at + n)
                first, last = at == start[of], at + n == end[of]
                ids += [_bucket(h), _bucket(mix(h[first] ^ _BEGINS)), _bucket(mix(h[last] ^ _ENDS))]
                rows += [at_row[of], at_row[of[first]], at_row[of[last]]]
        ids, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, rows))
        order = np.argsort(rows, kind="stable")
        yield row, np.searchsorted(rows[order], np.arange(len(edges))), ids[order]


def bags(texts: pa.Array, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and how often they occur, at most ``most`` of them, those of greatest counts.

    Numbers of 16 bits: where a count is beyond them, all of its text are scaled.
    """
    data, offsets = text_bytes(texts)
    parts: list[list] = [[(np.array([EVERY]), np.array([1]))] for _ in range(len(texts))]
    for row, bounds, ids in hashed(data, offsets):
        keys, counts = np.unique(np.repeat(np.arange(len(bounds) - 1) << 16, np.diff(bounds)) | ids, return_counts=True)
        at = np.searchsorted(keys, np.arange(len(bounds)) << 16)
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b > a:
                parts[row + k].append((keys[a:b] & 0xFFFF, counts[a:b]))
    out = []
    for pieces in parts:
        ids, counts = (np.concatenate(x) for x in zip(*pieces))
        if len(pieces) > 2:  # stretches of one long text
            both = np.bincount(ids, counts, BUCKETS).astype(np.int64)
            ids = np.flatnonzero(both)
            counts = both[ids]
        if len(ids) > most:
            first = np.sort(np.argsort(-counts, kind="stable")[:most])
            ids, counts = ids[first], counts[first]
        top = counts.max()
        counts = counts if top < 1 << 16 else np.maximum(counts * 65535 // top, 1)
        out.append((ids.astype(np.uint16), counts.astype(np.uint16)))
    return out


class Model:
    """Vectors of all buckets and the layer above their mean."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray):
        self.vectors, self.layer = vectors, layer

    @classmethod
    def new(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        return cls(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((2, DIM), np.float32))

    def learn(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rates: np.ndarray, rng: np.random.Generator) -> None:
        """Steps over all bags in random order, one pass for each rate."""
        for rate in rates:
            for k in rng.permutation(len(bags)):
                ids, shares = bags[k]
                mean = shares @ self.vectors[ids]
                z = self.layer @ mean
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                self.vectors[ids] -= np.outer(shares, rate * (p @ self.layer))
                self.layer -= rate * np.outer(p, mean)

    def numbers(self) -> np.ndarray:
        """What each bucket adds to the logit of label 1."""
        return self.vectors.astype(np.float64) @ (self.layer[1] - self.layer[0]).astype(np.float64)

    def to_bytes(self) -> bytes:
        return self.vectors.tobytes() + self.layer.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        flat = np.frombuffer(raw, np.float32).copy()
        return cls(flat[: BUCKETS * DIM].reshape(BUCKETS, DIM), flat[BUCKETS * DIM :].reshape(2, DIM))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_bags(docs: DataFrame, labels: DataFrame, sample: int, most: int, tasks: int, seed: int) -> DataFrame:
    """(task, place, label, ids, counts) of at most sample documents that are not held out."""
    usable = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = usable.where("doc_id is not null").where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows of 12 bytes
    once = texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))

    @F.arrow_udf("struct<ids:binary,counts:binary>")
    def counted(column: pa.Array) -> pa.Array:
        found = bags(column, most)
        return pa.StructArray.from_arrays([pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)], ["ids", "counts"])

    place = F.xxhash64(F.lit(seed + 1), "doc_id")
    made = once.select(F.pmod(place, F.lit(tasks)).cast("int").alias("task"), place.alias("place"), "label", counted("text").alias("b"))
    made = made.select("task", "place", "label", "b.ids", "b.counts").repartition("task")
    # a task's rows are one file, which is read by one task in each round
    path = new_path(docs.sparkSession, "quality-bags")
    made.write.option("compression", "zstd").option("parquet.block.size", 1 << 30).parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def _trainer(begin, seed: int, r: int, rates: np.ndarray):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(held).sort_by([("task", "ascending"), ("place", "ascending")]) if held else None
        for task in rows["task"].unique().to_pylist() if rows is not None else ():
            part = rows.filter(pc.equal(rows["task"], task))
            found = []
            for ids, counts in zip(part["ids"].to_pylist(), part["counts"].to_pylist()):
                shares = np.frombuffer(counts, np.uint16).astype(np.float32)
                found.append((np.frombuffer(ids, np.uint16).astype(np.int32), shares / shares.sum()))
            own = Model.from_bytes(begin.value)
            own.learn(found, part["label"].to_numpy(), rates, np.random.default_rng([seed, r, task]))
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([own.to_bytes()], pa.binary())], names=["task", "n", "model"])

    return train


def fit(rows: DataFrame, rounds: int, passes: int, rate: float, seed: int) -> Model:
    """A model learned in rounds: every task goes on from the average of all, with rates that fall from round to round."""
    model = Model.new(seed)
    for r in range(rounds):
        begin = rows.sparkSession.sparkContext.broadcast(model.to_bytes())  # 2 MB, whatever the input
        rates = rate * (1 - np.arange(r * passes, (r + 1) * passes) / (rounds * passes))
        made = rows.mapInArrow(_trainer(begin, seed, r, rates), "task int, n long, model binary").orderBy("task").collect()  # a model of 2 MB from each of a few tasks
        n = np.array([m["n"] for m in made], np.float32)
        models = [Model.from_bytes(m["model"]) for m in made]
        model = Model(*(sum(w * getattr(m, c) for w, m in zip(n / n.sum(), models)) for c in ("vectors", "layer")))
        begin.unpersist()
    return model


def logits(texts: pa.Array, numbers: np.ndarray) -> np.ndarray:
    """The mean of the numbers of each text's features."""
    data, offsets = text_bytes(texts)
    total, n = np.full(len(texts), numbers[EVERY]), np.ones(len(texts), np.int64)
    for row, bounds, ids in hashed(data, offsets):
        sums = np.concatenate([[0.0], np.cumsum(numbers[ids])])
        k = slice(row, row + len(bounds) - 1)
        total[k] += sums[bounds[1:]] - sums[bounds[:-1]]
        n[k] += np.diff(bounds)
    return total / n


def scores(docs: DataFrame, labels: DataFrame, sample: int = 12_000, most: int = 3_000, tasks: int = 4, rounds: int = 3, passes: int = 4, rate: float = 2.0, seed: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    rows = labelled_bags(docs, labels, sample, most, tasks, seed)
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        score = F.lit(float(sum(kinds)))
    else:
        numbers = fit(rows, rounds, passes, rate, seed).numbers()

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-logits(texts, numbers))))

        score = scored("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
