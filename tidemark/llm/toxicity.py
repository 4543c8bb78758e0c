"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities: of insults (a fixed lexicon, and words and stems that the labelled
rows show to be insults), of insults close to a second-person pronoun, of capitals, of punctuation, of
obfuscated words and the like. They are counted over the bytes of whole texts, many texts at once, with
words looked up by hash. The trees are fitted on labelled rows of which at most ``sample`` are used, chosen
by hash of doc_id; a fifth of them is set aside for the isotonic calibration.

Defined cases: null and empty texts have all features 0 and get a score like others; rows without a
usable label (null, not 0 or 1) and labels without a document are not learned from; where the labels
hold one class or none, every score is that class's share or 0; repeated rows are scored one by one; a
null doc_id is not held out; further columns of docs are ignored by scores() and kept by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import B1, materialize, prefix, release, slices, spans, text_bytes, windows

#: Insults in the languages of the corpus, lower case.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "trash", "garbage", "scum", "loser", "losers", "clown",
    "clowns", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "vermin", "filth", "freak", "dickhead",
    "asshole", "bitch", "crap", "shut up", "hate you", "kill yourself", "dummkopf", "arschloch", "abschaum", "trottel",
    "connard", "salaud", "crétin", "ordure", "imbécile", "estúpido", "basura", "escoria", "payaso", "gilipollas",
)
#: Second-person pronouns.
SECOND_PERSON = ("you", "your", "yours", "yourself", "ur", "u", "du", "dich", "dir", "dein", "tu", "toi", "ton", "vous", "ti", "usted")
#: What stands for letters in obfuscated words; a star may stand for any letter.
STANDS_FOR = (("a", "@4"), ("e", "3"), ("i", "1!|"), ("o", "0"), ("s", "5$"), ("t", "7+"))
#: An insult and a pronoun are close within so many words.
NEAR = 5

FEATURES = ("insults", "has_insult", "distinct_insults", "near_you", "obfuscated_insults", "you", "capitals", "punctuation", "marks", "obfuscation", "stretched", "length")


def learned_terms(labelled: DataFrame, most: int = 200, least: float = 30.0) -> tuple[str, ...]:
    """Words' first 4 to 6 letters, and whole words (with a $), that mark toxic texts (text, toxic), by log-likelihood ratio.

    A term must stand in at most one clean text for ten toxic ones. At most 8 * most terms reach the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]{3,}"), F.lit(0)))
    ends = F.transform(F.filter(words, lambda w: F.length(w) < 30), lambda w: F.concat(w, F.lit("$")))
    terms = F.concat(ends, *[F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.substring(w, 1, n)) for n in (4, 5, 6)])
    both = labelled.agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).first()
    if not both["n1"] or both["n1"] == both["n"]:
        return ()
    base = both["n1"] / both["n"]
    seen = labelled.select("toxic", F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    odd, even = F.col("a"), F.col("n") - F.col("a")
    ratio = 2 * (odd * F.log(odd / (F.col("n") * base)) + F.when(even > 0, even * F.log(even / (F.col("n") * (1 - base)))).otherwise(0.0))
    best = seen.where((odd >= 5) & (even * 10 <= odd)).withColumn("ratio", ratio).where(F.col("ratio") >= least)
    chosen: list[str] = []
    for r in best.orderBy(F.desc("ratio"), F.length("term"), "term").limit(8 * most).collect():
        if len(chosen) < most and not any(r["term"].startswith(c) for c in chosen if not c.endswith("$")):
            chosen.append(r["term"])
    return tuple(sorted(chosen))


# ---------------------------------------------------------------- features, over the bytes of many texts at once
def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
_WORD = _bytes(_LETTERS) | (np.arange(256) >= 0x80)
_SPACE, _CAPITAL = _bytes(" \t\n\v\f\r"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PUNCTUATION, _MARK, _SIGNS = _bytes("!?.,;:"), _bytes("!"), _bytes("@$*#%&")
_CORE, _DROPPED = _WORD | _bytes("@$"), _bytes("*._-")
_SWAP = np.arange(256, dtype=np.uint8)
for _letter, _signs in STANDS_FOR:
    _SWAP[list(_signs.encode())] = ord(_letter)
_ALTERED = _bytes("".join(x for _, x in STANDS_FOR)) | _DROPPED


def _hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return windows(prefix(data.astype(np.uint64) + np.uint64(1), B1), B1, start, end)


def _hashes(words) -> np.ndarray:
    """Sorted hashes of some words, as those of runs of bytes."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return np.unique(_hash_runs(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends)) if raw else np.zeros(0, np.uint64)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Lexicon:
    """Insults to be looked up by hash: whole words, stems (words' first letters), pairs of words, and words once their disguise is off."""

    def __init__(self, learned: tuple[str, ...] = ()):
        single = [w for w in LEXICON if " " not in w]
        self.whole = _hashes([*single, *(t[:-1] for t in learned if t.endswith("$"))])
        self.stems = {n: _hashes([t for t in learned if not t.endswith("$") and len(t) == n]) for n in (4, 5, 6)}
        self.pairs = [tuple(_hashes([w])[0] for w in x.split()) for x in LEXICON if " " in x]
        self.you = _hashes(SECOND_PERSON)
        long = [w for w in single if len(w) > 3]
        self.plain = _hashes(long)
        self.starred = _hashes({w[:i] + w[i + 1 :] for w in long for i in range(len(w))})

    def features(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row of FEATURES for each text; bounds are the texts' ends within data, from 0."""
        n_rows = len(bounds) - 1
        out = np.zeros((n_rows, len(FEATURES)))
        if not len(data):
            return out
        per_row = lambda hit: np.diff(np.searchsorted(np.flatnonzero(hit), bounds))
        begins = (data & 0xC0) != 0x80  # a character's first byte
        chars = per_row(begins)
        after_c3, after_e2 = np.zeros(len(data), bool), np.zeros(len(data), bool)
        after_c3[1:], after_e2[1:] = data[:-1] == 0xC3, data[:-1] == 0xE2
        accented = after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)  # capitals of Latin-1
        capital = _CAPITAL[data]
        low = data + np.where(capital | accented, np.uint8(32), np.uint8(0))
        # Latin-1 signs and general punctuation part words too
        sign = data == 0xC2
        sign[1:] |= data[:-1] == 0xC2
        dash = np.zeros(len(data), bool)
        dash[:-1] = (data[:-1] == 0xE2) & (data[1:] == 0x80)
        sign |= dash
        sign[1:] |= dash[:-1]
        sign[2:] |= dash[:-2]
        word = _WORD[data] & ~sign

        start, end = spans(word, bounds)
        sums = prefix(low.astype(np.uint64) + np.uint64(1), B1)
        h = windows(sums, B1, start, end)
        row = np.searchsorted(bounds, start, "right") - 1
        insult = _within(h, self.whole)
        at_char = np.flatnonzero(begins)
        nth = np.searchsorted(at_char, start)
        at_char = np.append(at_char, np.full(8, len(data)))
        for n, known in self.stems.items():
            stop = at_char[nth + n]
            fits = stop <= end
            insult[fits] |= _within(windows(sums, B1, start[fits], stop[fits]), known)
        for a, b in self.pairs:
            insult[:-1] |= (h[:-1] == a) & (h[1:] == b) & (row[:-1] == row[1:])
        you = _within(h, self.you)
        of_word = lambda hit: np.bincount(row[hit], minlength=n_rows)
        hits = of_word(insult)
        near = np.zeros(len(h), bool)
        if insult.any() and you.any():
            at, of = np.flatnonzero(insult), np.flatnonzero(you)
            k = np.searchsorted(of, at)
            for side in (np.minimum(k, len(of) - 1), np.maximum(k - 1, 0)):
                near[at] |= (np.abs(of[side] - at) <= NEAR) & (row[of[side]] == row[at]) & (of[side] != at)
        found = np.unique(np.stack([row[insult].astype(np.uint64), h[insult]]), axis=1)[0].astype(np.int64) if insult.any() else row[:0]

        # tokens that hold a sign or digit within, their disguise taken off
        t0, t1 = spans(~_SPACE[data], bounds)
        n_words = np.maximum(np.bincount(np.searchsorted(bounds, t0, "right") - 1, minlength=n_rows), 1)
        changed = np.flatnonzero(_ALTERED[data])
        odd = np.unique(np.searchsorted(t0, changed, "right") - 1)
        at = np.repeat(t0[odd] - np.cumsum(t1[odd] - t0[odd]) + (t1[odd] - t0[odd]), t1[odd] - t0[odd]) + np.arange((t1[odd] - t0[odd]).sum())
        out[:, FEATURES.index("obfuscated_insults")] = self.disguised(low[at], np.concatenate([[0], np.cumsum(t1[odd] - t0[odd])]), np.searchsorted(bounds, t0[odd], "right") - 1, n_rows)

        tripled = np.zeros(len(data), bool)
        tripled[:-2] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _WORD[data[2:]] & (data[2:] < 0x80)
        edges = bounds[1:-1]
        for back in (1, 2):
            tripled[np.maximum(edges - back, 0)] = False
        size = np.maximum(chars, 1)
        some = hits > 0
        columns = {
            "insults": hits / n_words, "has_insult": some, "distinct_insults": np.bincount(found, minlength=n_rows), "near_you": of_word(near) / n_words, "you": np.where(some, of_word(you) / n_words, 0),
            "capitals": per_row(capital | accented) / size, "punctuation": per_row(_PUNCTUATION[data]) / size, "marks": per_row(_MARK[data]) / size, "obfuscation": per_row(_SIGNS[data]) / size,
            "stretched": per_row(tripled) > 0, "length": np.log1p(chars),
        }
        for name, column in columns.items():
            out[:, FEATURES.index(name)] = column
        return out

    def disguised(self, low: np.ndarray, bounds: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """How many tokens of each row are insults with letters replaced, left out or split by marks."""
        if not len(row):
            return np.zeros(n_rows, np.int64)
        core, altered = (np.concatenate([[0], np.cumsum(x[low])]) for x in (_CORE, _ALTERED))
        place = np.flatnonzero(_CORE[low])
        some = np.flatnonzero(core[bounds[1:]] > core[bounds[:-1]])
        c0, c1 = place[core[bounds[some]]], place[core[bounds[some + 1]] - 1] + 1
        inside = altered[c1] > altered[c0]
        some, c0, c1 = some[inside], c0[inside], c1[inside]
        keep = ~_DROPPED[low]
        left, stars = (np.concatenate([[0], np.cumsum(x)]) for x in (keep, low == ord("*")))
        h = _hash_runs(_SWAP[low[keep]], left[c0], left[c1])
        bad = _within(h, self.plain) | ((stars[c1] > stars[c0]) & _within(h, self.starred))
        return np.bincount(row[some[bad]], minlength=n_rows)


def features(text: Column, learned: tuple[str, ...] = ()) -> Column:
    """An array of doubles, named as in FEATURES."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        lexicon = Lexicon(learned)
        data, offsets = text_bytes(texts)
        found = [lexicon.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
        values = np.concatenate(found).ravel() if found else np.zeros(0)
        release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values))

    return of(text)


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: rows with 0 are held out, a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def scored(docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 24, depth: int = 4, seed: int = 3) -> DataFrame:
    """(row, score) for each row of docs, which needs doc_id and text; labels has doc_id and toxic."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    chosen = usable.where(bucket(F.col("doc_id")) != 0).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    labelled = materialize(texts.join(F.broadcast(chosen), "doc_id"), "labelled")  # at most sample documents
    aside = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0
    terms = learned_terms(labelled.where(~aside))
    vector = lambda df: df.withColumn("features", array_to_vector("found"))
    known = labelled.select("doc_id", "toxic", aside.alias("aside"), features(F.col("text"), terms).alias("found"))
    known = materialize(known.repartition(4), "features")
    kinds = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = docs.select(row, features(F.col("text"), terms).alias("found"))
    if len(kinds) < 2:
        score = F.lit(1.0 if 1.0 in kinds else 0.0)
    else:
        rows = vector(known)
        model = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=3, maxBins=64, seed=seed).fit(rows.where("not aside"))
        raw = vector_to_array(F.col("probability"))[1]
        judged = model.transform(rows).select("aside", F.col("toxic").alias("label"), raw.alias("raw"))
        apart = judged.where("aside")
        steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(judged if apart.isEmpty() else apart)
        wide = steps.transform(model.transform(vector(wide)).withColumn("raw", raw))
        score = F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0))
    return wide.select("row", score.alias("score"))


def scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    rows = scored(docs, labels, **how).select(F.col("row.doc_id").alias("doc_id"), "score")
    return rows.select("doc_id", (bucket(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, bound: float = 0.5, **how) -> DataFrame:
    """The rows of docs with a score below bound."""
    return scored(docs, labels, **how).where(F.col("score") < bound).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
