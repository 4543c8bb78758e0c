"""Document fingerprints by consistent weighted sampling, in built-in functions only.

A document's terms are its words, weighted by their counts. For each term and each of ``samples`` samples,
r, c ~ Gamma(2, 1) and b ~ U(0, 1) follow from their hash; the weight s is quantised to t = floor(ln s / r
+ b), and the sample takes the term with the least a = c / (y e^r), where y = exp(r (t - b)). Two documents
agree in a sample with a probability equal to their generalised Jaccard similarity, sum of least weights
over sum of greatest. Since a is a function of (term, t, sample), equal least values mean equal samples,
so the minimum itself is kept and 16 bits of its hash are the sample's mark.

The next document (in descending doc_id) is found without a global sort: rows fall in ranges of about equal
numbers by (doc_id, text's hash), each range is one window, and the first row of the next range is copied to
its end. Bounds come from the rows themselves, so neither outlying ids nor many rows without an id meet in
one range; rows that agree in id and text do.

Defined cases: a null text is an empty one; documents without words have a fingerprint of dashes, like
each other alone (1) and no other (0); null doc_ids come last in the order; rows that repeat a doc_id are
ordered by their text's hash; the last document's next is the first, so a lone document is its own next;
no rows give no rows; further columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, materialize, partitions

SAMPLES = 32


def _uniform(h: Column, at: int, bits: int) -> Column:
    """A number in (0, 1) from ``bits`` bits of a hash."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * (1.0 / (1 << bits))


def _sample(k: int) -> Column:
    """a of one term (hash h, logarithm of its count ln_s) in sample k."""
    one, two = F.xxhash64("h", F.lit(2 * k)), F.xxhash64("h", F.lit(2 * k + 1))
    r = -F.log(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    b = _uniform(one, 42, 21)
    c = -F.log(_uniform(two, 0, 32) * _uniform(two, 32, 32))
    return c * F.exp(-r * (F.floor(F.col("ln_s") / r + b) - b + 1))


def least_samples(terms: DataFrame, by: list[str], samples: int) -> DataFrame:
    """marks: an array of one number per sample for each group of (h, count); -1 where a group has no terms."""
    drawn = terms.select(*by, "h", F.log(F.col("count").cast("double")).alias("ln_s"))
    found = drawn.groupBy(*by).agg(*[F.min(F.when(F.col("h").isNotNull(), _sample(k))).alias(f"m{k}") for k in range(samples)])
    mark = lambda k: F.coalesce(F.pmod(F.xxhash64(f"m{k}"), F.lit(65536)), F.lit(-1)).cast("int")
    return found.select(*by, F.array(*[F.when(F.col(f"m{k}").isNotNull(), mark(k)).otherwise(-1) for k in range(samples)]).alias("marks"))


def shown(marks: Column) -> Column:
    """Four hexadecimal digits for each sample."""
    return F.array_join(F.transform(marks, lambda m: F.when(m < 0, F.lit("----")).otherwise(F.lpad(F.lower(F.hex(m)), 4, "0"))), "")


def likeness(a: Column, b: Column, samples: int) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def _place(bounds: Column, key: Column) -> Column:
    """How many of the sorted bounds are at most key, less one: a search by halves, unrolled over powers of two."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    at = lambda i: F.try_element_at(bounds, i)
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= F.size(bounds)) & (at(low + s) <= key), low + s).otherwise(low)) - 1


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(range, rn, copied, doc_id, text, next_text): each document and the one after it in descending doc_id."""
    n = ranges or 2 * partitions(docs.sparkSession)
    parts = {"k0": F.col("doc_id").isNull().cast("int"), "k1": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "k2": F.xxhash64("text")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns(parts)
    key = F.struct(*parts)
    # narrow rows in ranges of about equal numbers, and each range's least key: one row a range
    dealt = rows.select(*parts).repartitionByRange(n, *parts).withColumn("p", F.spark_partition_id())
    lows = materialize(dealt.groupBy("p").agg(F.min(key).alias("low")).agg(F.sort_array(F.collect_list("low")).alias("bounds")), "bounds")
    placed = rows.crossJoin(F.broadcast(lows)).withColumn("key", key).withColumn("range", F.greatest(_place(F.col("bounds"), F.col("key")), F.lit(0)))
    leads = F.element_at("bounds", F.col("range") + 1) == F.col("key")
    before = F.when(F.col("range") > 0, F.col("range") - 1).otherwise(F.size("bounds") - 1)
    # the first row of a range is copied to the end of the one before
    of = lambda r, copied: F.struct(r.alias("range"), F.lit(copied).alias("copied"))
    places = F.when(leads, F.array(of(F.col("range"), False), of(before, True))).otherwise(F.array(of(F.col("range"), False)))
    both = placed.select("doc_id", "text", "key", F.explode(places).alias("at")).select("at.*", "doc_id", "text", "key").repartition(n, "range")
    # the key settles the number: it stands in the order so that both uses of the rows read the same columns and share one shuffle of texts
    w = W.partitionBy("range").orderBy("copied", "key", "text", "doc_id")
    return both.select("range", F.row_number().over(w).alias("rn"), "copied", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    pairs = with_next(docs).select("range", "rn", "copied", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    texts = pairs.select("range", "rn", F.posexplode(F.array("text", "edited")).alias("kind", "said"))
    words = texts.select("range", "rn", "kind", F.explode(F.split("said", f"[{SPACES}]+")).alias("word"))
    # an empty text and its only, empty word give a row without a term
    terms = words.select("range", "rn", "kind", F.when(F.col("word") != "", F.xxhash64("word")).alias("h"))
    counts = terms.groupBy("range", "rn", "kind", "h").count()
    marks = least_samples(counts, ["range", "rn", "kind"], samples)
    w = W.partitionBy("range").orderBy("rn", "kind")
    joined = marks.withColumns({"edited_marks": F.lead("marks", 1).over(w), "next_marks": F.lead("marks", 2).over(w)}).where("kind = 0")
    judged = joined.select(
        "range", "rn", shown(F.col("marks")).alias("fingerprint"), shown(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks"), samples).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks"), samples).alias("near_next"),
    )
    own = pairs.where("not copied").select("range", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    return own.join(judged, ["range", "rn"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
