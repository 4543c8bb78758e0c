"""The corpus pipeline, stage by stage and as a whole, against brute force on a small fixture with every odd case."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from tests.llm.test_corpus_operators import _components  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string, row string"


def _rows() -> list[tuple]:
    rng = random.Random(21)
    say = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(60)}" for _ in range(n))
    base, shared = say(90), say(60)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \n ", "one", base, " ".join(near), base, shared + " " + say(40), say(30) + " " + shared, say(300), "you idiot " * 12 + say(20), "stupid moron you are scum " * 9, say(5000)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), f"x{i}", "r") for i, t in enumerate(texts)]
    return [*rows, rows[9], (9, "another text of nine " + say(20), "de", "a", 1, "y", "r"), (None, base, "en", "b", 1, "z", "r"), (None, None, None, None, None, None, None), (30, shared, "en", "a", 1, "w", "r")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(22)
    spark.createDataFrame(_rows(), COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    # labels of the fixture's own documents, and of none
    bad = {10, 11}
    labels = [(i, 1, int(i in bad)) for i in range(13)] + [(900 + rng.randrange(90), 1, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.read.parquet(f"{table}/documents.parquet")


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_and_columns(spark, docs, table):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated passages", "mixing", "packing"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, table).columns == docs.columns
        assert stage(spark, docs.limit(0), table).count() == 0
    assert pipeline.pack_sequences(spark, docs.limit(0), table).count() == 0


def test_toxicity_drops_what_scores_high(spark, docs, table):
    from tidemark.llm import toxicity

    scores = toxicity.scores(docs, spark.read.parquet(f"{table}/labels.parquet"))
    assert pipeline.drop_toxic(spark, docs, table).count() == scores.where("predicted = 0").count()


def test_near_duplicates(spark, docs, table):
    rows = _rows()
    kept = {i for i, _, _, k in _components([r[:2] for r in rows], 5, 80) if k and i is not None}
    want = [r for r in rows if r[0] is None or r[0] in kept]
    assert 5 not in kept and 6 not in kept and 4 in kept
    assert _sorted(pipeline.drop_near_duplicates(spark, docs, table)) == sorted(want, key=repr)


def _without_passages(rows):
    order = lambda i: 2**63 - 1 if i is None else i
    first: dict = {}
    for r in rows:
        w = (r[1] or "").split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, 2**63 - 1), order(r[0]))
    out = []
    for r in rows:
        w = (r[1] or "").split()
        cut = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < order(r[0]) for q in range(p, p + 50)}
        if not cut:
            out.append(r)
        elif len(cut) < len(w):
            text = " ".join(x for k, x in enumerate(w) if k not in cut)
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def test_repeated_passages(spark, docs, table):
    assert _sorted(pipeline.drop_repeated_passages(spark, docs, table)) == sorted(_without_passages(_rows()), key=repr)


def test_columns_named_like_those_of_operators_pass_through(spark, docs, table):
    from pyspark.sql import functions as F

    named = docs.withColumns({"kept": F.lit("mine"), "n_removed": F.lit("x"), "longest": F.lit(1.5), "n_words": F.lit(True), "is_copy": F.lit(7)})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, named, table)
        assert out.columns == named.columns and out.select("kept", "n_removed", "longest", "n_words", "is_copy").distinct().collect() == [("mine", "x", 1.5, True, 7)]


def test_mixing_and_packing(spark, docs, table):
    from tidemark.llm import mixing

    mixed = spark.createDataFrame(pipeline.mix_sources(spark, docs, table).collect(), docs.schema)
    words = lambda t: len((t or "").split())
    rows, total = mixed.collect(), sum(words(r[1]) for r in _rows())
    plan = mixing.mix_plan(docs).collect()
    assert sum(words(r["text"]) for r in rows) == sum(r["taken"] for r in plan) and abs(sum(r["taken"] for r in plan) - total) <= 0.1 * total
    assert all(r["n_chars"] == len(r["text"]) and words(r["text"]) for r in rows)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = pipeline.pack_sequences(spark, mixed, table).collect()
    assert sum(r["length"] for r in out) == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows)
    filled: dict = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


def test_whole_run(spark, table):
    """Toxicity decides by its model; the stages behind it by rule."""
    docs = spark.read.parquet(f"{table}/documents.parquet")
    rows = [tuple(r) for r in pipeline.drop_toxic(spark, docs, table).collect()]
    kept = {i for i, _, _, k in _components([r[:2] for r in rows], 5, 80) if k and i is not None}
    rows = _without_passages([r for r in rows if r[0] is None or r[0] in kept])
    mixed = pipeline.mix_sources(spark, spark.createDataFrame(rows, docs.schema), table).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: dict = {}
    for r in mixed:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(t.encode(r["text"], add_special_tokens=False).ids) + 1
    got: dict = {}
    for r in pipeline.run(spark, table).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_the_mix_shuffles_texts_once(spark):
    """A table with a row for each million words joins without moving texts again."""
    from tidemark.llm import mixing

    docs = spark.createDataFrame([(i, "a b c " * i, f"s{i % 3}", i) for i in range(40)], "doc_id long, text string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 0 and plan.count("Exchange hashpartitioning") == 1
