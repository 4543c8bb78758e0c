"""Merkle manifest, prefix trie and quality scores against brute force in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import common, merkle, quality, ranks, trie  # noqa: E402

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, tree string, digest string, leaf string, idx long"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _fields(d) -> str:
    shown = [None if d[c] is None else str(d[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return _h(*["-" if x is None else f"{len(x.encode())}:{x}" for x in shown])


def _tree(level: list[str]) -> tuple[str, list[list]]:
    """Root, and for each leaf its path of (place in the run, run)."""
    paths: list[list] = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + 2] for i in range(0, len(level), 2)]
        for k, a in enumerate(at):
            paths[k].append((a % 2, runs[a // 2]))
        level, at = [_h(*r) for r in runs], [a // 2 for a in at]
    return level[0], paths


def _manifest(rows: list[dict]) -> list[tuple]:
    by: dict = {}
    for d in rows:
        by.setdefault(d["lang"], []).append(d)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = {}, []
    for lang in langs:
        own = sorted(by[lang], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, _fields(d)))
        subroot, paths = _tree([_fields(d) for d in own])
        subroots.append(subroot)
        found[lang] = own, paths
    root, above = _tree(subroots)
    out = []
    for lang, subroot, up in zip(langs, subroots, above):
        for d, path in zip(*found[lang]):
            changed = dict(d)
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None:
                changed["n_chars"] += 1
            folded = _fields(changed)
            for a, run in path + up:
                folded = _h(*[folded if k == a else x for k, x in enumerate(run)])
            siblings = [x for a, run in path + up for k, x in enumerate(run) if k != a]
            out.append((d["doc_id"], _fields(d), subroot, root, _h(*siblings), folded, folded == root))
    return sorted(out, key=repr)


def _docs(n_large: int) -> list[dict]:
    rng = random.Random(3)
    rows = [dict(doc_id=i, text="t" * rng.randrange(9) + "é", source=rng.choice(["a", None]), lang="en", n_chars=rng.choice([i, None])) for i in range(n_large)]
    rows += [dict(doc_id=rng.choice([None, i, 5]), text=rng.choice([None, "", "x" * 70_000, "ü\n"]), source="s", lang=rng.choice([None, "", "de", "=", "-", "zz"]), n_chars=2**63 - 1) for i in range(40)]
    rows += [dict(rows[3])] * 5 + [dict(doc_id=None, text=None, source=None, lang=None, n_chars=None)] * 3 + [dict(doc_id=7, text="alone", source="s", lang="xx", n_chars=5)]
    rng.shuffle(rows)
    return rows


def _frame(spark, rows, parts=3):
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    full = [tuple(d.get(c, 1 if c == "idx" else "clash") for c in columns) for d in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def _got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("n", "height"), [(77, 10), (150, 2), (64, 3)])
def test_manifest_against_brute_force(spark, n, height):
    rows = _docs(n)
    got = _got(merkle.manifest(_frame(spark, rows), height))
    assert got == _manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    rows = _docs(0)
    assert merkle.manifest(_frame(spark, rows).limit(0)).count() == 0
    for few in ([rows[0]], [dict(doc_id=i, text="a", source="b", lang=f"l{i}", n_chars=i) for i in range(9)]):
        assert _got(merkle.manifest(_frame(spark, few))) == _manifest(few)


def test_sweeps_meet_nodes_in_the_order_of_labels():
    for n, at in ((1, 0), (2, 0), (5, 8), (8, 16)):
        digests = [bytes([k]) * 32 for k in range(n)]
        known = merkle.sweep_up(at, digests, 3)
        assert list(known) == sorted(known) and max(known) >> 48 == 3
        for place, suffix in merkle.sweep_down(known, b""):
            assert merkle.fold(digests[place - at], suffix) == known[max(known)]


def test_places_in_a_key_that_many_tasks_share(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.randrange(50)) for _ in range(3000)]
    out = ranks.ranked(spark.createDataFrame(rows, "key string, v int").repartition(5), "key", ["v"], "places")
    by: dict = {}
    for r in out.collect():
        by.setdefault(r["key"], []).append((r["idx"], r["v"]))
    want: dict = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert {k: [v for _, v in sorted(x)] for k, x in by.items()} == {k: sorted(x) for k, x in want.items()}
    assert all(sorted(i for i, _ in x) == list(range(len(x))) for x in by.values())
    same = spark.createDataFrame([("one",)] * 2000, "key string").repartition(4)
    assert sorted(r["idx"] for r in ranks.ranked(same, "key", [], "places").collect()) == list(range(2000))


# ---------------------------------------------------------------- trie
def _trie(rows: list[tuple]) -> list[tuple]:
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in convs.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(said.get(c - c % 100, [])[:h] + said[c][h:])
    nodes: dict = {}
    for c, x in whole.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    out = []
    for x, members in nodes.items():
        below = [y for y in nodes if y[: len(x)] == x]
        kids = [y for y in below if len(y) == len(x) + 1]
        leaves = [y for y in below if not any(z[:-1] == y for z in nodes if z)]
        saved = sum((len(nodes[y]) - 1) * len(y[-1][1]) for y in below if y)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(x))))
        parent = min(nodes[x[:-1]]) if x else None
        out.append((min(members), len(x), parent, len(members), len(kids), len(leaves), saved, _h(ends)))
    return sorted(out, key=repr)


def _conversations() -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 399, 1000, 1001]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, ""]), rng.choice(["a", "bé", None, "long " * 40])))
    rows += [(c, t, "user", "same") for c in range(300, 330) for t in range(4)]
    rows += [(77, t, "u", f"w{t}") for t in range(60)] + [rows[0]] * 3 + [(None, 1, "user", "nobody")] * 4
    return rows


def test_trie_against_brute_force(spark, monkeypatch):
    rows = _conversations()
    schema = "conv_id long, turn long, role string, text string, idx int, seq string"
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], schema).repartition(4)
    want = _trie(rows)
    assert _got(trie.trie(df)) == want
    monkeypatch.setattr(trie, "STRETCH", 7)
    monkeypatch.setattr(trie, "PART", 3)
    assert _got(trie.trie(df)) == want
    assert trie.trie(df.limit(0)).count() == 0
    assert trie.trie(df.where("conv_id is null")).count() == 0


def test_trie_of_one_conversation(spark):
    rows = [(5, None, None, None)]
    assert _got(trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == _trie(rows)


# ---------------------------------------------------------------- quality
_TEXTS = [None, "", "  \n", "a", "Ab abc", "one one two two one", "é über  naïve\tword", "x" * 500, "na " * 40, "The end.", "The end. of it all " * 30]


def _plain_features(text: str | None) -> Counter:
    """Features by name, from plain Python."""
    words = (text or "").encode().split()
    out = Counter(["every"])
    for k, w in enumerate(words):
        out[("word", w)] += 1
        if w in words[max(0, k - quality.BACK) : k]:
            out["repeated"] += 1
        for n in quality.GRAMS:
            for p in range(len(w) - n + 1):
                out[("gram", w[p : p + n])] += 1
                if p == 0:
                    out[("begin", w[:n])] += 1
                if p + n == len(w):
                    out[("end", w[p:])] += 1
    return out


def _number(name) -> int:
    if name in ("every", "repeated"):
        return {"every": quality.EVERY, "repeated": quality.REPEATED}[name]
    kind, raw = name
    base = pow({"word": common.B1}.get(kind, common.B2), 1, 1 << 64)
    h = sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(raw)) % (1 << 64)
    h = common.mix(np.array([h], np.uint64))
    if kind in ("begin", "end"):
        h = common.mix(h ^ (quality._BEGINS if kind == "begin" else quality._ENDS))
    return int(quality._bucket(h)[0])


def test_quality_features_against_plain_python(monkeypatch):
    want = []
    for t in _TEXTS:
        found = Counter()
        for name, n in _plain_features(t).items():
            found[_number(name)] += n
        want.append(found)
    for long in (common.LONG, 200):
        monkeypatch.setattr(common, "LONG", long)
        for (ids, counts), found in zip(quality.bags(pa.array(_TEXTS), 10**6), want):
            assert dict(zip(ids.tolist(), counts.tolist())) == dict(found)
        numbers = np.random.default_rng(1).normal(size=quality.BUCKETS)
        z = quality.logits(pa.array(_TEXTS), numbers)
        assert np.allclose(z, [sum(numbers[i] * n for i, n in f.items()) / sum(f.values()) for f in want])


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(2)
    model = quality.Model.new(7)
    model.layer[:] = rng.normal(size=model.layer.shape)
    ids, shares = np.array([0, 5, 9], np.int32), np.array([0.5, 0.25, 0.25], np.float32)

    def loss(vectors, layer):
        z = layer @ (shares @ vectors[ids])
        return np.log(np.exp(z).sum()) - z[1]

    v, w = model.vectors.astype(float), model.layer.astype(float)
    slope = np.zeros(quality.DIM)
    for d in range(quality.DIM):
        up = v.copy()
        up[5, d] += 1e-5
        slope[d] = (loss(up, w) - loss(v, w)) / 1e-5
    model.learn([(ids, shares)], np.array([1]), np.array([0.1]), rng)
    assert np.allclose((v[5] - model.vectors[5]) / 0.1, slope, atol=1e-3)


def test_quality_scores(spark):
    rng = random.Random(11)
    good = lambda: " ".join(rng.choice(["river", "stone", "of", "the", "walks", "über"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["rvr###", "st$$", "%%of", "TH!!", "wlk&&"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), i) for i in range(400)] + [(None, "the river", 0), (500, None, 0), (500, "", 0), (3, good(), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, None, 0), (2, 7, 0), (None, 1, 0), (900, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.scores(docs, labels).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    of = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(501)}
    known = out[out.doc_id.notna()]
    assert [of[int(i)] for i in known.doc_id] == known.held_out.tolist() and not out[out.doc_id.isna()].held_out.any()
    held = out[out.held_out & (out.doc_id < 400)]
    assert (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.97
    assert out[out.doc_id == 500].score.nunique() == 1
    again = quality.scores(docs.repartition(5), labels).toPandas()
    assert np.allclose(np.sort(again.score), np.sort(out.score), rtol=0, atol=1e-12)
    one = quality.scores(docs, labels.where("quality = 1")).toPandas()
    assert (one.score == 1).all() and (quality.scores(docs, labels.limit(0)).toPandas().score == 0).all()
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert quality.labelled_bags(docs, labels, 50, 100, 2, 1).count() in (49, 50)  # the label of 900 has no document
    assert quality.labelled_bags(docs, labels, 10**6, 100, 2, 1).where(F.octet_length("ids") > 200).count() == 0
