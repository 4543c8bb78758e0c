"""Corpus operators against brute force, over texts with every odd case: nulls, empty and long texts, ties, copies."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import chat, common, fingerprints, minhash, mixing, neighbours, packing, substring, suffix, token_files, toxicity  # noqa: E402

WORDS = ["der", "la", "thing", "of", "é", "zu", "and", "mente", "über", "stone", "river", "ñandú"]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, n_words long, row string, kept string, doc string"


def _texts() -> list[tuple]:
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    shared, base = some(70), some(120).split()
    near = base[:50] + ["changed"] + base[51:]
    texts = [
        None, "", "   \n\t ", "one", "one two", shared, some(10) + "\n" + shared + " " + some(5), shared, shared + "  " + some(80), " ".join(base), " ".join(near), " ".join(near), "na " * 300, "na " * 300 + "end",
        "It's <|endoftext|> 12 ½ x²  İ Σ", "  é\x1c z", some(3000), "x" * 5000, "ONE two", some(60), "don't  stop\n\n now ",
    ]
    rows = [(i, t, ["b", "a", None][i % 3], "en", len(t or ""), 1, "r", "k", "d") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "null id " + shared, "a", "en", 1, 1, "r", "k", "d"), (40, shared, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def _repeats(rows, length):
    """Brute force of the suffix operator: (doc_id, n_bytes, n_removed, n_spans, sha256 of what stays)."""
    seen, raws = Counter(), [(t or "").encode() for _, t in rows]
    for x in raws:
        seen.update(x[p : p + length] for p in range(len(x) - length + 1))
    out = []
    for (i, _), x in zip(rows, raws):
        hit = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                hit[p : p + length] = True
        spans = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        out.append((i, len(x), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~hit].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_of_passages_cut_at_many_places(spark):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdef ghijé") for _ in range(1500))
    rows = []
    for i in range(150):
        a = rng.randrange(900)
        own = "".join(rng.choice("uvwxyz ") for _ in range(rng.randrange(300)))
        rows.append((i, own + passage[a : a + rng.randrange(300, 1400)] + own[::-1]))
    rows += [(None, rows[3][1])] * 3 + [(7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _repeats(rows, 400)
    for most in (2_000, 20):
        old, suffix.repeated_spans.__defaults__ = suffix.repeated_spans.__defaults__, (400, 64, most)
        try:
            got = _rows(suffix.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) h"), "doc_id", "n_bytes", "n_removed", "n_spans", "h")
        finally:
            suffix.repeated_spans.__defaults__ = old
        assert got == want


def _anchors(words):
    """Where a window of 50 words has the least hash of those in 100 words."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    h = common.word_hashes(data, np.array([0, len(data)]))[0]
    at = np.arange(max(0, len(h) - 49))
    w = common.windows(common.prefix(h, common.B2), common.B2, at, at + 50)
    high = (w >> np.uint64(32)).tolist()
    return {min(range(p, p + 51), key=lambda q: (high[q], q)) for p in range(len(high) - 50)}


def test_substring_against_brute_force(docs, empty):
    first, last, level = {}, {}, 50
    rows = [(r[0] if r[0] is not None else common.NO_ID, r[0], (r[1] or "").encode().split()) for r in _texts()]
    longest = [0] * len(rows)
    while level <= max(len(w) for _, _, w in rows):
        held: dict = {}
        for d, _, w in rows:
            for p in range(len(w) - level + 1):
                held.setdefault(tuple(w[p : p + level]), set()).add(d)
        if level == 50:
            first = {k: min(v) for k, v in held.items()}
            going = [{p for p in range(len(w) - 49) if len(held[tuple(w[p : p + 50])]) > 1} for _, _, w in rows]
            whole = [len({d for (d, _, _), q in zip(rows, _texts()) if q[1] == r[1]}) > 1 for r in _texts()]
        elif level == 100:
            going = [g & _anchors(w) for g, (_, _, w) in zip(going, rows)]
        held = {}
        for g, (d, _, w) in zip(going, rows):
            for p in g:
                if p + level <= len(w):
                    held.setdefault(tuple(w[p : p + level]), set()).add(d)
        for n, (g, (_, _, w)) in enumerate(zip(going, rows)):
            going[n] = {p for p in g if p + level <= len(w) and len(held[tuple(w[p : p + level])]) > 1}
            if going[n] or whole[n] and len(w) >= level:
                longest[n] = level
        level *= 2
    want = []
    for (d, i, w), n in zip(rows, longest):
        cut = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < d for q in range(p, p + 50)}
        want.append((i, len(w), len(cut), b" ".join(x for k, x in enumerate(w) if k not in cut).decode(), n))
    assert max(longest) >= 200
    assert _rows(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept", "longest") == sorted(want, key=repr)
    out = substring.remove_repeats(empty)
    assert out.count() == 0 and "row" in out.columns


def test_suffix_against_brute_force(docs, empty):
    out = suffix.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) h")
    assert _rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == _repeats([r[:2] for r in _texts()], 400)
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_by_window_hashes_agrees(docs):
    rows = substring.keyed(docs).dropDuplicates(["doc", "rk"])
    few, many = (suffix.repeated_spans(rows, most=m) for m in (0, 20_000))
    assert _rows(few, "doc", "starts", "ends") == _rows(many, "doc", "starts", "ends")


def test_merge_of_shard_transforms():
    rng = random.Random(9)
    for length, shard in ((20, 50), (33, 16), (64, 1 << 16)):
        base = bytes(rng.randrange(2) for _ in range(90))
        phrases = [base[: rng.randrange(30, 90)] if rng.random() < 0.5 else bytes(rng.randrange(2) for _ in range(rng.randrange(5, 90))) for _ in range(30)] + [b"\0" * 200]
        data, ends = np.frombuffer(b"".join(phrases), np.uint8), np.cumsum([len(x) for x in phrases])
        order, block = suffix.merge_transforms(data, ends, length, shard)
        at = [e - len(x) + k for x, e in zip(phrases, ends) for k in range(len(x) - length + 1)]
        said = lambda p: data[p : p + length].tobytes()
        assert sorted(order.tolist()) == at and [said(p) for p in order] == sorted(map(said, at))
        assert all((block[k] == block[k - 1]) == (said(order[k]) == said(order[k - 1])) for k in range(1, len(order)))


def _shingles(text, size):
    w = (text or "").encode().translate(bytes(common._LOWER)).split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def _components(rows, size, percent):
    """Brute force of (doc_id, n_shingles, component_id, kept): documents are linked by any of their texts."""
    sets = [(i, _shingles(t, size)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    links = [(i, j) for i, x in sets for j, y in sets if i is not None and j is not None and x and 100 * len(x & y) >= percent * len(x | y)]
    for _ in label:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return sorted(((i, len(x), label[i] if x and i is not None else i, i is None or not x or label[i] == i) for i, x in sets), key=repr)


def test_minhash_against_brute_force(spark, docs, empty):
    found = ("doc_id", "n_shingles", "component_id", "kept")
    assert _rows(minhash.near_duplicates(docs, size=3, percent=85), *found) == _components([r[:2] for r in _texts()], 3, 85)
    assert minhash.near_duplicates(empty).count() == 0
    # rows that share a doc_id, with the same text and with others
    text = lambda *skip: " ".join(f"w{i}" for i in range(17) if i not in skip)
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, other), (1, text(16)), (2, text(16)), (3, other + " end"), (4, text()), (4, text()), (5, "alone here and now"), (5, "quite another text of it"), (None, text()), (6, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _rows(minhash.near_duplicates(df, size=3, percent=85), *found) == _components(rows, 3, 85)


def test_minhash_links_all_of_a_large_template_group(spark):
    rng = random.Random(8)
    template = [f"w{i}" for i in range(120)]

    def fill(words, k):
        words = list(words)
        for p in rng.sample(range(len(words)), k):
            words[p] = f"x{rng.randrange(10**9)}"
        return words

    texts = [fill(template, 3) for _ in range(2000)]
    texts += [fill(texts[i], 1) for i in rng.sample(range(2000), 200)]
    sets = [_shingles(" ".join(t), 3) for t in texts]
    number: dict = {}
    m = np.zeros((len(texts), len(set().union(*sets))), np.float32)
    for i, x in enumerate(sets):
        m[i, [number.setdefault(g, len(number)) for g in x]] = 1
    n, shared = m.sum(1), m @ m.T
    label = list(range(len(texts)))
    for _ in range(4):
        for i, j in zip(*np.nonzero(100 * shared >= 85 * (n[:, None] + n[None, :] - shared))):
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = [(i, c) for i, c in enumerate(label)]
    assert len(set(label)) > 1700
    assert _rows(minhash.near_duplicates(docs, size=3, percent=85), "doc_id", "component_id") == sorted(want, key=repr)
    assert _rows(minhash.near_duplicates(docs, size=3, percent=85, block=400), "doc_id", "component_id") == sorted(want, key=repr)


def test_very_long_texts_in_stretches(spark, monkeypatch):
    """A text of many stretches gives what it gives in one piece."""
    rng = random.Random(14)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randrange(3000)}" for _ in range(9000))
    other = long[:30000] + " cut " + long[30400:] + " " + "z" * 3000
    rows = [(1, long), (2, other), (3, long[5000:25000]), (4, " ".join(long.split()[200:900])), (5, "y" * 9000), (6, "y" * 9000 + "x")]

    def all_of():
        ids = pa.array([r[0] for r in rows])
        batch = pa.record_batch([pa.array([r[1] for r in rows]), ids, pa.array([hash(r[1]) % 1000 for r in rows], pa.int64()), ids], names=["text", "doc", "rk", "node"])
        listed = pa.record_batch([*batch.columns, pa.array([list(range(0, max(1, len(r[1].split()) - 60), 3)) for r in rows], pa.list_(pa.int32()))], names=[*batch.schema.names, "pos"])
        gather = lambda f: {tuple(x.values())[:5] for out in f(iter([listed])) for x in out.to_pylist()}
        places = {(x["doc"], x["lo"] + k) for out in suffix._parse(400, 64)(iter([batch])) for x in out.to_pylist() for k in range(x["hi"] - x["lo"] + 1)}
        sets = {r: s.tolist() for r, s in minhash._shingle_sets(batch, 3)}
        return gather(substring._anchors(50, 25)), gather(substring._extended(50, 25)), places, sets

    whole = all_of()
    monkeypatch.setattr(common, "LONG", 5000)
    monkeypatch.setattr(common, "slices", lambda offsets, most=0: ((k, k + 1) for k in range(len(offsets) - 1)))
    parts = all_of()
    assert len(whole[1]) > 5000
    assert [a == b for a, b in zip(whole, parts)] == [True] * 4


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "x long, y long")
    found = {r["node"]: r["component"] for r in minhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_mixing(docs, empty, spark):
    out = mixing.mix_plan(docs).toPandas()
    assert len(out) == len(_texts()) and (out.taken <= 3 * out["size"]).all()
    by = out.assign(source=out.source.fillna("~")).groupby("source")
    sizes = by["size"].sum()
    assert (by.source_size.first() == sizes).all() and abs(by.target.first().sum() - sizes.sum()) < 1e-6
    assert (abs(by.taken.sum() - by.target.first()) <= 33).all()
    # targets by repeated resharing
    weight, cap, left = dict(zip(sorted(sizes.index), (5, 2, 1))), 3 * sizes, sizes.sum()
    target, open_ = {}, set(sizes.index)
    while True:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap[s]}
        if not full:
            break
        target |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    assert all(abs(by.target.first()[s] - v) < 1e-6 for s, v in (target | share).items() if s in open_ or s in target)
    again = mixing.mix_plan(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, out[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    parts = mixing.mix(docs).selectExpr("size(split(trim(text), '[ \\t\\n\\r\\u000c\\u000b]+')) n", "*")
    assert parts.columns[1:] == docs.columns and parts.agg({"n": "sum"}).first()[0] == out.taken.sum()
    assert mixing.mix(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    p = packing.pack_documents(docs, path, capacity=256).toPandas()
    ids = {repr((r[0], r[1])): [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in _texts()}
    assert p.length.sum() == sum(len(ids[repr((r[0], r[1]))]) for r in _texts())
    one = {r[0]: ids[repr((r[0], r[1]))] for r in _texts()}
    for r in p.dropna(subset=["doc_id"]).itertuples():
        assert zlib.crc32(np.array(one[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    full = p.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (full.cumsum() - p.sort_values(["sequence_id", "offset"]).length == p.sort_values(["sequence_id", "offset"]).offset).all() and full.sum().max() <= 256
    assert p.sequence_id.nunique() == -(-p.length.sum() // 256)
    assert packing.pack_documents(empty, path).count() == 0


def test_bin_completion():
    rng = random.Random(2)
    for n in (1, 5, 40, 400):
        items = [rng.randrange(1, 100) for _ in range(n)]
        bins = packing.complete(items, 100)
        assert sorted(x for b in bins for x in b) == sorted(items) and max(map(sum, bins)) <= 100 and len(bins) <= len(packing.best_fit(items, 100))
        many = packing.patterns(dict(Counter(items * 50)), 100, tail=100)
        assert sum((Counter({x: k * m for x, k in Counter(b).items()}) for b, m in many), Counter()) == Counter(items * 50)
    assert len(packing.complete([6, 6, 5, 5, 4, 4, 3, 3, 2, 2], 10)) == 4


def test_packing_of_many_short_pieces():
    rng = random.Random(4)
    for histogram in ({100: 1_000_000}, {7: 30_000, 90: 2_000, 333: 900}, dict(Counter(rng.randrange(20, 400) for _ in range(6000))), dict(Counter(min(2048, int(rng.lognormvariate(4.5, 1)) + 1) for _ in range(20_000)))):
        bins = packing.patterns(histogram, 2048)
        assert sum((Counter({x: k * m for x, k in Counter(b).items()}) for b, m in bins), Counter()) == Counter(histogram)
        assert max(sum(b) for b, _ in bins) <= 2048
        n = sum(m for _, m in bins)
        assert n <= sum(m for _, m in packing.best_fit_patterns(histogram, 2048))
        assert packing.lower_bound(histogram, 2048) <= n <= packing.lower_bound(histogram, 2048) + (1 if 100 not in histogram or len(histogram) > 1 else 1200)
    assert sum(m for _, m in packing.patterns({100: 1_000_000}, 2048)) == 50_000
    # the search finds what best fit does not
    assert sum(m for _, m in packing.best_fit_patterns({6: 200, 5: 100, 4: 100, 3: 300}, 15)) >= sum(m for _, m in packing.patterns({6: 200, 5: 100, 4: 100, 3: 300}, 15, tail=10)) >= packing.lower_bound({6: 200, 5: 100, 4: 100, 3: 300}, 15)


def test_best_fit_of_a_histogram_equals_that_of_items():
    rng = random.Random(6)
    for _ in range(200):
        items = [rng.randrange(1, rng.choice((5, 30, 100))) for _ in range(rng.randrange(1, 80))]
        bins: list[list[int]] = []
        for x in sorted(items, reverse=True):
            fit = [b for b in bins if sum(b) + x <= 100]
            if fit:
                max(fit, key=sum).append(x)
            else:
                bins.append([x])
        assert len(packing.best_fit(items, 100)) == len(bins) >= packing.lower_bound(Counter(items), 100)
        room = rng.randrange(1, 60)
        have, counts = sorted(set(items)), Counter(items)
        sums = {0}
        for x in items:
            sums |= {y + x for y in sums if y + x <= room}
        found = packing.fillings(room, have, counts)
        assert max(map(sum, found), default=0) == max(sums) and all(not Counter(f) - counts for f in found)


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    manifest = token_files.write_documents(docs, path, common.new_path(spark, "t"), files=3)
    rows = sorted(_texts(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    ids, start, want = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows], 0, []
    for r, x in zip(rows, ids):
        want.append((r[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert _rows(token_files.read_files(manifest), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    got = {r["doc_id"]: list(r["ids"]) for r in token_files.read_documents(spark, manifest, [3, 16]).collect()}
    assert got == {r[0]: x for r, x in zip(rows, ids) if r[0] in (3, 16)}
    assert token_files.read_files(token_files.write_documents(empty, path, common.new_path(spark, "t"))).count() == 0


def test_damaged_frames_are_found():
    import io

    out = io.BytesIO()
    w = token_files.Writer(out, frame_ids=10)
    for k in range(9):
        w.add(k, np.arange(k, dtype=np.uint32))
    w.close()
    assert [len(x) for _, x in token_files.Reader(io.BytesIO(out.getvalue())).documents()] == list(range(9))
    raw = bytearray(out.getvalue())
    raw[12] ^= 255
    with pytest.raises(Exception):
        list(token_files.Reader(io.BytesIO(bytes(raw))).documents())


def test_encoder_equals_library():
    rng = random.Random(1)
    odd = ["it's I'LL 'S", "a  b   c\n\n d\t\te ", "  lead", "x²½Ⅷ", "漢字 テスト", "é É", "a_b__c-d...", "12 345", "<|endoftext|>a", " a\u0085b", "ÀÉ ñÑ ßẞ İı Σς"]
    chars = "ab é'.,-_12 \n\tÉß<|>"
    texts = odd + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(400)]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        e = common.Encoder(public_tokenizers.path(name), drops, most=500)
        for a in range(0, len(texts), 37):
            part = texts[a : a + 37]
            assert [list(x) for x in e.encode(part)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in part]


def _edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [r[1] or "" for r in rows]
    return sorted((repr(r[0]), len(x), hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest()) for r, x, y in zip(rows, texts, texts[1:] + texts[:1]))


def _got(out):
    return sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out.collect())


def test_fingerprints(docs, empty):
    found = fingerprints.fingerprints(docs)
    out = found.toPandas()
    assert _got(found) == _edited([r[:2] for r in _texts()])
    assert out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
    same = out[out.doc_id.isin([5, 7, 40])].fingerprint
    assert same.nunique() == 1 and out[out.doc_id.isin([1, 2])].fingerprint.nunique() == 1
    assert fingerprints.fingerprints(empty).count() == 0


def test_next_documents_of_outlying_and_missing_ids(spark):
    rng = random.Random(7)
    rows = [(i * 3, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))) for i in range(300)]
    rows += [(10**15, "far away"), (-(10**12), "below"), (2**63 - 1, "top"), (-(2**63), "least")]
    rows += [(None, "the same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = fingerprints.with_next(df.union(spark.createDataFrame([(None, f"no id {i}") for i in range(150)], df.schema)), ranges=16)
    assert found.where("not copied").groupBy("range").count().agg({"count": "max"}).first()[0] < 100
    assert _got(fingerprints.fingerprints(df)) == _edited(rows)
    for few in (rows[:1], rows[:2], [(None, None)]):
        assert _got(fingerprints.fingerprints(spark.createDataFrame(few, "doc_id long, text string"))) == _edited(few)


def test_fingerprints_against_a_plain_sampler(spark):
    """Marks of whole texts, drawn again in plain Python from the same hashes."""
    texts = ["a b b c", "a b b c c c d", "x", "tie tie tie other other", "b a c b"]
    spark_hash = {}
    words = sorted({w for t in texts for w in t.split()})
    frame = spark.createDataFrame([(w,) for w in words], "word string").selectExpr("word", "xxhash64(word) as h")
    n = fingerprints.SAMPLES
    for r in frame.selectExpr("word", *[f"xxhash64(h, {k}) as c{k}" for k in range(2 * n)]).collect():
        spark_hash[r["word"]] = [r[f"c{k}"] & (2**64 - 1) for k in range(2 * n)]
    uniform = lambda h, at, bits: ((h >> at & ((1 << bits) - 1)) + 0.5) / (1 << bits)

    def least(text, k):
        best = []
        for w, c in Counter(text.split()).items():
            one, two = spark_hash[w][2 * k], spark_hash[w][2 * k + 1]
            r, b = -np.log(uniform(one, 0, 21) * uniform(one, 21, 21)), uniform(one, 42, 21)
            t = np.floor(np.log(c) / r + b)
            y = np.exp(r * (t - b))
            best.append((-np.log(uniform(two, 0, 32) * uniform(two, 32, 32)) / (y * np.exp(r)), w, t))
        return min(best)[1:]

    out = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    cut = lambda f: [f[4 * k : 4 * k + 4] for k in range(n)]
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            same = [a == b for a, b in zip(cut(out[i]["fingerprint"]), cut(out[j]["fingerprint"]))]
            assert same == [least(x, k) == least(y, k) for k in range(n)]
        if i:
            assert out[i]["near_next"] == sum(least(x, k) == least(texts[i - 1], k) for k in range(n)) / n


def test_fingerprints_estimate_weighted_jaccard(spark):
    a, b = "x x x y z w " * 30 + "q " * 50, "x x y y v w " * 30 + "q " * 20
    for samples in (96,):
        out = fingerprints.fingerprints(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"), samples=samples).toPandas()
        u, v = Counter(a.split()), Counter(b.split())
        assert abs(out.near_next.iloc[0] - sum((u & v).values()) / sum((u | v).values())) < 0.2


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(300, 24)), 1)
    v[7], v[150] = v[3], v[3]
    rows = [(i, [float(np.float32(x)) for x in r], "e") for i, r in enumerate(v)] + [(900, None, "e"), (1000, [0.0] * 24, "e"), (1100, [float("nan")] * 24, "e"), (1200, [1.0, None], "e"), (1300, [1.0], "e"), (None, [1.0] * 24, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = _rows(neighbours.nearest(df, df.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score")
    x = np.array([[np.float32(y) for y in r] for r in v], np.float64)
    want = []
    for q in range(0, 300, 50):
        d = sorted((float(np.sqrt(np.add.accumulate((x[c] - x[q]) ** 2)[-1])), c) for c in range(300) if c != q)[:10]
        want += [(q, k + 1, c, s) for k, (s, c) in enumerate(d)]
    assert got == sorted(want, key=repr)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert _rows(neighbours.nearest(few, few), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", "c"), (4, 0, "user", "b"), (4, 0, "user", "b"), (5, None, None, None), (None, 0, "user", "a"), (6, 1, "user", "x"), (6, 1, "bot", "x")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, n string")
    got = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert sorted(got) == [2, 4, 5, 6] and got[2]["n_turns"] == 3 and got[2]["n_equal"] == 2 and got[4]["n_turns"] == 1
    assert got[5]["text"] == "<|unknown|>\n\n<|end|>\n" and got[6]["text"].startswith("<|bot|>")
    assert chat.render(df.limit(0)).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(3)
    say = lambda bad: " ".join(rng.choice(["stone", "river", "walk", "green"] + ["idiot", "glurbish", "you"] * bad) for _ in range(40))
    rows = [(i, say(i % 4 == 0), "z") for i in range(240)] + [(500, None, "z"), (501, "", "z"), (None, "you idiot", "z"), (0, "again", "z")]
    labels = [(i, int(i % 4 == 0), 1) for i in range(0, 240)] + [(700, 1, 1), (None, 1, 1), (3, None, 1)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = toxicity.scores(d, lab, trees=5).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    held = out[out.held_out.fillna(False).astype(bool) & (out.doc_id < 240)]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.95
    assert all((zlib.crc32(str(int(i)).encode()) % 5 == 0) == h for i, h in zip(out.doc_id, out.held_out) if i == i)
    assert toxicity.clean(d, lab, trees=5).columns == d.columns
    assert toxicity.scores(empty, lab, trees=2).count() == 0
    assert set(toxicity.scores(d, lab.where("toxic = 0"), trees=2).toPandas().score) == {0.0}


def test_toxicity_features_against_plain_python():
    import re

    learned = ("thei", "stoneb", "foo$")
    single = [w for w in toxicity.LEXICON if " " not in w]
    rng = random.Random(31)
    words = [*single, *toxicity.SECOND_PERSON, "shut", "up", "SHUT", "kill", "Yourself", "their", "theirs", "thei", "the", "foo", "food", "stonebridge", "É", "Élan", "naïve", "aaa", "no.", "3.14", "«well»", "—", "ok!!!"]
    texts = [None, "", "  ", "idiot", "İ ß ñ", "you " * 4 + "idiot"] + [" ".join(rng.choice(words) + rng.choice(["", "", ",", "!", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]

    def plain(text):
        text = text or ""
        runs = re.findall(r"[\w]+", re.sub("[\u0080-\u00bf\u2000-\u203f]", " ", text.lower()))
        bad = [w in single or w == "foo" or w.startswith("thei") or w.startswith("stoneb") for w in runs]
        for i in range(len(runs) - 1):
            bad[i] |= f"{runs[i]} {runs[i + 1]}" in toxicity.LEXICON
        you = [w in toxicity.SECOND_PERSON for w in runs]
        near = sum(b and any(you[j] for j in range(max(0, i - 5), min(len(runs), i + 6)) if j != i) for i, b in enumerate(bad))
        n, m = max(1, len(text)), max(1, len(text.split()))
        return {
            "insults": sum(bad) / m, "has_insult": float(any(bad)), "distinct_insults": len({w for w, b in zip(runs, bad) if b}), "near_you": near / m, "you": sum(you) / m if any(bad) else 0.0,
            "capitals": sum(c.isupper() for c in text) / n, "punctuation": sum(c in "!?.,;:" for c in text) / n, "marks": text.count("!") / n, "obfuscation": sum(c in "@$*#%&" for c in text) / n,
            "stretched": float(bool(re.search(r"([A-Za-z0-9_])\1\1", text))), "length": np.log1p(len(text)),
        }

    texts = [t if t is None else t.replace("İ", "I") for t in texts]
    data, offsets = common.text_bytes(pa.array(texts, pa.string()))
    got = toxicity.Lexicon(learned).features(data, offsets)
    for row, text in zip(got, texts):
        for name, value in plain(text).items():
            assert abs(row[toxicity.FEATURES.index(name)] - value) < 1e-9, (name, text)
    disguised = ["1d10t", "st*pid", "i.d.i.o.t", "TR@SH!", "b4st4rd,", "@sshole", "$cum"]
    fine = ["idiot.", "idiot!", "stupid", "3.14", "a*b", "e-mail", "you"]
    for group, n in ((disguised, 1), (fine, 0)):
        data, offsets = common.text_bytes(pa.array(group, pa.string()))
        assert toxicity.Lexicon().features(data, offsets)[:, toxicity.FEATURES.index("obfuscated_insults")].tolist() == [n] * len(group)
