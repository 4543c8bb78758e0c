"""The engine's own operators on small fixtures with results by hand or by a plain loop."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.rolling import ewm
from tidemark.operators import ablation, gates, graph, metrics, options, papers, pit, quality, rotation, signals, specs, store
from tidemark.operators import backtest as bt
from tidemark.sources import landed

DAY = date(2024, 1, 1)


def _bars(spark, closes: dict[str, list], **spread):
    rows = [(s, DAY + timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), 1000.0 + i) for s, cs in closes.items() for i, c in enumerate(cs) if c is not None]
    return spark.createDataFrame(rows, "symbol string, t date, open double, high double, low double, close double, volume double")


def _walk(n, seed=1):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= 1 + rng.uniform(-0.02, 0.02)
        out.append(x)
    return out


@pytest.mark.parametrize("alpha", [1 / 3, 1 / 14, 2 / 101, 1.0])
def test_ewm_equals_the_recursion(spark, alpha):
    walk = _walk(1500)
    out = ewm(_bars(spark, {"A": walk}), "y", "close", alpha).orderBy("t").toPandas()["y"]
    assert (out - pd.Series(walk).ewm(alpha=alpha, adjust=False).mean()).abs().max() < 1e-8


def test_ewm_skips_leading_nulls(spark):
    rows = _bars(spark, {"A": _walk(60)}).withColumn("x", F.expr("close - lag(close) over (partition by symbol order by t)"))
    got = ewm(rows, "y", "x", 0.2).orderBy("t").toPandas()
    assert math.isnan(got["y"][0]) and (got["y"] - got["x"].ewm(alpha=0.2, adjust=False).mean()).abs().max() < 1e-9


@pytest.mark.parametrize("name", ["MOMENTUM", "RSI", "BOLLINGER", "KELTNER", "ADX_DI_CROSSOVER", "PARABOLIC_SAR", "SUPERTREND", "KAMA_TREND"])
def test_no_look_ahead(spark, name):
    walk = _walk(120)
    a = signals.apply(_bars(spark, {"A": walk}), name).orderBy("t").toPandas()
    b = signals.apply(_bars(spark, {"A": walk[:80] + [x * 3 for x in walk[80:]]}), name).orderBy("t").toPandas()
    assert a["position"][:80].tolist() == b["position"][:80].tolist()


def test_flat_prices_never_trade(spark):
    flat = _bars(spark, {"A": [50.0] * 80})
    for name in ("RSI", "BOLLINGER", "ZSCORE", "MOMENTUM", "TSMOM", "CCI", "VORTEX", "GAP_FADE"):
        assert signals.apply(flat, name).where("position <> 0").count() == 0, name


def test_a_dip_is_bought_one_bar_later(spark):
    out = signals.apply(_bars(spark, {"A": [100.0, 101.0] * 20 + [80.0, 80.0]}), "BOLLINGER").orderBy("t").toPandas()
    assert out["position"].tolist()[40:] == [0.0, 1.0]


def test_unknown_family_and_parameter_raise():
    with pytest.raises(ValueError):
        signals.REGISTRY.of("NOPE")
    with pytest.raises(ValueError):
        signals.REGISTRY.of("RSI", slow=3)


def test_accounting_equals_a_loop(spark):
    rng = random.Random(3)
    closes, pos = _walk(200, 5), [float(rng.random() < 0.5) for _ in range(200)]
    rows = spark.createDataFrame([("A", DAY + timedelta(i), c, p) for i, (c, p) in enumerate(zip(closes, pos))], "symbol string, t date, close double, position double")
    got = bt.account(rows).orderBy("t").toPandas()
    equity, gross, held, last, peak = 1000.0, 1000.0, 0.0, None, 1000.0
    for i, (c, p) in enumerate(zip(closes, pos)):
        r = c / last - 1 if last else 0.0
        paid = equity * 0.0015 * abs(p - held)
        equity, gross, held, last = (equity - paid) * (1 + p * r), gross * (1 + p * r), p, c
        peak = max(peak, equity)
        assert got["equity"][i] == pytest.approx(equity) and got["gross"][i] == pytest.approx(gross) and got["paid"][i] == pytest.approx(paid)
        assert got["drawdown"][i] == pytest.approx(1 - equity / peak)
    same = bt.account_with(rows, lambda n: 0.0015 * n).orderBy("t").toPandas()
    assert same["equity"].iloc[-1] == pytest.approx(equity)


def test_benchmark_waits_in_cash_for_a_listing(spark):
    rows = _bars(spark, {"A": [10, 20, 20, 20], "B": [None, None, 5, 10]})
    got = [r["equity"] for r in bt.benchmark(rows, rows, cost=0.0).orderBy("t").collect()]
    assert got == pytest.approx([1000, 1500, 1500, 2000])


def test_null_signals_keep_what_they_promise(spark):
    rows = signals.apply(_bars(spark, {"A": _walk(150), "B": _walk(150, 2)}), "MOMENTUM").select("symbol", "t", "close", "position")
    held = {r[0]: r[1] for r in rows.groupBy("symbol").agg(F.sum("position")).collect()}
    assert {r[0]: r[1] for r in bt.shifted(rows).groupBy("symbol").agg(F.sum("position")).collect()} == held
    moves = lambda d: {r[0]: r[1] for r in bt.account(d).groupBy("symbol").agg(F.sum("change")).collect()}
    assert moves(bt.flipped(rows)) == moves(rows) and bt.noise(rows).count() == 300


def _raw(spark, rows):
    return spark.createDataFrame(rows, "symbol string, timeframe string, event_time timestamp, available_at timestamp, revision int, close double, volume double")


def test_as_of_takes_the_newest_known_revision(spark):
    e = datetime(2024, 1, 1)
    rows = _raw(spark, [("A", "1d", e, datetime(2024, 1, 2), 1, 1.0, 1.0), ("A", "1d", e, datetime(2024, 1, 5), 2, 2.0, 1.0)])
    cut = lambda d: pit.as_of(rows, F.lit(datetime(2024, 1, d))).collect()
    assert cut(1) == [] and cut(3)[0]["close"] == 1.0 and cut(6)[0]["close"] == 2.0 and "event_time" not in cut(6)[0]


def test_of_bars_known_at_once_the_newest_counts(spark):
    """A late revision of an old bar becomes known with the bar after it."""
    at = datetime(2024, 1, 3, 0, 5)
    rows = [(f"S{k}", "1d", datetime(2024, 1, d), at, r, c, 1.0) for k in range(40) for d, r, c in ((1, 25, 10.0), (2, 1, 20.0))]
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, event_time timestamp, available_at timestamp, revision int, close double, volume double")
    asked = spark.createDataFrame([(datetime(2024, 1, 3, 0, 4),), (at,), (datetime(2024, 1, 9),)], "at timestamp")
    assert [r["close"] for r in pit.as_of_each(bars, asked).orderBy("at").collect()] == [None] * 40 + [20.0] * 80


def test_revision_plan(spark):
    day = lambda d: datetime(2024, 1, d)
    stored = _raw(spark, [("A", "1d", day(d), day(d + 1), 1, 1.0, 1.0) for d in (1, 2)])
    fetched = spark.createDataFrame([("A", "1d", day(d), c, 1.0) for d, c in ((1, 1.0 + 1e-10), (2, 1.5), (3, 1.0), (9, 1.0))], "symbol string, timeframe string, event_time timestamp, close double, volume double")
    got = {r["event_time"].day: (r["revision"], r["available_at"]) for r in pit.plan_writes(fetched, stored, F.lit(day(8))).collect()}
    assert got == {2: (2, day(8)), 3: (1, datetime(2024, 1, 4, 0, 5))}


def test_members_are_half_open(spark):
    m = spark.createDataFrame([("A", "etf", DAY, DAY + timedelta(5)), ("B", "etf", DAY, None)], "symbol string, asset_class string, listed_at date, delisted_at date")
    on = lambda k: sorted(r["symbol"] for r in pit.members(m, F.lit(DAY + timedelta(k))).collect())
    assert on(-1) == [] and on(4) == ["A", "B"] and on(5) == ["B"]


def test_version_ignores_order(spark):
    a = _bars(spark, {"A": _walk(50), "B": _walk(40)})
    assert sorted(pit.version(a).collect()) == sorted(pit.version(a.orderBy(F.desc("t")).repartition(5)).collect())


def test_quality_rules(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("A", "1h", t0 + timedelta(hours=h), o, hi, lo, c, v) for h, o, hi, lo, c, v in [(0, 5, 6, 4, 5, 1), (1, 5, 6, 4, 5, 1), (1, 5, 6, 4, 5, 1), (5, -1, 6, -2, 5, 1), (6, 5, 4, 6, 5, 1), (7, 5, 5, 5, 5, 1), (8, 5, 5, 5, 5, 1)]]
    b = spark.createDataFrame([(s, f, t, *map(float, x)) for s, f, t, *x in rows], "symbol string, timeframe string, event_time timestamp, open double, high double, low double, close double, volume double")
    got = {r["rule"]: r["n"] for r in quality.report(b, 2).collect()}
    assert got == {"gap": 1, "duplicate": 1, "price": 1, "ohlc": 1, "stale": 2}
    good, bad = quality.route(b, quality.report(b, 2))
    assert good.count() == 0 and bad.count() == 7


def test_options_per_expiry(spark):
    body = [("261002C00095000", 6.0, 6.2, 10, 100, 0.20), ("261002C00100000", 2.0, 2.2, 50, 500, 0.18), ("261002P00100000", 1.0, 1.2, 30, 300, 0.21), ("261002P00105000", 4.0, 4.4, 5, 50, 0.0), ("261016C00100000", 3.0, 3.4, 7, 70, 0.0)]
    rows = [("XLK", f"XLK{o}", date(2026, 9, 1), 101.0, i, b, a, float(v), float(oi), iv) for i, (o, b, a, v, oi, iv) in enumerate(body)]
    chain = options.contracts(spark.createDataFrame(rows, "underlying string, option string, quote_date date, spot double, place int, bid double, ask double, volume double, open_interest double, iv double"))
    a, b = options.per_expiry(chain).orderBy("expiry").collect()
    assert (a["call_volume"], a["put_volume"], a["call_oi"], a["put_oi"], a["atm_strike"], a["n_contracts"]) == (60, 35, 600, 350, 100, 4)
    assert (a["call_premium"], a["put_premium"]) == (pytest.approx(16600), pytest.approx(5400)) and (a["atm_call_iv"], a["atm_put_iv"]) == (0.18, 0.21)
    assert b["atm_call_iv"] is None and b["atm_put_iv"] is None
    odd = spark.createDataFrame([("SPY1261002P00100500",), ("junk",)], "o string").select(*options.parse_occ(F.col("o"))).collect()
    assert tuple(odd[0]) == (date(2026, 10, 2), False, 100.5) and odd[1][0] is None


def test_landed_bodies(spark):
    chart = '{"chart":{"result":[{"timestamp":[1,2,3],"events":{"splits":{"2":{"date":2,"numerator":1,"denominator":2}}},"indicators":{"quote":[{"open":[4,2,null],"high":[4,2,1],"low":[4,2,1],"close":[4,2,1],"volume":[1,1,1]}]}}]}}'
    got = landed.chart(spark.createDataFrame([("A", chart)], "symbol string, body string")).orderBy("event_time").collect()
    assert [(r["close"], r["volume"]) for r in got] == [(2.0, 2.0), (2.0, 1.0)]
    rows = landed.exchange_rows(spark.createDataFrame([("A", "1d", "x", "[[1000,1,2,0.5,1.5,9]]")], "symbol string, timeframe string, source string, body string")).collect()
    assert rows[0]["high"] == 2.0 and rows[0]["volume"] == 9.0
    assert landed.observations(spark.createDataFrame([("A", '{"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-01-02","value":"3"}]}')], "symbol string, body string")).count() == 1
    assert landed.paged(spark.createDataFrame([('{"bars":null}',), ('{"bars":{"A":[{"t":"2024-01-01T00:00:00Z","o":1,"h":1,"l":1,"c":1,"v":1}]}}',)], "body string")).count() == 1


def test_lineage_and_components(spark):
    e = spark.createDataFrame([(1, None), *[(i, i - 1) for i in range(2, 30)], (50, 1)], "id long, parent long")
    up = graph.ancestors(e)
    assert up.where("id = 29").count() == 28 and up.where("id = 29 and ancestor = 1").first()["depth"] == 28
    assert graph.ancestors(e, 5).where("id = 29").count() == 5
    assert {r["id"]: (r["root"], r["generation"]) for r in graph.roots(e).collect()}[50] == (1, 1)
    found = {r[0]: r[1] for r in graph.components(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_champions_and_status(spark):
    s = spark.createDataFrame([(1, "F", 5.0, False), (2, "F", 5.0, True), (3, "G", None, True), (4, "G", 1.0, False)], "id long, family string, score double, is_champion boolean")
    assert {r["family"]: r["id"] for r in store.champions(s).collect()} == {"F": 2, "G": 4}
    assert [r["id"] for r in store.demotions(s).collect()] == [3]
    req = spark.createDataFrame([("CANDIDATE", "VALIDATED", False, False, False, True), ("CANDIDATE", "PROMISING", False, False, False, False), ("VALIDATED", "PROMISING", False, False, True, True)], "status string, wanted string, halted boolean, is_canary boolean, discovered boolean, holdout_passed boolean")
    assert [r["refused"] for r in store.transitions(req).collect()] == ["NO_DISCOVERY", None, None]  # only promotions are refused


def test_gate_follows_the_published_levels(spark):
    found, t = [3, 5], 9
    want = gates.gamma(9) * 0.025 + (0.05 - 0.025) * gates.gamma(6) + 0.05 * gates.gamma(4)
    assert gates.threshold(t, found) == pytest.approx(want)
    rows = [("s", i, f"h{i % 7}", 0.0 if i == 2 else 0.9) for i in range(10)]
    out = gates.gate(spark.createDataFrame(rows, "stream string, test_index int, config_hash string, p_value double")).orderBy("t").collect()
    assert len(out) == 7 and [r["t"] for r in out if r["discovery"]] == [3]


def test_false_discoveries_stay_rare():
    rng, share = random.Random(1), []
    for _ in range(30):
        truth = [rng.random() < 0.1 for _ in range(300)]
        p = [0.5 * math.erfc(rng.gauss(3 if x else 0, 1) / math.sqrt(2)) for x in truth]
        out, *_ = gates.fold(pd.DataFrame({"p_value": p}), [], 0.0, 0)
        hits = [x for x, h in zip(truth, out["discovery"]) if h]
        share.append(1 - sum(hits) / len(hits) if hits else 0.0)
    assert sum(share) / len(share) < 0.06


def test_rank_correlation_and_p(spark):
    rows = spark.createDataFrame([("A", float(i), float(i * i)) for i in range(9)] + [("B", 1.0, float(i)) for i in range(9)], "symbol string, strength double, fwd double")
    out = {r["symbol"]: r for r in metrics.with_p(metrics.rank_correlation(rows, ["symbol"])).collect()}
    assert out["A"]["ic"] == pytest.approx(1.0) and out["A"]["p"] == 0.0 and out["B"]["ic"] is None
    from tidemark.functions.stats import t_two_sided

    p = spark.createDataFrame([(2.228, 10.0), (0.0, 5.0)], "t double, df double").select(t_two_sided(F.col("t"), F.col("df"))).collect()
    assert p[0][0] == pytest.approx(0.05, abs=1e-4) and p[1][0] == pytest.approx(1.0)


def test_overfitting_separates_noise_from_edge(spark):
    rng = random.Random(7)
    noise = [(f"t{k}", i, rng.gauss(0, 1)) for k in range(12) for i in range(64)]
    edge = [(s, i, r + (1.5 if s == "t3" else 0.0)) for s, i, r in noise]
    pbo = [metrics.overfitting(spark.createDataFrame(x, "symbol string, i int, r double")).first()["pbo"] for x in (noise, edge)]
    assert pbo[1] < 0.05 < pbo[0]


def test_overfitting_uses_the_shortest_trial_whole(spark):
    import numpy as np
    from itertools import combinations

    rng = random.Random(9)
    trials = {f"t{k}": [rng.gauss(0, 1) + (0.3 if i < 100 and k == 2 else 0) for i in range(203 + 10 * k)] for k in range(5)}
    for least, splits in ((203, 16), (13, 6), (3, 0)):
        cut = {s: r[: least + 2 * k] for k, (s, r) in enumerate(trials.items())}
        m = np.array([r[-least:] for _, r in sorted(cut.items())])
        blocks, bad = np.array_split(m, max(2, splits), axis=1), []
        for c in combinations(range(splits), splits // 2) if splits else ():
            ratio = lambda x: x.mean(1) / x.std(1, ddof=1)
            inside, out = (ratio(np.concatenate([blocks[i] for i in range(splits) if (i in c) == way], axis=1)) for way in (True, False))
            bad.append((out <= out[inside.argmax()]).sum() / (len(m) + 1) <= 0.5)
        got = metrics.overfitting(spark.createDataFrame([(s, i, x) for s, r in cut.items() for i, x in enumerate(r)], "symbol string, i int, r double")).first()
        assert got["n_combinations"] == len(bad)
        assert got["pbo"] == (pytest.approx(np.mean(bad)) if bad else None)


def test_folds_keep_their_distance(spark):
    rows = spark.createDataFrame([("A", i) for i in range(1, 61)] + [("B", i) for i in range(1, 13)], "symbol string, n int")
    out = metrics.folds(rows, 3).toPandas()
    assert out[out.symbol == "A"].fold.nunique() == 15 and out[out.symbol == "B"].fold.nunique() == 2
    for _, f in out[out.symbol == "A"].groupby("fold"):
        test, train = set(f[f.role == "test"].n), set(f[f.role == "train"].n)
        assert len(test) == 20 and all(abs(a - b) > 3 or a == b for a in train for b in test) and not train & test


def _weights(spark, rows):
    return spark.createDataFrame([(DAY + timedelta(k), s, w) for k, s, w in rows], "t date, symbol string, weight double")


def test_portfolio_by_hand(spark):
    rows = _bars(spark, {"A": [10, 10, 10], "B": [10, 10.5, 11]})
    days = spark.createDataFrame([(DAY,)], "t date")
    out = rotation.portfolio(rows, _weights(spark, [(0, "A", 0.5), (0, "B", 0.5)]), days, cost=0.0).orderBy("t").collect()
    assert out[-1]["equity"] == pytest.approx(1050.0)
    gone = _bars(spark, {"A": [10, 20, None], "B": [1, 1, 1]})
    out = rotation.portfolio(gone, _weights(spark, [(0, "A", 1.0)]), days, cost=0.0).orderBy("t").collect()
    assert out[-1]["equity"] == pytest.approx(2000.0)


def test_portfolio_equals_a_ledger(spark):
    rng = random.Random(4)
    syms, n = "ABC", 40
    px = {s: _walk(n, k) for k, s in enumerate(syms)}
    rows, starts = _bars(spark, px), [5, 12, 19, 26, 33]
    target = {k: dict(zip(syms, (rng.random() / 3 for _ in syms))) for k in starts}
    out = rotation.portfolio(rows, _weights(spark, [(k, s, w) for k, ws in target.items() for s, w in ws.items()]), spark.createDataFrame([(DAY + timedelta(k),) for k in starts], "t date")).orderBy("t").collect()
    equity, held, cash, want = 1000.0, {}, 1000.0, []
    for i in range(5, n):
        held = {s: v * px[s][i] / px[s][i - 1] for s, v in held.items()}
        equity = cash + sum(held.values())
        if i in target:
            traded = sum(abs(equity * w - held.get(s, 0.0)) for s, w in target[i].items())
            equity -= 0.0015 * traded
            held = {s: equity * w for s, w in target[i].items()}
            cash = equity - sum(held.values())
        want.append(equity)
    assert [r["equity"] for r in out] == pytest.approx(want)


def test_ranking_breaks_ties_by_universe_order(spark):
    rows = spark.createDataFrame([(DAY, "A", 2, 1.0), (DAY, "B", 0, 1.0), (DAY, "C", 1, 1.0), (DAY, "D", 3, None)], "t date, symbol string, pos int, s double")
    assert sorted(r["symbol"] for r in rotation.best(rows, "s", 2).collect()) == ["B", "C"]


def test_specs(spark):
    g = specs.grid(spark, spark.createDataFrame([("A",), ("B",)], "symbol string"))
    assert g.select("spec_id").distinct().count() == g.count() and g.where("family = 'MOMENTUM' and params['fast'] >= params['slow']").count() == 0
    close = specs.grid(spark, g.select("symbol"), {"N_DAY_LOW": [{"lookback": n} for n in (5, 6, 7, 10)]})
    assert specs.neighbours(close).count() == 8
    assert specs.tuned(g).join(g.select("spec_id"), "spec_id").count() >= 0 and specs.canaries(g).join(g, "spec_id").count() == 0
    import hashlib

    assert spark.range(1).select(bt.seed(F.lit("a"), F.lit("b"))).first()[0] == int(hashlib.sha256(b"a|b").hexdigest()[:8], 16)


def test_ablation(spark):
    rows = [("p", 1, 1.0, 1.0, None, None)] * 40 + [("v", 1, 2.0 + i % 2, 1.0, None, None) for i in range(40)] + [("few", 1, 2.0, 1.0, None, None)]
    t = spark.createDataFrame(rows, "component string, version int, enabled_return_pct double, disabled_return_pct double, enabled_sharpe double, disabled_sharpe double")
    assert {r["component"]: r["verdict"] for r in ablation.verdicts(ablation.registry(t)).collect()} == {"p": "NEUTRAL", "v": "VALUABLE", "few": "UNPROVEN"}


def test_papers(spark):
    inv = spark.createDataFrame([(1, {"b": [1], "a": [0, 2]})], "id int, inverted map<string,array<int>>")
    assert papers.abstracts(inv).first()["abstract"] == "a b a"
    body = '[{"claim":"c","family_hint":"X","asset_class":"etf","testable":true,"concepts":["Low Vol","low  vol","b"]}]'
    ex = spark.createDataFrame([(1, body), (2, '[{"claim":"c","family_hint":"BAD"}]'), (3, "nonsense")], "paper_id int, body string")
    got = papers.claims(ex, ["X"]).collect()
    assert [r["paper_id"] for r in got] == [1] and got[0]["concepts"] == ["low-vol", "b"]
    tags = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (2, 2, "b"), (3, 3, "a"), (3, 3, "b")], "claim_id int, paper_id int, concept string")
    assert [(r["other"], r["shared"]) for r in papers.link_candidates(tags, 1).where("claim_id = 3").collect()] == [(2, 2)]


def test_link_candidates_deal_pairs_not_tags(spark, monkeypatch):
    monkeypatch.setattr(papers, "PAIRS", 100, raising=False)
    tags = spark.createDataFrame([(c, c % 7, k) for c in range(60) for k in (c % 3, 10 + c % 5)], "claim_id long, paper_id long, concept long")
    out = papers.link_candidates(tags, 3)
    assert out.rdd.getNumPartitions() >= 9  # 930 pairs and more
    got = {(r["claim_id"], r["other"]): r["shared"] for r in out.collect()}
    want = {}
    for a in range(60):
        near = [((a % 3 == b % 3) + (a % 5 == b % 5), b) for b in range(a) if a % 7 != b % 7]
        want |= {(a, b): n for n, b in sorted(near, reverse=True)[:3] if n}
    assert got == want


def test_scores_and_verdicts(spark):
    from tidemark.operators import metrics

    cols = "k string, excess_return double, excess_sharpe double, pbo double, dsr double, has_power boolean, benchmark_mismatch boolean, previous_verdict string, turnover double, consistent boolean, n_failures int"
    rows = [
        ("mismatch", -1.0, -1.0, 0.1, 0.9, True, True, None, 1.0, True, 0), ("retire", -1.0, -1.0, 0.1, 0.9, True, False, "PROMOTE", 1.0, True, 0), ("reject", -1.0, None, 0.1, 0.9, True, False, None, 1.0, True, 0),
        ("not worse", -1.0, 0.2, None, None, True, False, None, 1.0, None, 0), ("dormant", 1.0, 1.0, 0.1, 0.9, True, False, None, 0.0, True, 0), ("overfit", 1.0, 1.0, 0.6, 0.9, True, False, None, 1.0, True, 0),
        ("regime", 1.0, 1.0, 0.5, 0.9, True, False, None, 1.0, False, 0), ("incomplete", 1.0, 1.0, 0.5, 0.9, True, False, None, 1.0, True, 2), ("promote", 1.0, 1.0, 0.25, 0.01, True, False, None, 1.0, None, 0),
        ("promising", 1.0, 1.0, None, None, False, False, None, 1.0, True, 0), ("go on", 1.0, None, None, None, False, False, None, 1.0, True, 0), ("nothing", 1.0, None, None, None, None, False, None, 1.0, True, 0),
    ]
    out = metrics.verdict(metrics.score(spark.createDataFrame(rows, cols))).withColumn("status", metrics.status()).collect()
    got = {r["k"]: (r["verdict"], round(r["score"], 2), list(r["reason_codes"]), r["status"]) for r in out}
    assert got == {
        "mismatch": ("CONTINUE_RESEARCH", 0.0, ["BENCHMARK_MISMATCH"], "EXPERIMENTAL"), "retire": ("RETIRE", 0.0, ["WORSE_THAN_HOLDING", "RETIRE_FROM_PROMOTE"], "RETIRED"), "reject": ("REJECT", 0.0, ["WORSE_THAN_HOLDING"], "REJECTED"),
        "not worse": ("PROMISING", 100.0, ["SCORE_PARTIAL_EVIDENCE"], "PROMISING"), "dormant": ("DORMANT", 95.0, ["NO_TRADES"], "DORMANT"), "overfit": ("REJECT", 75.0, ["OVERFITTING"], "REJECTED"),
        "regime": ("REGIME_SPECIALIST", 75.0, ["REGIME_INCONSISTENT"], "REGIME_SPECIALIST"), "incomplete": ("CONTINUE_RESEARCH", 75.0, ["INCOMPLETE_EVIDENCE"], "EXPERIMENTAL"), "promote": ("PROMOTE", 87.5, [], "VALIDATED"),
        "promising": ("PROMISING", 50.0, ["SCORE_PARTIAL_EVIDENCE"], "PROMISING"), "go on": ("CONTINUE_RESEARCH", 0.0, ["SCORE_PARTIAL_EVIDENCE"], "EXPERIMENTAL"), "nothing": ("CONTINUE_RESEARCH", 0.0, ["SCORE_PARTIAL_EVIDENCE"], "EXPERIMENTAL"),
    }
    m = metrics.failures(spark.createDataFrame([(1.0, None, None), (2.0, 3.0, "boom")], "a double, b double, why string"), ["a", "b"], {"a": F.lit(None).cast("string"), "b": F.col("why")})
    assert [(r["a"], r["b"], r["metric_failures"]) for r in m.collect()] == [(1.0, None, {}), (2.0, None, {"b": "boom"})]


def test_gauge_and_regate(spark):
    from tidemark.operators import gates

    rows = [(t, gates.threshold(t, [k for k in (3, 5) if k < t]), t in (3, 5)) for t in range(1, 9)]
    ledger = spark.createDataFrame([(t, a, d, f"h{t}") for t, a, d in rows], "test_index int, alpha_threshold double, discovery boolean, config_hash string")
    g = gates.gauge(ledger).first()
    assert (g["tests"], g["discoveries"]) == (8, 2) and abs(g["next_threshold"] - gates.threshold(9, [3, 5])) < 1e-12
    assert abs(g["wealth"] - (0.025 + 0.05 * 2 - 0.025 - sum(a for _, a, _ in rows))) < 1e-12
    promoted = spark.createDataFrame([(1, "h3"), (2, "h4"), (3, "new"), (4, "weak"), (5, "none"), (6, "new")], "id long, config_hash string")
    p = spark.createDataFrame([("new", 1e-9), ("weak", 0.9), ("h4", 1e-9)], "config_hash string, p_value double")
    assert {r["id"]: r["outcome"] for r in gates.regate(promoted, ledger, p).collect()} == {1: "DISCOVERY", 2: "FAILED", 3: "DISCOVERY", 4: "FAILED", 5: "UNTESTABLE", 6: "DISCOVERY"}
    assert gates.gauge(ledger.limit(0)).first()["tests"] == 0


def test_rotation_dispatch_guards(spark):
    from tidemark.operators import rotation, specs

    days = [(s, f"2024-01-{d:02d}", float(k * d + 10)) for k, s in enumerate("ABC", 1) for d in range(1, 29)]
    bars = spark.createDataFrame(days, "symbol string, t string, close double").withColumn("t", F.to_date("t"))
    on = spark.createDataFrame([("2024-01-20",), ("2024-01-25",)], "t string").withColumn("t", F.to_date("t"))
    legs = on.crossJoin(bars.select("symbol").distinct()).where("not (t = date'2024-01-25' and symbol = 'C')")
    out = rotation.weights_of("DUAL_MOMENTUM_GEM", {"lookback": 5}, ["A", "B", "C"], bars, on, legs).collect()
    assert [(str(r["t"]), r["symbol"], r["weight"]) for r in out] == [("2024-01-20", "B", 1.0)]  # the defensive leg is missing on the other day
    for family, params in (("SECTOR_MOMENTUM_ROTATION", {"lookback": 5}), ("NO_SUCH", {})):
        with pytest.raises(ValueError):
            rotation.weights_of(family, params, ["A", "B", "C"], bars, on, legs)
    for family in specs.ROTATION:
        w = rotation.weights_of(family, {"lookback": 5, "top": 2, "protection": 1.0}, ["A", "B", "C"], bars, on, legs)
        assert all(0 <= r["w"] <= 1 + 1e-9 for r in w.groupBy("t").agg(F.sum("weight").alias("w")).collect()), family


def test_specs_swapped_and_mechanisms(spark):
    from tidemark.operators import specs

    g = specs.grid(spark, spark.createDataFrame([("A",), ("B",)], "symbol string"))
    templates = g.groupBy("family").agg(F.min_by("params", "spec_id").alias("params"))
    children = specs.swapped(g, templates).join(g.select(F.col("spec_id").alias("parent_id"), F.col("family").alias("was"), F.col("symbol").alias("on")), "parent_id")
    assert children.where("family = was or symbol <> on").count() == 0 and children.count() > 0.9 * g.count()
    assert g.select(specs.mechanism(F.col("family")).alias("m")).distinct().count() == 4
    with pytest.raises(Exception):
        spark.createDataFrame([("NO_SUCH",)], "f string").select(specs.mechanism(F.col("f"))).collect()


def test_rolling_apply(spark):
    from tidemark.functions.rolling import rolling_apply

    rows = spark.createDataFrame([(s, t, float(t * t)) for s in "AB" for t in range(6)], "symbol string, t int, x double")
    got = {(r["symbol"], r["t"]): r["y"] for r in rolling_apply(rows, "y", "x", 3, lambda v: v.max() - v.min()).collect()}
    assert got["A", 1] is None or got["A", 1] != got["A", 1]
    assert got["B", 5] == 25.0 - 9.0


def test_strategy_lineage_with_loops(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 99, 5: 4, 6: 6, 7: 6, 8: 9, 9: 8, 10: 9, 11: 10, **{20 + i: 20 + (i + 1) % 5 for i in range(5)}, 30: 22, 31: 30}
    parents |= {100 + i: 99 + i if i else None for i in range(40)}
    rows = [(k, f"h{k}", f"h{p}" if p else None) for k, p in parents.items()] + [(500, "h1", None), (501, None, "h500")]
    got = {r["id"]: (r["parent_id"], r["generation"]) for r in graph.strategy_lineage(spark.createDataFrame(rows, "id long, config_hash string, parent_hash string")).collect()}

    def climb(k):
        seen, at = [], k
        while at in parents and parents[at] in parents:
            at = parents[at]
            if at in seen:
                break
            seen.append(at)
        return seen

    on_loop = {k for k in parents if k in climb(k)}
    assert on_loop == {6, 8, 9, *range(20, 25)}
    for k, p in parents.items():
        if k in on_loop or p not in parents:
            assert got[k] == (None, 0), k
        else:
            n, at = 0, k
            while at not in on_loop and parents[at] in parents:
                n, at = n + 1, parents[at]
            assert got[k] == (p, n), k
    assert got[500] == (None, 0) and got[501] == (None, 0) and len(got) == len(rows)
    assert graph.strategy_lineage(spark.createDataFrame([], "id long, config_hash string, parent_hash string")).count() == 0


@pytest.mark.parametrize("most", [1, 2, 5, 7, 32])
def test_lineage_without_pairs_equals_the_pairs(spark, most):
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else i - 1 if i % 3 else rng.randrange(i - i % 50, i)) for i in range(150)] + [(i, i - 1 if i > 200 else None) for i in range(200, 250)]
    e = spark.createDataFrame(rows, "id long, parent long")
    pairs = [tuple(r) for r in graph.ancestors(e, most).collect()]
    of = lambda k, i: [(a, d) for *x, d in pairs for a in [x[1 - k]] if x[k] == i]
    up = {r["id"]: r for r in graph.climbed(e, most).collect()}
    assert set(up) == {i for i, *_ in pairs}
    for i, r in up.items():
        own = of(0, i)
        assert (r["top"], r["generation"], r["total"]) == (max(own, key=lambda x: x[1])[0], len(own), sum(a for a, _ in own))
    down = {r["id"]: (r["n"], r["depth"]) for r in graph.descendant_counts(e, most).collect()}
    assert down == {a: (len(of(1, a)), max(d for _, d in of(1, a))) for _, a, _ in pairs}
    assert {r["depth"]: r["n"] for r in graph.levels(e, most).collect()} == {d: sum(x == d for *_, x in pairs) for *_, d in pairs}


def test_rounds_do_not_grow_with_the_number_of_loops(spark, monkeypatch):
    made, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: made.append(name) or write(df, name))
    rows = [(i, f"h{i}", f"h{i ^ 1}") for i in range(600)]
    assert {r["generation"] for r in graph.strategy_lineage(spark.createDataFrame(rows, "id long, config_hash string, parent_hash string")).collect()} == {0}
    assert made.count("met") <= 2


def test_trial_ledger(spark):
    rng, t = random.Random(2), datetime(2024, 1, 1)
    trials = [(rng.choice([None, f"c{rng.randrange(60)}"]), t + timedelta(minutes=rng.randrange(6000))) for _ in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "config_hash string, recorded_at timestamp")
    ledger = gates.record_trials(frame([]), frame(trials[:120]))
    ledger = ledger.unionByName(gates.record_trials(ledger, frame(trials[60:]))).cache()
    assert ledger.count() == len({c for c, _ in trials if c}) and gates.record_trials(ledger, frame(trials)).count() == 0
    rows = [(r["config_hash"], r["recorded_at"]) for r in ledger.collect()]
    asked = [(i, at) for i, at in enumerate([*(a for _, a in rows[:20]), t - timedelta(days=9), t + timedelta(days=90), *(t + timedelta(minutes=37 * k) for k in range(60))])]
    got = {r["i"]: r["n_trials"] for r in gates.trials_to_date(spark.createDataFrame(asked, "i int, at timestamp"), ledger).collect()}
    assert got == {i: sum(a <= at for _, a in rows) for i, at in asked}


def test_numbered_tests_and_regate_without_any(spark):
    from tidemark.operators import gates

    keys = spark.createDataFrame([(k,) for k in (5, 250, -3, 99, 100, 101, 9000)], "k long")
    assert {r["k"]: r["test_index"] for r in gates.numbered(keys, "k", width=100).collect()} == {-3: 1, 5: 2, 99: 3, 100: 4, 101: 5, 250: 6, 9000: 7}
    assert gates.numbered(keys.limit(0), "k").count() == 0
    ledger = spark.createDataFrame([], "test_index int, alpha_threshold double, discovery boolean, config_hash string")
    promoted = spark.createDataFrame([(1, "a"), (2, None)], "id long, config_hash string")
    nothing = spark.createDataFrame([], "config_hash string, p_value double")
    assert {r["outcome"] for r in gates.regate(promoted, ledger, nothing).collect()} == {"UNTESTABLE"}
    p = spark.createDataFrame([("a", 1e-9)], "config_hash string, p_value double")
    assert {r["id"]: r["outcome"] for r in gates.regate(promoted, ledger, p).collect()} == {1: "DISCOVERY", 2: "UNTESTABLE"}


def test_money_contract_without_volatility_gives_no_other_one(spark):
    from tidemark.operators import options

    rows = [(1, True, 50.0, 0.0), (2, True, 52.0, 0.3), (3, False, 50.0, 0.2), (4, False, 50.0, 0.4)]
    chain = spark.createDataFrame([("X", "2024-01-31", "2024-02-29", 50.0, n, c, k, iv, 1.0, 1.0, 1.0, 1.0) for n, c, k, iv in rows],
        "underlying string, quote_date string, expiry string, spot double, place int, is_call boolean, strike double, iv double, bid double, ask double, volume double, open_interest double")
    out = options.per_expiry(chain).first()
    assert (out["atm_strike"], out["atm_call_iv"], out["atm_put_iv"], out["n_contracts"]) == (50.0, None, 0.2, 4)


def test_option_bodies_are_sorted_in_compiled_code(spark):
    """array_sort compares structs in an interpreted function, which took most of the time."""
    from conftest import SF
    from tidemark.plans import admission

    plan = admission.bodies(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    odd = spark.createDataFrame([("SPY261302P00100500",), ("SPY260229P00100500",), ("SPY240229P00100500",)], "o string").select(*options.parse_occ(F.col("o"))).collect()
    assert [r[0] for r in odd] == [None, None, date(2024, 2, 29)]
