"""Walk-forward classifiers: windows and the logistic model against brute force, the others on cases with known answers."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.functions import fits
from tidemark.operators import learned


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for s, n in (("A", 420), ("B", 150), ("C", 60)):
        rng, x = random.Random(s), 50.0
        for i in range(n):
            x *= 1 + 0.02 * math.sin(i / 3) + rng.uniform(-0.01, 0.01)
            rows.append((s, date(2021, 1, 1) + timedelta(i), x, x * 1.01, x * 0.99, x, 0.0 if i % 37 == 5 else 100.0 + rng.randrange(50)))
    return spark.createDataFrame(rows, "symbol string, t date, open double, high double, low double, close double, volume double")


def _plain_logistic(x, y, z):
    """Penalised logistic regression by many small gradient steps."""
    mean, sd = x.mean(0), x.std(0)
    x, z = (x - mean) / sd, (z - mean) / sd
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(30_000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.01 * (x.T @ e + w), b - 0.01 * e.sum()
    return 1 / (1 + np.exp(-(z @ w + b)))


def test_logistic_walk_forward_against_brute_force(spark, bars):
    train, retrain = 60, 45
    f = learned.features(bars).toPandas()
    got = {(r["symbol"], r["t"]): (r["position"], r["strength"]) for r in learned.walk_forward(bars, "LOGISTIC_REGRESSION", train, retrain).collect()}
    assert len(got) == len(f)
    n_scored = 0
    for symbol, s in f.groupby("symbol"):
        s = s.sort_values("t").reset_index(drop=True)
        x, y = s[list(learned.FEATURES)].to_numpy(float), s["label"].to_numpy(float)
        fine = np.isfinite(x).all(1)
        raw, strength = np.zeros(len(s)), np.zeros(len(s))
        for c in range(train, len(s), retrain):
            known = np.flatnonzero(fine & np.isfinite(y) & (np.arange(len(s)) >= c - train) & (np.arange(len(s)) < c))
            ahead = [i for i in range(c, min(c + retrain, len(s))) if fine[i]]
            if len(known) < 20 or len(set(y[known])) < 2 or not ahead:
                continue
            p = _plain_logistic(x[known], y[known], x[ahead])
            raw[ahead], strength[ahead] = p >= 0.5, p - 0.5
            n_scored += len(ahead)
        for i, t in enumerate(s["t"]):
            position, own = got[symbol, t]
            assert math.isclose(own, strength[i], abs_tol=1e-4)
            if i and abs(strength[i - 1]) > 1e-3:
                assert position == raw[i - 1]
    assert n_scored > 350


@pytest.mark.parametrize("kind", learned.MODELS)
def test_models_find_a_cycle_and_repeat(spark, bars, kind):
    one = learned.walk_forward(bars, kind, 120, 20).orderBy("symbol", "t").toPandas()
    again = learned.walk_forward(bars.repartition(3), kind, 120, 20).orderBy("symbol", "t").toPandas()
    assert np.allclose(one.strength, again.strength) and (one.position == again.position).all()
    own = one[one.symbol == "A"].reset_index(drop=True)
    assert (own.position[:121] == 0).all() and (one[one.symbol == "C"].position == 0).all()
    ahead = (own.close.shift(-1) > own.close)[120:-1]
    right = ((own.strength[120:-1] > 0) == ahead).mean()
    assert right > 0.7, (kind, right)


def test_a_window_with_one_class_stays_flat(spark):
    rows = [("U", date(2021, 1, 1) + timedelta(i), *[100.0 + i] * 4, 10.0 + i % 3) for i in range(200)]
    rising = spark.createDataFrame(rows, "symbol string, t date, open double, high double, low double, close double, volume double")
    assert learned.walk_forward(rising, "RANDOM_FOREST", 60, 20).where("position <> 0 or strength <> 0").count() == 0
    assert learned.walk_forward(rising.limit(0), "SVM", 60, 20).count() == 0


def test_trees_split_where_a_plain_search_does():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = (x[:, 2] > 0.3).astype(float)
    bins, _ = fits._binned(x, x)
    feature, cut, node = fits.grow(bins[None], y[None], np.ones((1, 200)), 1)
    best = max(
        ((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum(), c, b) for c in range(4) for b in range(fits.BINS) for left in [bins[:, c] <= b] if left.sum() >= fits.LEAF and (~left).sum() >= fits.LEAF),
        key=lambda v: (v[0], -v[1], -v[2]),
    )
    assert (feature[0, 0], cut[0, 0]) == best[1:] and (node[0] == (bins[:, best[1]] > best[2])).all()


def test_problems_boosted_together_are_boosted_alone():
    rng = np.random.default_rng(5)
    problems = [(x, (x[:, 0] * x[:, 1] > 0).astype(float), rng.normal(size=(7 + k, 3))) for k, n in enumerate((60, 90, 40)) for x in [rng.normal(size=(n, 3))]]
    for alone, p in zip(problems, fits.boosted(problems)):
        assert np.allclose(fits.boosted([alone])[0], p)


def test_fourier_features_come_near_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 6)
    errors = []
    for size in (64, 256, 4096):
        f = fits.fourier(x, 1 / 6, size, 0)
        errors.append(abs(f @ f.T - kernel).max())
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.35 and errors[2] < 0.08


def test_the_radial_machine_parts_a_ring():
    rng = np.random.default_rng(2)
    angle, radius = rng.uniform(0, 2 * np.pi, 240), np.repeat([1.0, 3.0], 120) + rng.normal(scale=0.2, size=240)
    x, y = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]), np.repeat([0.0, 1.0], 120)
    mixed = rng.permutation(240)
    x, y = x[mixed], y[mixed]
    radial = fits.radial([(x[:160], y[:160], x[160:])])[0]
    linear = fits.logistic([(x[:160], y[:160], x[160:])])[0]
    assert ((radial > 0.5) == y[160:]).mean() > 0.95 and ((linear > 0.5) == y[160:]).mean() < 0.75
