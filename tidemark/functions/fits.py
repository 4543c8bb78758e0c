"""Small classifiers in numpy, for windows of a few hundred rows that are fitted side by side in tasks.

A problem is (x, y, z): features (rows by columns), labels of 0 and 1 (both present) and the rows to score. Each model takes
a list of problems and returns P(1) of each one's z. Same problems and seed, same result.
"""

from __future__ import annotations

import numpy as np

BINS, LEAF = 32, 10
Problem = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def standardised(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    return (x - mean) / sd, (z - mean) / sd


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with penalty ridge / 2 |w|^2, by Newton's method with step halving."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 0.0)
    w = np.zeros(a.shape[1])

    def loss(w: np.ndarray) -> float:
        v = a @ w
        return float(np.logaddexp(0, v).sum() - y @ v + penalty @ (w * w) / 2)

    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(a @ w)
        slope = a.T @ (p - y) + penalty * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-10)
        step, size = np.linalg.solve(curve, slope), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, fall, now = w - size * step, now - then, then
        if fall < 1e-10:
            break
    return w[:-1], float(w[-1])


def logistic(problems: list[Problem], seed: int = 0) -> list[np.ndarray]:
    out = []
    for x, y, z in problems:
        x, z = standardised(x, z)
        w, b = newton(x, y)
        out.append(_sigmoid(z @ w + b))
    return out


# ---------------------------------------------------------------- trees on binned features, many at once
def _binned(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of each column by quantiles of x."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    place = lambda m: np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, m.T)])
    return place(x), place(z)


def grow(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator | None = None, columns: int = 0):
    """Regression trees that lower the weighted squared error, grown level by level together.

    bins are (trees, rows, columns), target and weight (trees, rows). Returns (feature, cut, node): for each tree and inner
    node the column and the greatest bin that goes left (-1: no split), and the leaf, from 0, of each row. columns > 0: a
    node looks at so many columns, drawn by rng.
    """
    trees, rows, n_columns = bins.shape
    feature = np.full((trees, 2**depth - 1), -1)
    cut = np.zeros((trees, 2**depth - 1), int)
    node = np.zeros((trees, rows), int)
    some = (weight > 0).astype(float)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        at = (np.arange(trees)[:, None] * width + node - first)[:, :, None] * n_columns + np.arange(n_columns)
        flat = (at * BINS + bins).ravel()
        each = lambda v: np.bincount(flat, np.repeat(v, n_columns), trees * width * n_columns * BINS).reshape(trees, width, n_columns, BINS).cumsum(-1)  # noqa: E731, B023
        n, s, c = each(weight), each(weight * target), each(some)
        whole_n, whole_s, whole_c = n[..., -1:], s[..., -1:], c[..., -1:]
        fits = (c >= LEAF) & (whole_c - c >= LEAF)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, s**2 / n + (whole_s - s) ** 2 / (whole_n - n) - whole_s**2 / whole_n, -np.inf)
        if columns:
            drawn = np.argsort(rng.random((trees, width, n_columns)), -1) < columns
            gain = np.where(drawn[..., None], gain, -np.inf)
        gain = gain.reshape(trees, width, -1)
        best = gain.argmax(-1)
        better = np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-12
        feature[:, first : first + width] = np.where(better, best // BINS, -1)
        cut[:, first : first + width] = best % BINS
        node = _step(bins, feature, cut, node)
    return feature, cut, node - (2**depth - 1)


def _step(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The next level's nodes; a row of a node without a split goes left."""
    f, c = np.take_along_axis(feature, node, 1), np.take_along_axis(cut, node, 1)
    own = np.take_along_axis(bins, np.maximum(f, 0)[:, :, None], 2)[..., 0]
    return 2 * node + 1 + ((f >= 0) & (own > c))


def _ends(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(bins.shape[:2], int)
    for _ in range(depth):
        node = _step(bins, feature, cut, node)
    return node - (2**depth - 1)


def _leaf_sums(node: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    trees = node.shape[0]
    return np.bincount((np.arange(trees)[:, None] * 2**depth + node).ravel(), value.ravel(), trees * 2**depth).reshape(trees, -1)


def forest(problems: list[Problem], seed: int = 0, trees: int = 100, depth: int = 4) -> list[np.ndarray]:
    """Trees on bootstrap samples, a node looking at the root of the number of columns; the mean of their leaves' shares."""
    out = []
    for x, y, z in problems:
        rng = np.random.default_rng(seed)
        bins, ahead = (np.broadcast_to(b, (trees, *b.shape)) for b in _binned(x, z))
        weight = rng.multinomial(len(y), np.full(len(y), 1 / len(y)), trees).astype(float)
        target = np.broadcast_to(y, weight.shape)
        feature, cut, node = grow(bins, target, weight, depth, rng, max(1, int(x.shape[1] ** 0.5)))
        total, up = _leaf_sums(node, weight, depth), _leaf_sums(node, weight * target, depth)
        share = np.divide(up, total, out=np.full_like(up, 0.5), where=total > 0)
        out.append(np.take_along_axis(share, _ends(ahead, feature, cut, depth), 1).mean(0))
    return out


def boosted(problems: list[Problem], seed: int = 0, rounds: int = 100, depth: int = 3, rate: float = 0.1) -> list[np.ndarray]:
    """Trees on the slope of the log loss, leaves by one Newton step; all problems take their rounds together."""
    placed = [_binned(x, z) for x, _, z in problems]
    filled = lambda parts: np.stack([np.concatenate([p, np.zeros((max(map(len, parts)) - len(p), *p.shape[1:]), p.dtype)]) for p in parts])
    bins, ahead = filled([b for b, _ in placed]), filled([a for _, a in placed])
    y, weight = filled([y for _, y, _ in problems]), filled([np.ones(len(y)) for _, y, _ in problems])
    share = (y * weight).sum(1) / weight.sum(1)
    base = np.log(share / (1 - share))[:, None]
    v, out = np.repeat(base, bins.shape[1], 1), np.repeat(base, ahead.shape[1], 1)
    for _ in range(rounds):
        p = _sigmoid(v)
        feature, cut, node = grow(bins, y - p, weight, depth)
        slope, curve = _leaf_sums(node, weight * (y - p), depth), _leaf_sums(node, weight * p * (1 - p), depth)
        leaf = np.divide(slope, curve, out=np.zeros_like(slope), where=curve > 1e-12)
        v = v + rate * np.take_along_axis(leaf, node, 1)
        out = out + rate * np.take_along_axis(leaf, _ends(ahead, feature, cut, depth), 1)
    return [_sigmoid(row[: len(z)]) for row, (_, _, z) in zip(out, problems)]


# ---------------------------------------------------------------- radial support vectors by random Fourier features
def fourier(x: np.ndarray, gamma: float, size: int, seed: int) -> np.ndarray:
    """Features whose inner products are close to exp(-gamma |a - b|^2): their error falls with the root of size."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=(2 * gamma) ** 0.5, size=(x.shape[1], size // 2))
    return np.hstack([np.cos(x @ w), np.sin(x @ w)]) / (size // 2) ** 0.5


def margin(products: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of the rows of a machine with squared hinge loss, given their inner products: Newton steps, each a solution
    over the rows inside the margin."""
    sign, beta = 2 * y - 1, np.zeros(len(y))
    inside = np.ones(len(y), bool)
    for _ in range(steps):
        beta = np.zeros(len(y))
        beta[inside] = np.linalg.solve(products[np.ix_(inside, inside)] + np.eye(inside.sum()) / (2 * c), sign[inside])
        now = sign * (products @ beta) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return beta


def radial(problems: list[Problem], seed: int = 0, size: int = 256, parts: int = 5, bias: float = 10.0) -> list[np.ndarray]:
    """A machine on Fourier features of a radial kernel (gamma: one over columns times variance), its margins turned into
    shares by a logistic curve that is fitted on margins of rows left out, part by part."""
    out = []
    for x, y, z in problems:
        x, z = standardised(x, z)
        spread = x.var()
        both = fourier(np.vstack([x, z]), 1 / (x.shape[1] * spread) if spread > 0 else 1.0, size, seed)
        own = both[: len(x)]
        products = both @ own.T + bias  # a constant feature stands for the intercept
        inner, left_out, part = products[: len(x)], np.zeros(len(y)), np.arange(len(y)) % parts
        for k in range(parts):
            rest = part != k
            if len(np.unique(y[rest])) == 2:
                left_out[~rest] = inner[np.ix_(~rest, rest)] @ margin(inner[np.ix_(rest, rest)], y[rest])
        slope, base = newton(left_out[:, None], y, ridge=1e-3)
        out.append(_sigmoid(slope[0] * (products[len(x) :] @ margin(inner, y)) + base))
    return out
