"""Sparse rule ensembles on a bounded training sample: tree paths, then lasso logistic weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold): value > threshold if above, else <=."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for feature, above, threshold in self.conditions:
            out &= (x[:, feature] > threshold) == above
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def _merged(conditions: list[tuple[int, bool, float]]) -> Rule:
    """Keep the tightest limit of each feature and side."""
    tight: dict[tuple[int, bool], float] = {}
    for feature, above, threshold in conditions:
        at = (feature, above)
        tight[at] = threshold if at not in tight else (max if above else min)(tight[at], threshold)
    return Rule(tuple(sorted((f, a, t) for (f, a), t in tight.items())))


def _grow(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: list, out: list[Rule], fitted: np.ndarray, rows: np.ndarray) -> None:
    """Least-squares splits of the residuals `r`; adds the rule of every node but the root."""
    mean = r[rows].mean()
    fitted[rows] = mean
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-9, -1, 0.0)
    total = r[rows].sum()
    for feature, limits in enumerate(cuts):
        if not len(limits):
            continue
        bins = np.searchsorted(limits, x[rows, feature], side="left")
        n = np.bincount(bins, minlength=len(limits) + 1).cumsum()[:-1]
        s = np.bincount(bins, weights=r[rows], minlength=len(limits) + 1).cumsum()[:-1]
        rest = len(rows) - n
        ok = (n >= least) & (rest >= least)
        if not ok.any():
            continue
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(rest, 1) - total**2 / len(rows), -1)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), feature, float(limits[at]))
    _, feature, threshold = best
    if feature < 0:
        return
    above = x[rows, feature] > threshold
    for side in (False, True):
        deeper = [*path, (feature, side, threshold)]
        out.append(_merged(deeper))
        _grow(x, r, cuts, depth - 1, least, deeper, out, fitted, rows[above == side])


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, rate: float = 0.3, share: float = 0.5) -> list[Rule]:
    """Rules of boosted trees, each grown on a random share of the rows and of the features."""
    rng = np.random.default_rng(seed)
    quantiles = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    least = max(3, len(y) // 200)
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(2 * least, int(len(y) * share)), replace=len(y) < 4 * least)
        used = rng.random(x.shape[1]) < 0.7
        cuts = [q if u else q[:0] for q, u in zip(quantiles, used, strict=True)]
        residual = y - 1 / (1 + np.exp(-z))
        found: list[Rule] = []
        fitted = np.zeros(len(y))
        _grow(x, residual, cuts, depth, least, [], found, fitted, np.unique(rows))
        for rule in found:
            rules.setdefault(rule)
        # rows outside the sample get the value of the leaf they fall into
        step = np.zeros(len(y))
        for rule in found:  # deeper rules come after their parents
            inside = rule.holds(x)
            own = inside & np.isin(np.arange(len(y)), rows)
            if own.any():
                step[inside] = residual[own].mean()
        z += rate * 4 * step
    return list(rules)


def lasso_logistic(h: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Accelerated proximal gradient; the last weight is the intercept, which is not penalised."""
    n = len(y)
    h1 = np.column_stack([h, np.ones(n)])
    w = np.zeros(h1.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    # power iteration for the largest curvature
    u = np.ones(h1.shape[1])
    for _ in range(20):
        u = h1.T @ (h1 @ u)
        u /= np.linalg.norm(u) or 1
    rate = 4 * n / max(float(u @ (h1.T @ (h1 @ u))), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(h1 @ v, -30, 30)))
        new = v - rate * (h1.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-5:
            w = new
            break
        w, t = new, t2
    return w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, seed: int = 7, strengths=(0.03, 0.02, 0.012, 0.008, 0.005, 0.003)) -> Ensemble:
    """Rules from trees, lasso weights at the penalty with the least loss on a fifth of the rows.

    A sample of one class gives its smoothed prior and no rule.
    """
    n, ones = len(y), float(y.sum())
    prior = (ones + 1) / (n + 2)
    if n < 20 or ones in (0.0, float(n)):
        return Ensemble(float(np.log(prior / (1 - prior))), ())
    rules = tree_rules(x, y, trees, depth, seed)
    if not rules:
        return Ensemble(float(np.log(prior / (1 - prior))), ())
    h = np.column_stack([r.holds(x) for r in rules]).astype(float)
    test = np.random.default_rng(seed).permutation(n) < n // 5
    best, w = (np.inf, strengths[0]), None
    for strength in strengths:
        w = lasso_logistic(h[~test], y[~test], strength, w)
        p = np.clip(1 / (1 + np.exp(-(h[test] @ w[:-1] + w[-1]))), 1e-4, 1 - 1e-4)
        loss = float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
        if loss < best[0] - 1e-4:
            best = (loss, strength)
    w = lasso_logistic(h, y, best[1])
    return Ensemble(float(w[-1]), tuple((r, float(c)) for r, c in zip(rules, w[:-1], strict=True) if abs(c) > 1e-3))
