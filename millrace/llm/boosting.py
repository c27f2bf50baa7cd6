"""Small gradient-boosted trees: fitted in numpy, applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.predict(x), self.high.predict(x))

    def sql(self, features: str) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"IF({features}[{self.feature}] <= {self.cut!r}D, {self.low.sql(features)}, {self.high.sql(features)})"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int, ridge: float) -> Node:
    value = float(rate * g.sum() / (h.sum() + ridge))
    best = None
    if depth and len(g) >= 2 * least:
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + ridge) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + ridge) - whole
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2
    if best is None:
        return Node(value)
    low = x[:, best[1]] <= best[2]
    parts = (_grow(x[s], g[s], h[s], depth - 1, rate, least, ridge) for s in (low, ~low))
    return Node(value, best[1], best[2], *parts)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> tuple[float, list[Node]]:
    """Logistic boosting with Newton leaf values: the starting logit and the trees. Ties in gain go to the lower feature and cut."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start, found = float(np.log(share / (1 - share))), []
    z = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, y - p, p * (1 - p), depth, rate, least, ridge)
        found.append(tree)
        z = z + tree.predict(x)
    return start, found


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: a, b such that 1 / (1 + exp(-(a z + b))) fits held-out outcomes, by Newton steps that are halved until they help."""
    middle, spread = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - middle) / spread, np.ones(len(z))], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w = np.array([1.0, np.log(share / (1 - share))])

    def loss(w: np.ndarray) -> float:
        t = x @ w
        return float(np.logaddexp(0, t).sum() - (y * t).sum() + 0.01 * (w @ w))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2), x.T @ (y - p) - 0.02 * w)
        scale = 1.0
        while scale > 1e-4 and loss(w + scale * step) > loss(w):
            scale /= 2
        w = w + scale * step
        if np.abs(scale * step).max() < 1e-6:
            break
    a = float(w[0]) / spread
    return a, float(w[1]) - a * middle
