"""Two-class latent models over counted patterns: probabilistic linkage weights and a label model, both fitted by expectation-maximisation.

What goes in is a table of patterns (one level per comparison or vote) with the number of pairs that show it. Its length is the product of the
numbers of levels whatever the number of pairs, so it may be collected; the pairs themselves never leave the cluster.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np


class TwoClasses:
    """P(match | pattern). cliques: groups of positions that are modelled jointly, because they depend on each other within a class.

    belief: for each position the share of each level among non-matches and among matches that is believed beforehand; it weighs ``weight`` times as much as
    the pairs of the class. Without it the two classes are whatever parts the candidates best, which need not be matches and the rest.
    """

    def __init__(self, levels: list[int], cliques: list[tuple[int, ...]] | None = None, smooth: float = 0.5, belief: list | None = None, weight: float = 3.0):
        self.levels, self.smooth, self.belief, self.weight = levels, smooth, belief, weight
        self.cliques = cliques or [(i,) for i in range(len(levels))]
        self.prior, self.tables, self.likelihood = 0.5, [], 0.0

    def _cell(self, patterns: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
        cell = np.zeros(len(patterns), dtype=int)
        for i in clique:
            cell = cell * self.levels[i] + patterns[:, i]
        return cell

    def _believed(self, clique: tuple[int, ...]) -> np.ndarray:
        if self.belief is None:
            return np.zeros((2, 1))
        out = np.ones((2, 1))
        for i in clique:
            out = (out[:, :, None] * np.asarray(self.belief[i], dtype=float)[:, None, :]).reshape(2, -1)
        return out

    def fit(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-7) -> TwoClasses:
        """start: a first guess of P(match) for each pattern; it also says which class is the matches. An error is raised if the rounds don't converge."""
        p, total = start.astype(float), counts.sum()
        cells = [(self._cell(patterns, c), math.prod(self.levels[i] for i in c)) for c in self.cliques]
        believed = [self._believed(c) * self.weight for c in self.cliques]
        last = -np.inf
        for _ in range(rounds):
            self.prior = float(np.clip((p * counts).sum() / max(total, 1e-9), 1e-6, 1 - 1e-6))
            self.tables = []
            sizes = np.array([[((1 - p) * counts).sum()], [(p * counts).sum()]])
            for (cell, n), base in zip(cells, believed):
                both = np.stack([np.bincount(cell, weights=w * counts, minlength=n) + self.smooth for w in (1 - p, p)]) + base * sizes
                self.tables.append(both / both.sum(axis=1, keepdims=True))
            logs = np.log([1 - self.prior, self.prior])[:, None] + sum(np.log(t[:, cell]) for t, (cell, _) in zip(self.tables, cells))
            top = logs.max(axis=0)
            likely = top + np.log(np.exp(logs - top).sum(axis=0))
            p = np.exp(logs[1] - likely)
            self.likelihood = now = float((likely * counts).sum())
            if abs(now - last) <= tolerance * max(1.0, abs(now)):
                return self
            last = now
        raise RuntimeError(f"the likelihood still moves after {rounds} rounds")

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        if not len(patterns):
            return np.zeros(0)
        logs = np.log([1 - self.prior, self.prior])[:, None] + sum(np.log(t[:, self._cell(patterns, c)]) for t, c in zip(self.tables, self.cliques))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def weights(self) -> list[np.ndarray]:
        """log2(m / u) of each level of each clique."""
        return [np.log2(t[1] / t[0]) for t in self.tables]

    def criterion(self, total: float) -> float:
        """Log likelihood less half the parameters times the logarithm of the number of pairs (Bayesian information)."""
        free = 1 + 2 * sum(math.prod(self.levels[i] for i in c) - 1 for c in self.cliques)
        return self.likelihood - 0.5 * free * math.log(max(total, 2.0))


def label_model(patterns: np.ndarray, counts: np.ndarray, levels: list[int], start: np.ndarray, largest: int = 2, belief: list | None = None) -> TwoClasses:
    """Votes' accuracies and correlations: votes start as independent within a class; as long as the data say so, two groups of votes are joined and modelled jointly."""
    best = TwoClasses(levels, belief=belief).fit(patterns, counts, start)
    total = float(counts.sum())
    while True:
        found = None
        for a, b in combinations(best.cliques, 2):
            if len(a) + len(b) <= largest and total:
                cliques = sorted([*(c for c in best.cliques if c not in (a, b)), tuple(sorted(a + b))])
                model = TwoClasses(levels, cliques, belief=belief).fit(patterns, counts, start)
                if model.criterion(total) > (found or best).criterion(total):
                    found = model
        if found is None:
            return best
        best = found
