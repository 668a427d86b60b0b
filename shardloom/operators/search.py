"""Search strategies over a small space of parameters, and seeds from earlier campaigns.

A campaign has tens to thousands of runs, so a strategy works on the driver;
what it learns from is read by queries over the run history.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skyline import front_mask, pareto_front


class Strategy(ABC):
    """Proposes the next parameters from those tried so far. ``space`` maps each name to its possible values."""

    def __init__(self, space: dict[str, list], seed: int = 42) -> None:
        self.space, self.rng = space, np.random.default_rng(seed)
        self.names = list(space)

    @abstractmethod
    def propose(self, tried: list[tuple[dict, float | None]]) -> dict | None:
        """The next parameters, or None when there is nothing new to try."""

    def untried(self, tried: list[tuple[dict, float | None]]) -> list[dict]:
        seen = {tuple(p.get(n) for n in self.names) for p, _ in tried}
        return [dict(zip(self.names, v)) for v in product(*self.space.values()) if v not in seen]

    def place(self, params: dict) -> np.ndarray:
        """A point of the unit cube: numbers by their range, other values by their place in the list."""
        out = []
        for name, values in self.space.items():
            numeric = all(isinstance(v, (int, float)) for v in values)
            scale = [float(v) for v in values] if numeric else list(range(len(values)))
            x = float(params[name]) if numeric else values.index(params[name])
            out.append((x - min(scale)) / ((max(scale) - min(scale)) or 1.0))
        return np.array(out)


class Grid(Strategy):
    """In the order of the grid."""

    def propose(self, tried):
        left = self.untried(tried)
        return left[0] if left else None


class Random(Strategy):
    """Any untried point."""

    def propose(self, tried):
        left = self.untried(tried)
        return left[self.rng.integers(len(left))] if left else None


class GaussianUcb(Strategy):
    """The untried point with the greatest mean plus ``kappa`` deviations of a Gaussian process over the scored runs."""

    def __init__(self, space, seed: int = 42, kappa: float = 2.0, width: float = 0.3, noise: float = 1e-4, first: int = 3) -> None:
        super().__init__(space, seed)
        self.kappa, self.width, self.noise, self.first = kappa, width, noise, first

    def propose(self, tried):
        left = self.untried(tried)
        scored = [(self.place(p), s) for p, s in tried if s is not None and np.isfinite(s)]
        if not left or len(scored) < self.first:
            return left[self.rng.integers(len(left))] if left else None
        x, y = np.stack([p for p, _ in scored]), np.array([s for _, s in scored], "f8")
        spread = y.std() or 1.0
        z = (y - y.mean()) / spread
        new = np.stack([self.place(p) for p in left])
        kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * self.width**2))
        k = kernel(x, x) + self.noise * np.eye(len(x))
        cross = kernel(new, x)
        mean = cross @ np.linalg.solve(k, z)
        var = np.maximum(1.0 - (cross * np.linalg.solve(k, cross.T).T).sum(1), 0.0)
        return left[int(np.argmax(mean + self.kappa * np.sqrt(var)))]


class ParzenTree(Strategy):
    """The untried point whose values are most typical of the better runs and least of the others."""

    def __init__(self, space, seed: int = 42, better: float = 0.25, first: int = 5) -> None:
        super().__init__(space, seed)
        self.better, self.first = better, first

    def propose(self, tried):
        left = self.untried(tried)
        scored = sorted([(s, p) for p, s in tried if s is not None and np.isfinite(s)], key=lambda x: -x[0])
        if not left or len(scored) < self.first:
            return left[self.rng.integers(len(left))] if left else None
        cut = max(1, int(np.ceil(self.better * len(scored))))
        ratio = np.zeros(len(left))
        for name, values in self.space.items():
            share = lambda runs: {v: (1 + sum(p[name] == v for _, p in runs)) / (len(values) + len(runs)) for v in values}
            good, bad = share(scored[:cut]), share(scored[cut:])
            ratio += [np.log(good[p[name]] / bad[p[name]]) for p in left]
        return left[int(np.argmax(ratio))]


class ManyGoals(Strategy):
    """Crosses and mutates runs of the Pareto front; ``tried`` scores are tuples of objectives, greater is better."""

    def __init__(self, space, seed: int = 42, mutate: float = 0.3) -> None:
        super().__init__(space, seed)
        self.mutate = mutate

    def propose(self, tried):
        left = self.untried(tried)
        scored = [(p, s) for p, s in tried if s is not None and all(v is not None for v in s)]
        if not left or len(scored) < 2:
            return left[self.rng.integers(len(left))] if left else None
        front = [p for (p, _), good in zip(scored, front_mask(np.array([s for _, s in scored], "f8"))) if good]
        for _ in range(50):
            a, b = (front[self.rng.integers(len(front))] for _ in range(2))
            child = {n: (a if self.rng.random() < 0.5 else b)[n] for n in self.names}
            for n in self.names:
                if self.rng.random() < self.mutate:
                    child[n] = self.space[n][self.rng.integers(len(self.space[n]))]
            if child in left:
                return child
        return left[self.rng.integers(len(left))]


STRATEGIES: dict[str, type[Strategy]] = {"grid": Grid, "random": Random, "gp": GaussianUcb, "tpe": ParzenTree, "nsga": ManyGoals}


def warm_start(prior: DataFrame, current: DataFrame, run: str, run_name: str = "run", params: str = "params", score: str = "score", goals: list[str] | None = None, n: int = 1) -> DataFrame:
    """``params, score``: up to ``n`` parameters of an earlier campaign to begin with, best first.

    Of the run of the same name, or of all runs if that one has no score; with
    ``goals`` (greater is better) only those of the Pareto front. Parameters
    that the current campaign has tried are left out; of equal ones the best counts.
    """
    scored = prior.where(F.col(score).isNotNull())
    own = scored.where(F.col(run_name) == run)
    pool = scored if own.isEmpty() else own
    if goals:
        keyed = pool.withColumn("__id", F.xxhash64(run_name, params, score, *goals))
        pool = keyed.join(pareto_front(keyed, "__id", goals), "__id", "left_semi")
    best = pool.groupBy(params).agg(F.max(score).alias(score)).join(current.select(params).distinct(), params, "left_anti")
    return best.orderBy(F.desc(score), params).limit(n)
