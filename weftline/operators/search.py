"""Hyper-parameter search by Parzen estimators over the trials so far, kept in a run store so that it can go on later."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import mean_precision
from .runs import RunStore, ranker_for


@dataclass(frozen=True)
class Float:
    """Numbers of an interval; with ``log``, their logarithms count as evenly spread."""

    low: float
    high: float
    log: bool = False

    def unit(self, value: float) -> float:
        a, b, x = (math.log(v) if self.log else v for v in (self.low, self.high, value))
        return (x - a) / (b - a) if b > a else 0.5

    def value(self, unit: float) -> float:
        a, b = (math.log(v) if self.log else v for v in (self.low, self.high))
        x = a + unit * (b - a)
        return min(max(math.exp(x) if self.log else x, self.low), self.high)


@dataclass(frozen=True)
class Int:
    """Whole numbers from ``low`` to ``high``."""

    low: int
    high: int

    def unit(self, value: int) -> float:
        return (value - self.low + 0.5) / (self.high - self.low + 1)

    def value(self, unit: float) -> int:
        return min(self.low + int(unit * (self.high - self.low + 1)), self.high)


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple


Space = dict[str, Float | Int | Choice]


class Parzen:
    """A mixture of normal densities on [0, 1], one around each point and a flat one; a point is as wide as its farther neighbour is away."""

    def __init__(self, points: list[float]):
        self.points = sorted(points)
        n = len(self.points)
        edges = [0.0, *self.points, 1.0]
        self.widths = [min(max(edges[k + 1] - edges[k], edges[k + 2] - edges[k + 1], 1 / (1 + n)), 0.5) for k in range(n)]

    def draw(self, rng: random.Random) -> float:
        k = rng.randrange(len(self.points) + 1)
        if k == len(self.points):
            return rng.random()
        while not 0 <= (x := rng.gauss(self.points[k], self.widths[k])) <= 1:
            pass
        return x

    def density(self, x: float) -> float:
        total = 1.0
        for p, w in zip(self.points, self.widths):
            inside = 0.5 * (math.erf((1 - p) / w / math.sqrt(2)) - math.erf(-p / w / math.sqrt(2)))
            total += math.exp(-0.5 * ((x - p) / w) ** 2) / (w * math.sqrt(2 * math.pi)) / inside
        return total / (len(self.points) + 1)


def suggested(space: Space, trials: list[dict], rng: random.Random, startup: int = 10, share: float = 0.15, draws: int = 24) -> dict:
    """Parameters of the next trial, from trials ``{"params": .., "score": ..}`` (higher is better, None failed).

    The first ``startup`` are drawn at random. Then the best ``share`` of the trials and the rest give two densities for each parameter, and
    of some draws from the first the one is taken where their ratio is largest.
    """
    done = sorted((t for t in trials if t["score"] is not None), key=lambda t: -t["score"])
    if len(done) < startup:
        return {name: rng.choice(s.values) if isinstance(s, Choice) else s.value(rng.random()) for name, s in space.items()}
    n = max(1, math.ceil(share * len(done)))
    good, rest, out = done[:n], done[n:], {}
    for name, s in space.items():
        a, b = ([t["params"][name] for t in some] for some in (good, rest))
        if isinstance(s, Choice):
            weights = [a.count(v) + 1 for v in s.values]  # one more each, so that no value is ever out of the search
            odds = [w / (b.count(v) + 1) for w, v in zip(weights, s.values)]
            out[name] = s.values[max(rng.choices(range(len(s.values)), weights, k=draws), key=lambda k: odds[k])]
        else:
            low, high = Parzen([s.unit(v) for v in a]), Parzen([s.unit(v) for v in b])
            out[name] = s.value(max((low.draw(rng) for _ in range(draws)), key=lambda x: low.density(x) / high.density(x)))
    return out


def searched(objective: Callable[[dict], float | None], space: Space, trials: int, seed: int = 42, startup: int = 10, store: RunStore | None = None, study: str = "study") -> list[dict]:
    """Up to ``trials`` trials ``{"trial", "params", "score"}``, best first; of equal ones the earlier.

    With a store, trials of the study that it holds count, and each new one is kept when it ends: a search that
    was ended goes on as if it had not been, as a trial's draws depend on the seed, its number and the trials before.
    """
    found = store.trials(study) if store else []
    for n in range(len(found), trials):
        params = suggested(space, found, random.Random(f"{seed}:{n}"), startup)
        score = objective(params)
        found.append({"trial": n, "params": params, "score": None if score is None else float(score)})
        if store:
            store.save_trial(study, found[-1])
    return sorted(found, key=lambda t: (t["score"] is None, -(t["score"] or 0.0), t["trial"]))


def tuned_ranker(config, space: Space, train: DataFrame, valid: DataFrame, candidates: DataFrame, actual: DataFrame, trials: int = 50, k: int = 12, seed: int = 42, startup: int = 10, store: RunStore | None = None, study: str = "ranker"):
    """(the best configuration, all trials): rankers of ``config`` with other parameters, by MAP@k on the validation candidates.

    ``valid`` are labelled rows for early stopping, ``candidates`` and ``actual`` what is ranked and what was bought.
    """

    def objective(params: dict) -> float | None:
        ranker = ranker_for(type(config)(**(json.loads(config.to_json()) | params))).train(train, valid)
        return mean_precision(actual, ranker.ranks(candidates, k), k).select(F.col("map")).first()[0]

    found = searched(objective, space, trials, seed, startup, store, study)
    return type(config)(**(json.loads(config.to_json()) | found[0]["params"])), found
