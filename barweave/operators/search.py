"""Model-based search of settings: a tree-structured Parzen estimator.

A trial's score is a loss. After some random trials the best share of them is taken as good and the rest as bad; each
setting gets a density of the good values and one of the bad ones (a mixture of normal curves about the values on the
setting's scale, wide where there are few; smoothed counts for choices). Candidates are drawn from the good densities, and
those with the largest ratio of good to bad, which is where improvement is expected, are tried next, a batch at a time.
A setting under a choice (``when``) takes part in those trials alone that chose it.

The driver holds the trials; their number is the caller's. The same seed gives the same trials.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from .models import fit_trees, metrics, predict
from .store import time_folds


@dataclass(frozen=True)
class Between:
    """A number from low to high, on a logarithmic scale or as a whole number if asked for."""

    low: float
    high: float
    log: bool = False
    whole: bool = False
    when: tuple[str, object] | None = None

    def ends(self) -> tuple[float, float]:
        spare = 0.5 if self.whole else 0.0
        low, high = self.low - spare, self.high + spare
        return (math.log(max(low, 1e-12)), math.log(high)) if self.log else (low, high)

    def draw(self, rng: random.Random) -> float:
        return self.value(rng.uniform(*self.ends()))

    def value(self, place: float) -> float:
        x = math.exp(place) if self.log else place
        x = round(x) if self.whole else x
        return min(max(x, self.low), self.high)

    def place(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def density(self, values: list, rng: random.Random | None = None) -> Callable[[float], float]:
        """The logarithm of the density at a value; with a generator, a drawn value instead."""
        low, high = self.ends()
        places = sorted(self.place(v) for v in values)
        middle, span = (low + high) / 2, high - low
        curves = [(middle, span)]  # what is known beforehand
        edges = [low, *places, high]
        for i, place in enumerate(places, 1):
            wide = max(place - edges[i - 1], edges[i + 1] - place)
            curves.append((place, min(max(wide, span / min(100.0, len(places) + 2.0)), span)))
        if rng is not None:
            while True:
                place = rng.gauss(*rng.choice(curves))
                if low <= place <= high:
                    return self.value(place)
        normal = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
        inside = [normal((high - m) / s) - normal((low - m) / s) for m, s in curves]

        def at(value: float) -> float:
            x = self.place(value)
            total = sum(math.exp(-0.5 * ((x - m) / s) ** 2) / (s * share * math.sqrt(2 * math.pi)) for (m, s), share in zip(curves, inside))
            return math.log(max(total / len(curves), 1e-300))

        return at


@dataclass(frozen=True)
class OneOf:
    """One of some choices."""

    choices: tuple
    when: tuple[str, object] | None = None

    def draw(self, rng: random.Random) -> object:
        return rng.choice(self.choices)

    def density(self, values: list, rng: random.Random | None = None) -> Callable[[object], float]:
        weights = [1 + sum(v == c for v in values) for c in self.choices]
        if rng is not None:
            return rng.choices(self.choices, weights)[0]
        return lambda value: math.log(weights[self.choices.index(value)] / sum(weights))


Space = dict[str, Between | OneOf]


def _asked(setting: Between | OneOf, chosen: dict) -> bool:
    return setting.when is None or chosen.get(setting.when[0]) == setting.when[1]


def _draw(space: Space, rng: random.Random, held: list[dict] | None = None) -> dict:
    """Settings at random, or from the densities of those held."""
    chosen: dict = {}
    for name, setting in space.items():
        if _asked(setting, chosen):
            values = [h[name] for h in held or () if name in h]
            chosen[name] = setting.density(values, rng) if values else setting.draw(rng)
    return chosen


def minimise(objective: Callable[[dict], float], space: Space, trials: int = 50, startup: int = 10, batch: int = 4, seed: int = 7, good: float = 0.25, candidates: int = 48, at_once: int = 1) -> tuple[dict, list[tuple[dict, float]]]:
    """The settings with the least loss, and all trials in order; a loss that is no number counts as the worst.

    A setting that depends on a choice (``when``) stands behind it in the space. ``at_once`` trials of a batch run at the
    same time.
    """
    rng, found = random.Random(seed), []
    with ThreadPoolExecutor(at_once) as pool:
        while len(found) < trials:
            many = min(batch, trials - len(found))
            if len(found) < startup:
                todo = [_draw(space, rng) for _ in range(min(many, startup - len(found)))]
            else:
                ranked = [s for s, _ in sorted(found, key=lambda t: math.inf if math.isnan(t[1]) else t[1])]
                cut = max(1, math.ceil(good * len(ranked)))
                best, rest = ranked[:cut], ranked[cut:]
                drawn = [_draw(space, rng, best) for _ in range(candidates * many)]
                ahead = {n: s.density([b[n] for b in best if n in b]) for n, s in space.items()}
                behind = {n: s.density([b[n] for b in rest if n in b]) for n, s in space.items()}
                gain = lambda c: sum(ahead[n](v) - behind[n](v) for n, v in c.items())
                # each of the batch is the best of its own draws, so that they don't crowd about one place
                todo = [max(drawn[i * candidates : (i + 1) * candidates], key=gain) for i in range(many)]
            found += zip(todo, pool.map(inheritable_thread_target(objective), todo))
    return min(found, key=lambda t: math.inf if math.isnan(t[1]) else t[1])[0], found


def parzen_search(df: DataFrame, features: list[str], target: str, space: Space, trials: int = 50, n_folds: int = 3, fold_size: int = 100, gap: int = 0, at_once: int = 4, **options) -> tuple[dict, list[tuple[dict, float]]]:
    """Settings of ``fit_trees`` with the least mean RMSE over time-ordered folds; ``df`` has ``_row`` (1, 2, ... by time)."""
    folds = time_folds(df.count(), n_folds, fold_size, gap)
    inside = lambda a, b: df.where((F.col("_row") > a) & (F.col("_row") <= b))

    def loss(settings: dict) -> float:
        errors = [metrics(predict(fit_trees(inside(a, b), features, target, **settings), inside(c, d)), target).first().rmse for a, b, c, d in folds]
        return sum(errors) / len(errors) if errors else math.nan

    return minimise(loss, space, trials, at_once=at_once, **options)
