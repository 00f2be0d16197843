"""The Parzen search on known surfaces, and ranks by counts."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barweave.operators import evaluate as ev
from barweave.operators.search import Between, OneOf, minimise, parzen_search

SPACE = {"x": Between(-10, 10), "rate": Between(1e-5, 1.0, log=True), "depth": Between(1, 20, whole=True), "kind": OneOf(("a", "b", "c")), "extra": Between(0, 1, when=("kind", "b"))}


def surface(s):
    base = {"a": 3.0, "b": 0.0, "c": 5.0}[s["kind"]]
    return base + (s["x"] - 4) ** 2 / 20 + (math.log10(s["rate"]) + 2) ** 2 + abs(s["depth"] - 7) / 5 + 2 * abs(s.get("extra", 0.5) - 0.9)


def test_it_beats_random_draws_and_repeats_itself():
    model, drawn = [], []
    for seed in range(8):
        best, trials = minimise(surface, SPACE, trials=60, seed=seed)
        assert trials == minimise(surface, SPACE, trials=60, seed=seed, at_once=4)[1] and len(trials) == 60
        assert surface(best) == min(loss for _, loss in trials)
        model.append(surface(best))
        drawn.append(min(loss for _, loss in minimise(surface, SPACE, trials=60, startup=60, seed=seed)[1]))
    assert np.mean(model) < 0.6 * np.mean(drawn) and sum(m < d for m, d in zip(model, drawn)) >= 7
    for s, _ in trials:
        assert -10 <= s["x"] <= 10 and 1e-5 <= s["rate"] <= 1 and s["depth"] in range(1, 21) and ("extra" in s) == (s["kind"] == "b")


def test_losses_that_are_no_numbers_are_the_worst():
    best, trials = minimise(lambda s: math.nan if s["x"] > 0 else abs(s["x"] + 3), {"x": Between(-10, 10)}, trials=30, seed=1)
    assert best["x"] <= 0 and abs(best["x"] + 3) < 1 and any(math.isnan(loss) for _, loss in trials)
    assert minimise(lambda s: math.nan, {"x": Between(0, 1)}, trials=3)[1][0][0].keys() == {"x"}


def test_densities_are_densities():
    setting, choices = Between(0.1, 100, log=True), OneOf(("a", "b"))
    at = setting.density([1.0, 2.0, 50.0])
    places = np.linspace(*setting.ends(), 4001)
    assert abs(np.trapezoid([math.exp(at(math.exp(p))) for p in places], places) - 1) < 1e-3
    assert abs(sum(math.exp(choices.density(["a", "a"])(c)) for c in "ab") - 1) < 1e-12
    rng = random.Random(0)
    drawn = [setting.density([2.0] * 30, rng) for _ in range(300)]
    assert np.median(drawn) == np.clip(np.median(drawn), 1.2, 3.5)


def test_search_of_trees_over_time_folds(spark):
    rng = np.random.default_rng(0)
    d = pd.DataFrame({"_row": range(1, 241), "f1": rng.normal(size=240), "f2": rng.normal(size=240)})
    d["y"] = np.sign(d.f1) + 0.05 * rng.normal(size=240)
    space = {"maxIter": Between(1, 6, whole=True), "maxDepth": OneOf((1, 2))}
    best, trials = parzen_search(spark.createDataFrame(d), ["f1", "f2"], "y", space, trials=5, startup=3, batch=2, n_folds=2, fold_size=60)
    assert len(trials) == 5 and best in [s for s, _ in trials] and min(loss for _, loss in trials) < 0.6


def test_ranks_by_counts_are_those_of_the_window(spark):
    rng = np.random.default_rng(6)
    d = pd.DataFrame({"g": np.where(np.arange(3000) % 3 == 0, "a", "b"), "x": np.where(rng.random(3000) < 0.5, 0.0, rng.integers(-50, 900, 3000) / 4), "i": range(3000)})
    d.loc[rng.random(3000) < 0.05, "x"] = np.nan
    df = spark.createDataFrame(d).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    want = d.groupby("g").x.rank().to_dict()
    for few, heavy in ((10**6, 1e-3), (0, 1e-3), (0, 0.2), (0, 1.0)):
        found = ev.with_average_rank(df, "x", ["g"], "r", 20, few, heavy).collect()
        assert len(found) == 3000 and all((r.r is None and np.isnan(want[r.i])) or r.r == want[r.i] for r in found)
