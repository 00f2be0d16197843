"""Evaluation operators that have no SQL, against plain loops."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.frames import Panel
from barweave.functions import sessions as se, technical as te
from barweave.operators import evaluate as ev, models as mo, store as st


def test_pr_auc(spark):
    rng = random.Random(1)
    rows = [(1, rng.randint(0, 1), float(rng.randint(0, 9))) for _ in range(60)]
    got = ev.pr_auc(spark.createDataFrame(rows, "g int, y int, x double"), "y", "x", ["g"]).first().pr_auc
    total, area, r0, p0 = sum(y for _, y, _ in rows), 0.0, 0.0, 1.0
    for cut in sorted({x for *_, x in rows}, reverse=True):
        chosen = [y for _, y, x in rows if x >= cut]
        r, p = sum(chosen) / total, sum(chosen) / len(chosen)
        area, r0, p0 = area + (r - r0) * (p + p0) / 2, r, p
    assert got == pytest.approx(area)


def test_share_of_samples_above(spark):
    samples = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 3)] + [("b", None)], "k string, z double")
    asked = spark.createDataFrame([("a", 2.0), ("a", 0.0), ("a", 3.0), ("a", None), ("b", 1.0)], "k string, threshold double")
    got = {(r.k, r.threshold): r.prob_greater for r in se.ecdf_greater(samples, asked, "k").collect()}
    assert got == {("a", 2.0): 0.25, ("a", 0.0): 1.0, ("a", 3.0): 0.0, ("a", None): None, ("b", 1.0): None}


def test_normal_and_chi_squared_tails(spark):
    rows = spark.createDataFrame([(z,) for z in (-3.0, -0.5, 0.0, 0.7, 2.5, 6.0)], "z double").select("z", te.normal_tail(F.col("z")).alias("p"), te.chi_squared_tail(F.abs("z"), 3).alias("c")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=2e-7, abs=1e-12)
        x = abs(r.z)
        assert r.c == pytest.approx(math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), abs=1e-6)


def test_stationarity(spark):
    rng = np.random.default_rng(0)
    x, walk = [0.0], np.cumsum(rng.normal(size=600))
    for e in rng.normal(size=599):
        x.append(0.9 * x[-1] + e)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=i), float(v)) for s, series in (("revert", x), ("walk", walk)) for i, v in enumerate(series)]
    p = Panel(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double"))
    hurst = {r.symbol: r.hurst for r in ev.hurst_by_lags(p, "close").collect()}
    lags = np.arange(2, 21)
    wanted = np.polyfit(np.log(lags), np.log([np.std(walk[k:] - walk[:-k]) for k in lags]), 1)[0]
    assert hurst["walk"] == pytest.approx(wanted) and hurst["revert"] < hurst["walk"]
    half = {r.symbol: r.half_life for r in ev.half_life(p, "close").collect()}
    phi = 1 + np.polyfit(x[:-1], np.diff(x), 1)[0]
    assert half["revert"] == pytest.approx(-math.log(2) / math.log(phi))
    ranks = {r.symbol: r.rank for r in ev.stationarity_rank(ev.hurst_by_lags(p, "close").join(ev.half_life(p, "close"), "symbol")).collect()}
    assert ranks == {"revert": 1, "walk": 2}


def test_greedy_selection(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    rows = [(i, float(u), float(u + 0.01 * v), float(w)) for i, (u, v, w) in enumerate(zip(a, rng.normal(size=300), rng.normal(size=300)))]
    matrix = ev.correlation_matrix(spark.createDataFrame(rows, "k int, a double, b double, c double"), "k", ["a", "b", "c"])
    rho = {(r.a, r.b): r.rho for r in matrix.collect()}
    assert rho["a", "b"] > 0.99 and abs(rho["a", "c"]) < 0.2
    assert ev.greedy_select(matrix, ["a", "b", "c"], 0.8) == ["a", "c"] and ev.greedy_select(matrix, ["b", "a", "c"], 0.8, total=1) == ["b"]


def test_time_folds():
    assert st.time_folds(100, 2, 10, 5) == [(0, 75, 80, 90), (0, 85, 90, 100)]
    assert st.time_folds(100, 2, 10, 5, "rolling") == [(0, 75, 80, 90), (10, 85, 90, 100)]


def test_hidden_markov_model(spark):
    rng = np.random.default_rng(2)
    rows, state = [], 0
    for i in range(400):
        state = 1 - state if rng.random() < 0.05 else state
        rows.append(("S", datetime(2024, 1, 1) + timedelta(hours=i), state, float(rng.normal(4 * state, 1))))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, truth int, x double")
    model, first = mo.fit_hmm(df, ["x"], 2, iterations=2)
    model, last = mo.fit_hmm(df, ["x"], 2, iterations=10)
    assert last >= first and sorted(np.round(model.mean.ravel())) == [0, 4]
    found = mo.hmm_states(df, model, ["x"]).collect()
    assert np.mean([r.state == r.truth for r in found]) > 0.95 and all(abs(r.p_state_0 + r.p_state_1 - 1) < 1e-9 for r in found)
    # the likelihood of a short sequence, summed over all paths
    x, total = np.array([[0.5], [3.0], [4.0]]), 0.0
    density = np.exp(model.log_density(x))
    for path in np.ndindex(2, 2, 2):
        total += model.start[path[0]] * density[0, path[0]] * np.prod([model.move[path[t - 1], path[t]] * density[t, path[t]] for t in (1, 2)])
    assert model.passes(x)[2] == pytest.approx(math.log(total))
