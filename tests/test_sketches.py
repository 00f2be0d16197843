"""Quantile sketches against exact quantiles."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import evaluate as ev


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 60_000
    d = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 86400, n), unit="s"), "x": rng.lognormal(0, 1, n), "z": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n))})
    d.loc[rng.random(n) < 0.05, "x"] = np.nan
    return spark.createDataFrame(d).persist(), d


def near(values, found, q, share):
    """Whether a value's rank is that near to the wanted one."""
    values = np.sort(values[~np.isnan(values)])
    return np.searchsorted(values, found, "left") / len(values) - share <= q <= np.searchsorted(values, found, "right") / len(values) + share


QS = [0.01, 0.25, 0.5, 0.9, 0.99]


def test_both_ways_of_one_function(rows):
    df, d = rows
    exact, sketched = (df.groupBy("g").agg(*(c.alias(n) for n, c in ev.quantiles("x", QS, exact).items())).collect() for exact in (True, False))
    assert [c for c in exact[0].asDict()] == [c for c in sketched[0].asDict()]
    for r in sketched:
        for q in QS:
            assert near(d[d.g == r.g].x.to_numpy(), r[f"q{int(q * 100):02d}"], q, 0.005)


def test_sketches_of_days_merge_into_any_range(rows):
    df, d = rows
    kept = ev.daily_sketches(df, ["x", "z"], ["g"]).persist()
    assert kept.count() == 2 * 2 * 20 and kept.agg(F.max(F.length("sketch"))).first()[0] < 60_000
    for start, end in ((None, None), ("2024-01-05", "2024-01-12"), ("2024-01-19", None)):
        part = d[(d.ts >= (start or "2000")) & (d.ts < (end or "2100"))]
        found = ev.quantiles_between(kept, QS, start, end, ["g"]).collect()
        assert len(found) == 4
        for r in found:
            values = part[part.g == r.g][r.feature].to_numpy()
            assert r.n == (~np.isnan(values)).sum() and all(near(values, r[f"q{int(q * 100):02d}"], q, 0.01) for q in QS)
    whole = ev.quantiles_between(kept, [0.5]).collect()
    assert {r.feature for r in whole} == {"x", "z"}


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), None)], "g string, ts timestamp, x double")
    assert df.agg(*(c.alias(n) for n, c in ev.quantiles("x", [0.5], False).items())).first().q50 is None
    assert df.limit(0).agg(*(c.alias(n) for n, c in ev.quantiles("x", [0.5], False).items())).first().q50 is None
    assert ev.daily_sketches(df, ["x"]).first().n == 0 and ev.quantiles_between(ev.daily_sketches(df, ["x"]), [0.5]).count() == 0
