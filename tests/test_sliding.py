"""Frames computed incrementally against Spark's windows and plain loops."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from barweave.frames import Panel
from barweave.operators import sliding
from barweave.plans import catalogs
from barweave.plans.feature_queries import hourly


def results(p):
    x, y = F.col("x"), F.col("y")
    found = {}
    for n, least in ((1, None), (5, None), (5, 2), (37, 20), (700, 3)):
        tag = f"{n}_{least}"
        found |= {f"{kind}_{tag}": getattr(p, kind)(x, n, least) for kind in ("sum", "mean", "std", "var", "highest", "lowest", "median")}
        found |= {f"q9_{tag}": p.quantile(y, n, 0.9, least), f"cov_{tag}": p.cov(x, y, n, least), f"corr_{tag}": p.corr(x, y, n, least), f"slope_{tag}": p.slope(y, x, n, least), f"count_{tag}": p.count(x, n), f"z_{tag}": p.zscore(p.log_return("x", 2), n, least)}
        if n < 100:
            found |= {f"skew_{tag}": p.skewness(y, n), f"kurt_{tag}": p.kurtosis(y, n)}
    other = p.let(F.avg(y).over(Window.partitionBy(*p.by, F.minute(p.ts)).orderBy(p.ts)))
    found["after_another_order"] = p.mean(p.mean(other, 4), 3)
    return found | {"lag": p.lag("s"), "lag3": p.lag("ts", 3), "lead": p.lead("x"), "deep": p.mean(p.std(p.diff("x"), 4), 6), "carried": p.carried(p.mean("x", 3))}


def table_of(spark, n=260):
    rng = np.random.default_rng(8)
    frames = []
    for s in ("a", "b", None):
        x = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
        x[40:90] = 101.25  # equal values
        x[200] = 1e7  # a jump that nothing after it may feel
        d = pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "x": x, "y": rng.integers(0, 6, n).astype(float), "s": [f"{s}{i}" for i in range(n)]})
        d.loc[rng.random(n) < 0.1, "x"] = np.nan
        d.loc[100:150, "y"] = np.nan
        frames.append(d)
    df = spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=2))
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("x", "y")})


def test_sliding_is_the_window(spark):
    df = table_of(spark).persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        a, b = (p.select(**results(p)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for p in (Panel(df), sliding.Sliding(df)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(a.columns) == list(b.columns) and len(a) == len(b) == 780
    for c in a.columns[2:]:
        if a[c].dtype == object or "datetime" in str(a[c].dtype):
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
            continue
        u, v = a[c].to_numpy(float), b[c].to_numpy(float)
        assert (np.isnan(u) == np.isnan(v)).all(), (c, np.flatnonzero(np.isnan(u) != np.isnan(v))[:5])
        there = ~np.isnan(u)
        worst = np.max(np.abs(u - v)[there] / (1e-9 + np.abs(u[there])), initial=0)
        assert worst < 1e-7 or c.startswith(("cov", "corr", "slope", "skew", "kurt")) and np.max(np.abs(u - v)[there]) < 1e-9 * np.max(np.abs(u[there])), (c, worst, np.argmax(np.abs(u - v)[there]))


def test_one_shuffle_for_any_number_of_frames(spark):
    p = sliding.Sliding(table_of(spark))
    plan = p.select(a=p.mean(p.zscore(p.log_return("x"), 30), 10), b=p.median("y", 50), c=p.corr("x", "y", 90))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_long_frames_of_quantiles_take_seconds():
    x = np.random.default_rng(1).normal(size=100_000)
    began = time.process_time()
    found = sliding.quantiles(x, 5000, [0.1, 0.5])
    assert time.process_time() - began < 10
    for i in (0, 17, 4999, 5000, 77_777):
        assert found[0][i] == pytest.approx(np.quantile(x[max(0, i - 4999) : i + 1], 0.1)) and found[1][i] == pytest.approx(np.median(x[max(0, i - 4999) : i + 1]))


def test_spreads_do_not_lose_their_digits():
    rng = np.random.default_rng(2)
    x = 1e9 + rng.normal(0, 1e-3, 3000)
    x[1000] = 1e15
    held = sliding.Frames(x, 64)
    n, found = sliding.products(held, held)
    for i in (5, 63, 64, 900, 1000, 1063, 1064, 1065, 2999):
        part = x[max(0, i - 63) : i + 1]
        assert n[i] == len(part) and found[i] == pytest.approx(((part - part.mean()) ** 2).sum(), rel=1e-6)


def test_sliding_of_nothing(spark):
    p = sliding.Sliding(table_of(spark).limit(0))
    assert p.select(**results(p)).count() == 0


@pytest.mark.parametrize("catalog", ["derived", "technical"])
def test_every_column_of_a_catalog_is_that_of_the_windows(spark, catalog):
    bars = hourly(spark, "/root/testdata/sf0.01").withColumn("ls_ratio", (1 + F.col("taker_buy")) / (1 + F.col("volume") - F.col("taker_buy"))).where("symbol in ('click', 'view')").persist()
    made = {"derived": lambda k: catalogs.derived_catalog(bars, k), "technical": lambda k: catalogs.technical_catalog(bars, "1H", 240, panel=k)}[catalog]
    a, b = (made(k).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for k in (sliding.Sliding, Panel))
    assert list(a.columns) == list(b.columns) and len(a.columns) >= 112 and len(a) == len(b)
    for c in a.columns[2:]:
        u, v = a[c].to_numpy(float), b[c].to_numpy(float)
        assert (np.isnan(u) == np.isnan(v)).all(), c
        assert np.max(np.abs(u - v)[~np.isnan(v)] / (1e-6 + np.abs(v[~np.isnan(v)])), initial=0) < 1e-8, c
