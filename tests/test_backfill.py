"""Features after late, corrected and deleted bars against a rebuild of everything."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import backfill as bf, recursive as rec
from barweave.operators.sliding import Sliding

START = dt.datetime(2024, 1, 1)


def bars_of(spark, prices):
    return spark.createDataFrame([(s, START + dt.timedelta(hours=h), float(x)) for (s, h), x in prices.items()], "symbol string, ts timestamp_ntz, close double")


def features(df, by=("symbol",)):
    p = Sliding(df, by=by)
    found = p.with_columns(mean=p.mean("close", 30, 5), high=p.highest("close", 12, 1), before=p.lag("close", 2), change=p.mean(p.change("close"), 10, 3))
    return found.select("symbol", "ts", "mean", "high", "before", "change")


def rounded(df):
    return sorted((r.symbol, r.ts, *(None if x is None else round(x, 9) for x in (r.mean, r.high, r.before, r.change))) for r in df.collect())


@pytest.mark.parametrize("seed, broadcast", [(0, 10**6), (1, 0), (2, 10**6)])
def test_late_bars_change_what_a_rebuild_changes(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(bf, "BROADCAST", broadcast)
    rng = random.Random(seed)
    old = {(s, h): rng.uniform(50, 150) for s in "abc" for h in range(24 * 120) if rng.random() < 0.97 and not 1500 < h < 1600}
    new, changed = dict(old), []
    for _ in range(3):
        key = ("a", rng.randrange(24 * 110))
        new[key] = 999.0  # corrected or late
        changed.append(key)
    gone = rng.choice([k for k in old if k[0] == "b"])
    del new[gone]
    new["b", 1550] = 777.0  # on a day that had no bars
    new["new", 5] = 1.0
    changed += [gone, ("b", 1550), ("new", 5)]
    bars = bars_of(spark, new)
    at = spark.createDataFrame([(s, START + dt.timedelta(hours=h)) for s, h in changed], "symbol string, ts timestamp_ntz")
    want = features(bars)
    before = features(bars_of(spark, old)).persist()
    assert rounded(bf.refreshed(before, bars, at, features, 29)) == rounded(want)
    read = bf.rows_to_read(bars, bf.stretches(bf.day_counts(bars), at, 29))
    assert {r.symbol for r in read.select("symbol").distinct().collect()} == {"a", "b", "new"} and read.count() < len(changed) * (29 * 2 + 24 * 3) < 0.1 * len(new)


def test_nothing_changed(spark):
    bars = bars_of(spark, {("a", h): h for h in range(100)})
    none = bars.select("symbol", "ts").limit(0)
    assert rounded(bf.refreshed(features(bars), bars, none, features, 29)) == rounded(features(bars))
    assert bf.rows_to_read(bars, bf.stretches(bf.day_counts(bars), none, 29)).count() == 0


def test_averages_over_the_whole_history_after_their_reach(spark):
    rng = random.Random(4)
    prices = {("a", h): rng.uniform(50, 150) for h in range(1500)}
    alpha = 0.2

    def smooth(df, by=("symbol",)):
        key = F.concat_ws("/", *by)
        return rec.with_ewm(df.withColumn("_series", key), "_series", "ts", e=(F.col("close"), alpha, 0)).select("symbol", "ts", "e")

    before = smooth(bars_of(spark, prices))
    prices["a", 700] = 500.0
    bars = bars_of(spark, prices)
    at = spark.createDataFrame([("a", START + dt.timedelta(hours=700))], "symbol string, ts timestamp_ntz")
    found = {r.ts: r.e for r in bf.refreshed(before, bars, at, smooth, bf.reach(alpha)).collect()}
    want = {r.ts: r.e for r in smooth(bars).collect()}
    assert found.keys() == want.keys() and max(abs(found[t] - x) for t, x in want.items()) < 1e-9
    assert (1 - alpha) ** bf.reach(alpha) <= 1e-15 < (1 - alpha) ** (bf.reach(alpha) - 1) and bf.reach(1.0) == 0
