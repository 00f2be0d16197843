"""The walk of all settings at once against one state machine for each."""

import time

import numpy as np
import pandas as pd
import pytest

from barweave.operators import backtest as bt


class Machine:
    """One position at most: flat, waiting to fill, open with a stop, waiting to close."""

    def __init__(self, symbol: str, config: str, stop_pct: float, expiry: int, side: str, fee: float, report_open: bool) -> None:
        self.symbol, self.config, self.stop_pct, self.expiry, self.fee, self.report_open = symbol, config, stop_pct, expiry, fee, report_open
        self.sides = {"long": (1,), "short": (-1,), "both": (1, -1)}[side]
        self.state, self.last = "flat", None

    def trade(self, ts, price: float, reason: str) -> list[tuple]:
        gain = (price / self.price - 1 if self.way == 1 else 1 - price / self.price) * 100 - self.fee
        self.state = "flat"
        return [(self.symbol, self.config, self.entered, ts, self.way, self.price, price, self.held, reason, self.stop_pct, gain)]

    def step(self, ts, open_: float, high: float, low: float, close: float, signal: int) -> list[tuple]:
        out: list[tuple] = []
        mean = (open_ + high + low + close) / 4
        if self.state == "entering":
            self.state, self.entered, self.price, self.held = "open", ts, mean, 0
            self.stop = close * (1 + self.way * self.stop_pct / 100)
        elif self.state in ("open", "closing"):
            self.held += 1
            if self.state == "closing":
                out = self.trade(ts, mean, "time_exit")
            elif (low <= self.stop) if self.way == 1 else (high >= self.stop):
                beyond = open_ <= self.stop if self.way == 1 else open_ >= self.stop
                out = self.trade(ts, open_ if beyond else self.stop, "stop_loss")
            elif self.held >= self.expiry:
                self.state = "closing"
        if self.state == "flat" and not out and signal in self.sides:
            self.state, self.way = "entering", int(signal)
        self.last = (ts, close)
        return out

    def finish(self) -> list[tuple]:
        if self.state == "closing" or (self.state == "open" and self.report_open):
            return self.trade(self.last[0], self.last[1], "end_of_data")
        return []


def bars_of(n, seed=0, symbols=("a", "b")):
    rng, frames = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        open_ = np.r_[100.0, close[:-1]] * (1 + rng.normal(0, 0.003, n))
        high, low = np.maximum(open_, close) * (1 + rng.random(n) / 100), np.minimum(open_, close) * (1 - rng.random(n) / 100)
        frames.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="h").astype("datetime64[us]"), "open": open_, "high": high, "low": low, "close": close, "signal": rng.choice([-1, 0, 0, 1], n)}))
    return pd.concat(frames)


def plain(bars, settings, fee, report_open):
    found = []
    for symbol, rows in bars.groupby("symbol"):
        for s in settings.itertuples():
            machine = Machine(symbol, s.config, s.stop_loss_pct, s.expiry_bars, s.direction, fee, report_open)
            for bar in zip(rows.ts, rows.open, rows.high, rows.low, rows.close, rows.signal):
                found += machine.step(*bar)
            found += machine.finish()
    return found


@pytest.mark.parametrize("block, report_open", [(5000, True), (7, False)])
def test_all_settings_at_once_give_the_trades_of_each(spark, monkeypatch, block, report_open):
    monkeypatch.setattr(bt, "BLOCK", block)
    bars = bars_of(300)
    configs = bt.grid(spark, stop_loss_pct=[-0.5, -2.0, -30.0], expiry_bars=[1, 5, 400], direction=["long", "short", "both"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        found = bt.run_backtest(spark.createDataFrame(bars.sample(frac=1, random_state=0)).withColumn("ts", bt.F.col("ts").cast("timestamp_ntz")), configs, 0.1, report_open).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(bars, configs.toPandas(), 0.1, report_open)
    key = lambda t: (t[0], t[1], str(t[2]))
    got = sorted((tuple(r) for r in found.itertuples(index=False)), key=key)
    assert len(got) == len(want) > 500 and {t[8] for t in got} >= {"time_exit", "stop_loss", "end_of_data"}
    for a, b in zip(got, sorted(want, key=key)):
        assert (a[0], a[1], pd.Timestamp(a[2]), pd.Timestamp(a[3]), a[4], a[7], a[8]) == (b[0], b[1], pd.Timestamp(b[2]), pd.Timestamp(b[3]), b[4], b[7], b[8])
        assert np.allclose([a[5], a[6], a[9], a[10]], [b[5], b[6], b[9], b[10]], rtol=1e-12)


def test_a_thousand_settings_walk_the_bars_once():
    bars = bars_of(5_000, symbols=("a",))
    settings = pd.DataFrame([(f"{s}|{e}", -s / 10, e, "both") for s in range(1, 41) for e in range(1, 26)], columns=["config", "stop_loss_pct", "expiry_bars", "side"])
    began, machines = time.process_time(), bt.Machines("a", settings, 0.0, True)
    n = sum(len(t) for part in (bars.iloc[:3000], bars.iloc[3000:]) for t in machines.walk(part)) + sum(map(len, machines.finish()))
    took = time.process_time() - began
    assert n > 100_000 and took < 30  # 5 million steps


def test_grids_that_are_empty_or_too_large(spark, monkeypatch):
    bars = spark.createDataFrame(bars_of(5)).withColumn("ts", bt.F.col("ts").cast("timestamp_ntz"))
    configs = bt.grid(spark, stop_loss_pct=[-1.0, -2.0], expiry_bars=[3], direction=["long"])
    assert bt.run_backtest(bars, configs.limit(0)).count() == 0 and bt.run_backtest(bars.limit(0), configs).count() == 0
    monkeypatch.setattr(bt, "MOST_SETTINGS", 1)
    with pytest.raises(ValueError):
        bt.run_backtest(bars, configs)
