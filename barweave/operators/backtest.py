"""Backtests: entry rules as expressions of a bar, the position as a state machine over the bars.

The state machine streams over each symbol in time order, a batch at a time, for all settings of a grid at once: bars
are read once for up to ``BLOCK`` settings, whose states are arrays, and copied once for each further block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..frames import col, flag, ratio
from .recursive import _stretches

OPERATORS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}


def holds(x, op: str, threshold: float | None) -> Column:
    """Whether the value passes; no threshold always does, an unknown value never."""
    return F.lit(True) if threshold is None else F.coalesce(OPERATORS[op](col(x), F.lit(threshold)), F.lit(False))


def entry_signal(long_rules: list[tuple], short_rules: list[tuple], direction: str = "both", tie: str = "skip") -> Column:
    """1, -1 or 0: all rules of a side hold; if both sides do, none or the one of ``tie`` is taken."""
    every = lambda rules: reduce(lambda a, b: a & b, [holds(*r) for r in rules], F.lit(bool(rules)))
    up = every(long_rules) if direction in ("long", "both") else F.lit(False)
    down = every(short_rules) if direction in ("short", "both") else F.lit(False)
    both = {"skip": 0, "long": 1, "short": -1}[tie]
    return F.when(up & down, both).when(up, 1).when(down, -1).otherwise(0)


def rules_met(values: dict[str, tuple[str, float]], mode: str = "all", least: int = 1) -> Column:
    """Rules over several timeframes by column: all, any, majority or a count of those whose value is known."""
    known = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0))
    met = sum((flag(OPERATORS[op](F.col(c), F.lit(t))).cast("int") for c, (op, t) in values.items()), F.lit(0))
    return {"all": (known > 0) & (met == known), "any": met > 0, "majority": met * 2 > known, "count": met >= least}[mode]


def stop_from_close(direction, close, stop_pct) -> Column:
    """``stop_pct`` is below zero: under the close for a long position, over it for a short one."""
    return col(close) * (1 + col(direction) * col(stop_pct) / 100)


def dynamic_stop_pct(volatility_before, times: float, cutoff: float) -> Column:
    return -F.least(col(volatility_before) * times, F.lit(cutoff)) * 100


def pnl_pct(entry, exit_, direction, fee_pct: float = 0.0) -> Column:
    return F.when(col(direction) == 1, ratio(exit_, entry) - 1).otherwise(1 - ratio(exit_, entry)) * 100 - fee_pct


TRADES = "symbol string, config string, entry_time timestamp_ntz, exit_time timestamp_ntz, direction int, entry_price double, exit_price double, bars_held int, exit_reason string, stop_loss_pct double, pnl_pct double"
NO_TRADES = pd.DataFrame(columns=[c.split()[0] for c in TRADES.split(", ")])
#: Settings of one walk over the bars, and of a grid: it is sent to every task.
BLOCK, MOST_SETTINGS = 5_000, 200_000


def run_backtest(bars: DataFrame, configs: DataFrame, fee_pct: float = 0.0, report_open: bool = False) -> DataFrame:
    """Trades of every configuration (config, stop_loss_pct below zero, expiry_bars, direction) over every symbol.

    ``bars`` has symbol, ts, prices and ``signal`` (1, -1, 0). A signal fills at the next bar's mean price. The stop
    works from the fill's close on and fills where the next bar reaches it, at the open if it opens beyond. After
    ``expiry_bars`` bars the position closes at the next bar's mean price; at the end of the data at the last close.
    A stop that still works on the last bar leaves the position unreported unless ``report_open``.
    """
    settings = configs.select(F.col("config").cast("string"), F.col("stop_loss_pct").cast("double"), F.col("expiry_bars").cast("int"), F.col("direction").alias("side")).orderBy("config").limit(MOST_SETTINGS + 1).toPandas()
    if len(settings) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    blocks = [settings.iloc[at : at + BLOCK].reset_index(drop=True) for at in range(0, len(settings), BLOCK)]
    work = bars.select("symbol", "ts", "open", "high", "low", "close", F.coalesce("signal", F.lit(0)).cast("int").alias("signal"))
    work = work.withColumn("_block", F.explode(F.array(*(F.lit(i) for i in range(len(blocks))))) if blocks else F.lit(0))
    held = bars.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for batch in batches:
            trades: list[pd.DataFrame] = []
            for start, stop in _stretches(batch.symbol.astype(str) + "\0" + batch._block.astype(str)):
                rows = batch.iloc[start:stop]
                now = (rows.symbol.iloc[0], int(rows._block.iloc[0]))
                if now != key:
                    if machine:
                        trades += machine.finish()
                    key, machine = now, Machines(now[0], held.value[now[1]], fee_pct, report_open)
                trades += machine.walk(rows)
            yield pd.concat(trades) if trades else NO_TRADES
        if machine:
            yield from machine.finish()

    if not blocks:
        return bars.sparkSession.createDataFrame([], TRADES)
    return work.repartition("symbol", "_block").sortWithinPartitions("symbol", "_block", "ts").mapInPandas(run, TRADES)


FLAT, ENTERING, OPEN, CLOSING = range(4)


class Machines:
    """One position at most for each of a block of settings: flat, waiting to fill, open with a stop, waiting to close.

    A bar is one step of all settings at once, on arrays; memory is that of the settings and of a batch's trades.
    """

    def __init__(self, symbol: str, settings: pd.DataFrame, fee: float, report_open: bool) -> None:
        self.symbol, self.fee, self.report_open = symbol, fee, report_open
        self.config = settings["config"].to_numpy(object)
        self.stop_pct, self.expiry = settings["stop_loss_pct"].to_numpy(float), settings["expiry_bars"].to_numpy(np.int64)
        side, n = settings["side"].to_numpy(object), len(settings)
        self.takes = {1: np.isin(side, ("long", "both")), -1: np.isin(side, ("short", "both"))}
        self.state, self.way, self.held = np.zeros(n, np.int8), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.price, self.stop, self.entered = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, "datetime64[us]")
        self.last, self.found = None, []

    def trade(self, at: np.ndarray, ts: np.datetime64, price: np.ndarray | float, reason: str) -> None:
        price, way, entry = np.broadcast_to(price, at.shape), self.way[at], self.price[at]
        gain = np.where(way == 1, price / entry - 1, 1 - price / entry) * 100 - self.fee
        self.found.append((self.config[at], self.entered[at], np.full(len(at), ts), way, entry, price, self.held[at], np.full(len(at), reason, object), self.stop_pct[at], gain))
        self.state[at] = FLAT

    def walk(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        """The trades that end in the next bars."""
        times = rows["ts"].to_numpy("datetime64[us]")
        for ts, open_, high, low, close, signal in zip(times, *(rows[c].to_numpy() for c in ("open", "high", "low", "close", "signal"))):
            self._step(ts, open_, high, low, close, int(signal))
            self.last = ts, close
        return self._taken()

    def _step(self, ts: np.datetime64, open_: float, high: float, low: float, close: float, signal: int) -> None:
        mean, state = (open_ + high + low + close) / 4, self.state
        free = state == FLAT
        if not free.all():
            entering, is_open, closing = np.flatnonzero(state == ENTERING), np.flatnonzero(state == OPEN), np.flatnonzero(state == CLOSING)
            self.held[is_open] += 1
            self.held[closing] += 1
            if len(closing):
                self.trade(closing, ts, mean, "time_exit")
            if len(is_open):
                long, stop = self.way[is_open] == 1, self.stop[is_open]
                hit = np.where(long, low <= stop, high >= stop)
                beyond = np.where(long, open_ <= stop, open_ >= stop)
                if hit.any():
                    self.trade(is_open[hit], ts, np.where(beyond, open_, stop)[hit], "stop_loss")
                old = is_open[~hit & (self.held[is_open] >= self.expiry[is_open])]
                state[old] = CLOSING
            state[entering], self.entered[entering], self.price[entering], self.held[entering] = OPEN, ts, mean, 0
            self.stop[entering] = close * (1 + self.way[entering] * self.stop_pct[entering] / 100)
        if signal in self.takes:  # what closed in this bar waits for the next signal
            at = free & self.takes[signal]
            state[at], self.way[at] = ENTERING, signal

    def _taken(self) -> list[pd.DataFrame]:
        parts, self.found = self.found, []
        names = [c.split()[0] for c in TRADES.split(", ")]
        if not parts:
            return []
        columns = [np.concatenate(x) for x in zip(*parts)]
        return [pd.DataFrame(dict(zip(names[1:], columns))).assign(symbol=self.symbol)[names]]

    def finish(self) -> list[pd.DataFrame]:
        at = np.flatnonzero((self.state == CLOSING) | ((self.state == OPEN) & self.report_open))
        if len(at):
            self.trade(at, self.last[0], self.last[1], "end_of_data")
        return self._taken()


def trade_stats(trades: DataFrame, *by: str, start: float = 1000.0, most: float = 100_000.0) -> DataFrame:
    """Per group: trades, win rate, mean and summed gain, by reason, and capital compounded up to a cap.

    Capital is a fold over a group's gains in time order; a group is one symbol and configuration.
    """
    gains = F.transform(F.sort_array(F.collect_list(F.struct("exit_time", "entry_time", "pnl_pct"))), lambda t: t["pnl_pct"])
    return trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"),
        F.avg((F.col("pnl_pct") > 0).cast("double")).alias("win_rate"),
        F.avg("pnl_pct").alias("mean_pnl"),
        F.sum("pnl_pct").alias("total_pnl"),
        F.avg(F.when(F.col("pnl_pct") > 0, F.col("pnl_pct"))).alias("mean_win"),
        F.avg(F.when(F.col("pnl_pct") <= 0, F.col("pnl_pct"))).alias("mean_loss"),
        F.count_if(F.col("exit_reason") == "stop_loss").alias("n_stops"),
        F.count_if(F.col("exit_reason") == "time_exit").alias("n_time_exits"),
        F.aggregate(gains, F.lit(start), lambda c, g: F.least(c * (1 + g / 100), F.lit(most))).alias("capital"),
    )


def rolling_trade_stats(trades: DataFrame, gain: str, days: int, by: list[str] = (), ts: str = "ts") -> DataFrame:
    """Each realised trade (or bar) with the win rate, mean and sum of gains and their number over the days before it.

    The window is open on the left: a trade exactly ``days`` before is out, one of the same time is in. Without ``by``
    all trades are one sequence.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(*(by or [F.lit(1)])).orderBy(micros).rangeBetween(-(max(1, days) * 86_400_000_000 - 1), 0)
    win = (F.col(gain) > 0).cast("double")
    realised = trades.where(F.col(gain).isNotNull())
    return realised.select(*by, ts, F.avg(win).over(frame).alias("win_rate"), F.avg(gain).over(frame).alias("avg_return"), F.sum(gain).over(frame).alias("total_return"), F.count(F.lit(1)).over(frame).alias("n_trades"))


def threshold_strategy(df: DataFrame, prices: DataFrame, signal: str, threshold: float, mode: str = "symmetric") -> DataFrame:
    """Yes above the threshold and no below its complement, at the price one minute later; gain at settlement."""
    later = prices.select(F.col("ts").alias("_later"), F.col("market_prob").alias("next_prob"))
    joined = df.withColumn("_later", F.col("ts") + F.expr("INTERVAL 1 MINUTE")).join(later, "_later", "left").drop("_later")
    yes = (F.col(signal) >= threshold) if mode in ("symmetric", "yes_only") else F.lit(False)
    no = (F.col(signal) <= 1 - threshold) if mode in ("symmetric", "no_only") else F.lit(False)
    side = F.when(yes, "YES").when(no, "NO")
    gain = F.when(yes, F.col("outcome") - F.col("next_prob")).when(no, F.col("next_prob") - F.col("outcome"))
    return joined.withColumns({"side": side, "pnl": gain})


def grid(spark, **settings: list) -> DataFrame:
    """Every combination of the settings as a table with a name for each."""
    from itertools import product

    names = list(settings)
    rows = [("|".join(f"{n}={v}" for n, v in zip(names, values)), *values) for values in product(*settings.values())]
    return spark.createDataFrame(rows, ["config", *names])
