"""Bars: from ticks to bars, to longer timeframes, as-of lookups, lags, and checks of the grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..frames import Panel

TIMEFRAMES = {"1H": "1 hour", "4H": "4 hours", "12H": "12 hours", "1D": "1 day"}
HOURS = {"1H": 1, "4H": 4, "12H": 12, "1D": 24}


def bars_from_ticks(ticks: DataFrame, every: str = "1 hour", symbol="symbol", ts="ts", price="price", order="event_id", **sums: Column) -> DataFrame:
    """Left-closed bars labelled by their start; open and close by (ts, order), ``sums`` are further aggregates."""
    place = F.struct(ts, order)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, every).start.cast("timestamp_ntz").alias("ts"))
        .agg(F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), *(c.alias(n) for n, c in sums.items()))
    )


def resample_right_closed(bars: DataFrame, every: str, last_ts: str | None = "last") -> DataFrame:
    """Bars of a longer timeframe, right-closed and labelled by their end: (end - every, end].

    Bins that end after the symbol's last bar are not closed and are left out unless ``last_ts`` is None.
    """
    end = F.window(F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"), every).end.cast("timestamp_ntz")
    found = bars.groupBy("symbol", end.alias("label")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_bars")
    )
    if last_ts is not None:
        ends = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
        found = found.join(ends, "symbol").where("label <= _last").drop("_last")
    return found.withColumnRenamed("label", "ts")


def as_of(left: DataFrame, right: DataFrame, columns: list[str], by: str = "symbol", ts: str = "ts", prefix: str = "") -> DataFrame:
    """For each row of ``left`` the last row of ``right`` at or before its time: one union, one window, no pairs."""
    own = left.withColumns({"_side": F.lit(1), "_found": F.lit(None).cast(StructType([right.schema[c] for c in columns]))})
    other = right.select(by, ts, F.lit(0).alias("_side"), F.struct(*columns).alias("_found"))
    both = own.unionByName(other, allowMissingColumns=True)
    before = Window.partitionBy(by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last_value("_found", ignoreNulls=F.lit(True)).over(before)).where("_side = 1")
    return found.select(*left.columns, *(F.col(f"_found.{c}").alias(prefix + c) for c in columns))


def with_timeframes(bars: DataFrame, timeframes: tuple[str, ...] = ("4H", "12H", "1D")) -> DataFrame:
    """Hourly bars with open, high, low, close and volume of the latest closed bar of each timeframe.

    The grid is regular, so this is an equi-join on the end of the latest closed bin, not a search.
    """
    found = bars
    for name in timeframes:
        hours = HOURS[name]
        longer = resample_right_closed(bars, TIMEFRAMES[name])
        renamed = longer.select("symbol", F.col("ts").alias("_end"), *(F.col(c).alias(f"{c}_{name}") for c in ("open", "high", "low", "close", "volume")))
        last = F.window("ts", f"{hours} hours").start.cast("timestamp_ntz")
        found = found.withColumn("_end", last).join(renamed, ["symbol", "_end"], "left").drop("_end")
    return found


def latest(df: DataFrame, n: int = 1, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """The last n rows of each symbol."""
    order = Window.partitionBy(by).orderBy(F.col(ts).desc())
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def trimmed_lookback(bars: DataFrame, timeframe: str, base_hours: int = 720) -> DataFrame:
    """The bars of a lookback of ``base_hours``: 720, 180, 60 or 30 of them by timeframe."""
    return latest(bars, base_hours // HOURS[timeframe])


def lookback_faults(bars: DataFrame, timeframe: str, base_hours: int, end_ts: Column) -> DataFrame:
    """Per symbol the number of bars, whether the last is at the end's floor, and the number of NULL prices."""
    hours = HOURS[timeframe]
    floor = F.window(end_ts, f"{hours} hours").start.cast("timestamp_ntz")
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("open", "high", "low", "close", "volume")))
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), (F.count("*") == base_hours // hours).alias("length_ok"), (F.max("ts") == F.max(floor)).alias("aligned"), F.count_if(missing).alias("n_missing")
    )


def hourly_gaps(bars: DataFrame, every: str = "1 hour") -> DataFrame:
    """The hours between a symbol's first and last bar that have none."""
    spans = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    wanted = spans.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {every}"))).alias("ts"))
    return wanted.join(bars, ["symbol", "ts"], "left_anti")


def is_strictly_hourly(bars: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per symbol whether all steps are one bar long."""
    p = Panel(bars)
    step = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(p.lag("ts").cast("timestamp"))
    return p.with_columns(step=step).groupBy("symbol").agg(F.coalesce(F.bool_and(F.col("step") == seconds * 1_000_000), F.lit(True)).alias("regular"), F.count("*").alias("n_bars"))


def dedupe(df: DataFrame, keys: list[str], keep: str, order: list[Column]) -> DataFrame:
    """One row for each key: the ``first`` or ``last`` in the given order (of input or of time)."""
    if keep == "last":
        order = [c.desc() for c in order]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def period_start(ts: Column, timeframe: str) -> Column:
    return F.window(ts, TIMEFRAMES[timeframe]).start.cast("timestamp_ntz")


def live_rsi(bars: DataFrame, timeframe: str, n: int = 14) -> DataFrame:
    """``bars`` with the index of the unfinished longer bar: its n closed predecessors and the close at hand."""
    start = period_start(F.col("ts"), timeframe)
    longer = bars.withColumn("_start", start).groupBy("symbol", "_start").agg(F.max_by("close", "ts").alias("c"))
    before = Window.partitionBy("symbol").orderBy("_start").rowsBetween(-n, -1)
    closed = longer.withColumn("_closes", F.collect_list("c").over(before)).where(F.size("_closes") == n).drop("c")
    joined = bars.withColumn("_start", start).join(closed, ["symbol", "_start"], "left")
    path = F.concat("_closes", F.array("close"))
    moves = F.zip_with(F.slice(path, 2, n), F.slice(path, 1, n), lambda b, a: b - a)
    total = lambda sign: F.aggregate(moves, F.lit(0.0), lambda acc, m: acc + F.greatest(sign * m, F.lit(0.0)))
    found = joined.withColumns({"_gain": total(1), "_loss": total(-1)})
    value = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0))))
    return found.withColumn(f"live_rsi_{timeframe}", F.when(F.col("_closes").isNotNull(), value)).drop("_start", "_closes", "_gain", "_loss")


def complete_hours(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows up to the last full hour of each symbol."""
    ends = df.groupBy("symbol").agg(F.date_trunc("hour", F.max(ts)).cast("timestamp_ntz").alias("_end"))
    return df.join(ends, "symbol").where(F.col(ts) <= F.col("_end")).drop("_end")
