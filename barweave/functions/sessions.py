"""Features of one-minute bars: sides of the average price, sessions, time windows, betting on a strike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..frames import Panel, col, log, ratio
from .primitives import hlc3, rolling_vwap
from .technical import normal_tail


def sides(p: Panel, close, mean) -> Column:
    """above_vwap or below_vwap; equality keeps the side."""
    gap = col(close) - col(mean)
    return p.carried(F.when(gap > 0, "above_vwap").when(gap < 0, "below_vwap"))


def session_id(p: Panel, side: Column) -> Column:
    """Running number of stretches on one side."""
    before = p.lag(side)
    return p.running_sum(F.coalesce(~side.eqNullSafe(before) & before.isNotNull(), F.lit(False)).cast("int"))


def rolling_vwap_hlc(p: Panel, n: int) -> Column:
    return rolling_vwap(p, n, hlc3())


def cross_direction(p: Panel, close, mean) -> Column:
    """'above' or 'below' on the bar that crosses; a bar before the first mean was on no side."""
    now, under = F.coalesce(col(close) > col(mean), F.lit(False)), F.coalesce(col(close) < col(mean), F.lit(False))
    was_above, was_below = p.lag(now.cast("int")), p.lag(under.cast("int"))
    return F.when(now & (F.coalesce(was_above, F.lit(0)) == 0), "above").when(under & (F.coalesce(was_below, F.lit(0)) == 0), "below")


def intrabar_noise_ratio(p: Panel, n: int) -> Column:
    return p.sum(col("high") - col("low"), n, 1) / (p.sum(F.abs(col("close") - col("open")), n, 1) + 1e-9)


def summed_where(p: Panel, x, condition: Column, n: int) -> Column:
    """Rolling sum of x where the condition holds."""
    return p.sum(F.when(condition, col(x)).otherwise(0.0), n)


def vwap_gap_normalized(close, mean) -> Column:
    return ratio(col(close) - col(mean), close)


def time_frame(p: Panel, aggregate, interval: str) -> Column:
    """A window over the interval before each row, its far end open: rows later than ts - interval."""
    micros = F.unix_micros(F.col(p.ts).cast("timestamp"))
    order = Window.partitionBy(*p.by).orderBy(p.let(micros))
    return p.let(aggregate.over(order.rangeBetween(1 - _micros(interval), 0)))


def _micros(interval: str) -> int:
    amount, unit = interval.split()
    return int(amount) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def atr_time(p: Panel, true, interval: str = "30 minutes") -> Column:
    return time_frame(p, F.avg(p.ready(true)), interval)


def reference_quantile(p: Panel, x, interval: str = "63 days", q: float = 0.9, shift: int = 1, least: int = 100) -> Column:
    x = p.ready(x)
    found = F.when(time_frame(p, F.count(x), interval) >= least, time_frame(p, F.percentile(x, F.lit(q)), interval))
    return p.lag(found, shift)


def reference_quantile_bars(p: Panel, x, n: int, q: float = 0.75, least: int | None = None, shift: int = 1) -> Column:
    return p.lag(p.quantile(x, n, q, least or max(100, n // 2)), shift)


def forward_parkinson(p: Panel, n: int) -> Column:
    return F.sqrt(p.next_mean(F.pow(log(ratio("high", "low")), F.lit(2)), n) / (4 * math.log(2)))


def forward_sum(p: Panel, x, n: int) -> Column:
    """Sum over the next n bars."""
    return p.next_sum(x, n)


def lagged_proxy(p: Panel, n: int, shift: int, direction: str = "long", floor: Column | None = None) -> Column:
    """Forward return over the adverse excursion (or an upper bound on its smallness), known ``shift`` bars later."""
    later = ratio(p.lead("close", n), "close") - 1
    adverse = F.abs(ratio(p.next_low("low", n), "close") - 1) if direction == "long" else F.abs(ratio(p.next_high("high", n), "close") - 1)
    if floor is not None:
        adverse = F.greatest(adverse, floor)
    return p.lag(ratio(later if direction == "long" else -later, adverse), shift)


def stop_r_multiple(fwd, best, worst, volatility, direction: str = "long", times: float = 4.0, cutoff: float = 0.005) -> Column:
    """-1 if the stop (volatility times a factor, cut off) is reached, else the return over the stop."""
    stop = F.least(col(volatility) * times, F.lit(cutoff))
    if direction == "long":
        return F.when(col(worst) <= -stop, -1.0).otherwise(ratio(fwd, stop))
    return F.when(col(best) >= stop, -1.0).otherwise(ratio(-col(fwd), stop))


def percentile_rank(p: Panel, x, n: int) -> Column:
    """Share of the n - 1 values before that are lower; n // 2 valid ones needed, the share is of all rows there."""
    x = p.ready(x)
    values = p.over(F.collect_list(x), 1 - n, 0)
    rows = p.over(F.count(F.lit(1)), 1 - n, 0) - 1
    lower = F.size(F.filter(values, lambda v: v < x))
    return F.when((F.size(values) >= max(1, n // 2)) & x.isNotNull() & (rows > 0), lower / rows)


# -- betting on where the price will be


def blend_mar(one, three, five, weights=(0.2, 0.3, 0.5)) -> Column:
    return sum((col(x) * w for x, w in zip((three, five), weights[1:])), col(one) * weights[0])


def sigma_from_mar(blend, minutes, k: float = math.sqrt(math.pi / 2), safety: float = 1.0) -> Column:
    return k * F.greatest(col(blend), F.lit(0.0)) * F.sqrt(col(minutes)) * safety


def prob_yes_normal(price, strike, sigma, mu: float = 0.0) -> Column:
    return normal_tail(ratio(log(ratio(strike, price)) - mu, sigma))


def terminal_range_normal(price, sigma, coverage: float = 0.98, mu: float = 0.0) -> tuple[Column, Column]:
    from statistics import NormalDist

    z = NormalDist().inv_cdf(0.5 + coverage / 2)
    return col(price) * F.exp(mu - z * col(sigma)), col(price) * F.exp(mu + z * col(sigma))


def time_to_strike(n: int, ts="ts") -> Column:
    """Minutes left in the group of n minutes, n down to 1, two minutes ahead of the clock."""
    elapsed = (F.unix_micros(F.col(ts).cast("timestamp")) / 60_000_000).cast("long")
    return F.pmod(F.lit(n - 2) - elapsed, F.lit(n)) + 1


def group_strike(p: Panel, n: int) -> Column:
    """The close of the last bar with n minutes to go, that bar included; before the first one the first open."""
    first_open = p.over(F.first("open"), Window.unboundedPreceding, 0)
    return F.coalesce(p.carried(F.when(time_to_strike(n, p.ts) == n, F.col("close"))), first_open)


def z_pool(df: DataFrame, score_dates: DataFrame, z: str = "z", lookback_days: int = 7, group_minutes: int = 15) -> DataFrame:
    """Per score date the z of the days before it, up to ``group_minutes`` before midnight.

    Both sides meet on the day, each score date standing for its days: an equi-join, then the exact bounds.
    """
    days = score_dates.select("score_date", F.explode(F.sequence(F.date_sub("score_date", lookback_days), "score_date")).alias("day"))
    start = F.col("score_date").cast("timestamp_ntz")
    inside = (F.col("ts") >= start - F.make_dt_interval(F.lit(lookback_days))) & (F.col("ts") < start - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(group_minutes)))
    return df.withColumn("day", F.to_date("ts")).join(days, "day").where(inside).select("score_date", "ts", z)


def ecdf_greater(samples: DataFrame, asked: DataFrame, key: str, z: str = "z", threshold: str = "threshold") -> DataFrame:
    """``asked`` with the share of the key's samples above the threshold.

    Samples and questions are ranked together in one window, so no question meets every sample.
    """
    both = samples.select(key, F.col(z).alias("_x"), F.lit(0).alias("_side")).unionByName(asked.select("*", F.col(threshold).alias("_x"), F.lit(1).alias("_side")), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    sample = F.when((F.col("_side") == 0) & F.col("_x").isNotNull(), 1)
    ranked = both.withColumn("_below", F.count(sample).over(upto)).withColumn("_all", F.count(sample).over(whole)).where("_side = 1")
    return ranked.withColumn("prob_greater", F.when(F.col("_x").isNotNull(), 1 - ratio(F.col("_below").cast("double"), F.col("_all").cast("double")))).select(*asked.columns, "prob_greater")


def clean_markets(prices: DataFrame, minutes: int = 15, policy: str = "latest") -> tuple[DataFrame, DataFrame]:
    """(market, minute, t, p) with one price for each minute of complete markets, and the dropped markets with reasons.

    ``prices`` has market, market_ts (seconds), t (seconds), p and pos (place in the input; a tie goes to the later).
    """
    minute = F.floor((F.col("t") - F.col("market_ts")) / 60)
    inside = prices.withColumn("minute", minute).where((F.col("minute") >= 0) & (F.col("minute") < minutes))
    place = F.struct("t", "pos") if policy == "latest" else F.struct(-F.col("t"), F.col("pos"))
    points = inside.groupBy("market", "minute").agg(F.max_by("t", place).alias("t"), F.max_by("p", place).alias("p"))
    counts = prices.groupBy("market").agg(F.count("*").alias("n_points")).join(points.groupBy("market").agg(F.count("*").alias("n_minutes")), "market", "left").fillna(0, ["n_minutes"])
    dropped = counts.where(F.col("n_minutes") < minutes).withColumn("reason", F.when(F.col("n_minutes") == 0, "no_points_in_window").otherwise("missing_minutes"))
    return points.join(dropped.select("market"), "market", "left_anti"), dropped


