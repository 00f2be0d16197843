"""Features of price, flow, open interest, liquidity and trend over a panel of bars.

Columns have these names unless given: open, high, low, close, volume, taker_buy, trades, oi (open interest), premium,
spot_volume, quote_volume. Where a feature reads an exponential average, the average is an argument: make it with
``barweave.operators.recursive`` first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F

from ..frames import Panel, clip, col, flag, log, ratio
from .primitives import ohlc4, parkinson_volatility, rolling_std, rolling_vwap, true_range, zscore

# -- distance, momentum and reversion of price


def price_vwap_distance_zscore(p: Panel, n_vwap: int, n: int) -> Column:
    vwap = rolling_vwap(p, n_vwap)
    return zscore(p, ratio(col("close") - vwap, vwap), n)


def ema_distance(x, average) -> Column:
    return ratio(col(x) - col(average), average)


def ema_distance_zscore(p: Panel, x, average, n: int) -> Column:
    return zscore(p, ema_distance(x, average), n)


def price_roc_over_volatility(p: Panel, k: int, n: int) -> Column:
    return ratio(p.change("close", k), parkinson_volatility(p, n))


def return_autocorr(p: Panel, n: int) -> Column:
    r = p.change("close")
    return p.corr(r, p.lag(r), n)


def run_fraction(p: Panel, n: int) -> Column:
    """Share of the earlier moves of a full window, those of no change aside, that go the way of the latest."""
    signs = F.filter(p.window(F.signum(p.diff("close")), n), lambda s: s != 0)
    last = F.element_at(signs, -1)
    same = F.size(F.filter(signs, lambda s: s == last)) - 1
    return F.when(F.size(signs) >= 2, same / (F.size(signs) - 1))


def variance_ratio(p: Panel, q: int, n: int) -> Column:
    one = p.let(p.var(p.log_return("close"), n))
    return F.when(one > 0, p.var(p.log_return("close", q), n) / F.nullif(one * q, F.lit(0.0)))


def pullback_slope(p: Panel, mean, n: int) -> Column:
    """Slope of the log return on the negative distance of the log price from a mean one bar before."""
    gap = -p.lag(log("close") - col(mean))
    gap, move = p.ready(gap), p.log_return("close")
    return ratio(p.cov(gap, move, n), p.var(gap, n))


def mean_cross_rate(p: Panel, mean, n: int) -> Column:
    """Changes of side of a mean for each step of the window; equality keeps the side, the first side is a change."""
    side = p.carried(F.nullif(F.signum(log("close") - col(mean)), F.lit(0.0)))
    crossed = flag(~side.eqNullSafe(p.lag(side)) | side.isNull())
    return p.sum(crossed, n) / (n - 1)


def price_delta_zscore(p: Panel, k: int, n: int) -> Column:
    return zscore(p, p.log_return("close", k), n)


def return_efficiency(p: Panel, n: int) -> Column:
    """Net move over the path's length, between -1 and 1."""
    return clip(p.diff("close", n) / (p.sum(F.abs(p.diff("close")), n) + 1e-9), -1, 1)


def drawdown_distance(p: Panel, n: int) -> Column:
    return log(ratio("close", p.highest("close", n)))


def breakout_distance_from_low(p: Panel, n: int) -> Column:
    return log(ratio("close", p.lowest("close", n)))


def high_low_squeeze(p: Panel, n_range: int, n_median: int) -> Column:
    """Log of the window's range over its earlier median, that ratio cut at 10; NULL at 0."""
    spread = p.ready(p.highest("high", n_range) - p.lowest("low", n_range))
    return log(clip(spread / (p.lag(p.median(spread, n_median)) + 1e-9), 0, 10))


def vol_normalized_momentum(p: Panel, k: int, volatility) -> Column:
    return p.log_return("close", k) / (col(volatility) * math.sqrt(k) + 1e-9)


def breakout_distance(p: Panel, n: int, volatility) -> Column:
    middle = (p.highest("high", n) + p.lowest("low", n)) / 2
    return log(ratio("close", middle)) / (col(volatility) + 1e-9)


def close_location_value(p: Panel, n: int) -> Column:
    low = p.lowest("low", n)
    return clip((col("close") - low) / (p.highest("high", n) - low + 1e-9), 0, 1)


def close_location_value_signed(p: Panel, n: int) -> Column:
    return 2 * close_location_value(p, n) - 1


def range_expansion(p: Panel, n: int) -> Column:
    true = p.ready(true_range(p))
    return true / (p.lag(p.median(true, n)) + 1e-9)


def close_in_range() -> Column:
    return clip((col("close") - col("low")) / (col("high") - col("low") + 1e-9), 0, 1)


def close_in_range_signed() -> Column:
    return 2 * close_in_range() - 1


def impulse_signal(p: Panel, n: int) -> Column:
    return log(range_expansion(p, n)) * close_in_range_signed()


# -- open interest


def oi_price_momentum(p: Panel, oi_average, price_average) -> Column:
    return p.change(oi_average) * p.change(price_average)


def oi_delta_zscore(p: Panel, k: int, n: int) -> Column:
    return zscore(p, p.diff("oi", k), n)


def oi_price_delta_interaction(p: Panel, k: int, n: int) -> tuple[Column, Column]:
    """Product of the two z-scores, and their ratio cut at 5 either way."""
    oi, price = oi_delta_zscore(p, k, n), price_delta_zscore(p, k, n)
    return oi * price, clip(ratio(oi, price), -5, 5)


def oi_price_direction_flags(p: Panel, k: int) -> dict[str, Column]:
    """Open interest and price up or down over k bars, four flags; NULL only where open interest is unknown."""
    oi, price = p.ready(p.diff("oi", k)), p.ready(p.diff("close", k))
    found = {}
    for name, a, b in (("up_up", oi > 0, price > 0), ("up_down", oi > 0, price < 0), ("down_up", oi < 0, price > 0), ("down_down", oi < 0, price < 0)):
        found[f"oi_price_{name}"] = F.when(oi.isNotNull(), flag(a & b))
    return found


def ema_ratio_spread(a_fast, a_slow, b_fast, b_slow) -> Column:
    return ratio(a_fast, a_slow) - ratio(b_fast, b_slow)


def change_corr(p: Panel, x, y, n: int) -> Column:
    """Correlation of the changes of two series."""
    return p.corr(p.change(x), p.change(y), n)


def oi_volume_efficiency(p: Panel, n_ratio: int, n: int, method: str = "median_ratio", use_log: bool = True) -> Column:
    return normalize_ratio(p, ratio(F.abs(p.diff("oi")), p.sum("volume", n_ratio)), n, method, use_log)


def oi_volume_efficiency_signed(p: Panel, n_ratio: int, n: int, method: str = "median_ratio", use_log: bool = True) -> tuple[Column, Column]:
    """The rising and the falling part apart, zero in the other's place."""
    share = p.ready(ratio(p.diff("oi"), p.sum("volume", n_ratio)))
    rising, falling = F.when(share.isNotNull(), F.greatest(share, F.lit(0.0))), F.when(share.isNotNull(), F.greatest(-share, F.lit(0.0)))
    return normalize_ratio(p, rising, n, method, use_log), normalize_ratio(p, falling, n, method, use_log)


# -- premium, spot share, regimes


def positive_premium_pct(p: Panel, n: int) -> Column:
    """Share of bars with a positive premium; an unknown one counts as not positive."""
    return p.mean(flag(col("premium") > 0), n)


def vol_ratio(p: Panel, fast: int, slow: int) -> Column:
    return ratio(parkinson_volatility(p, fast), parkinson_volatility(p, slow))


def std_ratio(p: Panel, x, fast: int, slow: int) -> Column:
    """Of the standard deviations of two windows, a quarter of each valid."""
    return ratio(rolling_std(p, x, fast), rolling_std(p, x, slow))


def spot_dominance(spot="spot_volume", perp="volume") -> Column:
    return ratio(spot, col(spot) + col(perp))


def cvar_var_ratio(p: Panel, n: int, alpha: float = 0.05) -> Column:
    from .primitives import var_cvar

    threshold, mean = var_cvar(p, p.log_return("close"), n, alpha)
    return ratio(mean, threshold)


def tail_skewness(p: Panel, n: int) -> Column:
    r = p.log_return("close")
    high, low = p.quantile(r, n, 0.95), p.quantile(r, n, 0.05)
    return ratio(high + low, high - low)


def efficiency_avg(p: Panel, n: int) -> Column:
    """Summed log bodies over summed log ranges, between 0 and 1."""
    body, spread = F.abs(log(ratio("close", "open"))), F.abs(log(ratio("high", "low")))
    return clip(p.sum(body, n) / (p.sum(spread, n) + 1e-12), 0, 1)


def displacement_speed_product(p: Panel, n_vwap: int, k: int) -> Column:
    return log(ratio("close", rolling_vwap(p, n_vwap))) * p.log_return("close", k)


def range_chop_interaction(p: Panel, n: int) -> Column:
    return parkinson_volatility(p, n) * (1 - efficiency_avg(p, n))


def range_stretch_interaction(p: Panel, n_vwap: int, n: int) -> Column:
    return parkinson_volatility(p, n) * F.abs(log(ratio("close", rolling_vwap(p, n_vwap))))


# -- liquidity


def amihud(p: Panel, close="close", volume="volume") -> Column:
    turnover = F.nullif(col(close) * col(volume), F.lit(0.0))
    return F.abs(p.log_return(close)) / (turnover + 1e-12)


def normalize_ratio(p: Panel, x: Column, n: int, method: str = "median_ratio", use_log: bool = True, least: int | None = None) -> Column:
    """x against its window: over the median or mean, less the mean, or as a z-score; logs take x + 1e-12."""
    least, x = least or int(0.6 * n), p.ready(x)
    y = p.ready(log(x + 1e-12)) if use_log else x
    if method == "median_ratio":
        middle = p.median(x, n, least)
        return log(x + 1e-12) - log(middle + 1e-12) if use_log else ratio(x, middle)
    if method == "mean_ratio":
        middle = p.mean(x, n, least)
        return log(x + 1e-12) - log(middle + 1e-12) if use_log else ratio(x, middle)
    if method == "demean":
        return y - p.mean(y, n, least)
    if method == "zscore":
        return p.zscore(y, n, least)
    raise ValueError(f"no method {method}")


def relative_amihud(p: Panel, n: int, method: str = "median_ratio", use_log: bool = True) -> Column:
    return normalize_ratio(p, amihud(p), n, method, use_log)


# -- flow


def net_taker(taker="taker_buy", volume="volume") -> Column:
    return 2 * col(taker) - col(volume)


def taker_imb_cvd_slope(p: Panel, n: int, taker="taker_buy", volume="volume") -> Column:
    """Slope of the running sum of the net flow over n bars; NULL where the flow is."""
    net = p.ready(net_taker(taker, volume))
    total = F.when(net.isNotNull(), p.running_sum(net))
    return p.diff(total, n) / n


def relative_volume(p: Panel, n: int, volume="volume") -> Column:
    """Volume over the mean of the last n bars of the same hour of the day."""
    same = Window.partitionBy(*p.by, F.hour(p.ts)).orderBy(p.ts).rowsBetween(1 - n, 0)
    return ratio(volume, p.let(F.avg(volume).over(same)))


def trade_count_lead_price_corr(p: Panel, k: int, n: int) -> Column:
    return p.corr(p.change(p.lag("trades", k)), p.change("close"), n)


def avg_trade_size_price_corr(p: Panel, n: int) -> Column:
    return p.corr(p.change(ratio("quote_volume", "trades")), p.change("close"), n)


def taker_imb_price_corr(p: Panel, n: int) -> Column:
    return p.corr(zscore(p, net_taker(), n), p.change("close"), n)


def signed_volume_proxy(p: Panel) -> Column:
    return F.signum(p.log_return("close")) * col("volume")


def cumulative_signed_volume(p: Panel, n: int) -> Column:
    return clip(p.sum(signed_volume_proxy(p), n) / (p.sum("volume", n) + 1e-9), -1, 1)


def shock(p: Panel, x, n: int) -> Column:
    """x over its median one bar before (volume or number of trades)."""
    return col(x) / (p.lag(p.median(x, n)) + 1e-9)


def crowdedness(p: Panel, n: int) -> Column:
    return log(shock(p, "trades", n)) - log(shock(p, "volume", n))


def close_location_value_bar() -> Column:
    up, down = col("close") - col("low"), col("high") - col("close")
    return clip((up - down) / (col("high") - col("low") + 1e-9), -1, 1)


def money_flow_volume() -> Column:
    return close_location_value_bar() * col("volume")


def accumulation_distribution(p: Panel, n: int) -> Column:
    return clip(p.sum(money_flow_volume(), n) / (p.sum("volume", n) + 1e-9), -1, 1)


def taker_buy_ratio(taker="taker_buy", volume="volume") -> Column:
    return clip(col(taker) / (col(volume) + 1e-9), 0, 1)


def taker_imbalance(taker="taker_buy", volume="volume") -> Column:
    return clip(net_taker(taker, volume) / F.greatest(col(volume), F.lit(1e-9)), -1, 1)


def cumulative_taker_imbalance(p: Panel, n: int) -> Column:
    return p.sum(net_taker(), n) / (p.sum("volume", n) + 1e-9)


def trades_per_volume() -> Column:
    return F.log1p(col("trades") / (col("volume") + 1e-9))


def avg_trade_size() -> Column:
    return F.log1p(col("volume") / (col("trades") + 1e-9))


def clipped_zscore(p: Panel, x: Column, n: int) -> Column:
    """z-score with a hair added to the deviation, cut at 5 either way; full windows."""
    x = p.ready(x)
    return clip((x - p.mean(x, n)) / (p.std(x, n) + 1e-9), -5, 5)


def flow_return_alignment(p: Panel) -> Column:
    return taker_imbalance() * p.log_return("close")


def rolling_flow_alignment(p: Panel, n: int) -> Column:
    return p.sum(flow_return_alignment(p), n)


def flow_efficiency(p: Panel, n: int) -> Column:
    """Summed returns for each unit of summed imbalance; NULL where that is zero."""
    total = p.sum(taker_imbalance(), n)
    return ratio(p.sum(p.log_return("close"), n), F.signum(total) * F.greatest(F.abs(total), F.lit(1e-9)))


def price_impact(p: Panel) -> Column:
    return F.log1p(F.abs(p.log_return("close")) / (F.abs(taker_imbalance()) + 1e-9))


def rolling_price_impact_sum(p: Panel, n: int) -> Column:
    return F.log1p(p.sum(F.abs(p.log_return("close")), n) / (p.sum(F.abs(taker_imbalance()), n) + 1e-9))


def imbalance_variance(p: Panel, n: int) -> Column:
    return p.var(taker_imbalance(), n)


def imbalance_sign_flips(p: Panel, n: int, threshold: float = 0.05) -> Column:
    """Flips between buying and selling states for each step; an unknown or small imbalance is no state."""
    state = p.ready(F.when(taker_imbalance() > threshold, 1.0).when(taker_imbalance() < -threshold, -1.0).otherwise(0.0))
    before = p.lag(state)
    return p.sum(flag((state != before) & (state != 0) & (before != 0)), n) / (n - 1)


def churn_ratio(p: Panel, n: int) -> Column:
    """Log of gross over net imbalance."""
    x = taker_imbalance()
    return log(p.sum(F.abs(x), n) / (F.abs(p.sum(x, n)) + 1e-9))


# -- trend flags and R multiples


def is_above(close, average) -> Column:
    return flag(col(close) > col(average))


def ema_stack_flag(close, fast, middle, slow) -> Column:
    """1 for price over fast over middle over slow, -1 for the reverse, else 0."""
    close, fast, middle, slow = map(col, (close, fast, middle, slow))
    up, down = (close > fast) & (fast > middle) & (middle > slow), (close < fast) & (fast < middle) & (middle < slow)
    return flag(up) - flag(down)


def by_flag(x, state) -> tuple[Column, Column, Column]:
    """x in the place of the state 0, 1 or -1, zero in the others."""
    return tuple(col(x) * flag(col(state) == k) for k in (0, 1, -1))


def lookback_avg_r_multiple(p: Panel, r, n: int, horizon: int, least: int | None = None) -> Column:
    return p.mean(p.lag(r, horizon), n, least or max(1, n // 2))


def lookback_r_multiple_std(p: Panel, r, n: int, horizon: int, least: int | None = None) -> Column:
    return p.std(p.lag(r, horizon), n, least or max(1, n // 2))


def lookback_r_multiple_hit_rate(p: Panel, r, n: int, horizon: int, threshold: float = 0.0, least: int | None = None) -> Column:
    """Share of wins; an unknown outcome is a loss."""
    return p.mean(flag(p.lag(r, horizon) > threshold), n, least or max(1, n // 2))


# -- variance of bars


def safe_ohlc() -> tuple[Column, Column, Column, Column]:
    """Prices of at least 1e-12, the high not below and the low not above open and close."""
    o, h, low, c = (F.greatest(col(x), F.lit(1e-12)) for x in ("open", "high", "low", "close"))
    return o, F.greatest(h, o, c), F.least(low, o, c), c


def garman_klass_var() -> Column:
    o, h, low, c = safe_ohlc()
    return F.greatest(0.5 * F.pow(F.ln(h / low), F.lit(2)) - (2 * math.log(2) - 1) * F.pow(F.ln(c / o), F.lit(2)), F.lit(0.0))


def rogers_satchell_var() -> Column:
    o, h, low, c = safe_ohlc()
    return F.greatest(F.ln(h / c) * F.ln(h / o) + F.ln(low / c) * F.ln(low / o), F.lit(0.0))


def garman_klass_vol(p: Panel, n: int) -> Column:
    return F.sqrt(p.mean(garman_klass_var(), n))


def rogers_satchell_vol(p: Panel, n: int) -> Column:
    return F.sqrt(p.mean(rogers_satchell_var(), n))


def typical_price() -> Column:
    return ohlc4()
