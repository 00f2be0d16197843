"""Window primitives: rolling statistics, volatility, anchors and encodings of time.

Each function takes a ``Panel`` and columns and gives a column expression; its meaning is in the docstring. Operators
that carry a state over the whole history are in ``barweave.operators.recursive``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..frames import Panel, col, flag, log, ratio


def _quarter(n: int) -> int:
    return max(1, n // 4)


def rolling_mean(p: Panel, x, n: int, least: int | None = None) -> Column:
    """Mean of the last n values, of which a quarter must be valid unless ``least`` is given."""
    return p.mean(x, n, least or _quarter(n))


def rolling_std(p: Panel, x, n: int, least: int | None = None) -> Column:
    """Sample standard deviation, valid values as in ``rolling_mean``."""
    return p.std(x, n, least or _quarter(n))


def rolling_corr(p: Panel, x, y, n: int, least: int | None = None) -> Column:
    return p.corr(x, y, n, least or _quarter(n))


def rolling_highest(p: Panel, x, n: int, least: int | None = None) -> Column:
    return p.highest(x, n, least or _quarter(n))


def rolling_lowest(p: Panel, x, n: int, least: int | None = None) -> Column:
    return p.lowest(x, n, least or _quarter(n))


def rolling_median(p: Panel, x, n: int, least: int | None = None) -> Column:
    return p.median(x, n, least or _quarter(n))


def pct_change(p: Panel, x, k: int = 1) -> Column:
    return p.change(x, k)


def parkinson_volatility(p: Panel, n: int, high="high", low="low") -> Column:
    """Root of the mean squared log range over 4 ln 2, all n bars needed."""
    return F.sqrt(p.mean(F.pow(log(ratio(high, low)), F.lit(2)), n) / (4 * math.log(2)))


def historical_volatility(p: Panel, n: int, close="close", annualize: bool = True) -> Column:
    """Standard deviation of log returns, for a year of hours unless told otherwise."""
    return p.std(p.log_return(close), n) * (math.sqrt(365 * 24) if annualize else 1.0)


def true_range(p: Panel, high="high", low="low", close="close") -> Column:
    before = p.lag(close)
    return F.greatest(col(high) - col(low), F.abs(col(high) - before), F.abs(col(low) - before))


def zscore(p: Panel, x, n: int, least: int | None = None) -> Column:
    """Distance from the mean in standard deviations; 94 % of the frame must be valid unless ``least`` is given."""
    return p.zscore(x, n, least or max(1, int(0.94 * n)))


def ohlc4(open_="open", high="high", low="low", close="close") -> Column:
    return (col(open_) + col(high) + col(low) + col(close)) / 4


def hlc3(high="high", low="low", close="close") -> Column:
    return (col(high) + col(low) + col(close)) / 3


def rolling_vwap(p: Panel, n: int, price: Column | None = None, volume="volume") -> Column:
    """Volume-weighted price (mean of open, high, low, close) over n full bars."""
    price = ohlc4() if price is None else price
    return ratio(p.sum(price * col(volume), n), p.sum(volume, n))


def cyclical_encode(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def time_features(ts="ts") -> dict[str, Column]:
    """Sine and cosine of the weekday (Monday 0), the month and the week of the month."""
    week = F.floor((F.dayofmonth(ts) - 1) / 7) + 1
    found = {}
    for name, x, period in (("dow", F.weekday(ts), 7), ("month", F.month(ts), 12), ("week_of_month", week, 5)):
        found[f"{name}_sin"], found[f"{name}_cos"] = cyclical_encode(x.cast("double"), period)
    return found


def var_cvar(p: Panel, returns, n: int, alpha: float = 0.05) -> tuple[Column, Column]:
    """Rolling quantile of returns, and the mean of the returns not above it."""
    returns = p.ready(returns)
    threshold = p.let(p.quantile(returns, n, alpha))
    worst = F.filter(p.window(returns, n), lambda r: r <= threshold)
    return threshold, ratio(F.aggregate(worst, F.lit(0.0), lambda a, r: a + r), F.size(worst).cast("double"))


def linear_regression_slope(p: Panel, x, n: int) -> Column:
    """Slope of x against the bar number over n full bars."""
    return p.slope(x, p.row_number().cast("double"), n)


def lagged_daily(p: Panel, daily: Column) -> Column:
    """A daily value one day later, for hourly rows: see ``recursive.daily_ema_lagged`` for the average itself."""
    return p.lag(daily)


def side_flag(a, b) -> Column:
    """1.0 where a is above b, else 0.0, also where b is unknown."""
    return flag(col(a) > col(b))
