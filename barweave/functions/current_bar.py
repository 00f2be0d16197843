"""Features of the current bar against the one before, and their lags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..frames import Panel, col, ratio


def current_bar_features(p: Panel) -> dict[str, Column]:
    """Six measures of the bar and five products with its volume."""
    r = p.log_return("close")
    spread, body = ratio(col("high") - col("low"), "open"), ratio(col("close") - col("open"), "open")
    volume = F.log1p(col("volume"))
    delta, sign = p.diff(volume), F.signum(r)
    return {
        "close_logret_current": r,
        "high_low_range_pct_current": spread,
        "close_open_pct_current": body,
        "log_volume": volume,
        "log_volume_delta_current": delta,
        "sign_close_logret_current": sign,
        "close_logret_current_x_log_volume": r * volume,
        "close_logret_current_x_log_volume_delta_current": r * delta,
        "sign_close_logret_current_x_log_volume": sign * volume,
        "high_low_range_pct_current_x_log_volume": spread * volume,
        "close_open_pct_current_x_log_volume": body * volume,
    }


def lag_name(name: str, k: int) -> str:
    """``_current`` becomes ``_lag_k`` in each factor; a factor without it gets the ending."""
    parts = [re.sub(r"_current$", f"_lag_{k}", x) if x.endswith("_current") else f"{x}_lag_{k}" for x in name.split("_x_")]
    return "_x_".join(parts)


def with_lags(p: Panel, features: dict[str, Column], most: int = 3) -> dict[str, Column]:
    """The features and their values 1 to ``most`` bars back."""
    found = dict(features)
    for k in range(1, most + 1):
        found |= {lag_name(name, k): p.lag(x, k) for name, x in features.items()}
    return found


def with_current_bar_features(bars: DataFrame, suffix: str | None = None) -> DataFrame:
    """``bars`` with the features; a column that is there already is an error."""
    p = Panel(bars)
    named = {f"{n}_{suffix}" if suffix else n: x for n, x in current_bar_features(p).items()}
    if clash := set(named) & set(bars.columns):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    return p.with_columns(**named)
