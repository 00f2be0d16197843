"""What a column's name says: timeframe, family and settings of a feature, kind and horizon of a target."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Seconds of the units of a timeframe.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}
STORE_TIMEFRAMES = ("1H", "4H", "12H", "1D")

#: Fixed names of the feature store by family. {x} is any text, {x#} a whole number, {x=a,b} one of these; a part in
#: brackets may be absent. The first template that fits counts.
TEMPLATES = {
    "interaction": ["{left}_x_{right}"],
    "current_bar": ["close_logret_current", "high_low_range_pct_current", "close_open_pct_current", "log_volume", "log_volume_delta_current", "sign_close_logret_current"],
    "trend": ["{series}_sma_{window#}", "{series}_ema_{span#}", "{series}_wma_{window#}", "{series}_ma_cross_{kind=diff,ratio,signal}_{fast#}_{slow#}", "{series}_donchian_{which=pos,upper_dist,lower_dist}_{window#}", "{series}_aroon_{which=up,down,osc}_{window#}", "{series}_adx_{window#}", "{series}_di_{which=plus,minus}_{window#}"],
    "momentum": ["{series}_rsi_{window#}", "{series}_stoch_k_{k#}", "{series}_stoch_d_{k#}_{d#}", "{series}_cci_{window#}", "{series}_roc_{period#}", "{series}_williams_r_{window#}", "{series}_uo_{p1#}_{p2#}_{p3#}", "{series}_macd_line_{fast#}_{slow#}[_over_{norm}]", "{series}_macd_signal_{signal#}", "{series}_macd_histogram_{fast#}_{slow#}_{signal#}[_over_{norm}]"],
    "volatility": ["{series}_atr_{window#}", "{series}_hv_{window#}", "{series}_bb_width_pct_{window#}_{std}", "{series}_bb_{which=upper,middle,lower,width,percent}_{window#}[_{std}]", "{series}_vol_ratio_{short#}_{long#}", "{series}_parkinson_{window#}", "{series}_gk_{window#}"],
    "volume": ["close_obv", "close_vwap", "close_adl", "{series}_chaikin_{fast#}_{slow#}", "volume_roc_{period#}", "volume_rvol_{window#}", "close_obv_over_dollar_vol_{window#}", "close_adl_over_dollar_vol_{window#}"],
    "statistical": ["{series}_percentile_{percentile#}_{window#}", "{series}_skew_{window#}", "{series}_kurt_{window#}", "{series}_autocorr_{lag#}_{window#}", "{series}_hurst_{window#}", "{series}_perm_entropy_{m#}_{window#}", "{series}_entropy_{window#}", "{series}_ret_zscore_{window#}"],
    "liquidity": ["{series}_roll_spread_{window#}", "{series}_amihud_{window#}"],
    "risk": ["{series}_cvar_{alpha_pct#}_{window#}", "{series}_var_{alpha_pct#}_{window#}"],
    "cycle": ["{series}_dominant_cycle_length_{window#}", "{series}_cycle_strength_{window#}"],
    "time": ["time_{what}"],
    "pattern": ["{series}_candle_{which=body_ratio,upper_shadow_ratio,lower_shadow_ratio}"],
    "price_derived": ["{series}_typical_price", "{series}_ohlc_average"],
    "normalized": ["{series}_over_ema_{span#}", "{series}_log_ratio_ema_{span#}", "{series}_dist_ema{span#}_atr", "{series}_volume_ratio"],
    "regime": ["hmm_regime_state", "hmm_regime_p_state_{state#}", "hmm_regime_{name}"],
}
#: More specific names go before the families whose templates they would fit too.
ORDER = ("interaction", "regime", "current_bar", "volume", *(f for f in TEMPLATES if f not in ("interaction", "regime", "current_bar", "volume")))
TARGETS = {"forward_return": ["y_{kind=logret,ret}_{horizon}"], "excursion": ["y_{kind=mfe,mae}_{horizon}"], "triple_barrier_ternary": ["y_tb_label_u{up}_d{down}_{horizon}"], "tp_before_sl_binary": ["y_tp_before_sl_u{up}_d{down}_{horizon}"]}


def _pattern(template: str) -> re.Pattern:
    def field(m: re.Match) -> str:
        name, number, choice = m.groups()
        return f"(?P<{name}>{r'\d+' if number else choice.replace(',', '|') if choice else '.+?'})"

    text = template.replace("[", "(?:").replace("]", ")?")
    return re.compile(re.sub(r"\{(\w+?)(#)?(?:=([\w,]+))?\}", field, text))


_FEATURES = [(family, _pattern(t)) for family in ORDER for t in TEMPLATES[family]]
_TARGETS = [(family, _pattern(t)) for family, templates in TARGETS.items() for t in templates]


def timeframe(name: str, known: tuple[str, ...] | None = None) -> tuple[str | None, int | None]:
    """The timeframe at the end of a name and its seconds: one of ``known``, else any number with a unit."""
    if known is not None and (found := next((t for t in known if name.endswith(f"_{t}")), None)):
        size = re.fullmatch(r"(\d+)([A-Za-z]).*", found)
        seconds = UNITS.get(size[2].lower()) if size else None
        return found, None if seconds is None else int(size[1]) * seconds
    found = re.search(r"_(\d+)([smhdw])$", name, re.IGNORECASE)
    return (None, None) if not found else (found[1] + found[2].lower(), int(found[1]) * UNITS[found[2].lower()])


def without_timeframe(name: str, known: tuple[str, ...] | None = None) -> str:
    """The name of the same feature in every timeframe."""
    found, _ = timeframe(name, known)
    return name if found is None else name[: -len(found) - 1]


def _first(patterns: list[tuple[str, re.Pattern]], name: str) -> tuple[str, dict[str, str]]:
    for family, pattern in patterns:
        if m := pattern.fullmatch(name):
            return family, {k: v for k, v in m.groupdict().items() if v is not None}
    return "other", {}


def feature(name: str) -> tuple[str, str | None, dict[str, str]]:
    """Family, store timeframe and settings of a feature's name; lags are a setting, whatever the family."""
    tf = next((t for t in STORE_TIMEFRAMES if name.endswith(f"_{t}")), None)
    base = name[: -len(tf) - 1] if tf else name
    lags = re.findall(r"_lag_(\d+)", base)
    family, settings = _first(_FEATURES, re.sub(r"_lag_\d+", "", base))
    return family, tf, settings | ({"lags": ",".join(lags)} if lags else {})


def target(name: str) -> tuple[str, str | None, dict[str, str]]:
    """Family, horizon and settings of a target's name."""
    family, settings = _first(_TARGETS, name)
    return family, settings.pop("horizon", None), settings


METADATA = "column_name string, module string, family string, timeframe string, horizon string, params map<string,string>, source_file string, original_column string, description string"


def metadata(spark: SparkSession, columns: list[str], registry: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row for each feature and target column; ``registry`` has the source file and the column's name there."""
    rows = []
    for name in columns:
        if name in ("timestamp", "ts"):
            continue
        source, original = (registry or {}).get(name, (None, None))
        if name.startswith("y_"):
            family, horizon, settings = target(name)
            tf, module = None, "targets"
        else:
            family, tf, settings = feature(name)
            horizon = None
            module = "hmm_regime" if family == "regime" or source == "regimes" else "current_bar_features" if (source or "").startswith("current_bar_with_lags") else "multi_timeframe_features"
        said = ", ".join(f"{k} {v}" for k, v in settings.items())
        description = family.replace("_", " ") + (f" ({said})" if said else "") + (f" on {tf}" if tf else "") + (f" over {horizon}" if horizon else "")
        rows.append((name, module, family, tf, horizon, settings, source, original, description))
    return spark.createDataFrame(rows, METADATA)
