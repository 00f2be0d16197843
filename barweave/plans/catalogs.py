"""Whole catalogs of features under their published column names: derived features, and technical ones by timeframe.

Each catalog is one pass of recursive averages and one ``Sliding`` panel (or, by ``panel``, one of Spark's windows, with
the same results).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..frames import Panel, log, ratio
from ..functions import derived as d, primitives as pr, technical as te
from ..operators import bars as ba, lookback as lb, recursive as rec
from ..operators.sliding import Sliding

#: Windows of the derived catalog in hours (a day, two days, a week, a month).
DAY, TWO_DAYS, WEEK, MONTH = 24, 48, 168, 720
PACES = (DAY, WEEK, MONTH)


def derived_catalog(bars: DataFrame, panel: type[Panel] = Sliding) -> DataFrame:
    """117 columns for bars with volume, taker_buy, trades, oi, premium, spot_volume, quote_volume and ls_ratio."""
    grid = [(pace, n) for pace in PACES for n in (TWO_DAYS, WEEK)]
    averages = {f"_c{n}": rec.ema("close", n, f"_c{n}") for n in PACES} | {f"_l{n}": rec.ema("_log", n, f"_l{n}") for n in PACES} | {f"_o{n}": rec.ema("oi", n, f"_o{n}") for n in PACES}
    kernels = [*averages.values(), *(rec.rsi("close", n, f"rsi_{n}") for n in PACES), *(rec.adx(n, f"adx_{n}") for n in PACES)]
    kernels += [rec.scaled_acceleration(x, n, f"_{tag}a{n}") for x, tag in (("close", "c"), ("oi", "o")) for n in (DAY, WEEK)]
    outputs = [*averages, *(f"{k}_{n}" for k in ("rsi", "adx") for n in PACES), *(f"_{t}a{n}{e}" for t in "co" for n in (DAY, WEEK) for e in ("", "_size"))]
    p = panel(rec.stream(bars.withColumn("_log", log("close")), rec.together(*kernels), outputs))
    vwap = {n: p.ready(log(pr.rolling_vwap(p, n))) for n in PACES}
    spot = p.ready(d.spot_dominance())
    taker = p.ready(d.net_taker("taker_buy", "spot_volume"))
    size_z = {n: d.clipped_zscore(p, F.log1p(F.col("quote_volume") / (F.col("trades") + 1e-9)), n) for n in (TWO_DAYS, WEEK)}
    signed = {n: d.oi_volume_efficiency_signed(p, n, WEEK) for n in (TWO_DAYS, WEEK)}
    times, cycles = pr.time_features(), te.time_cycles()
    ends = ("sin", "cos")
    found = {f"hour_of_day_{e}": cycles[f"hour_{e}"] for e in ends} | {f"day_of_week_{e}": times[f"dow_{e}"] for e in ends} | {f"week_of_month_{e}": times[f"week_of_month_{e}"] for e in ends} | {f"month_of_year_{e}": times[f"month_{e}"] for e in ends}
    found |= {f"parkinson_volatility_{n}": pr.parkinson_volatility(p, n) for n in (DAY, WEEK)} | {f"historical_volatility_{n}": pr.historical_volatility(p, n) for n in (DAY, WEEK)}
    found |= {f"{k}_{n}": F.col(f"{k}_{n}") for k in ("rsi", "adx") for n in PACES}
    found |= {f"price_vwap_distance_zscore_{n}_{WEEK}": d.price_vwap_distance_zscore(p, n, WEEK) for n in PACES}
    found |= {f"price_ema_distance_zscore_{DAY}_{n}": d.ema_distance_zscore(p, "close", f"_c{DAY}", n) for n in (WEEK, MONTH)}
    found |= {f"price_roc_over_volatility_{DAY}_{n}": d.price_roc_over_volatility(p, DAY, n) for n in PACES}
    found |= {f"return_autocorr_{n}": d.return_autocorr(p, n) for n in (TWO_DAYS, WEEK)} | {f"variance_ratio_{DAY}_{n}": d.variance_ratio(p, DAY, n) for n in (TWO_DAYS, WEEK, MONTH)}
    found |= {f"oi_price_accel_product_{WEEK}": F.col(f"_oa{WEEK}") * F.col(f"_ca{WEEK}"), f"oi_price_momentum_{WEEK}": d.oi_price_momentum(p, f"_o{WEEK}", f"_c{WEEK}")}
    found |= {f"taker_imb_cvd_slope_{n}": d.taker_imb_cvd_slope(p, n, "taker_buy", "spot_volume") for n in (DAY, WEEK)} | {f"taker_imb_zscore_{WEEK}": pr.zscore(p, taker, WEEK)}
    found |= {f"relative_volume_{n}": d.relative_volume(p, n) for n in (7, 14, 30)} | {f"trade_count_lead_price_corr_{DAY}_{WEEK}": d.trade_count_lead_price_corr(p, DAY, WEEK)}
    found |= {f"pullback_slope_ema_{m}_{n}": d.pullback_slope(p, f"_l{m}", n) for m, n in grid} | {f"pullback_slope_vwap_{m}_{n}": d.pullback_slope(p, vwap[m], n) for m, n in grid}
    found |= {f"mean_cross_rate_ema_{m}_{n}": d.mean_cross_rate(p, f"_l{m}", n) for m, n in grid} | {f"mean_cross_rate_vwap_{m}_{n}": d.mean_cross_rate(p, vwap[m], n) for m, n in grid}
    found |= {f"oi_zscore_{WEEK}": pr.zscore(p, "oi", WEEK)} | {f"oi_ema_distance_zscore_{n}_{WEEK}": d.ema_distance_zscore(p, "oi", f"_o{n}", WEEK) for n in PACES}
    found |= {f"premium_zscore_{WEEK}": pr.zscore(p, "premium", WEEK), f"spot_vol_zscore_{WEEK}": pr.zscore(p, "spot_volume", WEEK)} | {f"long_short_ratio_zscore_{n}": pr.zscore(p, "ls_ratio", n) for n in (TWO_DAYS, WEEK)}
    found |= {f"avg_trade_size_zscore_{n}": x for n, x in size_z.items()}
    found |= {f"taker_imb_price_corr_{WEEK}": p.corr(pr.zscore(p, taker, WEEK), p.change("close"), WEEK), f"avg_trade_size_price_corr_{WEEK}": d.avg_trade_size_price_corr(p, WEEK)}
    found |= {f"efficiency_avg_{n}": d.efficiency_avg(p, n) for n in (DAY, WEEK)} | {f"vol_ratio_{DAY}_{n}": d.vol_ratio(p, DAY, n) for n in (WEEK, MONTH)}
    found |= {f"oi_volatility_{WEEK}": F.col(f"_oa{WEEK}_size"), f"oi_vol_ratio_{DAY}_{WEEK}": ratio(f"_oa{DAY}_size", f"_oa{WEEK}_size")}
    found |= {f"cvar_var_ratio_{n}": d.cvar_var_ratio(p, n) for n in (WEEK, MONTH)} | {f"tail_skewness_{n}": d.tail_skewness(p, n) for n in (WEEK, MONTH)}
    found |= {f"premium_vol_ratio_{DAY}_{n}": d.std_ratio(p, "premium", DAY, n) for n in (TWO_DAYS, WEEK)}
    found |= {f"spot_dominance_zscore_{WEEK}": pr.zscore(p, spot, WEEK), f"spot_dom_vol_ratio_{DAY}_{WEEK}": d.std_ratio(p, spot, DAY, WEEK)}
    found |= {f"displacement_speed_product_{m}_{n}": d.displacement_speed_product(p, m, n) for m in (WEEK, MONTH) for n in (DAY, TWO_DAYS)}
    found |= {f"range_chop_interaction_{n}": d.range_chop_interaction(p, n) for n in (DAY, WEEK)} | {f"range_stretch_interaction_{m}_{n}": d.range_stretch_interaction(p, m, n) for m in (WEEK, MONTH) for n in (DAY, WEEK)}
    found |= {f"scaled_acceleration_{n}": F.col(f"_ca{n}") for n in (DAY, WEEK)} | {f"oi_price_ratio_spread_{DAY}_{WEEK}": d.ema_ratio_spread(f"_o{DAY}", f"_o{WEEK}", f"_c{DAY}", f"_c{WEEK}")}
    found |= {f"spot_vol_price_corr_{WEEK}": d.change_corr(p, "spot_volume", "close", WEEK), f"oi_vol_price_corr_{WEEK}": d.change_corr(p, "oi", "close", WEEK)}
    found |= {f"spot_dom_price_corr_{n}": d.change_corr(p, spot, "close", n) for n in (DAY, WEEK)} | {f"spot_dom_oi_corr_{n}": d.change_corr(p, spot, "oi", n) for n in (DAY, WEEK)}
    found |= {f"trade_count_oi_corr_{WEEK}": d.change_corr(p, "trades", "oi", WEEK), f"trade_count_spot_dom_corr_{WEEK}": d.change_corr(p, "trades", spot, WEEK)}
    found |= {f"relative_amihud_{WEEK}": d.relative_amihud(p, WEEK), f"oi_volume_efficiency_{DAY}_{WEEK}": d.oi_volume_efficiency(p, DAY, WEEK)}
    found |= {f"oi_volume_efficiency_signed_{side}_{n}_{WEEK}": signed[n][k] for n in signed for k, side in enumerate(("pos", "neg"))}
    return p.select(**found)


def technical_catalog(bars: DataFrame, suffix: str, lookback: int = 720, skip_slow: bool = False, panel: type[Panel] = Sliding) -> DataFrame:
    """The technical features of bars of one timeframe with its suffix (``_4H``); ``skip_slow`` leaves four out."""
    features = tuple(f for f in lb.FEATURES if not (skip_slow and f is lb.chaikin))
    p = panel(lb.with_lookback_features(bars, features, lookback))
    differences, (k, day), bands, cross = te.price_differences(p), te.stochastic(p), te.bollinger(p, "close"), te.ma_crossover(p, "close", 5, 20)
    sma, atr = p.ready(te.sma(p, "close", 20)), p.ready(te.atr(p))
    away, away_pct = te.ma_distance("close", sma)
    skew, kurt = te.distribution(p)
    worst, mean_worst = te.var_cvar(p)
    don, aroon, candles, extremes = te.donchian(p), te.aroon(p), te.candle_ratios(), te.rolling_extremes(p, "close", 20)
    share, log_share = te.vwap_ratios(p, lookback)
    over_volume, high_over_volume = te.price_volume_ratios()
    found = {f"close_{n}": x for n, x in differences.items()} | {"log_close": te.log_transform("close"), "close_pct_change": te.percentage_change(p), "close_zscore_20": te.zscore(p, "close", 20), "close_sma_20": sma, "close_wma_20": te.wma(p, "close", 20)}
    found |= {f"close_cum_return_{n}": te.cumulative_return(p, n) for n in (5, 10, 20)} | {f"close_ma_cross_{n}_5_20": x for n, x in cross.items()}
    found |= {"close_ma_distance_sma20": away, "close_ma_distance_pct_sma20": away_pct, "volume_sma_20": te.sma(p, "volume", 20), "close_stoch_k_14": k, "close_stoch_d_14_3": day, "close_cci_20": te.cci(p), "close_roc_10": te.roc(p, "close", 10)}
    found |= {"close_ema_12": F.col("ema_12"), "close_over_ema_12": F.col("over_ema_12"), "close_log_ratio_ema_12": F.col("log_over_ema_12"), "close_dist_ema12_atr": F.col("dist_ema_12_atr_14"), "close_rsi_14": F.col("rsi_14"), "close_macd_line_12_26": F.col("macd_line"), "close_macd_signal_9": F.col("macd_signal"), "close_macd_histogram_12_26_9": F.col("macd_hist")}
    found |= {f"close_{n}": F.col(n) for n in ("macd_line_over_close", "macd_hist_over_close", "macd_line_over_atr", "macd_hist_over_atr", "adx_14", "di_plus_14", "di_minus_14", "spectral_entropy_50", "cycle_strength_50")} | {"close_dominant_cycle_length_50": F.col("cycle_length_50")}
    found |= {"close_williams_r_14": te.williams_r(p), "close_uo_7_14_28": te.ultimate_oscillator(p), "close_mfi_14": te.mfi(p), "close_hv_20": te.historical_volatility(p), "close_atr_14": atr, "close_vol_ratio_5_50": te.volatility_ratio(p), "close_parkinson_20": pr.parkinson_volatility(p, 20), "close_gk_20": te.garman_klass(p), "close_rs_20": te.rogers_satchell(p), "close_yz_20": te.yang_zhang(p)}
    found |= {f"close_bb_{n}_20_2": bands[n] for n in ("upper", "lower", "width", "percent", "width_pct")} | {"close_bb_middle_20": bands["middle"], "close_obv": te.obv(p, lookback), "close_obv_over_dollar_vol_20": te.obv_over_dollar_volume(p, 20, lookback), "close_vwap": te.lookback_vwap(p, lookback), "close_over_vwap": share, "close_log_ratio_vwap": log_share}
    found |= {"volume_roc_10": te.roc(p, "volume", 10), "close_skew_30": skew, "close_kurt_30": kurt, "close_autocorr_1_30": te.autocorrelation(p), "close_hurst_100": te.hurst(p), "close_entropy_20": te.entropy(p, "close"), "close_volume_ratio": over_volume, "high_volume_ratio": high_over_volume}
    found |= {f"close_percentile_{q}_20": x for q, x in te.rolling_percentiles(p, "close", 20).items()} | {"close_candle_body_ratio": candles["body"], "close_candle_upper_shadow_ratio": candles["upper"], "close_candle_lower_shadow_ratio": candles["lower"], "close_typical_price": pr.hlc3(), "close_ohlc_average": pr.ohlc4(), "close_vol_adj_return_atr14": te.volatility_adjusted_return(p, atr)}
    found |= te.time_parts() | te.time_cycles() | {"close_rolling_min_20": extremes["min"], "close_rolling_max_20": extremes["max"], "close_position_in_range_20": extremes["position"], "volume_rvol_20": te.rvol(p), "close_donchian_pos_20": don["pos"], "close_donchian_upper_dist_20": don["upper"], "close_donchian_lower_dist_20": don["lower"]}
    found |= {f"close_aroon_{n}_14": x for n, x in aroon.items()} | {"close_ret_zscore_20": te.return_zscore(p), "close_dist_sma20_atr": te.atr_normalized_distance("close", sma, atr), "close_roll_spread_20": te.roll_spread(p), "close_amihud_20": te.amihud_illiquidity(p), "turnover_z_20": te.turnover_zscore(p), "close_ljung_p_5_100": te.ljung_box(p), "close_ou_halflife_100": te.ou_half_life(p), "close_var_5_50": worst, "close_cvar_5_50": mean_worst}
    if not skip_slow:
        found |= {"close_adl": te.adl(p, lookback), "close_adl_over_dollar_vol_20": te.adl_over_dollar_volume(p, 20, lookback), "close_chaikin_3_10": F.col("chaikin_3_10"), "close_perm_entropy_3_50": te.permutation_entropy(p, "close")}
    return p.select(**{f"{n}_{suffix}": x for n, x in found.items()})


def normalized_catalog(bars: DataFrame, suffix: str, lookback: int = 720) -> DataFrame:
    """Of the technical catalog what has no unit of price or volume, with the close against both mean prices."""
    whole = technical_catalog(bars, suffix, lookback)
    levels = ("log_close", "close_sma", "close_wma", "close_ema_", "close_close_", "close_high_", "close_macd_line_12", "close_macd_signal", "close_macd_histogram_12", "volume_sma", "close_atr", "close_bb_upper", "close_bb_lower", "close_bb_width_20", "close_bb_middle", "close_obv_" + suffix, "close_vwap", "close_percentile", "close_typical", "close_ohlc", "close_rolling", "close_adl_" + suffix, "close_chaikin", "close_ma_distance_sma", "close_ma_cross_diff", "close_volume_ratio", "high_volume_ratio", "close_roll_spread")
    typical, mean = ratio("close", pr.hlc3()), ratio("close", pr.ohlc4())
    extra = bars.select("symbol", "ts", *(x.alias(f"{n}_{suffix}") for n, x in {"close_over_typical": typical, "close_log_ratio_typical": log(typical), "close_over_ohlc_avg": mean, "close_log_ratio_ohlc_avg": log(mean)}.items()))
    return whole.select(*(c for c in whole.columns if not c.startswith(levels))).join(extra, ["symbol", "ts"])


def multi_timeframe_catalog(bars: DataFrame, timeframes: tuple[str, ...] = ("1H", "4H", "12H", "1D"), base_hours: int = 720, skip_slow: bool = False) -> DataFrame:
    """The technical features of every timeframe for each hourly bar, those of the latest closed bar of the longer ones."""
    whole = None
    for name in timeframes:
        hours = ba.HOURS[name]
        own = bars if hours == 1 else ba.resample_right_closed(bars, ba.TIMEFRAMES[name]).drop("n_bars")
        made = technical_catalog(own, name, base_hours // hours, skip_slow)
        if whole is None:
            whole = made if hours == 1 else bars.select("symbol", "ts")
        if hours > 1:
            last = F.window("ts", ba.TIMEFRAMES[name]).start.cast("timestamp_ntz")
            whole = whole.withColumn("_end", last).join(made.withColumnRenamed("ts", "_end"), ["symbol", "_end"], "left").drop("_end")
    return whole
