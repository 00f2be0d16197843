"""Queries for targets, sessions, signals, evaluation, backtests, stored tables, joins and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..frames import Panel, log, ratio
from ..functions import sessions as se, signals as si, targets as tg
from ..operators import backtest as bt, evaluate as ev
from . import sqltext as q
from .feature_queries import hourly, panel, rounded, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# -- targets

H = 12
_ahead = q.over(1, H)
_full = q.lead("1", H) + " IS NOT NULL"


@query(
    "targets",
    q.staged(
        {
            "y_logret": q.ln(f"{'c12'} / close"), "y_ret": "c12 / close - 1", "y_mfe": "CASE WHEN full_ THEN mh / close - 1 END", "y_mae": "CASE WHEN full_ THEN ml / close - 1 END", "large_move": "CASE WHEN full_ THEN (mh / close - 1 >= 0.5 OR ml / close - 1 <= -0.5)::INT END",
            "mfe_mae_ratio": "CASE WHEN full_ THEN ((mh / close - 1) - abs(ml / close - 1)) / ((mh / close - 1) + abs(ml / close - 1) + 1e-8) END", "direction": "coalesce(c12 / close - 1 > 0, false)::INT", "mfe_partial": "mh / close - 1", "y_open_entry": q.ln("c12 / o1"),
            "hit_up": "CASE WHEN full_ THEN (mh / close - 1 >= 0.03)::INT END", "hit_down": "CASE WHEN full_ THEN (ml / close - 1 <= -0.02)::INT END",
        },
        {"c12": q.lead("close", H), "full_": _full, "mh": f"max(high) {_ahead}", "ml": f"min(low) {_ahead}", "o1": q.lead("open", 1)},
    ),
)
def targets(spark, sf_dir):
    p = panel(spark, sf_dir)
    best, worst = tg.mfe(p, H), tg.mae(p, H)
    return p.select(
        **rounded(
            {
                "y_logret": tg.forward_return(p, H), "y_ret": tg.forward_return(p, H, use_log=False), "y_mfe": best, "y_mae": worst, "large_move": tg.is_large_move(p, H, 0.5, 0.5), "mfe_mae_ratio": tg.mfe_mae_ratio(p, H), "direction": tg.direction_label(p, H),
                "mfe_partial": tg.mfe(p, H, partial=True), "y_open_entry": tg.forward_return(p, H, p.lead("open", 1)), "hit_up": F.when(best.isNotNull(), (best >= 0.03).cast("int")), "hit_down": F.when(worst.isNotNull(), (worst <= -0.02).cast("int")),
            }
        )
    )


UP, DOWN = 0.8, 0.6
_HITS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, count(*) OVER (PARTITION BY symbol) AS total, {q.lead('close', H)} AS c12 FROM bars),
hits AS (
  SELECT a.symbol, a.ts, a.close, a.c12, a.n + {H} <= a.total AS full_, min(CASE WHEN b.high >= a.close * (1 + {UP}) THEN b.n - a.n END) AS u, min(CASE WHEN b.low <= a.close * (1 - {DOWN}) THEN b.n - a.n END) AS d
  FROM numbered a LEFT JOIN numbered b ON a.symbol = b.symbol AND b.n BETWEEN a.n + 1 AND a.n + {H} GROUP BY ALL
), named AS (
  SELECT h.*, u IS NOT NULL AND (d IS NULL OR u < d) AS uf, d IS NOT NULL AND (u IS NULL OR d < u) AS df, u IS NOT NULL AND u = d AS tie, abs(h.close * (1 + {UP}) - b.open) AS to_up, abs(b.open - h.close * (1 - {DOWN})) AS to_down
  FROM hits h LEFT JOIN numbered a ON h.symbol = a.symbol AND h.ts = a.ts LEFT JOIN numbered b ON b.symbol = a.symbol AND b.n = a.n + h.u
)"""


@query(
    "barriers",
    f"""WITH {q.BARS}, {_HITS} SELECT symbol, ts,
  CASE WHEN full_ THEN CASE WHEN uf THEN 1 WHEN df THEN -1 ELSE 0 END END AS tb_label,
  CASE WHEN full_ THEN CASE WHEN uf THEN 1 WHEN df THEN -1 WHEN tie AND to_up < to_down THEN 1 WHEN tie AND to_down < to_up THEN -1 ELSE 0 END END AS tb_proximity,
  CASE WHEN full_ THEN (CASE WHEN uf THEN 1 ELSE 0 END) END AS tp_before_sl,
  {q.rounded({'r_multiple': f"CASE WHEN full_ THEN CASE WHEN uf THEN {UP / DOWN!r} WHEN df OR tie THEN -1.0 ELSE (c12 / close - 1) / {DOWN} END END", 'time_diff': f"CASE WHEN full_ AND (u IS NOT NULL OR d IS NOT NULL) THEN greatest(least(coalesce(d, {H + 1}) - coalesce(u, {H + 1}), {H}), -{H}) / {H}.0 END"})},
  CASE WHEN full_ AND uf THEN 1 WHEN full_ AND df THEN 0 END AS first_hit,
  CASE WHEN u IS NOT NULL AND (d IS NULL OR u <= d) THEN 1 WHEN d IS NOT NULL THEN -1 ELSE 0 END AS triple FROM named""",
)
def barriers(spark, sf_dir):
    p = panel(spark, sf_dir)
    h = tg.Hits(p, H, UP, DOWN)
    return p.select(
        tb_label=tg.barrier_label(h), tb_proximity=tg.barrier_label(h, "proximity"), tp_before_sl=tg.tp_before_sl(h), **rounded({"r_multiple": tg.r_multiple(p, h), "time_diff": tg.time_difference(h)}), first_hit=tg.first_hit_direction(h), triple=tg.triple_barrier(p, H, UP, DOWN)
    )


# -- sessions, time windows, bets

_vw = f"{q.total('((high + low + close) / 3) * volume', 24)} / nullif({q.total('volume', 24)}, 0)"


@query(
    "sessions",
    q.staged(
        {"vwap": "vwap", "gap": "(close - vwap) / nullif(close, 0)", "noise": f"sum(high - low) {q.over(-23)} / (sum(abs(close - open)) {q.over(-23)} + 1e-9)", "session": f"sum(CASE WHEN lside IS NOT NULL AND side IS DISTINCT FROM lside THEN 1 ELSE 0 END) {q.over('all')}", "above": "(side = 'above_vwap')::INT",
         "crossed": "CASE WHEN now_ AND NOT coalesce(was_above, false) THEN 1 WHEN under_ AND NOT coalesce(was_under, false) THEN -1 ELSE 0 END", "z_sum": q.total("(CASE WHEN zv > 1 THEN zv ELSE 0 END)", 24)},
        {"vwap": _vw, "zv": q.zscore("volume", 48, 40)}, {"side0": "CASE WHEN close > vwap THEN 'above_vwap' WHEN close < vwap THEN 'below_vwap' END", "now_": "coalesce(close > vwap, false)", "under_": "coalesce(close < vwap, false)"},
        {"side": f"last_value(side0 IGNORE NULLS) {q.over('all')}", "was_above": q.lag("now_"), "was_under": q.lag("under_")}, {"lside": q.lag("side")},
    ),
)
def sessions_query(spark, sf_dir):
    p = panel(spark, sf_dir)
    vwap = p.ready(se.rolling_vwap_hlc(p, 24))
    side, crossed, z = se.sides(p, "close", vwap), se.cross_direction(p, "close", vwap), p.zscore("volume", 48, 40)
    return p.select(
        **rounded(
            {"vwap": vwap, "gap": se.vwap_gap_normalized("close", vwap), "noise": se.intrabar_noise_ratio(p, 24), "session": se.session_id(p, side), "above": (side == "above_vwap").cast("int"), "crossed": F.when(crossed == "above", 1).when(crossed == "below", -1).otherwise(0), "z_sum": se.summed_where(p, z, z > 1, 24)}
        )
    )


def _range(hours: int, agg: str) -> str:
    return f"{agg} OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '{hours * 3600 - 1}.999999 seconds' PRECEDING AND CURRENT ROW)"


@query(
    "time_windows",
    q.staged(
        {"atr_6h": _range(6, "avg(tr)"), "reference": "CASE WHEN lag(cnt) OVER (PARTITION BY symbol ORDER BY ts) >= 100 THEN lag(qv) OVER (PARTITION BY symbol ORDER BY ts) END", "reference_bars": "lag(qb) OVER (PARTITION BY symbol ORDER BY ts)", "fwd_parkinson": f"CASE WHEN count(hl) {q.over(1, 6)} >= 6 THEN sqrt(avg(hl * hl) {q.over(1, 6)} / {4 * 0.6931471805599453!r}) END",
         "fwd_sum": f"CASE WHEN count(hl) {q.over(1, 6)} >= 6 THEN sum(hl) {q.over(1, 6)} END", "proxy": "lag(px, 6) OVER (PARTITION BY symbol ORDER BY ts)", "rank": f"CASE WHEN count(close) {q.over(-23)} >= 12 AND count(*) {q.over(-23)} > 1 THEN len(list_filter(lw, lambda v: v < close))::DOUBLE / (count(*) {q.over(-23)} - 1) END"},
        {"before": q.lag("close"), "hl": q.ln("high / nullif(low, 0)"), "c6": q.lead("close", 6), "ml6": f"min(low) {q.over(1, 6)}", "full6": q.lead("1", 6), "lw": f"list(close) {q.over(-23)}"},
        {"tr": "greatest(high - low, abs(high - before), abs(low - before))", "px": "CASE WHEN full6 IS NOT NULL THEN (c6 / close - 1) / nullif(abs(ml6 / close - 1), 0) END"},
        {"cnt": _range(240, "count(tr)"), "qv": _range(240, "quantile_cont(tr, 0.9)"), "qb": q.quantile("tr", 120, 0.75, 100)},
    ),
)
def time_windows(spark, sf_dir):
    from ..functions.primitives import true_range

    p = panel(spark, sf_dir)
    true = p.ready(true_range(p))
    return p.select(
        **rounded(
            {
                "atr_6h": se.atr_time(p, true, "6 hours"), "reference": se.reference_quantile(p, true, "240 hours"), "reference_bars": se.reference_quantile_bars(p, true, 120), "fwd_parkinson": se.forward_parkinson(p, 6),
                "fwd_sum": se.forward_sum(p, log(ratio("high", "low")), 6), "proxy": se.lagged_proxy(p, 6, 6), "rank": se.percentile_rank(p, "close", 24),
            }
        )
    )


@query(
    "betting",
    q.staged(
        {"mar": "0.2 * b + 0.3 * b2 + 0.5 * b3", "strike": f"coalesce(last_value(CASE WHEN ttl = 180 THEN close END IGNORE NULLS) {q.over('all')}, first_value(open) {q.over('all')})", "ttl": "ttl", "stop_r": "CASE WHEN ml6 / close - 1 <= -least(b * 4, 0.005) THEN -1.0 ELSE (c6 / close - 1) / nullif(least(b * 4, 0.005), 0) END"},
        {"b": f"avg(abs(close - open) / open) {q.over(-2)}", "b2": f"avg(abs(close - open) / open) {q.over(-5)}", "b3": f"avg(abs(close - open) / open) {q.over(-11)}", "ttl": "((180 - 2 - epoch(ts)::BIGINT // 60) % 180 + 180) % 180 + 1", "c6": q.lead("close", 6), "ml6": f"CASE WHEN {q.lead('1', 6)} IS NOT NULL THEN min(low) {q.over(1, 6)} END"},
    ),
)
def betting(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    p = Panel(bars)
    move = F.abs(F.col("close") - F.col("open")) / F.col("open")
    one, three, five = (p.ready(p.mean(move, n, 1)) for n in (3, 6, 12))
    forward, worst, best = p.ready(ratio(p.lead("close", 6), "close") - 1), p.ready(ratio(p.next_low("low", 6), "close") - 1), p.ready(ratio(p.next_high("high", 6), "close") - 1)
    return p.select(**rounded({"mar": se.blend_mar(one, three, five), "strike": se.group_strike(p, 180), "ttl": se.time_to_strike(180), "stop_r": se.stop_r_multiple(forward, best, worst, one)}))


@query("bet_probability")
def bet_probability(spark, sf_dir):
    """Probability of a price over the strike, by the normal law and by samples of the week before; range of the price.

    The samples of a day are those from seven days before it on whose six bars ahead have closed when it begins.
    """
    p = panel(spark, sf_dir)
    sigma = p.ready(se.sigma_from_mar(p.mean(F.abs(p.log_return("close")), 24), F.lit(6.0)))
    low, high = se.terminal_range_normal("close", sigma)
    z = p.ready(ratio(log(ratio(p.lead("close", 6), "close")), sigma))
    found = p.select(prob_normal=se.prob_yes_normal("close", F.col("open"), sigma), low=low, high=high, z=z, threshold=ratio(log(ratio("open", "close")), sigma), known=p.lead("ts", 6))
    asked = found.drop("z", "known").withColumn("score_date", F.to_date("ts"))
    sample = F.struct("symbol", "z", "known")
    pool = se.z_pool(found.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf"))).select("ts", sample.alias("z")), asked.select("score_date").distinct(), group_minutes=6 * 60)
    pool = pool.where(F.col("z.known") < F.col("score_date").cast("timestamp_ntz"))  # six bars are more than six hours where bars are missing
    day = F.struct("symbol", "score_date").alias("day")
    samples = pool.select("z.symbol", "score_date", "z.z").select(day, "z")
    return se.ecdf_greater(samples, asked.select("*", day), "day").select("symbol", "ts", *(c.alias(n) for n, c in rounded({n: n for n in ("prob_normal", "low", "high", "prob_greater")}).items()))


# -- signals from quantiles: a part's prices as the predicted distribution

_levels = list(si.QUANTILES.items())
_QF = "qf AS (SELECT l_partkey AS part, count(*) AS n, " + ", ".join(f"quantile_cont(l_extendedprice / 100000 - 0.35, {p}) AS {c}" for c, p in _levels) + " FROM lineitem GROUP BY 1)"


def quantile_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / 100000 - 0.35).alias("x"))
    return items.groupBy("part").agg(F.count("*").alias("n"), *(F.percentile("x", F.lit(p)).alias(c) for c, p in _levels))


def _node_sql() -> list[tuple[float, str]]:
    return [(0.0, _levels[0][0]), *((p, c) for c, p in _levels), (1.0, _levels[-1][0])]


_n = _node_sql()
_prob = "CASE WHEN pred_q05 >= 0 THEN 1.0 WHEN pred_q95 <= 0 THEN 0.0 " + " ".join(f"WHEN {a} <= 0 AND {b} > 0 THEN 1 - ({pa} + (-{a} / nullif({b} - {a}, 0)) * {pb - pa!r})" for (pa, a), (pb, b) in zip(_n, _n[1:]) if a != b) + " END"


@query(
    "quantile_signals",
    f"""WITH {_QF}, m AS (SELECT *, {_prob} AS p, {' + '.join(f'{(b[0] - a[0]) / 2!r} * ({a[1]} + {b[1]})' for a, b in zip(_n, _n[1:]))} AS et, {' + '.join(f'{b[0] - a[0]!r} * {a[1]}' for a, b in zip(_n, _n[1:]))} AS el FROM qf)
SELECT part, {q.rounded({'exp_ret_trapezoid': 'et', 'exp_ret_left': 'el', 'prob_up': 'p', 'tail_spread': 'pred_q95 - pred_q05'})}, 0 AS n_violations,
  CASE WHEN (et + el) / 2 > 0.01 THEN 1 WHEN (et + el) / 2 < -0.01 THEN -1 ELSE 0 END AS signal_exp, CASE WHEN p >= 0.55 THEN 1 WHEN p <= 0.45 THEN -1 ELSE 0 END AS signal_prob, CASE WHEN pred_q90 >= 0.4 THEN 1 WHEN pred_q10 <= -0.3 THEN -1 ELSE 0 END AS signal_quantile FROM m""",
)
def quantile_signals(spark, sf_dir):
    found = si.with_core_metrics(quantile_frame(spark, sf_dir))
    made = rounded({n: n for n in ("exp_ret_trapezoid", "exp_ret_left", "prob_up", "tail_spread")})
    return found.withColumns(si.basic_signals(band=0.01, quantile=(0.4, -0.3))).select("part", *(c.alias(n) for n, c in made.items()), "n_violations", "signal_exp", "signal_prob", "signal_quantile")


@query(
    "quantile_repair",
    f"WITH {_QF}, w AS (SELECT part, pred_q50 AS pred_q05, pred_q10, pred_q15, pred_q25, pred_q05 AS pred_q50, pred_q75, pred_q85, pred_q90, pred_q95 FROM qf) SELECT part, "
    + " + ".join(f"(CASE WHEN {a} > {b} THEN 1 ELSE 0 END)" for (a, _), (b, _) in zip(_levels, _levels[1:]))
    + " AS n_violations, "
    + q.rounded({"max_gap": "greatest(0, " + ", ".join(f"{a} - {b}" for (a, _), (b, _) in zip(_levels, _levels[1:])) + ")", "q50": "greatest(pred_q05, pred_q10, pred_q15, pred_q25, pred_q50)", "q95": "greatest(" + ", ".join(c for c, _ in _levels) + ")"})
    + " FROM w",
)
def quantile_repair(spark, sf_dir):
    """Quantiles that are out of order (two are swapped here) are counted and put in order."""
    wrong = quantile_frame(spark, sf_dir).withColumns({"pred_q05": F.col("pred_q50"), "pred_q50": F.col("pred_q05")})
    count, gap = si.monotonic_violations()
    fixed = si.monotonic_fix()
    return wrong.select("part", count.alias("n_violations"), *(c.alias(n) for n, c in rounded({"max_gap": gap, "q50": fixed["pred_q50"], "q95": fixed["pred_q95"]}).items()))


@query("static_thresholds", f"WITH {_QF} SELECT {q.rounded({'high': 'quantile_cont(pred_q90, 0.9)', 'low': 'quantile_cont(pred_q10, 0.1)'})} FROM (SELECT * FROM qf WHERE part % 2 = 0 UNION ALL SELECT * FROM qf WHERE part % 2 = 1)")
def static_thresholds(spark, sf_dir):
    frame = quantile_frame(spark, sf_dir)
    found = si.static_thresholds([frame.where("part % 2 = 0"), frame.where("part % 2 = 1")], [("pred_q90", 90.0), ("pred_q10", 10.0)])
    return found.select(*(c.alias(n) for n, c in rounded({"high": F.col("`pred_q90@90.0000`"), "low": F.col("`pred_q10@10.0000`")}).items()))


# -- evaluation: quality labels against the documents' length

_LD = "ld AS (SELECT d.doc_id, d.lang, l.quality, l.toxic, d.n_chars::DOUBLE AS x FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("x")), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id")


_RANKS = "ranked AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0 AS ry FROM ld)"


@query(
    "binary_separability",
    f"WITH {_LD}, {_RANKS}, a AS (SELECT lang, count(*) AS n, sum(quality) AS k, sum(rx) FILTER (quality = 1) AS s, covar_samp(x, quality) / nullif(stddev_samp(x) * stddev_samp(quality), 0) AS pb, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS sp FROM ranked GROUP BY lang), b AS (SELECT *, CASE WHEN n >= 20 AND k >= 5 AND n - k >= 5 THEN (s - k * (k + 1) / 2.0) / (k * (n - k)) END AS auc FROM a) "
    f"SELECT lang, n, {q.rounded({'pointbiserial': 'pb', 'spearman': 'sp', 'auc': 'auc', 'separability': 'CASE WHEN auc IS NOT NULL THEN greatest(auc, 1 - auc) END'})} FROM b",
)
def binary_separability(spark, sf_dir):
    found = ev.rank_auc(labelled(spark, sf_dir), "quality", "x", ["lang"])
    return found.select("lang", "n", *(c.alias(n) for n, c in rounded({n: n for n in ("pointbiserial", "spearman", "auc", "separability")}).items()))


@query(
    "decile_rates",
    f"WITH {_LD}, edges AS (SELECT lang, list_distinct(quantile_cont(x, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS e FROM ld GROUP BY lang) SELECT lang, greatest(len(list_filter(e, lambda v: v < x)), 1) AS bin, count(*) AS n, {q.rounded({'rate': 'avg(quality)', 'mean_x': 'avg(x)'})} FROM ld JOIN edges USING (lang) GROUP BY 1, 2",
)
def decile_rates(spark, sf_dir):
    found = ev.decile_stats(labelled(spark, sf_dir), "quality", "x", ["lang"])
    return found.select("lang", F.col("bin").cast("long").alias("bin"), "n", *(c.alias(n) for n, c in rounded({"rate": "rate", "mean_x": "mean_x"}).items()))


_P = "p AS (SELECT *, x / (x + 2000) AS prob FROM ld)"


@query(
    "calibration",
    f"WITH {_LD}, {_P}, b AS (SELECT lang, least(floor(prob * 10), 9)::BIGINT AS bin, count(*) AS n, avg(prob) AS mp, avg(quality) AS rate FROM p GROUP BY 1, 2), e AS (SELECT lang, sum(n * abs(mp - rate)) / sum(n) AS ece FROM b GROUP BY 1), s AS (SELECT lang, avg(pow(prob - quality, 2)) AS brier, avg(-(quality * ln(greatest(least(prob, 1 - 1e-6), 1e-6)) + (1 - quality) * ln(1 - greatest(least(prob, 1 - 1e-6), 1e-6)))) AS ll FROM p GROUP BY 1) SELECT lang, {q.rounded({'ece': 'ece', 'brier': 'brier', 'log_loss': 'll'})} FROM e JOIN s USING (lang)",
)
def calibration(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("prob", F.col("x") / (F.col("x") + 2000))
    scores = rows.groupBy("lang").agg(ev.brier("quality", "prob").alias("brier"), ev.log_loss("quality", "prob").alias("log_loss"))
    found = ev.expected_calibration_error(rows, "quality", "prob", ["lang"]).join(scores, "lang")
    return found.select("lang", *(c.alias(n) for n, c in rounded({"ece": "ece", "brier": "brier", "log_loss": "log_loss"}).items()))


@query(
    "equal_count_bins",
    f"WITH {_LD}, r AS (SELECT *, floor((row_number() OVER (PARTITION BY lang ORDER BY x, doc_id) - 1) * 5 / count(*) OVER (PARTITION BY lang))::BIGINT AS bin FROM ld) SELECT lang, bin, count(*) AS n, {q.rounded({'mean_p': 'avg(x)', 'rate': 'avg(quality)', 'low': 'min(x)', 'high': 'max(x)'})} FROM r GROUP BY 1, 2",
)
def equal_count_bins(spark, sf_dir):
    found = ev.equal_count_bins(labelled(spark, sf_dir), "quality", "x", ["lang"], 5, "doc_id")
    return found.select("lang", F.col("bin").cast("long").alias("bin"), "n", *(c.alias(n) for n, c in rounded({n: n for n in ("mean_p", "rate", "low", "high")}).items()))


_TAILS = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x, y) AS r, count(*) OVER (PARTITION BY lang) AS n FROM v) WHERE r <= floor(n * 0.25) OR r > n - floor(n * 0.25)), k AS (SELECT *, CASE WHEN r <= floor(n * 0.25) THEN -1 ELSE 1 END AS tail FROM t)"
_V = "v AS (SELECT d.lang, d.n_chars::DOUBLE AS x, ((d.doc_id * 7919) % 1009)::DOUBLE AS y FROM documents d)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), ((F.col("doc_id") * 7919) % 1009).cast("double").alias("y"))


@query(
    "tail_shift",
    f"WITH {_V}, {_TAILS}, a AS (SELECT lang, count(*) FILTER (tail = 1) AS n_tail, quantile_cont(y, 0.9) FILTER (tail = 1) - quantile_cont(y, 0.1) FILTER (tail = -1) - (quantile_cont(y, 0.9) FILTER (tail = -1) - quantile_cont(y, 0.1) FILTER (tail = 1)) AS s, quantile_cont(y, 0.5) FILTER (tail = 1) - quantile_cont(y, 0.5) FILTER (tail = -1) AS m FROM k GROUP BY 1), z AS (SELECT lang, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS sc FROM v GROUP BY 1) "
    f"SELECT lang, n_tail, {q.rounded({'tqss': 'CASE WHEN n_tail >= 10 THEN s END', 'tqss_norm': 'CASE WHEN n_tail >= 10 THEN s / nullif(sc, 0) END', 'median_shift_norm': 'CASE WHEN n_tail >= 10 THEN m / nullif(sc, 0) END'})} FROM a JOIN z USING (lang)",
)
def tail_shift(spark, sf_dir):
    found = ev.tail_shift(scored(spark, sf_dir), "x", "y", ["lang"])
    return found.select("lang", "n_tail", *(c.alias(n) for n, c in rounded({n: n for n in ("tqss", "tqss_norm", "median_shift_norm")}).items()))


@query(
    "wasserstein",
    f"WITH {_V}, {_TAILS}, g AS (SELECT lang, y, (count(*) FILTER (tail = 1) OVER w)::DOUBLE / count(*) FILTER (tail = 1) OVER (PARTITION BY lang) - (count(*) FILTER (tail = -1) OVER w)::DOUBLE / count(*) FILTER (tail = -1) OVER (PARTITION BY lang) AS gap, lead(y) OVER (PARTITION BY lang ORDER BY y) - y AS step FROM k WINDOW w AS (PARTITION BY lang ORDER BY y RANGE UNBOUNDED PRECEDING)), s AS (SELECT lang, sum(abs(gap) * step) AS w1 FROM g GROUP BY 1), m AS (SELECT lang, quantile_cont(y, 0.5) FILTER (tail = 1) - quantile_cont(y, 0.5) FILTER (tail = -1) AS d FROM k GROUP BY 1) SELECT lang, {q.rounded({'w1': 'w1', 'signed_w1': 'sign(d) * w1'})} FROM s JOIN m USING (lang)",
)
def wasserstein(spark, sf_dir):
    found = ev.signed_wasserstein(scored(spark, sf_dir), "x", "y", ["lang"])
    return found.select("lang", *(c.alias(n) for n, c in rounded({"w1": "w1", "signed_w1": "signed_w1"}).items()))


@query(
    "conditional_stats",
    f"WITH {_V}, l AS (SELECT lang, quantile_cont(x, 0.9) AS lim FROM v GROUP BY 1) SELECT lang, count(y) AS n, {q.rounded({'mean': 'CASE WHEN count(y) >= 10 THEN avg(y) END', 'median': 'CASE WHEN count(y) >= 10 THEN quantile_cont(y, 0.5) END', 'std': 'CASE WHEN count(y) >= 10 THEN stddev_pop(y) END', 'positive': 'CASE WHEN count(y) >= 10 THEN avg((y > 0)::INT) END'})} FROM v JOIN l USING (lang) WHERE x >= lim GROUP BY 1",
)
def conditional_stats(spark, sf_dir):
    found = ev.conditional_target_stats(scored(spark, sf_dir), "x", "y", ["lang"])
    return found.select("lang", "n", *(c.alias(n) for n, c in rounded({n: n for n in ("mean", "median", "std", "positive")}).items()))


_CURVE = f"""WITH {_LD}, points AS (SELECT lang, x, sum(quality)::DOUBLE AS hits, count(*) AS n FROM ld GROUP BY 1, 2),
curve AS (SELECT lang, x, sum(hits) OVER down AS tp, sum(n) OVER down AS n, sum(hits) OVER (PARTITION BY lang) AS whole FROM points WINDOW down AS (PARTITION BY lang ORDER BY x DESC)),
steps AS (SELECT lang, x, tp / nullif(whole, 0) AS recall, tp / n AS precision FROM curve),
parts AS (SELECT lang, (recall - coalesce(lag(recall) OVER down, 0)) * (precision + coalesce(lag(precision) OVER down, 1)) / 2 AS part FROM steps WINDOW down AS (PARTITION BY lang ORDER BY x DESC))
SELECT lang, {q.rounded({"pr_auc": "sum(part)"})} FROM parts GROUP BY lang"""


@query("pr_auc", _CURVE)
def pr_auc(spark, sf_dir):
    found = ev.pr_auc(labelled(spark, sf_dir), "quality", "x", ["lang"])
    return found.select("lang", *(c.alias(n) for n, c in rounded({"pr_auc": "pr_auc"}).items()))


_CORR = ["volume", "oi", "premium", "spot_volume"]


@query(
    "feature_correlations",
    f"WITH {q.BARS}, long AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS feature, {c} AS x, close FROM bars" for c in _CORR) + f"), r AS (SELECT *, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, feature ORDER BY close) + (count(*) OVER (PARTITION BY symbol, feature, close) - 1) / 2.0 AS ry FROM long) SELECT symbol, feature, count(*) AS n, {q.rounded({'pearson': 'covar_samp(x, close) / nullif(stddev_samp(x) * stddev_samp(close), 0)', 'spearman': 'covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0)'})} FROM r GROUP BY 1, 2",
)
def feature_correlations(spark, sf_dir):
    found = ev.feature_target_correlations(hourly(spark, sf_dir), "close", _CORR, ["symbol"])
    return found.select("symbol", "feature", "n", *(c.alias(n) for n, c in rounded({"pearson": "pearson", "spearman": "spearman"}).items()))


_CHOSEN = ["close", "open", "high", "low", *_CORR]
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, covar_samp(r_{a}, r_{b}) / nullif(stddev_samp(r_{a}) * stddev_samp(r_{b}), 0) AS rho, count(*) AS overlap FROM ranked" for i, a in enumerate(_CHOSEN) for b in _CHOSEN[i + 1 :]
)
_GREEDY = f"""WITH RECURSIVE {q.BARS}, ranked AS (SELECT {", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in _CHOSEN)} FROM bars),
pairs AS MATERIALIZED (SELECT a, b FROM ({_PAIRS}) WHERE abs(rho) >= 0.6 AND overlap >= 200),
near AS MATERIALIZED (SELECT name, list(other) AS others FROM (SELECT a AS name, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs) GROUP BY 1),
asked AS MATERIALIZED (SELECT n, name, coalesce(others, []) AS others FROM (SELECT unnest({_CHOSEN!r}) AS name, unnest(range({len(_CHOSEN)})) AS n) LEFT JOIN near USING (name)),
walk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS kept UNION ALL SELECT w.n + 1, CASE WHEN list_has_any(w.kept, a.others) THEN w.kept ELSE list_append(w.kept, a.name) END FROM walk w JOIN asked a ON a.n = w.n)
SELECT (unnest(range(len(kept))))::INTEGER AS place, unnest(kept) AS feature FROM walk WHERE n = {len(_CHOSEN)}"""


@query("feature_selection", _GREEDY)
def feature_selection(spark, sf_dir):
    """Greedy selection over the rank correlation of features; the kept ones with their places."""
    bars = hourly(spark, sf_dir).withColumn("key", F.concat_ws("|", "symbol", F.col("ts").cast("string")))
    kept = ev.greedy_select(ev.correlation_matrix(bars, "key", _CHOSEN), _CHOSEN, 0.6)
    return spark.createDataFrame([(i, n) for i, n in enumerate(kept)], "place int, feature string")


@query("missing_and_kinds", f"WITH {_LD}, k AS (SELECT 'quality' AS c, 'binary' AS kind UNION ALL SELECT 'toxic', 'binary' UNION ALL SELECT 'x', 'numerical') SELECT c AS \"column\", kind, 0.0::DOUBLE AS missing_pct FROM k")
def missing_and_kinds(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return ev.binary_columns(rows, ["quality", "toxic", "x"]).join(ev.missingness(rows, ["quality", "toxic", "x"]), "column")


_MOVES = " UNION ALL ".join(f"SELECT symbol, {k} AS k, close - lag(close, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars" for k in range(2, 21))
_STATIONARY = f"""WITH {q.BARS}, moves AS ({_MOVES}), spread AS (SELECT symbol, k, stddev_pop(d) AS s FROM moves GROUP BY 1, 2),
h AS (SELECT symbol, regr_slope(CASE WHEN s > 0 THEN ln(s) END, ln(k)) AS hurst FROM spread GROUP BY 1),
f AS (SELECT symbol, 1 + regr_slope(close - before, before) AS phi FROM (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars) GROUP BY 1),
m AS (SELECT symbol, hurst, CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS half_life FROM h JOIN f USING (symbol)),
scored AS (SELECT *, coalesce(hurst, 1) + 0.5 * ln(1 + coalesce(half_life, 1e9)) / ln(101) AS score FROM m)
SELECT symbol, (rank() OVER (ORDER BY score))::INTEGER AS rank, {q.rounded({"hurst": "hurst", "half_life": "half_life", "score": "score"})} FROM scored"""


@query("stationarity", _STATIONARY)
def stationarity(spark, sf_dir):
    scores = ev.hurst_by_lags(panel(spark, sf_dir), "close").join(ev.half_life(panel(spark, sf_dir), "close"), "symbol")
    found = ev.stationarity_rank(scores)
    return found.select("symbol", "rank", *(c.alias(n) for n, c in rounded({"hurst": "hurst", "half_life": "half_life", "score": "score"}).items()))


@query(
    "signal_metrics",
    q.staged(
        {"direction": "d", "forward_return": "fr", "drawdown": "CASE WHEN d = 1 THEN least(ml / close - 1, 0) WHEN d = -1 THEN least(-(mh / close - 1), 0) END", "correct": "CASE WHEN d <> 0 AND fr IS NOT NULL THEN (sign(fr) = d)::INT END"},
        {"d": "CASE WHEN premium > 0.01 THEN 1 WHEN premium < -0.01 THEN -1 ELSE 0 END", "fr": f"{q.lead('close', H)} / close - 1", "mh": f"max(high) {_ahead}", "ml": f"min(low) {_ahead}"},
    ),
)
def signal_metrics(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    found = ev.signal_metrics(bars.select("symbol", "ts", F.col("premium").alias("y_pred")), bars, H, 0.01)
    return found.select("symbol", "ts", *(c.alias(n) for n, c in rounded({n: n for n in ("direction", "forward_return", "drawdown", "correct")}).items()))


# -- backtests


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    z = p.ready(p.zscore("close", 24))
    return p.with_columns(signal=bt.entry_signal([(z, "<", -1.0)], [(z, ">", 2.0)]), z=z)


#: A bar after the other for each symbol and setting; the state is flat (0), entering (1), open (2) or closing (3).
_WALK = f"""WITH RECURSIVE {q.BARS}, grid AS (
  SELECT 'stop_loss_pct=' || s || '|expiry_bars=' || e || '|direction=' || d AS config, s::DOUBLE AS pct, e::INT AS expiry, d AS side
  FROM unnest(['-50.0', '-80.0']) AS a(s), unnest(['6', '24']) AS b(e), unnest(['long', 'both']) AS c(d)
), z AS (SELECT symbol, ts, open, high, low, close, {q.zscore("close", 24)} AS z FROM bars
), bar AS MATERIALIZED (
  SELECT symbol, ts, open, high, low, close, (open + high + low + close) / 4 AS mean, CASE WHEN coalesce(z < -1, false) THEN 1 WHEN coalesce(z > 2, false) THEN -1 ELSE 0 END AS signal,
         row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, count(*) OVER (PARTITION BY symbol) AS last
  FROM z
), walk AS (
  SELECT symbol, config, pct, expiry, side, n, CASE WHEN signal = 1 OR signal = -1 AND side = 'both' THEN 1 ELSE 0 END AS state, signal AS way, NULL::TIMESTAMP AS entered, NULL::DOUBLE AS price, 0 AS held, NULL::DOUBLE AS stop,
         NULL::TIMESTAMP AS exit_time, NULL::DOUBLE AS exit_price, NULL::VARCHAR AS reason
  FROM bar, grid WHERE n = 1
  UNION ALL
  SELECT symbol, config, pct, expiry, side, n,
         CASE WHEN reason IS NOT NULL THEN 0 WHEN before = 1 THEN 2 WHEN before = 2 THEN CASE WHEN held >= expiry THEN 3 ELSE 2 END WHEN signal = 1 OR signal = -1 AND side = 'both' THEN 1 ELSE 0 END,
         CASE WHEN before = 0 THEN signal ELSE way END, CASE WHEN before = 1 THEN ts ELSE entered END, CASE WHEN before = 1 THEN mean ELSE price END, CASE WHEN before = 1 THEN 0 ELSE held END,
         CASE WHEN before = 1 THEN close * (1 + way * pct / 100) ELSE stop END, CASE WHEN reason IS NOT NULL THEN ts END,
         CASE reason WHEN 'time_exit' THEN mean WHEN 'stop_loss' THEN CASE WHEN way = 1 AND open <= stop OR way = -1 AND open >= stop THEN open ELSE stop END WHEN 'end_of_data' THEN close END, reason
  FROM (
    SELECT *, CASE WHEN before = 3 THEN 'time_exit' WHEN before = 2 AND (way = 1 AND low <= stop OR way = -1 AND high >= stop) THEN 'stop_loss' WHEN before = 2 AND held >= expiry AND n = last THEN 'end_of_data' END AS reason
    FROM (
      SELECT b.*, w.config, w.pct, w.expiry, w.side, w.state AS before, w.way, w.entered, w.price, w.held + (w.state >= 2)::INT AS held, w.stop
      FROM walk w JOIN bar b ON b.symbol = w.symbol AND b.n = w.n + 1
    )
  )
), trades AS (
  SELECT symbol, config, entered AS entry_time, exit_time, way::INT AS direction, price AS entry_price, exit_price, held::INT AS bars_held, reason AS exit_reason, pct AS stop_loss_pct,
         (CASE WHEN way = 1 THEN exit_price / price - 1 ELSE 1 - exit_price / price END) * 100 - 0.1::DOUBLE AS pnl_pct
  FROM walk WHERE reason IS NOT NULL
)"""


@query("backtest_grid", f"{_WALK} SELECT * FROM trades")
def backtest_grid(spark, sf_dir):
    """Trades of every configuration."""
    configs = bt.grid(spark, stop_loss_pct=[-50.0, -80.0], expiry_bars=[6, 24], direction=["long", "both"])
    return bt.run_backtest(signalled(spark, sf_dir), configs, fee_pct=0.1)


_STATS = {"win_rate": "avg((pnl_pct > 0)::INT)", "mean_pnl": "avg(pnl_pct)", "total_pnl": "sum(pnl_pct)", "mean_win": "avg(pnl_pct) FILTER (pnl_pct > 0)", "mean_loss": "avg(pnl_pct) FILTER (pnl_pct <= 0)"}
_STATS["capital"] = "list_reduce(list_concat([1000::DOUBLE], list(pnl_pct ORDER BY exit_time, entry_time, pnl_pct)), lambda c, g: least(c * (1 + g / 100), 100000))"


@query("backtest_stats", f"{_WALK} SELECT symbol, config, count(*) AS n_trades, count(*) FILTER (exit_reason = 'stop_loss') AS n_stops, count(*) FILTER (exit_reason = 'time_exit') AS n_time_exits, {q.rounded(_STATS)} FROM trades GROUP BY 1, 2")
def backtest_stats(spark, sf_dir):
    found = bt.trade_stats(backtest_grid(spark, sf_dir), "symbol", "config")
    return found.select("symbol", "config", "n_trades", "n_stops", "n_time_exits", *(c.alias(n) for n, c in rounded({n: n for n in _STATS}).items()))


@query(
    "entry_signals",
    q.staged({"signal": "CASE WHEN coalesce(z < -1, false) THEN 1 WHEN coalesce(z > 2, false) THEN -1 ELSE 0 END", "stop": "CASE WHEN z < -1 THEN close * (1 - 0.5) END", "rules": "(coalesce(z < -1, false)::INT + (volume >= 5)::INT >= 2)::INT"}, {"z": q.zscore("close", 24)}),
)
def entry_signals(spark, sf_dir):
    bars = signalled(spark, sf_dir)
    met = bt.rules_met({"z": ("<", -1.0), "volume": (">=", 5.0)}, "count", 2)
    return bars.select("symbol", "ts", *(c.alias(n) for n, c in rounded({"signal": "signal", "stop": F.when(F.col("z") < -1, bt.stop_from_close(F.lit(1), "close", F.lit(-50.0))), "rules": met.cast("int")}).items()))


@query(
    "strategy_returns",
    f"WITH {q.BARS}, {_HITS} SELECT symbol, ts, {q.rounded({'ret': f'CASE WHEN uf OR tie THEN {UP} WHEN df THEN -{DOWN} WHEN full_ THEN c12 / close - 1 END'})} FROM named",
)
def strategy_returns(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select(**rounded({"ret": tg.strategy_return(p, tg.Hits(p, H, UP, DOWN))}))


@query(
    "rolling_evaluation",
    q.staged(
        {"auc": "CASE WHEN len(a) + len(z) >= 30 AND len(a) > 0 AND len(z) > 0 THEN list_sum(list_transform(a, lambda v: len(list_filter(z, lambda w: w < v)) + 0.5 * len(list_filter(z, lambda w: w = v)))) / (len(a) * len(z)) END", "corr_48": q.corr("premium", "close", 48, 20), "up_share": q.mean("(CASE WHEN close > open THEN 100.0 ELSE 0 END)", 48, 1)},
        {"y": "(close > open)::INT"}, {"a": f"coalesce(list(premium) FILTER (y = 1) {q.over(-47)}, [])", "z": f"coalesce(list(premium) FILTER (y = 0) {q.over(-47)}, [])"},
    ),
)
def rolling_evaluation(spark, sf_dir):
    p = Panel(hourly(spark, sf_dir).withColumn("y", (F.col("close") > F.col("open")).cast("int")))
    return p.select(**rounded({"auc": ev.rolling_auc(p, "y", "premium", 48, 30), "corr_48": p.corr("premium", "close", 48, 20), "up_share": p.mean(F.col("y") * 100.0, 48, 1)}))


_LIVE = """longer AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS s, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
closed AS (SELECT symbol, s, list(c) OVER (PARTITION BY symbol ORDER BY s ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS cs FROM longer),
moved AS (SELECT b.symbol, b.ts, list_transform(range(1, 15), lambda i: (list_append(cs, b.close))[i + 1] - cs[i]) AS m FROM bars b JOIN closed k ON b.symbol = k.symbol AND k.s = time_bucket(INTERVAL '4 hours', b.ts) WHERE len(cs) = 14),
sums AS (SELECT symbol, ts, list_sum(list_transform(m, lambda x: greatest(x, 0))) AS g, list_sum(list_transform(m, lambda x: greatest(-x, 0))) AS l FROM moved)"""


@query("live_rsi", f"WITH {q.BARS}, {_LIVE} SELECT b.symbol, b.ts, {q.rounded({'live_rsi_4H': 'CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END'})} FROM bars b LEFT JOIN sums USING (symbol, ts)")
def live_rsi(spark, sf_dir):
    from ..operators.bars import live_rsi as live

    found = live(hourly(spark, sf_dir), "4H")
    return found.select("symbol", "ts", *(c.alias(n) for n, c in rounded({"live_rsi_4H": "live_rsi_4H"}).items()))


@query(
    "joint_signal",
    f"WITH {q.BARS}, s AS (SELECT *, least(greatest(0.5 + premium * 5, 0), 1) AS p FROM bars) SELECT symbol, ts, CASE WHEN p >= 0.55 AND close > 40 AND premium > 0 THEN 1 WHEN p <= 0.45 AND close < 40 AND premium < 0 THEN -1 ELSE 0 END AS signal FROM s",
)
def joint_signal(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    signals = bars.select("symbol", "ts", F.least(F.greatest(0.5 + F.col("premium") * 5, F.lit(0.0)), F.lit(1.0)).alias("prob_up"), (F.col("close") - 40).alias("exp_ret_avg"))
    return si.joint_indicator(signals, bars.select("symbol", "ts", F.col("premium").alias("pred_q50")), out="signal", keys=("symbol", "ts")).select("symbol", "ts", "signal")
