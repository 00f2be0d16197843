"""Queries for probabilities by time to settlement, trades over time windows, index distributions and target sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..frames import Panel, ratio
from ..functions import targets as tg
from ..operators import backtest as bt, evaluate as ev, joins as jo, probability as pb, store as st
from . import sqltext as q
from .feature_queries import hourly, rounded, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def shown(df: DataFrame, plain: list[str], measured: list[str]) -> DataFrame:
    return df.select(*plain, *(c.alias(n) for n, c in rounded({n: n for n in measured}).items()))


#: Made-up predictions: a minute to settlement, an outcome, our probability and the market's.
_ASKED = "asked AS (SELECT event_id, (event_id % 15)::INT AS ttl, (user_id % 2)::DOUBLE AS outcome, ((event_id * 37) % 101) / 101.0 AS ours, ((user_id * 53) % 97) / 97.0 AS market FROM events)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c, a, b: ((F.col(c) * a) % b) / F.lit(float(b))
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 15).cast("int").alias("ttl"), (F.col("user_id") % 2).cast("double").alias("outcome"), share("event_id", 37, 101).alias("ours"), share("user_id", 53, 97).alias("market"))


_EDGE = {"edge_mean": "avg(e)", "edge_std": "stddev_samp(e)", **{f"edge_q{n}": f"quantile_cont(e, {p})" for n, p in (("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95))}, "pos_edge_rate": "avg((e > 0)::INT)"}


@query("edge_by_ttl", f"WITH {_ASKED}, g AS (SELECT ttl, ours - market AS e FROM asked) SELECT ttl, count(*) AS count, {q.rounded(_EDGE)} FROM g GROUP BY ttl")
def edge_by_ttl(spark, sf_dir):
    return shown(pb.edge_by_ttl(asked(spark, sf_dir), "ours", "market"), ["ttl", "count"], list(_EDGE))


_CLIPPED = lambda p: f"greatest(least({p}, 1 - 1e-6), 1e-6)"
_SCORES = {f"{n}_{s}": x.format(p=p, c=_CLIPPED(p)) for s, p in (("emp", "ours"), ("market", "market")) for n, x in (("brier", "avg(({p} - outcome) ** 2)"), ("logloss", "avg(-(outcome * ln({c}) + (1 - outcome) * ln(1 - {c})))"), ("acc", "avg((({p} >= 0.5) = (outcome = 1))::INT)"))}
_ECE = ", ".join(f"ece_{s} AS (SELECT ttl, sum(n * abs(a - r)) / sum(n) AS ece_{s} FROM (SELECT ttl, least(floor({p} * 10), 9) AS b, count(*) AS n, avg({p}) AS a, avg(outcome) AS r FROM asked GROUP BY 1, 2) GROUP BY 1)" for s, p in (("emp", "ours"), ("market", "market")))
_MEASURED = {"yes_rate": "yes_rate", "brier_emp": "brier_emp", "brier_market": "brier_market", "logloss_emp": "logloss_emp", "logloss_market": "logloss_market", "ece_emp": "ece_emp", "ece_market": "ece_market", "acc_emp_0p5": "acc_emp", "acc_market_0p5": "acc_market", **{f"{n}_delta_market_minus_emp": f"{n}_market - {n}_emp" for n in ("brier", "logloss", "ece")}}


@query(
    "accuracy_by_ttl",
    f"WITH {_ASKED}, g AS (SELECT ttl, count(*) AS count, avg(outcome) AS yes_rate, {', '.join(f'{x} AS {n}' for n, x in _SCORES.items())} FROM asked GROUP BY 1), {_ECE} SELECT ttl, count, CASE WHEN brier_market > brier_emp THEN 'empirical' WHEN brier_market < brier_emp THEN 'market' ELSE 'tie' END AS winner_brier, {q.rounded(_MEASURED)} FROM g JOIN ece_emp USING (ttl) JOIN ece_market USING (ttl)",
)
def accuracy_by_ttl(spark, sf_dir):
    return shown(pb.accuracy_by_ttl(asked(spark, sf_dir), "outcome", "ours", "market"), ["ttl", "count", "winner_brier"], list(_MEASURED))


_SIDE = "CASE WHEN p >= 0.6 THEN 'YES' WHEN p <= 0.4 THEN 'NO' END"
_WON = "CASE side WHEN 'YES' THEN outcome - next_prob WHEN 'NO' THEN next_prob - outcome END"
_STRATEGY = {"participation_rate": "count(side) / count(*)", "win_rate_entered": "avg(CASE side WHEN 'YES' THEN outcome WHEN 'NO' THEN 1 - outcome END)", "avg_abs_confidence": "avg(CASE WHEN side IS NOT NULL THEN abs(p - 0.5) END)", "pnl_total": "sum(coalesce(pnl, 0))", "pnl_per_entered_trade": "avg(pnl)", "pnl_per_opportunity": "avg(coalesce(pnl, 0))"}


@query(
    "strategy_by_ttl",
    f"""WITH {q.BARS}, d AS (SELECT ts, (hour(ts) % 15)::INT AS ttl, (volume::BIGINT % 2)::DOUBLE AS outcome, (close::BIGINT % 101) / 101.0 AS p FROM bars WHERE symbol = 'click'),
prices AS (SELECT ts + INTERVAL 1 MINUTE AS later, (close::BIGINT % 89) / 89.0 AS next_prob FROM bars WHERE symbol = 'view'), e AS (SELECT *, {_SIDE} AS side FROM d JOIN prices ON d.ts + INTERVAL 1 MINUTE = later), w AS (SELECT *, {_WON} AS pnl FROM e)
SELECT ttl, count(*) AS count_total, count(side) AS count_entered, count(*) FILTER (side = 'YES') AS count_yes_entries, count(*) FILTER (side = 'NO') AS count_no_entries, {q.rounded(_STRATEGY)} FROM w GROUP BY ttl""",
)
def strategy_by_ttl(spark, sf_dir):
    """Entries on made-up signals of the clicks' hours at prices of the views' one minute later."""
    bars = hourly(spark, sf_dir).withColumn("close", F.rint("close").cast("long"))
    signals = bars.where("symbol = 'click'").select("ts", (F.hour("ts") % 15).alias("ttl"), (F.col("volume").cast("long") % 2).cast("double").alias("outcome"), (F.col("close") % 101 / F.lit(101.0)).alias("p"))
    prices = bars.where("symbol = 'view'").select((F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"), (F.col("close") % 89 / F.lit(89.0)).alias("market_prob"))
    rows = bt.threshold_strategy(signals, prices, "p", 0.6)
    return shown(pb.strategy_by_ttl(rows, "p"), ["ttl", "count_total", "count_entered", "count_yes_entries", "count_no_entries"], list(_STRATEGY))


_ROLLING = {"win_rate": "avg((g > 0)::INT) OVER w", "avg_return": "avg(g) OVER w", "total_return": "sum(g) OVER w"}


@query("rolling_trade_stats", f"WITH {q.BARS}, g AS (SELECT symbol, ts, close / open - 1 AS g FROM bars WHERE open <> 0 AND volume > 4) SELECT symbol, ts, count(*) OVER w AS n_trades, {q.rounded(_ROLLING)} FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '259199.999999 seconds' PRECEDING AND CURRENT ROW)")
def rolling_trade_stats(spark, sf_dir):
    trades = hourly(spark, sf_dir).where("open <> 0 AND volume > 4").withColumn("g", ratio("close", "open") - 1)
    return shown(bt.rolling_trade_stats(trades, "g", 3, ["symbol"]), ["symbol", "ts", "n_trades"], list(_ROLLING))


_INDEX = "i AS (SELECT symbol, timeframe, greatest(least(x, 100), 0) AS x FROM (SELECT symbol, '1h' AS timeframe, close AS x FROM bars UNION ALL SELECT symbol, '4h', open FROM bars))"
_LEVELS = {"mean": "avg(x)", "std": "stddev_samp(x)", **{f"q{n}": f"quantile_cont(x, {p})" for n, p in (("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95))}, "low_share": "avg((x <= 30)::INT)", "high_share": "avg((x >= 70)::INT)"}


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lambda c: F.greatest(F.least(c, F.lit(100.0)), F.lit(0.0)).alias(c)
    return hourly(spark, sf_dir).select("symbol", kept("close"), kept("open"))


@query("index_distribution", f"WITH {q.BARS}, {_INDEX}, c AS (SELECT symbol, timeframe, least(floor(x / 5) * 5, 95) AS bin, count(*) AS n FROM i GROUP BY ALL) SELECT symbol, timeframe, bin, n, {q.rounded({'share': 'n / sum(n) OVER (PARTITION BY symbol, timeframe)'})} FROM c")
def index_distribution(spark, sf_dir):
    found = ev.index_distribution(_index(spark, sf_dir), {"1h": "close", "4h": "open"})
    return shown(found.withColumn("bin", F.col("bin").cast("double")), ["symbol", "timeframe", "bin", "n"], ["share"])


@query("index_levels", f"WITH {q.BARS}, {_INDEX} SELECT symbol, timeframe, count(*) AS n, {q.rounded(_LEVELS)} FROM i GROUP BY ALL")
def index_levels(spark, sf_dir):
    return shown(ev.index_levels(_index(spark, sf_dir), {"1h": "close", "4h": "open"}), ["symbol", "timeframe", "n"], list(_LEVELS))


@query("split_by_times", f"WITH {q.BARS} SELECT symbol, ts, CASE WHEN day(ts) % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM bars WHERE day(ts) % 3 < 2")
def split_by_times(spark, sf_dir):
    """A split by a stored list of times, some of them written with an offset."""
    bars = hourly(spark, sf_dir).select("symbol", "ts")
    day, text = F.dayofmonth("ts") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    times = bars.select("ts").distinct().where(day < 2).select(F.when(day == 0, F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("+00:00"))).alias("time"), F.when(day == 0, "train").otherwise("test").alias("split"))
    return st.split_by_times(bars, times).select("symbol", "ts", "split")


_UP, _DOWN = (0.02, 0.05), (0.01, 0.03)
_TARGETS = {f"{n}_{h}h": x for h in (3, 12) for n, x in (("y_logret", q.ln(f"{q.lead('close', h)} / close")), ("y_mfe", f"CASE WHEN {q.lead('1', h)} IS NOT NULL AND close <> 0 THEN max(high) {q.over(1, h)} / close - 1 END"), ("y_mae", f"CASE WHEN {q.lead('1', h)} IS NOT NULL AND close <> 0 THEN min(low) {q.over(1, h)} / close - 1 END"))}
_FLAGS = {f"y_hit_up_{h}h_ge_{t}": f"(y_mfe_{h}h >= {t})::INT" for h in (3, 12) for t in _UP} | {f"y_hit_down_{h}h_ge_{t}": f"(y_mae_{h}h <= -{t})::INT" for h in (3, 12) for t in _DOWN}
_TARGET_ROWS = f"{q.BARS}, t AS (SELECT symbol, ts, {', '.join(f'{x} AS {n}' for n, x in _TARGETS.items())} FROM bars)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.target_set(hourly(spark, sf_dir), (3, 12))


@query("target_set", f"WITH {_TARGET_ROWS} SELECT symbol, ts, {q.rounded({n: n for n in _TARGETS})}, {', '.join(f'{x} AS {n!r}'.replace(chr(39), chr(34)) for n, x in _FLAGS.items())} FROM t")
def target_set(spark, sf_dir):
    """Default targets of the bars and the flags made of their excursions."""
    found = _targets(spark, sf_dir)
    flags = tg.hit_columns(found.columns, list(_UP), list(_DOWN))
    return found.select("symbol", "ts", *(c.alias(n) for n, c in rounded({n: n for n in _TARGETS}).items()), *(c.cast("int").alias(n) for n, c in flags.items()))


@query("hit_summary", f"WITH {_TARGET_ROWS}, f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS flag, {x} AS x FROM t" for n, x in _FLAGS.items()) + f") SELECT flag, count(x) AS n, {q.rounded({'rate': 'avg(x)', 'std': 'stddev_samp(x)'})} FROM f GROUP BY 1")
def hit_summary(spark, sf_dir):
    found = _targets(spark, sf_dir)
    flags = tg.hit_columns(found.columns, list(_UP), list(_DOWN))
    return shown(st.hit_summary(found.select(*(c.alias(n) for n, c in flags.items())), list(flags)), ["flag", "n"], ["rate", "std"])


@query("join_all", f"WITH {q.BARS} SELECT a.symbol, a.ts, a.close, b.volume, c.premium FROM bars a JOIN bars b USING (symbol, ts) JOIN bars c USING (symbol, ts) WHERE a.volume > 4 AND b.close > 20 AND c.premium > 0")
def join_all(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return jo.join_all([bars.where("volume > 4").select("symbol", "ts", "close"), bars.where("close > 20").select("symbol", "ts", "volume"), bars.where("premium > 0").select("symbol", "ts", "premium")], ["symbol", "ts"])


@query("training_table", f"WITH {q.BARS}, k AS (SELECT *, row_number() OVER (ORDER BY ts) AS n FROM bars WHERE symbol = 'click'), t AS (SELECT *, ln(lead(close, 3) OVER (ORDER BY ts) / nullif(close, 0)) AS y FROM k) SELECT ts, close, volume, {q.rounded({'y_logret_3h': 'y'})} FROM t WHERE n > 24 AND y IS NOT NULL AND NOT isinf(y) AND close > 0")
def training_table(spark, sf_dir):
    """Chosen columns with one target, without the constant column, the warm-up and incomplete rows; a table is one symbol's."""
    bars = hourly(spark, sf_dir).where("symbol = 'click'")
    features = bars.select("ts", "close", "volume", "trades", F.lit(1.0).alias("same"), F.lit(2.0).alias("y_other"))
    wanted = _targets(spark, sf_dir).where("symbol = 'click'").select("ts", "y_logret_3h")
    return shown(st.training_table(features, wanted, "y_logret_3h", exclude=["trad*"], warm_up=24), ["ts", "close", "volume"], ["y_logret_3h"])


_RANKED = "r AS (SELECT feature, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS k, count(x) OVER (PARTITION BY feature) AS n FROM f)"


@query("quality_score", f"WITH {q.BARS}, f AS (SELECT 'close' AS feature, close AS x FROM bars UNION ALL SELECT 'held', CASE WHEN volume > 4 THEN premium END FROM bars), {_RANKED} SELECT feature, {q.rounded({'rank_std': 'stddev_samp(CASE WHEN x IS NOT NULL THEN k / n END)', 'nan_rate': 'avg((x IS NULL)::INT)', 'score': 'stddev_samp(CASE WHEN x IS NOT NULL THEN k / n END) * (1 - avg((x IS NULL)::INT))'})} FROM r GROUP BY 1")
def quality_score(spark, sf_dir):
    bars = hourly(spark, sf_dir).withColumn("held", F.when(F.col("volume") > 4, F.col("premium")))
    return shown(ev.quality_score(bars, ["close", "held"]), ["feature"], ["rank_std", "nan_rate", "score"])


@query("trade_returns", f"WITH {q.BARS}, t AS (SELECT symbol, ts, CASE WHEN volume > 8 THEN 1 WHEN volume > 4 THEN -1 ELSE 0 END AS s, (volume::INT % 3) - 1 AS label, premium AS p, {q.ln(q.lead('close', 3) + ' / close')} AS y FROM bars) SELECT symbol, ts, ((sign(y) = s) AND y <> 0)::INT AS win, {q.rounded({'pnl_pct': 's * (exp(y) - 1) * 100', 'labelled': 'CASE WHEN p >= 0 THEN 1 ELSE -1 END * CASE label WHEN 1 THEN 0.04 WHEN -1 THEN -0.02 ELSE exp(y) - 1 END'})} FROM t")
def trade_returns(spark, sf_dir):
    p = Panel(hourly(spark, sf_dir))
    signal = F.when(F.col("volume") > 8, 1).when(F.col("volume") > 4, -1).otherwise(0)
    made = p.select(s=signal, label=F.col("volume").cast("int") % 3 - 1, p=F.col("premium"), y=tg.forward_return(p, 3))
    found = made.select("symbol", "ts", *(c.alias(n) for n, c in ev.trade_returns("s", "y").items()), ev.labelled_trade_return("p", "label", "y", 0.04, 0.02, 0.0).alias("labelled"))
    return shown(found, ["symbol", "ts", "win"], ["pnl_pct", "labelled"])
