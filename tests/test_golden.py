"""Small cases with known results."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barweave.frames import Panel
from barweave.functions import signals as si, targets as tg, technical as te
from barweave.functions.current_bar import current_bar_features, lag_name
from barweave.operators import backtest as bt, bars as ba, joins as jo, store as st
from barweave.sources import readers

START = datetime(2024, 1, 1)


def bars(spark, rows, symbol="S"):
    """Hourly bars from (open, high, low, close, volume)."""
    data = [(symbol, START + timedelta(hours=i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def first(df):
    return df.orderBy("ts").first()


def forward(spark, highs, lows, entry=100.0, closes=None):
    closes = closes or [entry] * len(highs)
    return bars(spark, [(entry, entry, entry, entry, 1)] + [(c, h, low, c, 1) for h, low, c in zip(highs, lows, closes)])


def test_forward_return(spark):
    p = Panel(forward(spark, [101, 102, 103], [101, 102, 103], closes=[101.0, 102.0, 103.0]))
    row = first(p.select(a=tg.forward_return(p, 2), b=tg.forward_return(p, 3, use_log=False), c=tg.forward_return(p, 5)))
    assert row.a == pytest.approx(math.log(1.02)) and row.b == pytest.approx(0.03) and row.c is None


def test_excursions(spark):
    p = Panel(forward(spark, [101, 103, 102], [99.5, 100, 98]))
    row = first(p.select(a=tg.mfe(p, 3), b=tg.mae(p, 3), c=tg.mfe(p, 5), d=tg.mfe(p, 5, partial=True)))
    assert row.a == pytest.approx(0.03) and row.b == pytest.approx(-0.02) and row.c is None and row.d == pytest.approx(0.03)


@pytest.mark.parametrize(
    "highs, lows, label, binary, hit",
    [([100.5, 102.2, 101.5], [99.8, 100.4, 100.0], 1, 1, 1), ([100.5, 100.8, 100.9], [98.9, 99.2, 99.4], -1, 0, 0), ([102.5, 100, 100], [98.5, 100, 100], 0, 0, None), ([101, 101, 101], [99.5, 99.5, 99.5], 0, 0, None)],
)
def test_barriers(spark, highs, lows, label, binary, hit):
    p = Panel(forward(spark, highs, lows))
    h = tg.Hits(p, 3, 0.02, 0.01)
    row = first(p.select(a=tg.barrier_label(h), b=tg.tp_before_sl(h), c=tg.first_hit_direction(h), r=tg.r_multiple(p, h)))
    assert (row.a, row.b, row.c) == (label, binary, hit)
    assert row.r == pytest.approx(2.0 if label == 1 else -1.0 if min(lows) <= 99 else 0.0)


def test_barrier_tie_by_the_open(spark):
    p = Panel(bars(spark, [(100, 100, 100, 100, 1), (100.1, 102.5, 98.5, 100, 1)]))
    h = tg.Hits(p, 1, 0.02, 0.01)
    row = first(p.select(a=tg.barrier_label(h), b=tg.barrier_label(h, "proximity")))
    assert (row.a, row.b) == (0, -1)


Q = list(si.QUANTILES)


def quantile_row(spark, values):
    return spark.createDataFrame([tuple(map(float, values))], ", ".join(f"{c} double" for c in Q))


def test_quantile_order(spark):
    df = quantile_row(spark, [0, -0.01, 0, -0.002, 0, 0.01, 0.02, 0.025, 0.03])
    n, gap = si.monotonic_violations()
    row = df.select(n.alias("n"), gap.alias("gap")).first()
    assert row.n >= 2 and row.gap == pytest.approx(0.01)
    fixed = df.select(*(c.alias(k) for k, c in si.monotonic_fix().items())).first()
    assert list(fixed) == sorted(fixed)


def test_expectations(spark):
    row = quantile_row(spark, [0.02] * 9).select(si.expected_trapezoid().alias("a"), si.expected_left().alias("b")).first()
    assert row.a == pytest.approx(0.02) and row.b == pytest.approx(0.02)
    row = quantile_row(spark, [-0.10, -0.08, -0.05, -0.02, 0, 0.02, 0.05, 0.08, 0.10]).select(si.expected_trapezoid().alias("a"), si.expected_left().alias("b")).first()
    assert abs(row.a) < 1e-3 and row.b <= row.a


@pytest.mark.parametrize("values, wanted", [([0.01] * 9, 1), ([-0.01] * 9, 0), ([-0.05, -0.04, -0.03, -0.02, -0.02, 0.02, 0.03, 0.04, 0.05], 0.375)])
def test_prob_up(spark, values, wanted):
    assert quantile_row(spark, values).select(si.prob_up().alias("p")).first().p == pytest.approx(wanted)


def test_static_thresholds(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in xs], "v double") for xs in ((1, 2, 3), (4, 5, 6)))
    row = si.static_thresholds([a, b], [("v", 90.0), ("v", 10.0)]).first()
    assert row["v@90.0000"] == pytest.approx(5.5) and row["v@10.0000"] == pytest.approx(1.5)


def test_basic_signals(spark):
    rows = [(-1e-5, 0.40, 0.01, -0.03), (0.0, 0.50, 0.02, -0.02), (2e-5, 0.60, 0.03, -0.01)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, exp_ret_avg double, prob_up double, pred_q90 double, pred_q10 double")
    found = df.withColumns(si.basic_signals(quantile=(0.02, -0.02))).orderBy("i").collect()
    assert [(r.signal_exp, r.signal_prob, r.signal_quantile) for r in found] == [(-1, -1, -1), (0, 0, 1), (1, 1, 1)]


def test_current_bar(spark):
    p = Panel(bars(spark, [(100, 104, 99, 103, 1000), (102, 105, 101, 104, 1100), (103, 106, 102, 105, 900)]))
    row = p.select(**current_bar_features(p)).orderBy(F.col("ts").desc()).first()
    assert row.close_logret_current == pytest.approx(math.log(105 / 104)) and row.high_low_range_pct_current == pytest.approx(4 / 103)
    assert row.close_open_pct_current == pytest.approx(2 / 103) and row.log_volume_delta_current == pytest.approx(math.log1p(900) - math.log1p(1100))
    assert lag_name("close_logret_current_x_log_volume", 2) == "close_logret_lag_2_x_log_volume_lag_2"


def test_catch_up_append(spark):
    hours = lambda a, b: spark.createDataFrame([(datetime(2024, 1, 1, h), float(h)) for h in range(a, b)], "ts timestamp_ntz, close double")
    table = hours(8, 10)
    fresh, faults = st.ingest(hours(8, 13), table, F.lit(datetime(2024, 1, 1, 12, 30)), ["close"])
    whole = table.unionByName(fresh)
    assert whole.count() == 4 and whole.agg(F.max("ts")).first()[0] == datetime(2024, 1, 1, 11) and faults.count() == 0
    assert st.ingest(hours(8, 13), whole, F.lit(datetime(2024, 1, 1, 12, 30)), ["close"])[0].count() == 0


def test_partial_last_bar(spark):
    whole = bars(spark, [(1, 1, 1, 1, 1)] * 50)
    half = spark.createDataFrame([("S", START + timedelta(hours=50, minutes=-30), 1.0, 1.0, 1.0, 1.0, 1.0)], whole.schema)
    assert ba.complete_hours(whole.unionByName(half)).count() == 50


def test_flat_and_short_windows(spark):
    p = Panel(bars(spark, [(5, 5, 5, 5, 0)] * 30))
    bands, k = te.bollinger(p, "close"), te.stochastic(p)[0]
    row = p.select(z=te.zscore(p, "close", 20), pb=bands["percent"], k=k, w=te.williams_r(p), d=te.donchian(p)["pos"], long=te.sma(p, "close", 40), corr=p.corr("close", "volume", 20)).orderBy(F.col("ts").desc()).first()
    assert (row.z, row.pb, row.k, row.w, row.d, row.long, row.corr) == (None, 0.5, 50.0, -50.0, 0.5, None, None)


def test_no_look_ahead_and_symbols_apart(spark):
    base = [(10 + i % 7, 12 + i % 7, 9, 11 + i % 5, 100 + i) for i in range(60)]
    changed = base[:40] + [(99, 100, 1, 50, 7)] * 20
    other = bars(spark, [(1, 2, 1, 2, 3)] * 60, "T")

    def made(df):
        p = Panel(df)
        return {(r.symbol, r.ts): r for r in p.select(z=te.zscore(p, "close", 10), c=te.cci(p, 10), m=te.mfi(p, 5), e=te.entropy(p, "close", 10)).collect()}

    a, b = made(bars(spark, base)), made(bars(spark, changed).unionByName(other))
    early = [k for k in a if k[1] < START + timedelta(hours=40)]
    assert all(a[k] == b[k] for k in early) and len(early) == 40


def test_backtest_loop(spark):
    rows = [(100, 101, 99, 100, 1), (100, 102, 98, 101, 1), (101, 103, 100, 102, 1), (102, 102, 90, 91, 1), (91, 95, 90, 94, 1), (94, 96, 93, 95, 1), (95, 97, 94, 96, 1), (96, 98, 95, 97, 1)]
    df = bars(spark, rows).withColumn("signal", F.when(F.hour("ts").isin(0, 4), 1).otherwise(0))
    trades = bt.run_backtest(df, bt.grid(spark, stop_loss_pct=[-5.0], expiry_bars=[1], direction=["long"])).orderBy("entry_time").collect()
    # the first fills at bar 1's mean price, closes after one more bar; the second fills at bar 5 and closes at bar 7
    assert [(t.entry_time.hour, t.exit_time.hour, t.exit_reason) for t in trades] == [(1, 3, "time_exit"), (5, 7, "time_exit")]
    assert trades[0].entry_price == pytest.approx((100 + 102 + 98 + 101) / 4) and trades[0].exit_price == pytest.approx((102 + 102 + 90 + 91) / 4)
    stopped = bt.run_backtest(df, bt.grid(spark, stop_loss_pct=[-5.0], expiry_bars=[10], direction=["long"])).orderBy("entry_time").collect()
    assert stopped[0].exit_reason == "stop_loss" and stopped[0].exit_price == pytest.approx(101 * 0.95)
    stats = bt.trade_stats(bt.run_backtest(df, bt.grid(spark, stop_loss_pct=[-5.0], expiry_bars=[1], direction=["long"])), "symbol").first()
    assert stats.n_trades == 2 and stats.capital == pytest.approx(1000 * (1 + trades[0].pnl_pct / 100) * (1 + trades[1].pnl_pct / 100))


def test_one_to_one_rejects_repeats(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        jo.one_to_one(df, df.dropDuplicates(["k"]), ["k"])


def test_readers(spark, tmp_path):
    import zipfile

    line = "1704067200000,1,2,0.5,1.5,10,1704070799999,1,1,1,1,0\n"
    (tmp_path / "a.csv").write_text(",".join(readers.KLINE_FIELDS) + "\n" + line)
    row = st.klines(readers.read_kline_csv(spark, f"file://{tmp_path}/a.csv")).first()
    assert row.ts == START and row.close == 1.5
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", line + line)
    assert readers.read_zip_csv(spark, f"file://{tmp_path}/a.zip").count() == 2
    (tmp_path / "p.json").write_text('{"m": {"market_timestamp": 0, "price_history": [{"t": 5, "p": 0.5}, {"t": 61, "p": 0.6}]}}')
    assert [(r.t, r.p) for r in readers.read_price_history(spark, f"file://{tmp_path}/p.json").orderBy("t").collect()] == [(5, 0.5), (61, 0.6)]
    (tmp_path / "b.csv").write_text("Timestamp,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,2,x,1.5,\n2024-01-01 00:00:00,2,2,1,1.5,3\n")
    found = readers.read_table(spark, f"file://{tmp_path}/b.csv", start="2024-01-01 00:00:00")
    assert found.count() == 2 and found.where("low is null").count() == 1
    readers.write_table(found, f"file://{tmp_path}/out.parquet")
    with pytest.raises(Exception, match="exists"):
        readers.write_table(found, f"file://{tmp_path}/out.parquet")


def test_synthetic_bars(spark):
    a, b = readers.synthetic_bars(spark, 50), readers.synthetic_bars(spark, 50).repartition(3)
    assert a.exceptAll(b).count() == 0 and a.where("high < greatest(open, close) or low > least(open, close)").count() == 0
