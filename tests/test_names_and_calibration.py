"""Names of columns, calibration, searches over settings and features, clusters: against plain Python."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from barweave.functions import names
from barweave.operators import evaluate as ev, models as mo, probability as pb
from barweave.sources import readers


def test_names(spark):
    assert names.timeframe("close_rsi_14_4H") == ("4h", 4 * 3600) and names.timeframe("close_4H", ("12H", "4H")) == ("4H", 4 * 3600)
    assert names.timeframe("plain") == (None, None) and names.timeframe("x_abc", ("abc",)) == ("abc", None)
    assert names.without_timeframe("close_rsi_14_4H") == "close_rsi_14" and names.without_timeframe("plain") == "plain"
    wanted = {
        "close_rsi_14_4H": ("momentum", "4H", {"series": "close", "window": "14"}), "close_ma_cross_diff_12_26_1D": ("trend", "1D", {"series": "close", "kind": "diff", "fast": "12", "slow": "26"}), "close_bb_width_20_2_1H": ("volatility", "1H", {"series": "close", "which": "width", "window": "20", "std": "2"}),
        "close_bb_width_pct_20_2": ("volatility", None, {"series": "close", "window": "20", "std": "2"}), "close_obv": ("volume", None, {}), "close_obv_over_dollar_vol_20_12H": ("volume", "12H", {"window": "20"}), "a_1_x_b_2_1H": ("interaction", "1H", {"left": "a_1", "right": "b_2"}),
        "close_logret_current_lag_2_4H": ("current_bar", "4H", {"lags": "2"}), "close_macd_line_12_26_over_atr14": ("momentum", None, {"series": "close", "fast": "12", "slow": "26", "norm": "atr14"}), "close_cvar_5_50": ("risk", None, {"series": "close", "alpha_pct": "5", "window": "50"}),
        "close_perm_entropy_3_50": ("statistical", None, {"series": "close", "m": "3", "window": "50"}), "close_dist_ema20_atr": ("normalized", None, {"series": "close", "span": "20"}), "hmm_regime_p_state_1_1H": ("regime", "1H", {"state": "1"}), "whatever": ("other", None, {}),
    }
    assert {n: names.feature(n) for n in wanted} == wanted
    assert names.target("y_tb_label_u0.04_d0.02_24h") == ("triple_barrier_ternary", "24h", {"up": "0.04", "down": "0.02"}) and names.target("y_mae_24h") == ("excursion", "24h", {"kind": "mae"})
    rows = {r.column_name: r for r in names.metadata(spark, ["timestamp", "close_obv_1H", "y_ret_3h", "state"], {"close_obv_1H": ("current_bar_with_lags_1H.csv", "close_obv"), "state": ("regimes", "state")}).collect()}
    assert len(rows) == 3 and rows["close_obv_1H"].module == "current_bar_features" and rows["state"].module == "hmm_regime" and rows["y_ret_3h"].horizon == "3h" and rows["y_ret_3h"].params == {"kind": "ret"}


def scored(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = round(rng.gauss(0, 1), 2)
        rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i), x, int(rng.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * x))))))
    return rows


def test_platt_and_isotonic(spark):
    rows = scored()
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double, y int")
    slope = start = 0.0
    for _ in range(60):  # Newton steps on the same penalised loss
        g = [slope, 0.0]
        h = [[1.0, 0.0], [0.0, 0.0]]
        for _, x, y in rows:
            p = 1 / (1 + math.exp(-(slope * x + start)))
            g[0] += (p - y) * x
            g[1] += p - y
            w = p * (1 - p)
            h[0][0] += w * x * x
            h[0][1] += w * x
            h[1][0] += w * x
            h[1][1] += w
        det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
        slope, start = slope - (h[1][1] * g[0] - h[0][1] * g[1]) / det, start - (h[0][0] * g[1] - h[1][0] * g[0]) / det
    for r in df.limit(50).select("x", pb.platt(df, "x", "y")(F.col("x")).alias("p")).collect():
        assert abs(r.p - 1 / (1 + math.exp(-(slope * r.x + start)))) < 1e-4
    # pool adjacent violators
    pools = []
    for x in sorted({x for _, x, _ in rows}):
        own = [y for _, v, y in rows if v == x]
        pools.append([sum(own), len(own), [x]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, xs = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + xs]
    plain = {x: s / n for s, n, xs in pools for x in xs}
    got = df.select("x", pb.isotonic(df, "x", "y")(F.col("x")).alias("p")).distinct().collect()
    assert all(abs(r.p - plain[r.x]) < 1e-9 for r in got)


def test_monthly_calibration(spark):
    df = spark.createDataFrame(scored(), "ts timestamp_ntz, x double, y int")
    rows, bins = pb.monthly_calibration(df, "x", "y", "2024-03-01", 3, lookback=2, bins=5)
    assert {str(r.month) for r in rows.select("month").distinct().collect()} == {"2024-03-01", "2024-04-01", "2024-05-01"}
    assert rows.where("p_cal <= 0 or p_cal >= 1").count() == 0 and bins.agg(F.sum("n")).first()[0] == rows.count()
    none, _ = pb.monthly_calibration(df, "x", "y", "2020-01-01", 2)
    assert none.count() == 0


def test_searches(spark):
    rng = random.Random(2)
    rows = [(i + 1, a := rng.gauss(0, 1), b := rng.gauss(0, 1), rng.gauss(0, 1), int(a + 0.5 * b > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "_row int, a double, b double, noise double, y int")
    best, found = mo.random_search(df, ["a", "b"], "y", {"maxIter": [1, 2], "maxDepth": [1, 3]}, trials=3, n_folds=1, fold_size=100)
    assert len(found) == 3 and best == min(found, key=lambda x: x[1])[0]
    train, test = df.where("_row <= 300"), df.where("_row > 300")
    chosen, trials = mo.forward_selection(train, test, [], ["noise", "a", "b"], "y", most=2, maxIter=3, maxDepth=3)
    assert chosen == ["a", "b"] and [t["round"] for t in trials] == [1, 1, 1, 2, 2]


def test_chunked_regimes_are_the_whole_ones(spark, monkeypatch):
    rng = random.Random(6)
    rows, state = [], 0
    for i in range(700):
        state = 1 - state if rng.random() < 0.05 else state
        rows.append(("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), rng.gauss(3 * state, 1)))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    whole, score = mo.fit_hmm(df, ["x"], 2, iterations=4)
    wanted = {r.ts: r.p_state_1 for r in mo.hmm_states(df, whole, ["x"]).collect()}
    monkeypatch.setattr(mo, "CHUNK", 50)
    cut, other = mo.fit_hmm(df, ["x"], 2, iterations=4)
    assert abs(score - other) < 1e-10 * abs(score) and abs(cut.move - whole.move).max() < 1e-10 and abs(cut.mean - whole.mean).max() < 1e-10
    found = {r.ts: r.p_state_1 for r in mo.hmm_states(df, whole, ["x"]).collect()}
    assert set(found) == set(wanted) and max(abs(found[t] - p) for t, p in wanted.items()) < 1e-10


def test_clusters_overlap_and_attributions(spark):
    matrix = spark.createDataFrame([("a", "b", 0.1, 500), ("a", "c", -0.9, 500), ("a", "d", 0.2, 500), ("b", "c", 0.1, 500), ("b", "d", 0.8, 50), ("c", "d", 0.1, 500)], "a string, b string, rho double, overlap long")
    assert ev.cluster_order(matrix, ["a", "b", "c", "d"]) == ["a", "c", "b", "d"]
    assert ev.greedy_select(matrix, ["b", "d"], 0.5) == ["b", "d"] and ev.greedy_select(matrix, ["b", "d"], 0.5, least_overlap=10) == ["b"]
    rows = ev.with_attributions(spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "ts int, a double, b double"), spark.createDataFrame([(1, 0.1, -0.2)], "ts int, shap_a double, b double"), ["a", "b"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 2.0, 0.1), (1, "b", 3.0, -0.2)]


def test_broken_rows_are_no_headers(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("open_time,open,high\n1700000000000,1,2\n,3,4\n-5x,5,6\n")
    assert [r.open for r in readers.read_kline_csv(spark, str(tmp_path / "bars.csv")).collect()] == ["1", "3", "5"]
