"""The models of all symbols, with the operator's default settings."""

from datetime import datetime, timedelta

from barweave.operators import models as mo
from barweave.plans.feature_queries import hourly
from barweave.plans.table_queries import trained_trees


def test_every_symbol_has_a_model(spark, sf_dir, monkeypatch):
    fit, given = mo.fit_trees, []
    monkeypatch.setattr(mo, "fit_trees", lambda train, features, target, **settings: given.append(settings) or fit(train, features, target, **settings))
    rows = trained_trees(spark, sf_dir).collect()
    symbols = {r.symbol for r in hourly(spark, sf_dir).select("symbol").distinct().collect()}
    assert len(symbols) > 1 and {r.symbol for r in rows} == symbols and len(rows) == len(symbols)
    assert given == [{}] * len(symbols)
    assert all(0 < r.rmse and 0 < r.mae <= r.rmse for r in rows)


def test_training_reads_written_rows(spark, sf_dir, monkeypatch):
    """Each tree reads its rows again: they are made from the events once."""
    read = []
    monkeypatch.setattr(mo, "fit_trees", lambda train, features, target: read.extend(train.inputFiles()))
    monkeypatch.setattr(mo, "predict", lambda fitted, df: read.extend(df.inputFiles()) or df.withColumn("y_pred", df.y * 0))
    assert len(trained_trees(spark, sf_dir).collect()) == 5
    assert read and not [f for f in read if f.endswith("events.parquet")]


def test_symbols_with_too_few_rows_have_no_model(spark, tmp_path):
    """Bars with a low of zero leave one complete row of symbol b, none of c; d has no name."""
    bars = {"a": 80, "b": 30, "c": 30, None: 60}
    events = [(n, datetime(2024, 1, 1) + timedelta(hours=h, minutes=n % 60), n % 7, s, 0.0 if s == "c" and h == 10 else 10.0 + (n * 37 % 100) / 10) for s, k in bars.items() for h in range(k) for n in range(5 * h, 5 * h + 5)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = {r.symbol: r for r in trained_trees(spark, str(tmp_path)).collect()}
    assert set(rows) == set(bars)
    assert all(rows[s].rmse > 0 for s in ("a", None))
    assert all(rows[s][1:] == (None,) * 4 for s in ("b", "c"))
