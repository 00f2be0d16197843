"""The query scalars against its SQL on values, numbers and letters that the events don't have."""

from datetime import datetime

import pytest

from tests.test_zero_prices import same

VALUES = [None, 0.0, -0.0, -1.0, -50.0, float("nan"), float("inf"), float("-inf"), 1e-300, 99.99999999]
NUMBERS = ["1.0", "1.5", "2.5", "-0.5", "1e3", "123e-1", "null", '" 7.5 "', '"1_000"', "9223372036854775807"]
TYPES = [None, "", "\ra", "\na", " a", "😀x", "straße", "ŉx", "ﬁx", "ᾳ", "1d", "1e5d", "0x1p3", "-nan", "+nan", "nan", "-inf", "1_000", "1__0", " .5e1 ", "\x003"]


@pytest.mark.parametrize("column, odd", [("value", VALUES), ("props", NUMBERS), ("event_type", TYPES)])
def test_odd_values(spark, tmp_path, column, odd):
    plain = {"ts": datetime(2024, 2, 29, 23, 59), "user_id": 1, "event_type": "view", "value": 2.5, "props": '{"k": 7}'}
    rows = [{"event_id": i} | plain | {column: f'{{"k": {x}}}' if column == "props" else x} for i, x in enumerate(odd)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    same(spark, str(tmp_path), "scalars")
