"""The stream over events whose files each span all times, as the tasks of a large table write them."""

from pyspark.sql import functions as F

from tests.test_zero_prices import same


def test_no_tick_is_late(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    same(spark, str(tmp_path), "stream_bars")
