"""Queries on events of which some have the value zero, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import ordered


@pytest.fixture(scope="module")
def zeros(spark, sf_dir, tmp_path_factory):
    """Bars whose low, open, close or whole is zero, also the first ones of a symbol."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = events.groupBy("event_type").agg(F.min("event_id").alias("event_id"))
    early = events.join(first.where("event_type < 'error'"), ["event_type", "event_id"], "left_semi").select("event_id")
    chosen = events.where("event_id % 97 = 5").select("event_id").union(early).distinct().withColumn("zero", F.lit(True))
    events.join(chosen, "event_id", "left").withColumn("value", F.when(F.col("zero"), 0.0).otherwise(F.col("value"))).drop("zero").write.parquet(f"{folder}/events.parquet")
    return folder


def same(spark, folder, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found, wanted = entry.queries()[name](spark, folder), con.sql(entry.oracle_sql()[name])
    columns = sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in columns]
    assert ordered([[r[c] for c in columns] for r in found.collect()]) == ordered([[r[i] for i in places] for r in wanted.fetchall()])


def test_inspection(spark, zeros):
    same(spark, zeros, "inspection")


def test_inspection_counts_what_is_no_price(spark):
    from barweave.operators.store import inspection

    rows = spark.createDataFrame([("2024-01-01 00:00:00", 2.0, 1.0, 1.5), ("2024-01-01 01:00:00", 1.0, 2.0, 1.5), ("2024-01-01 02:00:00", 1.0, -1.0, -1.0), ("2024-01-01 05:00:00", 0.0, 0.0, 0.0)], "ts string, high double, low double, close double")
    assert inspection(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect() == [(4, 0, 1, 2)]


def test_recursive_averages(spark, zeros):
    same(spark, zeros, "recursive_averages")


def test_recursive_scan(spark, zeros):
    same(spark, zeros, "recursive_scan")


def test_scalars(spark, zeros):
    same(spark, zeros, "scalars")


def test_technical(spark, zeros):
    same(spark, zeros, "technical")
