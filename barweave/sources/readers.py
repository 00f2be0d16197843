"""Readers that give tables with UTC times without a zone, lower-case names and NULL for what is missing."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The fields of a raw bar file, in order.
KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades",
    "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume", "ignore",
]
TIME_NAMES = ["timestamp", "ts", "datetime", "datetime_utc", "date", "time", "open_time", "index", "unnamed: 0"]


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def time_column(columns: list[str]) -> str:
    """The column that holds the time: by name, else the first."""
    by_name = {c.lower(): c for c in columns}
    return next((by_name[n] for n in TIME_NAMES if n in by_name), columns[0])


def utc(x: Column, kind: str) -> Column:
    """A time without a zone from a time, a text or milliseconds."""
    if kind in ("bigint", "int", "double"):
        return F.timestamp_millis(x.cast("long")).cast("timestamp_ntz")
    return F.to_timestamp_ntz(x) if kind == "string" else x.cast("timestamp_ntz")


def normalized(df: DataFrame, numbers: list[str] | None = None, keep: str = "last", position: str | None = None) -> DataFrame:
    """``ts`` from the time column, numbers as doubles (what is none becomes NULL, also NaN), one row for each time.

    Of repeated times the last (or first) by ``position`` counts, a column with the input's order.
    """
    df = lower_names(df)
    name = time_column(df.columns)
    df = df.withColumn("ts", utc(F.col(f"`{name}`"), dict(df.dtypes)[name]))
    df = df.drop(name) if name != "ts" else df
    numbers = numbers if numbers is not None else [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    df = df.withColumns({c: F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None).cast("double")) for c in numbers})
    if position is None:
        return df.where(F.col("ts").isNotNull())
    best = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c != "ts"]
    picked = df.where(F.col("ts").isNotNull()).groupBy("ts").agg(best(F.struct(*rest), position).alias("_row"))
    return picked.select("ts", "_row.*").drop(position)


def read_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None, schema=None, position: str | None = None) -> DataFrame:
    """A Parquet or CSV table by its ending, between two times (both in), with the wanted columns."""
    if path.rstrip("/").endswith(".csv") or path.endswith(".csv.gz"):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    else:
        df = spark.read.parquet(path)
    df = normalized(df, position=position)
    if start is not None:
        df = df.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        df = df.where(F.col("ts") <= F.to_timestamp_ntz(F.lit(end)))
    return df.select("ts", *columns) if columns else df


def read_kline_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Raw bar files with or without a header line, all twelve fields as text."""
    df = spark.read.option("encoding", encoding).schema(", ".join(f"{c} string" for c in KLINE_FIELDS)).csv(path)
    return df.where(~is_header(F.col("open_time")))


def is_header(first: Column) -> Column:
    """Whether a row's first field is a name: it begins with a letter. Broken rows of data are no headers and stay."""
    return F.coalesce(first.rlike(r"^\s*[A-Za-z_]"), F.lit(False))


def read_csv_any_encoding(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """UTF-8, or Latin-1 where the file's bytes are no UTF-8."""
    broken = spark.read.text(path).where(F.col("value").contains("�")).limit(1).count() > 0
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1" if broken else "UTF-8")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_zip_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first CSV of every archive as lines' fields; header lines are left out. An archive is read by one task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    inner = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
                    if inner is None:
                        continue
                    with archive.open(inner) as lines:
                        for rows in pd.read_csv(lines, header=None, names=KLINE_FIELDS, dtype=str, chunksize=50_000):
                            rows = rows[~rows.open_time.map(lambda x: isinstance(x, str) and bool(re.match(r"\s*[A-Za-z_]", x)))]
                            yield rows.assign(file=name)

    schema = ", ".join(f"{c} string" for c in KLINE_FIELDS) + ", file string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_price_history(spark: SparkSession, path: str) -> DataFrame:
    """(market, market_ts, t, p, pos) from a JSON object of markets with their price points."""
    shape = "map<string, struct<market_timestamp: bigint, price_history: array<struct<t: bigint, p: double>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("m"))
    markets = whole.select(F.explode("m").alias("market", "data"))
    return markets.select("market", F.col("data.market_timestamp").alias("market_ts"), F.posexplode("data.price_history").alias("pos", "point")).select("market", "market_ts", "point.t", "point.p", "pos")


def write_table(df: DataFrame, path: str) -> None:
    """CSV or Parquet by the ending; never over a table that is there."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)


def synthetic_bars(spark: SparkSession, n: int, seed: int = 0, symbol: str = "S") -> DataFrame:
    """A random walk of hourly bars from 2024-01-01, the same for a seed however it is partitioned."""
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0 - 0.5
    from pyspark.sql import Window

    steps = spark.range(n).select("id", F.floor(F.col("id") / 4096).alias("piece"), noise(1).alias("step"), F.abs(noise(2)).alias("up"), F.abs(noise(3)).alias("down"), (1000 + 100 * noise(4)).alias("volume"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    starts = steps.groupBy("piece").agg(F.sum("step").alias("moved")).select("piece", F.coalesce(F.sum("moved").over(before), F.lit(0.0)).alias("start"))
    close = 100 + F.col("start") + F.sum("step").over(Window.partitionBy("piece").orderBy("id"))
    walk = steps.join(starts, "piece").withColumn("close", close).withColumn("open", F.col("close") - F.col("step"))
    return walk.select(
        F.lit(symbol).alias("symbol"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), "open",
        (F.greatest("open", "close") + F.col("up")).alias("high"), (F.least("open", "close") - F.col("down")).alias("low"), "close", "volume",
    )
