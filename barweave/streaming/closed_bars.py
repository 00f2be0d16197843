"""Structured Streaming: closed bars from ticks, idempotent append, and averages whose state lives with the stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import absent, overlap_faults


def closed_bars(ticks: DataFrame, every: str = "1 hour", late: str = "1 hour", symbol: str = "symbol", price: str = "price", order: str = "event_id") -> DataFrame:
    """Bars that no tick can change any more: the watermark has passed their end. ``ts`` is a TIMESTAMP."""
    place = F.struct("ts", order)
    bars = ticks.withWatermark("ts", late).groupBy(F.col(symbol).alias("symbol"), F.window("ts", every).alias("w"))
    return bars.agg(
        F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.count("*").cast("double").alias("volume")
    ).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def append_stream(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "ts"), faults_path: str | None = None) -> StreamingQuery:
    """Appends each batch's rows whose key the table at ``path`` lacks, so that a repeated batch changes nothing.

    Rows that come again with other prices are written to ``faults_path``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        table = spark.read.schema(batch.schema).parquet(path) if there else spark.createDataFrame([], batch.schema)
        if faults_path:
            faults = overlap_faults(batch, table, ["open", "high", "low", "close"], list(keys))
            faults.withColumn("batch", F.lit(number)).write.mode("append").parquet(faults_path)
        absent(batch, table, list(keys)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ewm_stream(bars: DataFrame, alpha: float, column: str = "close", out: str = "ewm") -> DataFrame:
    """Exponential average for each symbol; the state is the average and the weight it has left.

    Rows of a batch are taken in time order; a stream that hands bars in late gives them their turn when they come.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, weight = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        found = []
        for x in rows[column]:
            weight *= 1 - alpha
            if not pd.isna(x):
                average = float(x) if average is None else (weight * average + alpha * x) / (weight + alpha)
                weight = 1.0
            found.append(average)
        state.update((average, weight))
        yield rows[["symbol", "ts", column]].assign(**{out: pd.Series(found, index=rows.index, dtype=float)})

    return bars.select("symbol", "ts", column).groupBy("symbol").applyInPandasWithState(step, f"symbol string, ts timestamp_ntz, {column} double, {out} double", "average double, weight double", "append", GroupStateTimeout.NoTimeout)


def sliding_counts(ticks: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and mean prices of sliding windows."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size, slide)).agg(F.count("*").alias("n"), F.avg("price").alias("mean_price")).select("symbol", F.col("window.start").alias("start"), "n", "mean_price")


def session_counts(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of ticks that are no more than the gap apart."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def ticks_from_files(spark: SparkSession, path: str, schema, per_trigger: int | None = 1) -> DataFrame:
    """A stream over the files of a folder of ticks.

    Files come by their times of writing. Where that isn't the order of their ticks, the watermark of one file makes the
    ticks of the next late, and they are lost: then all files are to come at once (``per_trigger`` None).
    """
    reader = spark.readStream.schema(schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(path)
