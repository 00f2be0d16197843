"""Joins of time tables by equal keys, with the checks and column rules that training tables need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def assert_unique(df: DataFrame, keys: list[str], name: str = "the table") -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{name} has repeated keys {keys}")
    return df


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", suffix: str = "_b") -> DataFrame:
    """A join of tables whose keys are unique; columns of ``b`` that ``a`` has get the suffix."""
    assert_unique(a, keys, "the left table"), assert_unique(b, keys, "the right table")
    return a.join(suffixed(b, keys, [c for c in a.columns if c not in keys], suffix), keys, how)


def suffixed(df: DataFrame, keys: list[str], clash: list[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in clash and c not in keys})


def join_all(frames: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, how), frames)


def join_merged(frames: list[DataFrame], keys: list[str], tolerance: float = 1e-9, how: str = "inner") -> DataFrame:
    """Several tables; a column that is there again goes if it is equal throughout, else it stays as ``name__dup1``, ..."""
    whole = frames[0]
    for i, frame in enumerate(frames[1:], 1):
        again = [c for c in frame.columns if c in whole.columns and c not in keys]
        whole = whole.join(frame.withColumnsRenamed({c: f"{c}__dup{i}" for c in again}), keys, how)
        if again:
            same = whole.agg(*(F.bool_and(_equal(F.col(c), F.col(f"{c}__dup{i}"), tolerance)).alias(c) for c in again)).first()
            whole = whole.drop(*(f"{c}__dup{i}" for c in again if same[c] in (True, None)))
    return whole


def _equal(a: Column, b: Column, tolerance: float) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= tolerance, F.lit(False))


def reindexed(base: DataFrame, frame: DataFrame, keys: list[str], required: bool = False) -> DataFrame:
    """The frame on the base's keys; a required frame must have them all."""
    base = base.select(*keys).distinct()
    if required and base.join(frame, keys, "left_anti").limit(1).count():
        raise ValueError("the frame lacks keys of the base")
    return base.join(frame, keys, "left")


def lookup_later(df: DataFrame, values: DataFrame, minutes: Column, columns: dict[str, str], ts: str = "ts", keys: list[str] = ()) -> DataFrame:
    """``df`` with values at a time some minutes later (settlement, next price); of repeated times the last counts."""
    later = values.select(*keys, F.col(ts).alias("_later"), *(F.col(a).alias(b) for a, b in columns.items()))
    moved = df.withColumn("_later", (F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).cast("timestamp_ntz"))
    return moved.join(later, [*keys, "_later"], "left").drop("_later")


def on_hour(a: DataFrame, b: DataFrame, how: str = "inner", ts: str = "ts") -> DataFrame:
    """A join on both times cut to the hour."""
    cut = lambda df: df.withColumn("hour", F.date_trunc("hour", ts).cast("timestamp_ntz"))
    return cut(a).join(cut(b).withColumnRenamed(ts, f"{ts}_b"), "hour", how)


def by_place(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows side by side in the order of each table (a number or a time without repeats)."""
    return _placed(a, order_a).join(_placed(b, order_b), "_place").drop("_place")


def _placed(df: DataFrame, order: str, pieces: int = 200) -> DataFrame:
    """``df`` with ``_place``: counts of the pieces between fixed split points, and numbers within a piece."""
    splits = df.agg(F.percentile_approx(order, F.array(*(F.lit(i / pieces) for i in range(1, pieces))), F.lit(1000)).alias("s")).first().s or []
    piece = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col(order))) if splits else F.lit(0)
    marked = df.withColumn("_piece", piece)
    counts = marked.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece
    offsets = counts.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    in_piece = Window.partitionBy("_piece").orderBy(order)
    return marked.join(offsets, "_piece").withColumn("_place", F.col("_first") + F.row_number().over(in_piece)).drop("_piece", "_first")


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, step: int) -> DataFrame:
    """Points (numbers) inside [start, end): both sides meet in buckets ``step`` wide, then the exact bounds hold."""
    buckets = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor(F.col(end) / step))))
    return points.withColumn("_bucket", F.floor(F.col(at) / step)).join(buckets, "_bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")
