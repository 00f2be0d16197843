"""Features that follow late and corrected bars: only the rows that depend on a change are computed again.

A row's features depend on itself and the ``back`` rows before it (the longest frame less one; for an average over the
whole history the rows until its weight has died out, ``reach``). So a changed bar changes the ``back`` rows after it
too, and these are computed from ``back`` more rows before it. Counts of bars by symbol and day say on which days those
rows lie; whole days are read and written. Changed days whose rows meet are one stretch, and a stretch is computed as a
series of its own, so that ten changed hours cost ten short series however long the symbol is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Stretches up to this many are broadcast (some 100 bytes each); beyond it they meet the bars by symbol and day.
BROADCAST = 100_000


def reach(alpha: float, least: float = 1e-15) -> int:
    """Rows after which a value has less than this weight in an exponential average."""
    return 0 if alpha >= 1 else math.ceil(math.log(least) / math.log1p(-alpha))


def day_counts(bars: DataFrame) -> DataFrame:
    """(symbol, day, n): what ``stretches`` needs of a table of bars; reads the symbol and the time alone."""
    return bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def stretches(days: DataFrame, changed: DataFrame, back: int) -> DataFrame:
    """(symbol, stretch, read_from, write_from, until): days, all inclusive, of the rows that follow the changed (symbol, ts).

    ``days`` counts the bars with the changes in; a changed time without a bar (a deleted one) counts as well.
    """
    hit = changed.select("symbol", F.to_date("ts").alias("day")).distinct()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")  # a row for each day
        day, n = rows["day"].to_numpy("datetime64[D]"), rows["n"].fillna(0).to_numpy(np.int64)
        upto = np.cumsum(n)
        at = np.flatnonzero(rows["hit"].fillna(False).to_numpy(bool))
        first, last = upto[at] - n[at], upto[at] - 1 + back  # places of the first and the last row that a day changes
        begin = np.searchsorted(upto, np.maximum(first - back, 0), side="right")
        end = np.minimum(np.searchsorted(upto, last, side="right"), len(day) - 1)
        begin = np.minimum(begin, at)
        found: list[list[int]] = []
        for b, w, e in zip(begin.tolist(), at.tolist(), np.maximum(end, at).tolist()):
            if found and b <= found[-1][2]:
                found[-1][2] = max(found[-1][2], e)
            else:
                found.append([b, w, e])
        names = ["read_from", "write_from", "until"]
        out = pd.DataFrame([[day[i] for i in f] for f in found], columns=names)
        return out.assign(symbol=rows["symbol"].iloc[0], stretch=range(len(found)))[["symbol", "stretch", *names]]

    both = days.join(hit.withColumn("hit", F.lit(True)), ["symbol", "day"], "full_outer").where("symbol IS NOT NULL")
    kind = dict(days.dtypes)["symbol"]
    return both.groupBy("symbol").applyInPandas(run, f"symbol {kind}, stretch int, read_from date, write_from date, until date")


def rows_to_read(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """The bars of the stretches, with ``stretch`` and whether their features are to be written (``_write``)."""
    ends = ranges.agg(F.min("read_from"), F.max("until"), F.count("*")).first()
    if not ends[2]:
        return bars.limit(0).withColumns({"stretch": F.lit(0), "_write": F.lit(False)})
    kind = bars.schema["ts"].dataType
    # plain limits of time reach the scan
    near = bars.where((F.col("ts") >= F.lit(str(ends[0])).cast(kind)) & (F.col("ts") < F.date_add(F.lit(str(ends[1])).cast("date"), 1).cast(kind))).withColumn("_day", F.to_date("ts"))
    if ends[2] <= BROADCAST:
        met = near.join(F.broadcast(ranges), ["symbol"]).where(F.col("_day").between(F.col("read_from"), F.col("until")))
    else:
        met = near.join(ranges.withColumn("_day", F.explode(F.sequence("read_from", "until"))), ["symbol", "_day"])
    return met.withColumn("_write", F.col("_day") >= F.col("write_from")).select(*bars.columns, "stretch", "_write")


def refreshed(features: DataFrame, bars: DataFrame, changed: DataFrame, compute: Callable[[DataFrame, tuple[str, ...]], DataFrame], back: int, days: DataFrame | None = None) -> DataFrame:
    """``features`` (by symbol and ts) after the ``changed`` (symbol, ts) of ``bars``, as a whole rebuild would give them.

    ``compute`` gives the features of bars for series by the named columns; ``days`` are the bars' ``day_counts`` where a
    table of them is kept. Rows of deleted bars go.
    """
    ranges = stretches(day_counts(bars) if days is None else days, changed, back)
    read = rows_to_read(bars, ranges)
    written = read.where("_write").select("symbol", "ts")
    made = compute(read.drop("_write"), ("symbol", "stretch")).join(written, ["symbol", "ts"], "left_semi").select(*features.columns)
    spans = ranges.select("symbol", F.explode(F.sequence("write_from", "until")).alias("_day"))
    kept = features.withColumn("_day", F.to_date("ts")).join(spans, ["symbol", "_day"], "left_anti").select(*features.columns)
    return kept.unionByName(made)
