"""Frames of the last n rows in one pass: ``Sliding`` is a ``Panel`` whose frame results are computed incrementally.

Spark aggregates a bounded frame again for every row; here a row costs the same whatever the frame. Rows are dealt by
symbol and sorted once; each stage then is a projection and a pass in Arrow batches that computes all frames that the
stage asks for, and keeps of a symbol the last rows that its longest frame needs. Any number of stages is one shuffle.

Sums and moments come from blocks as long as the frame: a frame is the end of one block and the start of the next, and
the running sums of both (about each block's own centre) are put together, so that nothing is ever subtracted. Where
that leaves a spread that is tiny against the blocks' own, and for third and fourth moments, frames are summed one by
one. Extremes run through the same blocks. Quantiles keep the frame's values sorted, with a binary search for what comes
and what goes. Results are those of ``Panel`` but for rounding; frames of equal values have a spread of exactly zero.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..frames import Panel, col, ratio

#: Numbers that are looked at together where frames are summed one by one.
AT_ONCE = 4_000_000
#: Frames up to this long are summed from their oldest row on, so that what cancels in a window cancels here too.
SHORT = 1024
#: Share of the blocks' squares below which a spread is summed again.
TINY = 1e-6


@dataclass(frozen=True)
class Request:
    """A result over the last ``n`` rows (or, for ``lag``, n rows ago) of one or two columns; NULL below ``least`` valid values."""

    kind: str
    x: str
    n: int
    least: int = 0
    y: str = ""
    q: float = 0.0


class Frames:
    """All frames of the last n values of a series; shorter at its start."""

    def __init__(self, x: np.ndarray, n: int) -> None:
        self.n, self.size = n, len(x)
        rows = -(-(len(x) + n - 1) // n)
        padded = np.full(rows * n, np.nan)
        padded[n - 1 : n - 1 + len(x)] = x
        self.padded, self.blocks = padded, padded.reshape(rows, n)
        self.valid = ~np.isnan(self.blocks)
        self.whole = np.arange(len(x)) % n == 0  # the frame is a block

    def _ends(self, running: np.ndarray) -> np.ndarray:
        return running.ravel()[self.n - 1 : self.n - 1 + self.size]

    def add(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the part of each frame in the earlier and in the later block."""
        later = self._ends(np.cumsum(values, axis=1))
        backward = np.cumsum(values[:, ::-1], axis=1)[:, ::-1]
        earlier = np.where(self.whole, 0, backward.ravel()[: self.size])
        return earlier, later

    def count(self) -> np.ndarray:
        a, b = self.add(self.valid.astype(np.int64))
        return a + b

    def sum(self) -> np.ndarray:
        if self.n <= SHORT:
            values, total = np.where(np.isnan(self.padded), 0.0, self.padded), np.zeros(self.size)
            for k in range(self.n):
                total += values[k : k + self.size]
            return total
        a, b = self.add(np.where(self.valid, self.blocks, 0.0))
        return a + b

    def extreme(self, up: bool) -> np.ndarray:
        pick, none = (np.maximum, -np.inf) if up else (np.minimum, np.inf)
        values = np.where(self.valid, self.blocks, none)
        later = self._ends(pick.accumulate(values, axis=1))
        earlier = pick.accumulate(values[:, ::-1], axis=1)[:, ::-1].ravel()[: self.size]
        found = np.where(self.whole, later, pick(earlier, later))
        return np.where(np.isinf(found), np.nan, found)

    def each(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their frames) in parts."""
        view = np.lib.stride_tricks.sliding_window_view(self.padded, self.n)
        step = max(1, AT_ONCE // self.n)
        for at in range(0, len(rows), step):
            yield rows[at : at + step], view[rows[at : at + step]]

    def centres(self) -> np.ndarray:
        n = self.valid.sum(axis=1)
        return np.where(n > 0, np.where(self.valid, self.blocks, 0.0).sum(axis=1) / np.maximum(n, 1), 0.0)[:, None]


def products(a: Frames, b: Frames) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum of products of the deviations from both means) of two series that are valid in the same rows."""
    gone = ~a.valid
    x, y = a.blocks - a.centres(), b.blocks - b.centres()
    x[gone], y[gone] = 0.0, 0.0
    n1, n2 = a.add(a.valid.astype(np.int64))
    (x1, x2), (y1, y2), (p1, p2), (sx1, sx2), (sy1, sy2) = a.add(x), a.add(y), a.add(x * y), a.add(x * x), a.add(y * y)
    centre_x, centre_y = np.broadcast_to(a.centres(), a.blocks.shape), np.broadcast_to(b.centres(), b.blocks.shape)
    apart = lambda centre, s1, s2: (a._ends(centre) - centre.ravel()[: a.size]) + (s2 / np.maximum(n2, 1) - s1 / np.maximum(n1, 1))
    both = n1 * n2 / np.maximum(n1 + n2, 1)
    total = p1 - x1 * y1 / np.maximum(n1, 1) + p2 - x2 * y2 / np.maximum(n2, 1) + np.where(both > 0, both * apart(centre_x, x1, x2) * apart(centre_y, y1, y2), 0.0)
    lost = np.flatnonzero((np.abs(total) <= TINY * np.sqrt((sx1 + sx2) * (sy1 + sy2))) & (n1 + n2 > 1))
    for (rows, left), (_, right) in zip(a.each(lost), b.each(lost)):
        centred = [v - np.nanmean(v, axis=1, keepdims=True) for v in (left, right)]
        total[rows] = np.nansum(centred[0] * centred[1], axis=1)
    for frames in (a, b):  # equal values have no spread
        total = np.where(frames.extreme(True) == frames.extreme(False), 0.0, total)
    return n1 + n2, total


def moments(frames: Frames, power: int) -> np.ndarray:
    """The skewness (3) or the excess kurtosis (4) of frames without missing values."""
    found = np.full(frames.size, np.nan)
    for rows, values in frames.each(np.flatnonzero(frames.count() == frames.n)):
        centred = values - values.mean(axis=1, keepdims=True)
        second = (centred**2).sum(axis=1)
        second = np.where(values.max(axis=1) == values.min(axis=1), 0.0, second)
        with np.errstate(all="ignore"):
            top = (centred**power).sum(axis=1)
            found[rows] = np.sqrt(frames.n) * top / second**1.5 if power == 3 else frames.n * top / second**2 - 3
    return np.where(np.isfinite(found), found, np.nan)


def quantiles(x: np.ndarray, n: int, shares: list[float]) -> list[np.ndarray]:
    """Exact quantiles of the last n values, between two values by the straight line."""
    found = [np.full(len(x), np.nan) for _ in shares]
    held: list[float] = []
    values = x.tolist()
    for i, value in enumerate(values):
        if value == value:
            insort(held, value)
        if i >= n and (old := values[i - n]) == old:
            del held[bisect_left(held, old)]
        if held:
            for out, q in zip(found, shares):
                place = (len(held) - 1) * q
                low = int(place)
                out[i] = held[low] if low == place else (low + 1 - place) * held[low] + (place - low) * held[low + 1]
    return found


def compute(requests: list[Request], series: dict[str, np.ndarray]) -> dict[Request, np.ndarray]:
    """Every result (but lags) over whole series."""
    found: dict[Request, np.ndarray] = {}
    frames: dict[tuple[str, int], Frames] = {}
    spreads: dict[tuple[str, str, int], tuple[np.ndarray, np.ndarray]] = {}

    def of(x: str, n: int) -> Frames:
        if (x, n) not in frames:
            frames[x, n] = Frames(series[x], n)
        return frames[x, n]

    def spread(x: str, y: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        if (x, y, n) not in spreads:
            spreads[x, y, n] = products(of(x, n), of(y, n))
        return spreads[x, y, n]

    shares: dict[tuple[str, int], list[float]] = {}
    for r in requests:
        if r.kind == "quantile":
            shares.setdefault((r.x, r.n), []).append(r.q)
    sorted_ = {(x, n, q): v for (x, n), qs in shares.items() for q, v in zip(qs, quantiles(series[x], n, qs))}
    with np.errstate(all="ignore"):
        for r in requests:
            held = of(r.x, r.n)
            n = held.count()
            if r.kind == "count":
                found[r] = n.astype(float)
                continue
            if r.kind == "sum":
                value = held.sum()
            elif r.kind == "mean":
                value = held.sum() / n
            elif r.kind in ("highest", "lowest"):
                value = held.extreme(r.kind == "highest")
            elif r.kind == "quantile":
                value = sorted_[r.x, r.n, r.q]
            elif r.kind in ("skewness", "kurtosis"):
                value = moments(held, 3 if r.kind == "skewness" else 4)
            elif r.kind in ("var", "std"):
                value = spread(r.x, r.x, r.n)[1] / (n - 1)
                value = np.sqrt(value) if r.kind == "std" else value
            elif r.kind == "cov":
                value = spread(r.x, r.y, r.n)[1] / (n - 1)
            else:  # slope of x on y
                value = spread(r.x, r.y, r.n)[1] / spread(r.y, r.y, r.n)[1]
            found[r] = np.where((n >= r.least) & np.isfinite(value), value, np.nan)
    return found


class Sliding(Panel):
    """A ``Panel`` that computes frames of the last rows and lags by ``compute``; other windows stay with Spark."""

    def __init__(self, df: DataFrame, by: tuple[str, ...] = ("symbol",), ts: str = "ts") -> None:
        super().__init__(df, by, ts)
        self._asked: dict[int, dict[str, Request]] = {}

    def _ask(self, kind: str, n: int, x: Column, least: int = 0, y: Column | None = None, q: float = 0.0) -> Column:
        name = lambda c: "" if c is None else str(c)[len("Column<'") : -len("'>")]
        request = Request(kind, name(x), n, least, name(y), q)
        if (text := str(request)) not in self._made:
            out = f"_s{len(self._made)}_"
            depth = 1 + max(self._depth.get(c, -1) for c in (request.x, request.y))
            while len(self._stages) <= depth:
                self._stages.append({})
            self._asked.setdefault(depth, {})[out] = request
            self._made[text], self._depth[out] = out, depth
        return F.col(self._made[text])

    def count(self, x, n: int) -> Column:
        return self._ask("count", n, self.ready(x))

    def _last(self, kind: str, x, n: int, least: int | None, at_least: int = 1, **more) -> Column:
        return self._ask(kind, n, self.ready(x), max(at_least, n if least is None else least), **more)

    def sum(self, x, n: int, least: int | None = None) -> Column:
        return self._last("sum", x, n, least)

    def mean(self, x, n: int, least: int | None = None) -> Column:
        return self._last("mean", x, n, least)

    def std(self, x, n: int, least: int | None = None) -> Column:
        return self._last("std", x, n, least, 2)

    def var(self, x, n: int, least: int | None = None) -> Column:
        return self._last("var", x, n, least, 2)

    def highest(self, x, n: int, least: int | None = None) -> Column:
        return self._last("highest", x, n, least)

    def lowest(self, x, n: int, least: int | None = None) -> Column:
        return self._last("lowest", x, n, least)

    def quantile(self, x, n: int, q: float, least: int | None = None) -> Column:
        return self._last("quantile", x, n, least, q=q)

    def skewness(self, x, n: int) -> Column:
        return self._last("skewness", x, n, None)

    def kurtosis(self, x, n: int) -> Column:
        return self._last("kurtosis", x, n, None)

    def cov(self, x, y, n: int, least: int | None = None) -> Column:
        x, y = self._pair(x, y)
        return self._last("cov", x, n, least, 2, y=y)

    def corr(self, x, y, n: int, least: int | None = None) -> Column:
        x, y = self._pair(x, y)
        spread = self._last("std", x, n, 2) * self._last("std", y, n, 2)
        return ratio(self._last("cov", x, n, least, 2, y=y), spread)

    def slope(self, y, x, n: int, least: int | None = None) -> Column:
        x, y = self._pair(x, y)
        return self._last("slope", y, n, least, 2, y=x)

    def lag(self, x, k: int = 1) -> Column:
        return self._ask("lag", k, self.ready(x)) if k > 0 else super().lag(x, k)

    def _keeps_order(self, stage: dict[str, Column]) -> bool:
        """Whether all of Spark's windows in a stage run by symbol and time."""
        usual = f"OVER (PARTITION BY {', '.join(self.by)} ORDER BY {self.ts} ASC NULLS FIRST"
        return all(text.count("OVER (") == text.count(usual) for text in map(str, stage.values()))

    def staged(self) -> DataFrame:
        df, in_order = self.df, False
        for depth, stage in enumerate(self._stages):
            if stage:
                df = df.withColumns(stage)
                in_order &= self._keeps_order(stage)
            if asked := self._asked.get(depth):
                if not in_order:
                    df = df.repartition(*self.by).sortWithinPartitions(*self.by, self.ts)
                df, in_order = _passed(df, list(self.by), asked), True
        return df


def _passed(df: DataFrame, by: list[str], asked: dict[str, Request]) -> DataFrame:
    """``df``, whose partitions have each symbol's rows together and in order, with the results as columns."""
    plain = {out: r for out, r in asked.items() if r.kind != "lag"}
    inputs = sorted({c for r in plain.values() for c in (r.x, r.y) if c})
    ahead = max([r.n - 1 for r in plain.values()], default=0)
    lags = {out: r for out, r in asked.items() if r.kind == "lag"}
    types = [df.schema[r.x].dataType if r.kind == "lag" else DoubleType() for r in asked.values()]
    schema = StructType([*df.schema.fields, *(StructField(out, kind) for out, kind in zip(asked, types))])

    def stretches(batch: pa.RecordBatch) -> list[int]:
        changed = np.zeros(batch.num_rows, bool)
        for c in by:
            codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changed[1:] |= codes[1:] != codes[:-1]
        return [0, *np.flatnonzero(changed).tolist(), batch.num_rows]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, before, rows_ago = None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = stretches(batch)
            parts: dict[str, list] = {out: [] for out in asked}
            for at, to in zip(edges, edges[1:]):
                part = batch.slice(at, to - at)
                now = [part.column(c)[0].as_py() for c in by]
                if symbol is None or now != symbol:
                    symbol, before, rows_ago = now, {}, {}
                series = {}
                for c in inputs:
                    new = part.column(c).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                    series[c] = np.concatenate([before[c], new]) if c in before else new
                found = compute(list(plain.values()), series) if plain else {}
                for out, r in plain.items():
                    values = found[r][-part.num_rows :]
                    parts[out].append(pa.array(values, mask=np.isnan(values)))
                before = {c: x[len(x) - min(ahead, len(x)) :] for c, x in series.items()}
                for out, r in lags.items():
                    new = part.column(r.x)
                    old = rows_ago.get(out, pa.nulls(r.n, new.type))
                    whole = pa.concat_arrays([old, new])
                    parts[out].append(whole.slice(0, len(new)))
                    rows_ago[out] = whole.slice(len(new))
            columns = [pa.concat_arrays(parts[out]) for out in asked]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *asked])

    return df.mapInArrow(run, schema)
