"""Staged window expressions over rows that are ordered by time within a symbol.

Spark does not nest window functions, so ``Panel`` names each window result as an intermediate column. Intermediate
columns that do not depend on one another are made by one projection, equal ones are made once, and all frames share
one partitioning and order: however many operators a query asks for, there is one exchange and one sort.

Missing values are NULL. ``least`` is the number of valid values that a frame needs; unless given, all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero or anything is missing."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def log(x: Column | str) -> Column:
    """Natural logarithm, NULL for what has none."""
    return F.when(col(x) > 0, F.ln(col(x)))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


class Panel:
    """A table with ``by`` (symbol) and ``ts``, and the window results that were asked for so far."""

    def __init__(self, df: DataFrame, by: tuple[str, ...] = ("symbol",), ts: str = "ts") -> None:
        self.df, self.by, self.ts = df, by, ts
        self._made: dict[str, str] = {}
        self._stages: list[dict[str, Column]] = []
        self._depth: dict[str, int] = {}

    # -- intermediate columns

    def let(self, expression: Column) -> Column:
        """The expression as an intermediate column that any window may read."""
        text = str(expression)
        if text not in self._made:
            name = f"_s{len(self._made)}_"
            depth = 1 + max((self._depth[t] for t in re.findall(r"_s\d+_", text)), default=-1)
            while len(self._stages) <= depth:
                self._stages.append({})
            self._stages[depth][name] = expression
            self._made[text], self._depth[name] = name, depth
        return F.col(self._made[text])

    def _order(self):
        return Window.partitionBy(*self.by).orderBy(self.ts)

    def over(self, aggregate: Column, first: int, last: int) -> Column:
        """A window result over rows ``first`` to ``last`` relative to the current one."""
        return self.let(aggregate.over(self._order().rowsBetween(first, last)))

    def rows(self, n: int) -> tuple[int, int]:
        return 1 - n, 0

    def _gated(self, x: Column, aggregate: Column, n: int, least: int | None, forward: bool = False) -> Column:
        x, (first, last) = self.ready(x), ((1, n) if forward else self.rows(n))
        return F.when(self.over(F.count(x), first, last) >= (n if least is None else least), self.over(aggregate, first, last))

    def ready(self, x: Column | str) -> Column:
        """A plain column for an expression, so that windows read it and its text stays short."""
        x = col(x)
        return x if re.fullmatch(r"Column<'\w+'>", str(x)) else self.let(x)

    # -- frames of the last n rows

    def count(self, x, n: int) -> Column:
        return self.over(F.count(self.ready(x)), *self.rows(n))

    def sum(self, x, n: int, least: int | None = None) -> Column:
        x = self.ready(x)
        return self._gated(x, F.sum(x), n, least)

    def mean(self, x, n: int, least: int | None = None) -> Column:
        x = self.ready(x)
        return self._gated(x, F.avg(x), n, least)

    def std(self, x, n: int, least: int | None = None) -> Column:
        x = self.ready(x)
        return self._gated(x, F.stddev_samp(x), n, max(2, n if least is None else least))

    def var(self, x, n: int, least: int | None = None) -> Column:
        x = self.ready(x)
        return self._gated(x, F.var_samp(x), n, max(2, n if least is None else least))

    def highest(self, x, n: int, least: int | None = None) -> Column:
        x = self.ready(x)
        return self._gated(x, F.max(x), n, least)

    def lowest(self, x, n: int, least: int | None = None) -> Column:
        x = self.ready(x)
        return self._gated(x, F.min(x), n, least)

    def quantile(self, x, n: int, q: float, least: int | None = None) -> Column:
        """Exact, between two values by the straight line."""
        x = self.ready(x)
        return self._gated(x, F.percentile(x, F.lit(q)), n, least)

    def median(self, x, n: int, least: int | None = None) -> Column:
        return self.quantile(x, n, 0.5, least)

    def skewness(self, x, n: int) -> Column:
        x = self.ready(x)
        return self._gated(x, F.skewness(x), n, None)

    def kurtosis(self, x, n: int) -> Column:
        x = self.ready(x)
        return self._gated(x, F.kurtosis(x), n, None)

    def _pair(self, x, y) -> tuple[Column, Column]:
        x, y = self.ready(x), self.ready(y)
        return self.let(F.when(y.isNotNull(), x)), self.let(F.when(x.isNotNull(), y))

    def cov(self, x, y, n: int, least: int | None = None) -> Column:
        x, y = self._pair(x, y)
        return self._gated(x, F.covar_samp(x, y), n, least)

    def corr(self, x, y, n: int, least: int | None = None) -> Column:
        """Pearson over rows where both are valid; NULL where either is constant."""
        x, y = self._pair(x, y)
        spread = self.over(F.stddev_samp(x), *self.rows(n)) * self.over(F.stddev_samp(y), *self.rows(n))
        return ratio(self._gated(x, F.covar_samp(x, y), n, max(2, n if least is None else least)), spread)

    def slope(self, y, x, n: int, least: int | None = None) -> Column:
        """Least-squares slope of y on x."""
        x, y = self._pair(x, y)
        return self._gated(x, F.regr_slope(y, x), n, max(2, n if least is None else least))

    def zscore(self, x, n: int, least: int | None = None) -> Column:
        x = self.ready(x)
        return ratio(x - self.mean(x, n, least), self.std(x, n, least))

    def window(self, x, n: int) -> Column:
        """Array of the last n values, oldest first; NULL unless all n are there and valid."""
        x = self.ready(x)
        return self._gated(x, F.collect_list(x), n, None)

    # -- other rows

    def lag(self, x, k: int = 1) -> Column:
        return self.let(F.lag(self.ready(x), k).over(self._order())) if k else self.ready(x)

    def lead(self, x, k: int = 1) -> Column:
        return self.let(F.lead(self.ready(x), k).over(self._order()))

    def diff(self, x, k: int = 1) -> Column:
        x = self.ready(x)
        return x - self.lag(x, k)

    def change(self, x, k: int = 1) -> Column:
        """x over its value k rows ago, less one."""
        x = self.ready(x)
        return ratio(x, self.lag(x, k)) - 1

    def log_return(self, x="close", k: int = 1) -> Column:
        x = self.ready(x)
        return log(ratio(x, self.lag(x, k)))

    def carried(self, x) -> Column:
        """The last valid value up to here."""
        return self.let(F.last_value(self.ready(x), ignoreNulls=F.lit(True)).over(self._order().rowsBetween(Window.unboundedPreceding, 0)))

    def running_sum(self, x) -> Column:
        return self.let(F.sum(self.ready(x)).over(self._order().rowsBetween(Window.unboundedPreceding, 0)))

    def row_number(self) -> Column:
        return self.let(F.row_number().over(self._order()))

    # -- frames of the next n rows

    def next_high(self, x, n: int, partial: bool = False) -> Column:
        x = self.ready(x)
        best = self.over(F.max(x), 1, n)
        return best if partial else F.when(self.lead(F.lit(1), n).isNotNull(), best)

    def next_low(self, x, n: int, partial: bool = False) -> Column:
        x = self.ready(x)
        best = self.over(F.min(x), 1, n)
        return best if partial else F.when(self.lead(F.lit(1), n).isNotNull(), best)

    def next_mean(self, x, n: int) -> Column:
        x = self.ready(x)
        return self._gated(x, F.avg(x), n, None, forward=True)

    def next_sum(self, x, n: int) -> Column:
        x = self.ready(x)
        return self._gated(x, F.sum(x), n, None, forward=True)

    def next_rows(self, x: Column, n: int) -> Column:
        """Array of the next n rows' values (structs keep their places); shorter at the end."""
        return self.over(F.collect_list(self.let(x)), 1, n)

    # -- result

    def staged(self) -> DataFrame:
        df = self.df
        for stage in self._stages:
            df = df.withColumns(stage)
        return df

    def select(self, **columns: Column | str) -> DataFrame:
        """The keys, then the named columns."""
        return self.staged().select(*self.by, self.ts, *(col(c).alias(name) for name, c in columns.items()))

    def with_columns(self, **columns: Column | str) -> DataFrame:
        """The table with the named columns added or replaced."""
        kept = [c for c in self.df.columns if c not in columns]
        return self.staged().select(*kept, *(col(c).alias(name) for name, c in columns.items()))


def in_chunks(df: DataFrame, ahead: int, every: int, by: tuple[str, ...] = ("symbol",), ts: str = "ts", behind: int = 0) -> DataFrame:
    """``df`` cut into chunks for frames of bounded length: a long symbol is then many independent tasks.

    ``every`` rows of a symbol are a chunk; a chunk also gets the ``ahead`` rows before and the ``behind`` rows after
    it, marked by ``_halo``. Windows partition by (symbol, ``_chunk``); drop the halo afterwards. Rows are numbered
    without one task per symbol: counts by day give each day its first number.
    """
    day = F.to_date(ts)
    days = df.groupBy(*by, day.alias("_day")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    in_day = Window.partitionBy(*by, "_day").orderBy(ts)
    numbered = df.withColumn("_day", day).join(offsets, [*by, "_day"]).withColumn("_row", F.col("_first") + F.row_number().over(in_day) - 1).drop("_first", "_day")
    own = F.floor(F.col("_row") / every)
    first, last = F.floor((F.col("_row") - behind) / every), F.floor((F.col("_row") + ahead) / every)
    dealt = numbered.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return dealt.withColumn("_halo", F.col("_chunk") != own).drop("_row")
