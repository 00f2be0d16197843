"""Evaluation of features and predictions against targets, by aggregation.

Unless said otherwise an operator takes one table and gives a table with one row for each group (``by``), so that many
features, periods or symbols are evaluated in one job. Ranks average ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..frames import Panel, col, ratio


def average_rank(x: Column | str, by: list[str]) -> Column:
    """Rank of x with ties at their mean; missing values have none."""
    x = col(x)
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = Window.partitionBy(*by, x)
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def with_average_rank(df: DataFrame, x: str, by: list[str], name: str, pieces: int = 200, few: int = 500_000, heavy: float = 1e-3) -> DataFrame:
    """``df`` with ``average_rank`` as a column; no task holds all rows or all values of a large group.

    Where no group has more than ``few`` rows that is a window. Else the distinct values of a group are counted, cut at
    about ``pieces`` split points, numbered within a piece from the piece's first place on, and joined back: those with
    more than the share ``heavy`` of all rows, a bounded number, by a broadcast.
    """
    sizes = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    if (sizes[0] or 0) <= few:
        return df.withColumn(name, average_rank(x, by))
    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    splits = values.groupBy(*by).agg(F.percentile_approx(x, F.array(*(F.lit(i / pieces) for i in range(1, pieces))), F.lit(1000)).alias("_splits"))
    marked = values.join(splits, by).withColumn("_piece", F.size(F.filter("_splits", lambda s: s <= F.col(x)))).drop("_splits")
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    first = marked.groupBy(*by, "_piece").agg(F.sum("_n").alias("_all")).select(*by, "_piece", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by, "_piece").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranks = marked.join(first, [*by, "_piece"]).select(*by, x, "_n", (F.col("_first") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(name))
    often = F.broadcast(ranks.where(F.col("_n") > heavy * sizes[1]).select(*by, x, F.col(name).alias("_often")))
    marked = df.join(often, [*by, x], "left")
    rare = marked.where("_often IS NULL").drop("_often").join(ranks.where(F.col("_n") <= heavy * sizes[1]).drop("_n"), [*by, x], "left")
    return marked.where("_often IS NOT NULL").withColumnRenamed("_often", name).unionByName(rare)


def safe_corr(x: str, y: str) -> Column:
    """Pearson over pairs; NULL where one side does not vary."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def unpivoted(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """(keep..., feature, x): one row for each feature of a row."""
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))))


#: Size of a quantile sketch; its rank error is about 2.3 / k^0.9 at 99 % confidence (0.2 % of the rows at 2,000).
SKETCH = 2_000


def quantiles(x: str, qs: list[float], exact: bool = True, k: int = SKETCH) -> dict[str, Column]:
    """Quantiles of a group: exact ones, for which every distinct value is held at once, or those of a KLL sketch of bounded size."""
    if exact:
        return {f"q{int(q * 100):02d}": F.percentile(x, F.lit(q)) for q in qs}
    sketch = F.kll_sketch_agg_double(F.nullif(F.col(x).cast("double"), F.lit(float("nan"))), k)
    return {f"q{int(q * 100):02d}": _of_sketch(sketch, q) for q in qs}


def _of_sketch(sketch: Column, q: float) -> Column:
    """A value of the data with about this rank; NULL for a sketch of nothing."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(q))))


def daily_sketches(df: DataFrame, x: list[str], by: list[str] = (), ts: str = "ts", k: int = SKETCH) -> DataFrame:
    """(by..., day, feature, n, sketch): mergeable quantile sketches, to be kept as a table; missing values are left out."""
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias("_x")) for c in x)))
    rows = df.select(*by, F.to_date(ts).alias("day"), each)
    return rows.groupBy(*by, "day", "feature").agg(F.count("_x").alias("n"), F.kll_sketch_agg_double("_x", k).alias("sketch"))


def quantiles_between(sketches: DataFrame, qs: list[float], start: str | None = None, end: str | None = None, by: list[str] = (), k: int = SKETCH) -> DataFrame:
    """(by..., feature, n, q..): quantiles of the days from ``start`` up to ``end`` out of their sketches, without the rows."""
    inside = sketches.where("n > 0")
    inside = inside.where(F.col("day") >= F.lit(start).cast("date")) if start else inside
    inside = inside.where(F.col("day") < F.lit(end).cast("date")) if end else inside
    merged = inside.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("_sketch"))
    return merged.select(*by, "feature", "n", *(_of_sketch(F.col("_sketch"), q).alias(f"q{int(q * 100):02d}") for q in qs))


# -- tails


def tail_exceedance_rate(z: str, level: float = 0.98, two_sided: bool = True) -> Column:
    from statistics import NormalDist

    limit = NormalDist().inv_cdf(0.5 + level / 2 if two_sided else level)
    x = F.abs(F.col(z)) if two_sided else F.col(z)
    return F.avg(F.when(x.isNotNull(), (x > limit).cast("double")))


def tails(df: DataFrame, x: str, y: str, q: float, by: list[str]) -> DataFrame:
    """Rows of the lower and upper q of x (``tail`` -1 and 1), disjoint: a share of the rows by rank, ties by order."""
    valid = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = Window.partitionBy(*by)
    order = n.orderBy(x, y)
    ranked = valid.withColumn("_n", F.count("*").over(n)).withColumn("_r", F.row_number().over(order))
    size = F.floor(F.col("_n") * q)
    return ranked.withColumn("tail", F.when(F.col("_r") <= size, -1).when(F.col("_r") > F.col("_n") - size, 1).otherwise(0)).drop("_n", "_r").where("tail != 0")


def robust_scale(y: str, method: str = "iqr") -> Column:
    """Spread of y: between the quartiles, or between the tenth and ninetieth percentile."""
    low, high = {"iqr": (0.25, 0.75), "q90q10": (0.1, 0.9)}[method]
    return F.percentile(y, F.lit(high)) - F.percentile(y, F.lit(low))


def mad_scale(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    """Median distance from the median, by group."""
    middle = df.groupBy(*by).agg(F.percentile(y, F.lit(0.5)).alias("_m"))
    return df.join(middle, by).groupBy(*by).agg(F.percentile(F.abs(F.col(y) - F.col("_m")), F.lit(0.5)).alias("mad"))


def tail_shift(df: DataFrame, x: str, y: str, by: list[str], q: float = 0.25, high: float = 0.9, low: float = 0.1, scale: str = "iqr") -> DataFrame:
    """Tail quantile shift: y's upper quantile in x's upper tail and lower quantile in x's lower tail against each other.

    Columns tqss, its value over y's spread, and the shift of the medians over that spread; 10 rows a tail needed.
    """
    t = tails(df, x, y, q, by)
    in_tail = lambda k: F.when(F.col("tail") == k, F.col(y))
    found = t.groupBy(*by).agg(
        F.count_if(F.col("tail") == 1).alias("n_tail"),
        (F.percentile(in_tail(1), F.lit(high)) - F.percentile(in_tail(-1), F.lit(low))).alias("upper"),
        (F.percentile(in_tail(-1), F.lit(high)) - F.percentile(in_tail(1), F.lit(low))).alias("lower"),
        (F.percentile(in_tail(1), F.lit(0.5)) - F.percentile(in_tail(-1), F.lit(0.5))).alias("median_shift"),
    )
    spread = df.where(F.col(x).isNotNull()).groupBy(*by).agg(robust_scale(y, scale).alias("scale"))
    enough = F.col("n_tail") >= 10
    score = F.when(enough, F.col("upper") - F.col("lower"))
    return found.join(spread, by).select(*by, "n_tail", score.alias("tqss"), ratio(score, "scale").alias("tqss_norm"), F.when(enough, ratio("median_shift", "scale")).alias("median_shift_norm"))


def wasserstein(df: DataFrame, value: str, side: str, by: list[str]) -> DataFrame:
    """Earth mover's distance between the values of side 1 and of side -1, by group.

    Both are sorted together; the gap to the next value times the difference of the two distribution functions adds up.
    """
    valid = df.where(F.col(value).isNotNull())
    order = Window.partitionBy(*by).orderBy(value)
    upto, whole = order.rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    share = lambda k: ratio(F.sum((F.col(side) == k).cast("double")).over(upto), F.sum((F.col(side) == k).cast("double")).over(whole))
    stepped = valid.select(*by, F.col(value).alias("v"), (F.abs(share(1) - share(-1)) * (F.lead(value).over(order) - F.col(value))).alias("part"))
    return stepped.groupBy(*by).agg(F.sum("part").alias("w1"))


def signed_wasserstein(df: DataFrame, x: str, y: str, by: list[str], q: float = 0.25, scale: str = "iqr") -> DataFrame:
    """Distance of y between x's tails, with the sign of the medians' difference, plain and over y's spread."""
    t = tails(df, x, y, q, by)
    far = wasserstein(t, y, "tail", by)
    middle = t.groupBy(*by).agg((F.percentile(F.when(F.col("tail") == 1, F.col(y)), F.lit(0.5)) - F.percentile(F.when(F.col("tail") == -1, F.col(y)), F.lit(0.5))).alias("d"))
    spread = df.where(F.col(x).isNotNull()).groupBy(*by).agg(robust_scale(y, scale).alias("scale"))
    signed = F.signum("d") * F.col("w1")
    return far.join(middle, by).join(spread, by).select(*by, "w1", signed.alias("signed_w1"), ratio("w1", "scale").alias("w1_norm"), ratio(signed, "scale").alias("signed_w1_norm"))


def conditional_target_stats(df: DataFrame, x: str, y: str, by: list[str], q: float = 0.9, direction: str = "above", qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """y where x is in its upper q (or lower 1 - q) share; fewer than ten rows give NULL."""
    limit = df.groupBy(*by).agg(F.percentile(x, F.lit(q if direction == "above" else 1 - q)).alias("_limit"))
    joined = df.join(limit, by)
    inside = joined.where(F.col(x) >= F.col("_limit") if direction == "above" else F.col(x) <= F.col("_limit"))
    found = inside.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"), F.stddev_pop(y).alias("std"), F.avg((F.col(y) > 0).cast("double")).alias("positive"), *(c.alias(n) for n, c in quantiles(y, list(qs)).items()))
    return found.select(*by, "n", *(F.when(F.col("n") >= 10, F.col(c)).alias(c) for c in found.columns if c not in (*by, "n")))


# -- probabilities


def brier(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def log_loss(y: str, p: str, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    return F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q)))


def calibration(df: DataFrame, y: str, p: str, by: list[str], bins: int = 10) -> DataFrame:
    """Per equal-width bin of the probability: rows, mean probability, event rate; the last bin is closed."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return df.withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def expected_calibration_error(df: DataFrame, y: str, p: str, by: list[str], bins: int = 10) -> DataFrame:
    return calibration(df, y, p, by, bins).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def equal_count_bins(df: DataFrame, y: str, p: str, by: list[str], bins: int, order: str) -> DataFrame:
    """Bins of equal counts by rank (ties by ``order``): rows, means and bounds."""
    w = Window.partitionBy(*by)
    place = F.floor((F.row_number().over(w.orderBy(p, order)) - 1) * bins / F.count("*").over(w))
    return df.withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.min(p).alias("low"), F.max(p).alias("high"))


def decile_stats(df: DataFrame, y: str, x: str, by: list[str], bins: int = 10) -> DataFrame:
    """Bins between the quantiles of x, right-closed, the lowest value in the first."""
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(x, F.array(*(F.lit(i / bins) for i in range(bins + 1))))).alias("_edges"))
    joined = df.join(edges, by).where(F.col(x).isNotNull())
    place = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(x))), F.lit(1))
    return joined.withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"), F.avg(x).alias("mean_x"))


def rank_auc(df: DataFrame, y: str, x: str, by: list[str], least: int = 20, each: int = 5) -> DataFrame:
    """Separation of a binary target: rank AUC (ties at their mean), point-biserial and rank correlation."""
    valid = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = valid.withColumn("_r", average_rank(x, by)).withColumn("_ry", average_rank(y, by)).withColumn("_y", F.col(y).cast("double")).withColumn("_x", F.col(x).cast("double"))
    found = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_y").alias("ones"), F.sum(F.when(F.col("_y") == 1, F.col("_r"))).alias("ranks"), safe_corr("_x", "_y").alias("pointbiserial"), safe_corr("_r", "_ry").alias("spearman")
    )
    zeros = F.col("n") - F.col("ones")
    auc = F.when((F.col("n") >= least) & (F.col("ones") >= each) & (zeros >= each), ratio(F.col("ranks") - F.col("ones") * (F.col("ones") + 1) / 2, F.col("ones") * zeros))
    return found.select(*by, "n", "pointbiserial", "spearman", auc.alias("auc"), F.greatest(auc, 1 - auc).alias("separability"))


def rolling_auc(p: Panel, y: str, x: str, n: int, least: int = 100) -> Column:
    """Rank AUC of the last n rows, ties by half; both classes and ``least`` valid rows needed. Each frame is sorted once."""
    seen = p.over(F.collect_list(p.let(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))), 1 - n, 0)
    names = ("x", "below", "zeros", "ones", "n_zeros", "n_ones", "won")  # below: zeros under x; zeros and ones: at x
    state = lambda *values: F.struct(*(v.alias(n) for n, v in zip(names, values)))

    def step(a: Column, r: Column) -> Column:
        same = a["x"] == r["x"]
        below, zeros, ones = F.when(same, a["below"]).otherwise(a["below"] + a["zeros"]), F.when(same, a["zeros"]).otherwise(0.0), F.when(same, a["ones"]).otherwise(0.0)
        zero, one = F.when(r["y"] == 0, 1.0).otherwise(0.0), F.when(r["y"] == 1, 1.0).otherwise(0.0)
        return state(r["x"], below, zeros + zero, ones + one, a["n_zeros"] + zero, a["n_ones"] + one, a["won"] + one * (below + 0.5 * zeros) + zero * 0.5 * ones)

    done = p.let(F.aggregate(F.array_sort(seen), state(F.lit(None).cast("double"), *(F.lit(0.0) for _ in names[1:])), step))
    both = done["n_ones"] * done["n_zeros"]
    return F.when((F.size(seen) >= max(10, least)) & (both > 0), done["won"] / both)


def pr_auc(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Area under precision over recall by trapezoids, the points at each distinct score, from recall 0."""
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x).agg(F.sum(F.col(y).cast("double")).alias("tp"), F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col(x).desc())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    curve = points.select(*by, x, F.sum("tp").over(upto).alias("tp"), F.sum("n").over(upto).alias("n"), F.sum("tp").over(Window.partitionBy(*by)).alias("all"))
    curve = curve.select(*by, x, ratio("tp", "all").alias("recall"), ratio("tp", "n").alias("precision"))
    before_r, before_p = F.coalesce(F.lag("recall").over(order), F.lit(0.0)), F.coalesce(F.lag("precision").over(order), F.lit(1.0))
    return curve.withColumn("part", (F.col("recall") - before_r) * (F.col("precision") + before_p) / 2).groupBy(*by).agg(F.sum("part").alias("pr_auc"))


def regression_metrics(y: str, p: str, alpha: float = 0.5) -> dict[str, Column]:
    gap = F.col(y) - F.col(p)
    return {"rmse": F.sqrt(F.avg(gap * gap)), "mae": F.avg(F.abs(gap)), "corr": safe_corr(y, p), "pinball": F.avg(F.greatest(alpha * gap, (alpha - 1) * gap))}


# -- features


def feature_target_correlations(df: DataFrame, target: str, features: list[str], by: list[str] = (), least: int = 10) -> DataFrame:
    """Pearson and Spearman of each feature with the target, over valid pairs."""
    keys = [*by, "feature"]
    pairs = unpivoted(df, [*by, target], features).where(F.col("x").isNotNull() & F.col(target).isNotNull())
    ranked = with_average_rank(with_average_rank(pairs, "x", keys, "_rx"), target, keys, "_ry")
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("x", target).alias("pearson"), safe_corr("_rx", "_ry").alias("spearman"))
    return found.select(*keys, "n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("pearson", "spearman")))


def correlation_matrix(df: DataFrame, row_key: str, features: list[str], method: str = "spearman") -> DataFrame:
    """(a, b, rho) for every pair of features: pairs of columns within each row, then one aggregation."""
    long = unpivoted(df, [row_key], features).where(F.col("x").isNotNull())
    if method == "spearman":
        long = with_average_rank(long, "x", ["feature"], "_rank").withColumn("x", F.col("_rank"))
    wide = long.groupBy(row_key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("m"))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("m")[a].alias("x"), F.col("m")[b].alias("y")) for i, a in enumerate(features) for b in features[i + 1 :]))
    return wide.select(F.inline(pairs)).groupBy("a", "b").agg(safe_corr("x", "y").alias("rho"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("overlap"))


def greedy_select(matrix: DataFrame, ordered: list[str], most: float, family_cap: int | None = None, family=lambda name: name, keep: list[str] = (), total: int | None = None, least_overlap: int = 200) -> list[str]:
    """Features in the given order that are not too close to one kept before, with a cap for each family.

    A pair with fewer common rows than ``least_overlap`` counts as far apart. The matrix has a row for each pair of features and is as large as their number squared, whatever the data.
    """
    rho = {(r.a, r.b): abs(r.rho or 0.0) if r.overlap >= least_overlap else 0.0 for r in matrix.collect()}
    kept, counts = list(keep), {}
    for name in kept:
        counts[family(name)] = counts.get(family(name), 0) + 1
    for name in ordered:
        if total is not None and len(kept) >= total:
            break
        if name in kept or (family_cap is not None and counts.get(family(name), 0) >= family_cap):
            continue
        if all(max(rho.get((name, k), 0.0), rho.get((k, name), 0.0)) < most for k in kept):
            kept.append(name)
            counts[family(name)] = counts.get(family(name), 0) + 1
    return kept


def cluster_order(matrix: DataFrame, features: list[str]) -> list[str]:
    """The features in the order of an average-linkage tree on 1 - |rho|, so that close ones stand together.

    Like ``greedy_select`` it works on the matrix of feature pairs alone. Of equally close pairs the first by place merges.
    """
    far = {frozenset((r.a, r.b)): 1 - abs(r.rho or 0.0) for r in matrix.collect()}
    groups = [[f] for f in features]
    distance = lambda x, y: sum(far.get(frozenset((a, b)), 1.0) for a in x for b in y) / (len(x) * len(y))
    while len(groups) > 1:
        _, i, j = min((distance(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    return groups[0] if groups else []


def index_distribution(df: DataFrame, columns: dict[str, str], by: list[str] = ("symbol",), width: float = 5.0) -> DataFrame:
    """(by..., timeframe, bin, n, share): histograms of an index from 0 to 100; ``columns`` names the column of each timeframe."""
    long = df.select(*by, F.inline(F.array(*(F.struct(F.lit(t).alias("timeframe"), F.col(c).cast("double").alias("x")) for t, c in columns.items()))))
    place = F.least(F.floor(F.col("x") / width) * width, F.lit(100 - width))
    counts = long.where(F.col("x").isNotNull()).groupBy(*by, "timeframe", place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "timeframe")))


def index_levels(df: DataFrame, columns: dict[str, str], by: list[str] = ("symbol",), low: float = 30.0, high: float = 70.0) -> DataFrame:
    """(by..., timeframe): rows, mean, deviation, quantiles, and the shares below and above the usual levels of an index."""
    long = df.select(*by, F.inline(F.array(*(F.struct(F.lit(t).alias("timeframe"), F.col(c).cast("double").alias("x")) for t, c in columns.items()))))
    valid = long.where(F.col("x").isNotNull()).groupBy(*by, "timeframe")
    return valid.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), *(c.alias(n) for n, c in quantiles("x", [0.05, 0.25, 0.5, 0.75, 0.95]).items()), F.avg((F.col("x") <= low).cast("double")).alias("low_share"), F.avg((F.col("x") >= high).cast("double")).alias("high_share"))


def with_attributions(features: DataFrame, attributions: DataFrame, names: list[str], keys: list[str] = ("ts",), prefix: str = "shap_") -> DataFrame:
    """(keys..., feature, x, attribution): each feature's value beside what a model made of it; rows that both tables have."""
    parts = attributions.select(*keys, *(F.col(f"{prefix}{n}" if f"{prefix}{n}" in attributions.columns else n).alias(f"_a_{n}") for n in names))
    both = features.select(*keys, *names).join(parts, list(keys))
    return both.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x"), F.col(f"_a_{n}").cast("double").alias("attribution")) for n in names))))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, percent missing), rounded to two places."""
    shares = df.agg(*(F.round(100 * F.avg(F.col(c).isNull().cast("double")), 2).alias(c) for c in columns))
    return unpivoted(shares, [], columns).select(F.col("feature").alias("column"), F.col("x").alias("missing_pct"))


def quality_score(df: DataFrame, features: list[str], penalty: float = 1.0) -> DataFrame:
    """Spread of a feature's percent ranks times its share of valid values."""
    ranked = with_average_rank(unpivoted(df, [], features), "x", ["feature"], "_r")
    found = ranked.groupBy("feature").agg(ratio(F.stddev_samp("_r"), F.count("x").cast("double")).alias("rank_std"), F.avg(F.col("x").isNull().cast("double")).alias("nan_rate"))
    return found.withColumn("score", F.coalesce("rank_std", F.lit(0.0)) * F.pow(1 - F.col("nan_rate"), F.lit(penalty)))


def binary_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind): binary for values 0 and 1, ternary if there is also -1 and nothing else, else numerical."""
    long = unpivoted(df, [], columns)
    found = long.groupBy("feature").agg(F.bool_and(F.col("x").isin(0, 1)).alias("b"), F.bool_and(F.col("x").isin(-1, 0, 1)).alias("t"))
    return found.select(F.col("feature").alias("column"), F.when(F.col("b"), "binary").when(F.col("t"), "ternary").otherwise("numerical").alias("kind"))


def hurst_by_lags(p: Panel, x: str, low: int = 2, high: int = 20) -> DataFrame:
    """Per symbol the slope of ln std(x[t + lag] - x[t]) on ln lag."""
    steps = p.select(**{f"d{k}": p.diff(x, k) for k in range(low, high + 1)})
    spread = steps.groupBy(*p.by).agg(*(F.stddev_pop(f"d{k}").alias(f"d{k}") for k in range(low, high + 1)))
    import math

    points = spread.select(*p.by, F.inline(F.array(*(F.struct(F.lit(math.log(k)).alias("l"), F.when(F.col(f"d{k}") > 0, F.ln(f"d{k}")).alias("s")) for k in range(low, high + 1)))))
    return points.groupBy(*p.by).agg(F.regr_slope("s", "l").alias("hurst"))


def half_life(p: Panel, x: str) -> DataFrame:
    """Per symbol -ln 2 over ln(1 + beta) of the move on the level before; NULL unless 1 + beta is between 0 and 1."""
    beta = p.select(move=p.diff(x), before=p.lag(x)).groupBy(*p.by).agg((1 + F.regr_slope("move", "before")).alias("phi"))
    return beta.select(*p.by, F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.ln(F.lit(2.0)) / F.ln("phi")).alias("half_life"))


def stationarity_rank(scores: DataFrame, weight: float = 0.5, scale: float = 100.0) -> DataFrame:
    """hurst + weight * log1p(half-life) / log1p(scale), ranked ascending; an unknown Hurst is 1, a half-life 1e9."""
    score = F.coalesce("hurst", F.lit(1.0)) + weight * F.log1p(F.coalesce("half_life", F.lit(1e9))) / F.log1p(F.lit(scale))
    return scores.withColumn("score", score).withColumn("rank", F.rank().over(Window.orderBy("score")))


# -- trades


def trade_returns(signal: str, y: str) -> dict[str, Column]:
    """A trade wins if it has the sign of a log return that is not zero; its percent gain is by the simple return."""
    return {"win": ((F.signum(y) == F.col(signal)) & (F.col(y) != 0)).cast("int"), "pnl_pct": F.col(signal) * (F.exp(y) - 1) * 100}


def labelled_trade_return(prob: str, label: str, logret: str, up: float, down: float, threshold: float = 0.5) -> Column:
    """Long at or above the threshold, else short: the barrier that was hit, or the natural return."""
    natural = F.expm1(logret)
    long = F.when(F.col(label) == 1, up).when(F.col(label) == -1, -down).otherwise(natural)
    return F.when(F.col(prob) >= threshold, long).otherwise(-long)


def signal_metrics(predictions: DataFrame, bars: DataFrame, horizon: int, threshold: float = 0.0) -> DataFrame:
    """Predictions with direction, forward return and excursions (the last bars by what is left), drawdown, correctness."""
    p = Panel(bars)
    later = p.lead("close", horizon)
    known = p.select(forward_return=ratio(later, "close") - 1, forward_log_return=F.ln(ratio(later, "close")), worst=ratio(p.next_low("low", horizon, True), "close") - 1, best=ratio(p.next_high("high", horizon, True), "close") - 1)
    direction = F.when(F.col("y_pred") > threshold, 1).when(F.col("y_pred") < -threshold, -1).otherwise(0)
    joined = predictions.join(known, ["symbol", "ts"], "left").withColumn("direction", direction)
    drawdown = F.when(F.col("direction") == 1, F.least("worst", F.lit(0.0))).when(F.col("direction") == -1, F.least(-F.col("best"), F.lit(0.0)))
    correct = F.when((F.col("direction") != 0) & F.col("forward_return").isNotNull(), (F.signum("forward_return") == F.col("direction")).cast("int"))
    return joined.withColumns({"drawdown": drawdown, "correct": correct})


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per column the mismatches over common keys and their size; and the largest differences of each column."""
    both = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in columns)).join(b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in columns)), keys)
    long = both.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").cast("double").alias("a"), F.col(f"{c}_b").cast("double").alias("b")) for c in columns))))
    gap = F.abs(F.col("a") - F.col("b"))
    long = long.withColumn("gap", gap).withColumn("differs", (F.col("a").isNull() != F.col("b").isNull()) | F.coalesce(F.col("gap") > tolerance, F.lit(False)))
    stats = long.groupBy("column").agg(F.count("*").alias("n"), F.count_if("differs").alias("mismatches"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"))
    order = Window.partitionBy("column").orderBy(F.col("gap").desc(), *keys)
    return stats, long.where("differs").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
