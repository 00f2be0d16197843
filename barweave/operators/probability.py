"""Probabilities against outcomes: by time to settlement, and calibration by Platt's and the isotonic method."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from .evaluate import brier, calibration, expected_calibration_error, log_loss


def edge_by_ttl(df: DataFrame, ours: str, market: str, ttl: str = "ttl") -> DataFrame:
    """Per minute to settlement: rows, mean, deviation and quantiles of our probability less the market's, positive share."""
    edge = df.select(F.col(ttl).cast("int").alias("ttl"), (F.col(ours) - F.col(market)).alias("edge")).dropna()
    levels = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    return edge.groupBy("ttl").agg(
        F.count("*").alias("count"), F.avg("edge").alias("edge_mean"), F.stddev_samp("edge").alias("edge_std"), *(F.percentile("edge", F.lit(p)).alias(f"edge_{n}") for n, p in levels.items()), F.avg((F.col("edge") > 0).cast("double")).alias("pos_edge_rate")
    )


def accuracy_by_ttl(df: DataFrame, outcome: str, ours: str, market: str, ttl: str = "ttl", bins: int = 10) -> DataFrame:
    """Per minute to settlement: Brier score, log loss, calibration error and accuracy of both probabilities, what ours gains, who wins."""
    valid = df.select(F.col(ttl).cast("int").alias("ttl"), F.col(outcome).cast("double").alias("y"), F.col(ours).alias("emp"), F.col(market).alias("market")).dropna()
    right = lambda p: F.avg(((F.col(p) >= 0.5) == (F.col("y") == 1)).cast("double"))
    kinds = {"brier": brier, "logloss": log_loss}
    found = valid.groupBy("ttl").agg(F.count("*").alias("count"), F.avg("y").alias("yes_rate"), *(f("y", p).alias(f"{n}_{p}") for n, f in kinds.items() for p in ("emp", "market")), *(right(p).alias(f"acc_{p}_0p5") for p in ("emp", "market")))
    for p in ("emp", "market"):
        clipped = valid.withColumn(p, F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0)))
        found = found.join(expected_calibration_error(clipped, "y", p, ["ttl"], bins).withColumnRenamed("ece", f"ece_{p}"), "ttl")
    found = found.withColumns({f"{n}_delta_market_minus_emp": F.col(f"{n}_market") - F.col(f"{n}_emp") for n in (*kinds, "ece")})
    gain = F.col("brier_delta_market_minus_emp")
    return found.withColumn("winner_brier", F.when(gain > 0, "empirical").when(gain < 0, "market").otherwise("tie"))


def strategy_by_ttl(rows: DataFrame, signal: str, ttl: str = "ttl") -> DataFrame:
    """Per minute to settlement of ``backtest.threshold_strategy``'s rows with a next price: entries, win rate, gains."""
    valid = rows.where(F.col("next_prob").isNotNull() & F.col(signal).isNotNull() & F.col("outcome").isNotNull())
    entered, yes = F.col("side").isNotNull(), F.col("side") == "YES"
    win = F.when(yes, (F.col("outcome") == 1).cast("double")).when(F.col("side") == "NO", (F.col("outcome") == 0).cast("double"))
    return valid.groupBy(F.col(ttl).cast("int").alias("ttl")).agg(
        F.count("*").alias("count_total"), F.count("side").alias("count_entered"), F.count_if(yes).alias("count_yes_entries"), F.count_if(F.col("side") == "NO").alias("count_no_entries"), (F.count("side") / F.count("*")).alias("participation_rate"), F.avg(win).alias("win_rate_entered"),
        F.avg(F.when(entered, F.abs(F.col(signal) - 0.5))).alias("avg_abs_confidence"), F.sum(F.coalesce("pnl", F.lit(0.0))).alias("pnl_total"), F.avg("pnl").alias("pnl_per_entered_trade"), F.avg(F.coalesce("pnl", F.lit(0.0))).alias("pnl_per_opportunity"),
    )


def platt(df: DataFrame, score: str, label: str, strength: float = 1.0, use_logit: bool = False, eps: float = 1e-6):
    """A function from a score's column to its calibrated probability: a logistic curve, its slope with an L2 penalty.

    The penalty is 1 / (2 * strength) of the squared slope against the summed loss. ``use_logit`` takes the scores as
    probabilities and fits on their logits.
    """
    moved = _logit(F.col(score), eps) if use_logit else F.col(score).cast("double")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.select(moved.alias("x"), F.col(label).cast("double").alias("label")).dropna())
    n = rows.count()
    model = LogisticRegression(regParam=1.0 / (strength * max(n, 1)), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(rows)
    slope, start = float(model.coefficients[0]), float(model.intercept)

    def apply(x: Column) -> Column:
        z = (_logit(x, eps) if use_logit else x) * slope + start
        return 1 / (1 + F.exp(-z))

    return apply


def _logit(p: Column, eps: float) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def isotonic(df: DataFrame, score: str, label: str):
    """A function from a score's column to its probability: the monotone fit, linear between its points, flat outside.

    The fit's points come to the driver; their number is that of distinct steps, so it is meant for scores rounded or binned.
    """
    rows = df.select(F.col(score).cast("double").alias("features"), F.col(label).cast("double").alias("label")).dropna()
    model = IsotonicRegression().fit(rows)
    bounds, values = (list(map(float, x)) for x in (model.boundaries, model.predictions))

    def apply(x: Column) -> Column:
        b, v = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, values))
        below = F.size(F.filter(b, lambda e: e <= x))
        low, high = F.get(b, below - 1), F.get(b, below)
        between = F.get(v, below - 1) + (x - low) / (high - low) * (F.get(v, below) - F.get(v, below - 1))
        return F.when(x.isNull(), None).when(below == 0, values[0]).when(below == len(bounds), values[-1]).otherwise(between)

    return apply


def monthly_calibration(df: DataFrame, score: str, label: str, first_month: str, months: int, lookback: int = 12, method: str = "platt", bins: int = 20, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows of ``months`` months from the first on with ``month`` and ``p_cal``, fitted on the ``lookback`` months before each; and their calibration bins.

    A fit for each month, one after another; a month before which there are fewer than two classes is left out.
    """
    fit = {"platt": platt, "isotonic": isotonic}[method]
    found = None
    for k in range(months):
        start = F.add_months(F.lit(first_month).cast("date"), k)
        inside = lambda a, b: (F.col(ts) >= a.cast("timestamp_ntz")) & (F.col(ts) < b.cast("timestamp_ntz"))
        before = df.where(inside(F.add_months(start, -lookback), start) & F.col(score).isNotNull() & F.col(label).isNotNull())
        if before.select(label).distinct().limit(2).count() < 2:
            continue
        month = df.where(inside(start, F.add_months(start, 1))).withColumn("month", start).withColumn("p_cal", fit(before, score, label)(F.col(score).cast("double")))
        found = month if found is None else found.unionByName(month)
    if found is None:
        found = df.where(F.lit(False)).withColumn("month", F.lit(None).cast("date")).withColumn("p_cal", F.lit(None).cast("double"))
    return found, calibration(found.where(F.col("p_cal").isNotNull()), label, "p_cal", ["month"], bins)
