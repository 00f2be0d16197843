"""Signals from predicted quantiles: order, expectation, probability of a rise, thresholds, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..frames import col

#: The columns of a quantile prediction and their probabilities.
QUANTILES = {"pred_q05": 0.05, "pred_q10": 0.10, "pred_q15": 0.15, "pred_q25": 0.25, "pred_q50": 0.50, "pred_q75": 0.75, "pred_q85": 0.85, "pred_q90": 0.90, "pred_q95": 0.95}
COLUMNS = list(QUANTILES)


def monotonic_violations(q: list[str] = COLUMNS) -> tuple[Column, Column]:
    """How many neighbouring quantiles fall, and the largest fall."""
    falls = [F.coalesce(F.greatest(F.col(a) - F.col(b), F.lit(0.0)), F.lit(0.0)) for a, b in zip(q, q[1:])]
    return reduce(lambda a, b: a + b, [(f > 0).cast("int") for f in falls]), F.greatest(*falls)


def monotonic_fix(q: list[str] = COLUMNS) -> dict[str, Column]:
    """Running maximum along the quantiles; a missing one stays missing."""
    return {name: F.when(F.col(name).isNotNull(), F.greatest(*map(F.col, q[: k + 1])) if k else F.col(name)) for k, name in enumerate(q)}


def nodes(q: list[str] = COLUMNS) -> list[tuple[float, Column]]:
    """Probability and value with the ends carried out to 0 and 1."""
    inner = [(QUANTILES[n], F.col(n)) for n in q]
    return [(0.0, inner[0][1]), *inner, (1.0, inner[-1][1])]


def expected_trapezoid(q: list[str] = COLUMNS) -> Column:
    n = nodes(q)
    return reduce(lambda a, b: a + b, [(b[0] - a[0]) / 2 * (a[1] + b[1]) for a, b in zip(n, n[1:])])


def expected_left(q: list[str] = COLUMNS) -> Column:
    n = nodes(q)
    return reduce(lambda a, b: a + b, [(b[0] - a[0]) * a[1] for a, b in zip(n, n[1:])])


def prob_up(q: list[str] = COLUMNS) -> Column:
    """One less the probability at which the straight line between the nodes crosses zero."""
    n = nodes(q)
    found = F.when(n[0][1] >= 0, 1.0).when(n[-1][1] <= 0, 0.0)
    for (pa, a), (pb, b) in zip(n, n[1:]):
        share = F.when(b == a, 0.0).otherwise(-a / F.nullif(b - a, F.lit(0.0)))
        found = found.when((a <= 0) & (b > 0), 1 - (pa + share * (pb - pa)))
    return found


def tail_spread(q: list[str] = COLUMNS) -> Column:
    return F.col(q[-1]) - F.col(q[0])


def with_core_metrics(df: DataFrame, q: list[str] = COLUMNS) -> DataFrame:
    """Violations counted, quantiles put in order, then both expectations, their mean, the probability and the spread."""
    count, gap = monotonic_violations(q)
    fixed = df.withColumns({"n_violations": count, "max_gap": gap}).withColumns(monotonic_fix(q))
    made = fixed.withColumns({"exp_ret_trapezoid": expected_trapezoid(q), "exp_ret_left": expected_left(q), "prob_up": prob_up(q), "tail_spread": tail_spread(q)})
    return made.withColumn("exp_ret_avg", (F.col("exp_ret_trapezoid") + F.col("exp_ret_left")) / 2)


def static_thresholds(frames: list[DataFrame], wanted: list[tuple[str, float]]) -> DataFrame:
    """One row with the percentile of each column over all frames together, named ``column@percent``."""
    both = reduce(lambda a, b: a.unionByName(b), [f.select(*dict.fromkeys(c for c, _ in wanted)) for f in frames])
    return both.agg(*(F.percentile(c, F.lit(q / 100)).alias(f"{c}@{q:.4f}") for c, q in wanted))


def basic_signals(expected="exp_ret_avg", band: float = 1e-6, probability=(0.55, 0.45), quantile=(0.0, 0.0)) -> dict[str, Column]:
    """By expectation outside a dead band, by probability, and by the outer quantiles (long wins)."""
    e, p = col(expected), F.col("prob_up")
    return {
        "signal_exp": F.when(e > band, 1).when(e < -band, -1).otherwise(0),
        "signal_prob": F.when(p >= probability[0], 1).when(p <= probability[1], -1).otherwise(0),
        "signal_quantile": F.when(F.col("pred_q90") >= quantile[0], 1).when(F.col("pred_q10") <= quantile[1], -1).otherwise(0),
    }


def joint_indicator(signals: DataFrame, original: DataFrame, long: float = 0.55, short: float = 0.45, expected: str = "exp_ret_avg", out: str = "signal_prob_exp_q50", keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """1 or -1 where probability, expectation and the original median agree; ``original`` is joined by time (or ``keys``)."""
    median = original.select(*keys, F.col("pred_q50").alias("_median"))
    up = (F.col("prob_up") >= long) & (F.col(expected) > 0) & (F.col("_median") > 0)
    down = (F.col("prob_up") <= short) & (F.col(expected) < 0) & (F.col("_median") < 0)
    return signals.join(median, list(keys), "left").withColumn(out, F.when(up, 1).when(down, -1).otherwise(0)).drop("_median")


def merge_quantile_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Predictions of several quantiles by time and target, equal to the bit; columns ``pred_q05``, ..."""
    named = [df.select("ts", "y_true", F.col("y_pred").alias(f"pred_{label}")) for label, df in runs.items()]
    return reduce(lambda a, b: a.join(b, ["ts", "y_true"]), named)


def quantile_label(alpha: float) -> str:
    return f"q{round(alpha * 100):02d}"


def position(prediction="y_pred", mode: str = "long_only") -> Column:
    return F.when(col(prediction) > 0, 1).otherwise(0) if mode == "long_only" else F.coalesce(F.signum(prediction).cast("int"), F.lit(0))
