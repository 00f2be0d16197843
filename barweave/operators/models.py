"""Models: gradient-boosted trees by MLlib, and a Gaussian hidden Markov model by expectation maximisation on Spark."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..frames import in_chunks
from ..sources.shared import written
from .evaluate import rank_auc, regression_metrics
from .store import time_folds


def fit_trees(train: DataFrame, features: list[str], target: str, **settings):
    """A fitted MLlib model with its assembler."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    defaults = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 7}
    model = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="y_pred", **defaults | settings).fit(assembler.transform(train))
    return assembler, model


def predict(fitted, df: DataFrame) -> DataFrame:
    assembler, model = fitted
    return model.transform(assembler.transform(df)).drop("_features")


def metrics(df: DataFrame, target: str, prediction: str = "y_pred", alpha: float = 0.5) -> DataFrame:
    return df.agg(*(c.alias(n) for n, c in regression_metrics(target, prediction, alpha).items()))


def grid_search(df: DataFrame, features: list[str], target: str, space: dict[str, list], n_folds: int = 3, fold_size: int = 100, gap: int = 0) -> tuple[dict, list[tuple[dict, float]]]:
    """Settings with the least mean RMSE over time-ordered folds; ``df`` has ``_row`` (1, 2, ... by time)."""
    return _search(df, features, target, [dict(zip(space, values)) for values in product(*space.values())], n_folds, fold_size, gap)


def random_search(df: DataFrame, features: list[str], target: str, space: dict[str, list], trials: int = 50, seed: int = 7, n_folds: int = 3, fold_size: int = 100, gap: int = 0) -> tuple[dict, list[tuple[dict, float]]]:
    """``grid_search`` over at most ``trials`` different settings drawn at random; over all of them where there are no more."""
    settings = [dict(zip(space, values)) for values in product(*space.values())]
    if len(settings) > trials:
        settings = random.Random(seed).sample(settings, trials)
    return _search(df, features, target, settings, n_folds, fold_size, gap)


def _search(df: DataFrame, features: list[str], target: str, candidates: list[dict], n_folds: int, fold_size: int, gap: int) -> tuple[dict, list[tuple[dict, float]]]:
    folds = time_folds(df.count(), n_folds, fold_size, gap)
    found = []
    for settings in candidates:
        errors = []
        for a, b, c, d in folds:
            fitted = fit_trees(df.where((F.col("_row") > a) & (F.col("_row") <= b)), features, target, **settings)
            errors.append(metrics(predict(fitted, df.where((F.col("_row") > c) & (F.col("_row") <= d))), target).first().rmse)
        found.append((settings, sum(errors) / len(errors)))
    return min(found, key=lambda x: x[1])[0], found


def forward_selection(train: DataFrame, test: DataFrame, base: list[str], candidates: list[str], label: str, least_gain: float = 0.0, most: int | None = None, **settings) -> tuple[list[str], list[dict]]:
    """Adds the candidate whose model has the best area under the curve on ``test``, round after round, and all trials.

    A round whose best falls below the best before it by more than ``least_gain`` ends the search; the first round is
    compared with the model of ``base`` alone (0.5 where it is empty). ``label`` is 0 or 1.
    """

    def area(features: list[str]) -> float:
        if not features:
            return 0.5
        scored = predict(fit_trees(train, features, label, **settings), test)
        return rank_auc(scored.withColumn("_one", F.lit(1)), label, "y_pred", ["_one"], 2, 1).first().auc

    chosen, left, trials = list(base), [c for c in candidates if c not in base], []
    best = area(chosen)
    while left and (most is None or len(chosen) < most):
        found = [{"round": len(chosen) - len(base) + 1, "candidate": c, "auc": area([*chosen, c]), "before": best} for c in left]
        trials += found
        top = max(found, key=lambda t: t["auc"])
        if top["auc"] < best - least_gain:
            break
        chosen.append(top["candidate"])
        left.remove(top["candidate"])
        best = top["auc"]
    return chosen, trials


@dataclass
class Hmm:
    """Start and move probabilities, and the mean and variance of each observation in each state.

    ``variance`` has a variance for each observation (states x observations) or whole covariances (states x observations
    x observations).
    """

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        gap = x[:, None, :] - self.mean
        if self.variance.ndim == 3:
            root = np.linalg.cholesky(self.variance)
            own = np.linalg.solve(root, gap.transpose(1, 2, 0))  # for each state, the rows without their correlation
            size = 2 * np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1) + x.shape[1] * math.log(2 * math.pi)
            return -0.5 * (size + (own * own).sum(axis=1).T)
        return -0.5 * (np.log(2 * math.pi * self.variance) + gap * gap / self.variance).sum(axis=2)

    def densities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's densities over the largest of them, and the logarithm of that."""
        logs = self.log_density(x)
        top = logs.max(axis=1, keepdims=True)
        return np.exp(logs - top), top[:, 0]

    def product(self, x: np.ndarray) -> np.ndarray:
        """What the rows of a chunk do to the probabilities of the row before them, but for a factor."""
        whole = np.eye(len(self.start))
        for row in self.densities(x)[0]:
            whole = (whole @ self.move) * row
            whole /= max(whole.sum(), 1e-300)
        return whole

    def passes(self, x: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Posterior of each state, the expected moves into the rows, and their log likelihood.

        ``enter`` has the probabilities of the row before the chunk (none at a start), ``leave`` the likelihood of what
        comes after it for each state of its last row, but for a factor.
        """
        density, top = self.densities(x)
        n, k = density.shape
        ahead, back, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        for t in range(n):
            before = enter if t == 0 else ahead[t - 1]
            row = (self.start if before is None else before @ self.move) * density[t]
            scale[t] = max(row.sum(), 1e-300)
            ahead[t] = row / scale[t]
        if leave is not None:
            back[-1] = leave / max(ahead[-1] @ leave, 1e-300)
        for t in range(n - 2, -1, -1):
            back[t] = self.move @ (density[t + 1] * back[t + 1]) / scale[t + 1]
        posterior = ahead * back
        posterior /= posterior.sum(axis=1, keepdims=True)
        sources, into = (ahead[:-1], density[1:] * back[1:] / scale[1:, None]) if enter is None else (np.vstack([enter, ahead[:-1]]), density * back / scale[:, None])
        return posterior, self.move * (sources.T @ into), float((np.log(scale) + top).sum())


KINDS = ("diag", "full")


def hmm_parameters(states: int, features: int, kind: str = "diag") -> int:
    """Free parameters of a model with variances alone (diag) or whole covariances (full)."""
    spread = features if kind == "diag" else features * (features + 1) // 2
    return states - 1 + states * (states - 1) + states * (features + spread)


def sticky(states: int, weight: float) -> np.ndarray:
    """Moves that stay with the weight and spread the rest."""
    rest = (1 - weight) / (states - 1) if states > 1 else 0.0
    return np.full((states, states), rest) + np.eye(states) * ((weight if states > 1 else 1.0) - rest)


#: Rows of a chunk of a long sequence.
CHUNK = 100_000


def _chunks(df: DataFrame, columns: list[str], sequence: str) -> DataFrame:
    """The rows with all columns, written once, with the number of their chunk."""
    return written(in_chunks(df.dropna(subset=columns), 0, CHUNK, (sequence,), "ts").drop("_halo"), "hmm-chunks")


def _ends(chunks: DataFrame, model: Hmm, columns: list[str], sequence: str) -> DataFrame:
    """(sequence, _chunk, enter, leave): what ``Hmm.passes`` needs on either side of each chunk; a scan over the chunks' products."""
    k, keys = len(model.start), [sequence, "_chunk"]
    fields = [chunks.schema[c] for c in keys]
    numbers = ArrayType(DoubleType())

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("ts")[columns].to_numpy(float)
        first = int(rows["_chunk"].iloc[0]) == 0
        # the first chunk gives what leaves it in any case
        enter = (model.start * model.densities(x[:1])[0][0])[None] if first else np.eye(k)
        out = enter @ model.product(x[1:] if first else x)
        return rows[keys].iloc[:1].assign(product=[(out / out.sum()).ravel().tolist()])

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_chunk")
        products = [np.array(p) for p in rows["product"]]
        enter, leave = [None], [None] * len(products)
        for p in products[:-1]:
            row = p if enter[-1] is None else enter[-1] @ p.reshape(k, k)
            enter.append(row / max(row.sum(), 1e-300))
        for i in range(len(products) - 2, -1, -1):
            later = products[i + 1].reshape(k, k) @ (np.ones(k) if leave[i + 1] is None else leave[i + 1])
            leave[i] = later / max(later.sum(), 1e-300)
        as_list = lambda v: None if v is None else v.tolist()
        return rows[keys].assign(enter=[as_list(v) for v in enter], leave=[as_list(v) for v in leave])

    products = chunks.select(*keys, "ts", *columns).groupBy(*keys).applyInPandas(product, StructType([*fields, StructField("product", numbers)]))
    # a row for each chunk: few even for the longest sequence
    return products.groupBy(sequence).applyInPandas(along, StructType([*fields, StructField("enter", numbers), StructField("leave", numbers)]))


def _with_ends(chunks: DataFrame, model: Hmm, columns: list[str], sequence: str, run, schema: StructType) -> DataFrame:
    """``run`` (rows, enter, leave) over each chunk."""
    keys = [sequence, "_chunk"]
    side = lambda v: None if v is None else np.array(v)

    def both(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        return run(rows.sort_values("ts"), side(ends["enter"].iloc[0]), side(ends["leave"].iloc[0]))

    if chunks.where("_chunk > 0").limit(1).count() == 0:  # a sequence is a chunk
        return chunks.groupBy(*keys).applyInPandas(lambda rows: run(rows.sort_values("ts"), None, None), schema)
    return chunks.groupBy(*keys).cogroup(_ends(chunks, model, columns, sequence).groupBy(*keys)).applyInPandas(both, schema)


def fit_hmm(df: DataFrame, columns: list[str], states: int, sequence: str = "symbol", iterations: int = 20, tolerance: float = 1e-4, stay: float = 0.9, floor: float = 1e-6, kind: str = "diag") -> tuple[Hmm, float]:
    """The model and its log likelihood. Chunks of ``CHUNK`` rows are passed over in parallel, with the result of whole sequences.

    ``kind``: diag for variances alone, full for whole covariances. The chunks are written once; each round sends back sums whose size is that of the model. Means start at spread quantiles of the columns.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    shares = [(k + 0.5) / states for k in range(states)]
    rows = df.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in columns), *(F.var_pop(c).alias(f"v_{c}") for c in columns)).first()
    model = Hmm(np.full(states, 1 / states), sticky(states, stay), np.array([[rows[c][k] for c in columns] for k in range(states)]), np.tile([max(rows[f"v_{c}"], floor) for c in columns], (states, 1)))
    schema = StructType([StructField("sums", ArrayType(DoubleType())), StructField("loglik", DoubleType())])
    width, before = len(columns), -math.inf
    squares = width if kind == "diag" else width * width
    if kind == "full":
        model.variance = np.array([np.diag(v) for v in model.variance])
    chunks = _chunks(df.select(sequence, "ts", *columns), columns, sequence)
    for _ in range(iterations):
        now = model

        def expect(rows: pd.DataFrame, enter: np.ndarray | None, leave: np.ndarray | None) -> pd.DataFrame:
            x = rows[columns].to_numpy(float)
            posterior, moves, score = now.passes(x, enter, leave)
            begins = posterior[0] * (enter is None)
            sums = [begins, moves.ravel(), posterior.sum(axis=0), (posterior.T @ x).ravel(), (posterior.T @ (x * x if kind == "diag" else (x[:, :, None] * x[:, None, :]).reshape(len(x), -1))).ravel()]
            return pd.DataFrame({"sums": [np.concatenate(sums).tolist()], "loglik": [score]})

        size = states + states * states + states + states * (width + squares)
        parts = _with_ends(chunks, now, columns, sequence, expect, schema)
        total = parts.agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)), F.sum("loglik").alias("loglik")).first()
        flat = np.array([total[f"s{i}"] for i in range(size)])
        start, moves, weight, first, second = np.split(flat, np.cumsum([states, states * states, states, states * width]))
        weight = np.maximum(weight, 1e-12)[:, None]
        mean = first.reshape(states, width) / weight
        second = second.reshape(states, squares) / weight
        if kind == "diag":
            variance = np.maximum(second - mean**2, floor)
        else:
            variance = second.reshape(states, width, width) - mean[:, :, None] * mean[:, None, :]
            low, axes = np.linalg.eigh((variance + variance.transpose(0, 2, 1)) / 2)
            variance = (axes * np.maximum(low, floor)[:, None, :]) @ axes.transpose(0, 2, 1)
        model = Hmm(start / start.sum(), (m := moves.reshape(states, states) + 1e-12) / m.sum(axis=1, keepdims=True), mean, variance)
        if total.loglik - before < tolerance:
            break
        before = total.loglik
    return model, total.loglik


def hmm_scores(loglik: float, states: int, features: int, n: int, entropy: float = 0.0, kind: str = "diag") -> dict[str, float]:
    """BIC, AIC, and ICL as BIC less twice the entropy."""
    free = hmm_parameters(states, features, kind)
    bic = -2 * loglik + free * math.log(n)
    return {"bic": bic, "aic": -2 * loglik + 2 * free, "icl": bic - 2 * entropy}


def hmm_states(df: DataFrame, model: Hmm, columns: list[str], sequence: str = "symbol") -> DataFrame:
    """``df`` (rows with all columns) with the likeliest state of each row and its posterior probabilities, of whole sequences in chunks."""
    k = len(model.start)
    kept = df.schema.fields
    schema = StructType([*kept, StructField("state", IntegerType()), *(StructField(f"p_state_{i}", DoubleType()) for i in range(k))])

    def run(rows: pd.DataFrame, enter: np.ndarray | None, leave: np.ndarray | None) -> pd.DataFrame:
        posterior = model.passes(rows[columns].to_numpy(float), enter, leave)[0]
        return rows.drop(columns="_chunk").assign(state=posterior.argmax(axis=1).astype("int32"), **{f"p_state_{i}": posterior[:, i] for i in range(k)})

    return _with_ends(_chunks(df, columns, sequence), model, columns, sequence, run, schema)


def select_states(df: DataFrame, columns: list[str], choices: list[int], criterion: str = "bic", kind: str = "diag") -> tuple[int, list[dict]]:
    """The number of states with the least criterion."""
    n = df.dropna(subset=columns).count()
    found = []
    for states in choices:
        model, loglik = fit_hmm(df, columns, states, kind=kind)
        found.append({"states": states, "loglik": loglik} | hmm_scores(loglik, states, len(columns), n, kind=kind))
    return min(found, key=lambda r: r[criterion])["states"], found
