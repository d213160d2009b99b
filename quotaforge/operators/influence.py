"""Expected influence on validation loss: a linear softmax head, its temperature, the validation gradient, and candidates' utilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import coin


@dataclass
class Head:
    """Weights (classes x features), biases and temperature."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_head(rows: DataFrame, features: str, label: str, l2: float, weight: str | None = None, classes: int = 0) -> Head:
    """Mean negative log likelihood plus l2/2 of the squared weights, biases free; fitted by Spark's own distributed solver.

    The head knows at least `classes` classes; those beyond the largest label in `rows` get next to no probability.
    """
    named = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    model = LogisticRegression(family="multinomial", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-6, weightCol="weight").fit(named)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    more = max(0, classes - len(bias))
    return Head(np.vstack([weights, np.zeros((more, weights.shape[1]))]), np.concatenate([bias, np.full(more, bias.min() - 30.0)]))


def calibrated(head: Head, rows: DataFrame, features: str, label: str, points: int = 121) -> Head:
    """`head` with the temperature in [0.05, 20] of least loss on `rows`: all temperatures of a log grid in one scan.

    Fewer than four rows or two labels say nothing about it: the temperature is then 1.
    """
    has = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels")).first()
    if has["n"] < 4 or has["labels"] < 2:
        return Head(head.weights, head.bias)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), points))

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for b in batches:
            if len(b):
                z = head.logits(np.array(b["x"].tolist())) / grid[:, None, None]
                top = z.max(2)
                total += (np.log(np.exp(z - top[..., None]).sum(2)) + top - z[:, np.arange(len(b)), b["y"]]).sum(1)
        yield pd.DataFrame({"t": range(points), "loss": total})

    found = _xy(rows, features, label).mapInPandas(losses, "t int, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).orderBy("loss", "t").limit(1).first()
    return Head(head.weights, head.bias, float(grid[found["t"]]) if found else 1.0)


def feature_scale(rows: DataFrame, features: str, centre: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean (0 unless `centre`) and root mean square about it of each feature, in one scan of JVM vector sums.

    A scale below a tenth of the median of those above 1e-8 (1e-6 at least) is raised to
    that floor; where none is above 1e-8, all scales are at least 1.
    """
    named = rows.filter(F.col(features).isNotNull()).select(array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    if named.isEmpty():
        return np.zeros(0), np.zeros(0)
    row = named.select(Summarizer.metrics("count", "mean", "variance", "normL2").summary(F.col("v")).alias("s")).select("s.*").first()
    n, mean = row["count"], row["mean"].toArray()
    squares = row["variance"].toArray() * (n - 1) / n if centre else row["normL2"].toArray() ** 2 / n
    scale = np.sqrt(np.maximum(squares, 0.0))
    seen = scale[scale > 1e-8]
    return (mean if centre else np.zeros(len(mean))), np.maximum(scale, max(1e-6, float(np.median(seen)) * 0.1) if len(seen) else 1.0)


def scaled(rows: DataFrame, features: str, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """`rows` with `features` less the mean, over the scale, as doubles."""
    fixed = lambda v: F.lit(np.asarray(v, dtype=np.float64))
    less = F.zip_with(F.col(features).cast("array<double>"), fixed(mean), lambda x, m: x - m)
    return rows.withColumn(features, F.zip_with(less, fixed(scale), lambda x, s: x / s))


def _xy(rows: DataFrame, features: str, label: str) -> DataFrame:
    return rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))


def mean_gradient(head: Head, rows: DataFrame, features: str, label: str) -> np.ndarray:
    """Mean gradient of the loss at temperature over labelled rows, biases last: classes x (features + 1) sums leave a task."""
    shape = (len(head.bias), head.weights.shape[1] + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(shape), 0
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist())
                off = head.probabilities(x) - np.eye(shape[0])[b["y"]]
                total += off.T @ np.hstack([x, np.ones((len(x), 1))]) / head.temperature
                n += len(b)
        yield pd.DataFrame({"k": range(-1, total.size), "v": [float(n), *total.ravel()]})

    found = _xy(rows, features, label).mapInPandas(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().set_index("k")["v"].reindex(range(-1, shape[0] * shape[1]), fill_value=0.0)
    return found.iloc[1:].to_numpy().reshape(shape) / max(found.iloc[0], 1.0)


def expected_influence(head: Head, gradient: np.ndarray, rows: DataFrame, id_: str, features: str, cost: str | None = None) -> DataFrame:
    """(id, utility, influences): per label the inner product of the validation gradient and the row's own, and the
    mean under the head's posterior of its positive part, over cost. Labels of candidates are never read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist())
                p = head.probabilities(x)
                along = np.hstack([x, np.ones((len(x), 1))]) @ gradient.T
                gain = ((p * along).sum(1, keepdims=True) - along) / head.temperature
                yield pd.DataFrame({"id": b["id"], "utility": (p * np.maximum(0, gain)).sum(1) / b["cost"], "influences": gain.tolist()})

    named = rows.select(F.col(id_).cast("string").alias("id"), F.col(features).cast("array<double>").alias("x"), (F.col(cost).cast("double") if cost else F.lit(1.0)).alias("cost"))
    return named.mapInPandas(run, "id string, utility double, influences array<double>")


def choose_l2(fit: DataFrame, calibration: DataFrame, features: str, label: str, grid: list[float]) -> tuple[Head, float]:
    """The head, and its l2, of least loss on `calibration` (ties: the larger l2); without calibration rows the l2 nearest to 1 by logarithm."""
    if calibration.isEmpty():
        l2 = min(sorted(grid, reverse=True), key=lambda v: abs(np.log10(v)))
        return fit_head(fit, features, label, l2), l2
    best = None
    for l2 in sorted(grid, reverse=True):
        head = fit_head(fit, features, label, l2)
        loss = mean_loss(head, calibration, features, label)
        if best is None or loss < best[0] - 1e-12:
            best = (loss, head, l2)
    return best[1], best[2]


def mean_loss(head: Head, rows: DataFrame, features: str, label: str) -> float:
    """Mean negative log likelihood at temperature."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = head.probabilities(np.array(b["x"].tolist()))
                yield pd.DataFrame({"n": [len(b)], "loss": [-np.log(np.maximum(p[np.arange(len(b)), b["y"]], 1e-300)).sum()]})

    row = _xy(rows, features, label).mapInPandas(sums, "n long, loss double").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).first()
    return row["loss"] / row["n"] if row["n"] else 0.0


def bootstrap_heads(fit: DataFrame, calibration: DataFrame, id_: str, features: str, label: str, l2: float, heads: int, seed: int) -> list[Head]:
    """Calibrated heads of seeded resamples: every row weighs a Poisson(1) number of times, drawn from a hash of its id, so nothing is shuffled."""
    classes = 1 + int(fit.unionByName(calibration).agg(F.max(label)).first()[0])
    law = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 9)]))
    out = []
    for k in range(heads):
        u = coin(seed, F.lit(k), F.col(id_))
        weighed = fit.withColumn("_w", sum((F.when(u >= float(c), 1.0).otherwise(0.0) for c in law), F.lit(0.0))).filter("_w > 0")
        out.append(calibrated(fit_head(weighed, features, label, l2, "_w", classes), calibration, features, label))
    return out


def posterior(head: Head, heads: list[Head], rows: DataFrame, id_: str, features: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(id, p, lower, upper): probabilities by `head` and their quantiles over `heads`; without heads the bounds are 0 and 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist())
                p = head.probabilities(x)
                every = np.stack([h.probabilities(x) for h in heads]) if heads else np.stack([np.zeros_like(p), np.ones_like(p)])
                lo, hi = np.quantile(every, [low, high] if heads else [0.0, 1.0], axis=0)
                yield pd.DataFrame({"id": b["id"], "p": p.tolist(), "lower": lo.tolist(), "upper": hi.tolist()})

    named = rows.select(F.col(id_).cast("string").alias("id"), F.col(features).cast("array<double>").alias("x"))
    return named.mapInPandas(run, "id string, p array<double>, lower array<double>, upper array<double>")


def pair_features(a: Column, b: Column, gap: Column) -> tuple[Column, Column]:
    """Direction features (difference of two responses' vectors, then their length gap), and trainability features (their absolute values)."""
    direction = F.concat(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.array(gap.cast("double")))
    return direction, F.transform(direction, F.abs)


def pair_posterior(direction: DataFrame, trainable: DataFrame) -> DataFrame:
    """(id, p, lower, upper) over tie, B, A: which response wins (B, A) times whether any does (tie, some), both from `posterior`.

    Bounds multiply as intervals of independent factors; the bounds of a tie are the complements.
    """
    names = {c: c for c in ("p", "lower", "upper")}
    both = direction.select("id", *[F.col(c).alias(f"d_{n}") for n, c in names.items()]).join(trainable.select("id", *[F.col(c)[1].alias(f"t_{n}") for n, c in names.items()]), "id")
    tie = {"p": 1 - F.col("t_p"), "lower": F.greatest(F.lit(0.0), 1 - F.col("t_upper")), "upper": F.least(F.lit(1.0), 1 - F.col("t_lower"))}
    return both.select("id", *[F.array(tie[n], F.col(f"t_{n}") * F.col(f"d_{n}")[0], F.col(f"t_{n}") * F.col(f"d_{n}")[1]).alias(n) for n in names])


def pair_influence(direction_utility: DataFrame, trainable: DataFrame) -> DataFrame:
    """(id, utility): the direction head's expected influence times the probability that a response wins at all."""
    gate = trainable.select("id", F.col("p")[1].alias("_some"))
    return direction_utility.join(gate, "id").select("id", (F.col("utility") * F.col("_some")).alias("utility"))
