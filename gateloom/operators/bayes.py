"""A Gaussian mixture under a Dirichlet process, fitted by variational inference to all rows.

The process is truncated at a number of components; those that the data don't need lose their weight. Each round is one aggregation: every batch of rows gives, for each component, the
sums of its responsibilities, of the values and of their products under them. From these sums, of a size that depends on components and features alone, the driver updates sticks (beta), means (normal) and
precisions (Wishart). The rows are read once a round, and no row leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.core.shared import Stages


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to 8 and more, then its asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = out - np.where(small, 1 / np.where(small, x, 1), 0)
        x = np.where(small, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


lgamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass
class Sums:
    """Of each component: responsibility n, values x (n by features), products xx; and the sum of r log r."""

    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    entropy: float

    def flat(self) -> np.ndarray:
        return np.concatenate([self.n, self.x.ravel(), self.xx.ravel(), [self.entropy]])

    @staticmethod
    def of(flat: np.ndarray, k: int, d: int) -> Sums:
        a, b = k, k + k * d
        return Sums(flat[:a], flat[a:b].reshape(k, d), flat[b : b + k * d * d].reshape(k, d, d), float(flat[-1]))


@dataclass
class Mixture:
    """The posterior: sticks (a, b), means, their precision factors, degrees of freedom and covariances of components."""

    stick_a: np.ndarray
    stick_b: np.ndarray
    kappa: np.ndarray
    mean: np.ndarray
    dof: np.ndarray
    covariance: np.ndarray
    bound: float = -math.inf

    def log_weights(self) -> np.ndarray:
        total = digamma(self.stick_a + self.stick_b)
        return digamma(self.stick_a) - total + np.r_[0, np.cumsum(digamma(self.stick_b) - total)[:-1]]

    def weights(self) -> np.ndarray:
        """Expected shares."""
        rest = self.stick_b / (self.stick_a + self.stick_b)
        w = self.stick_a / (self.stick_a + self.stick_b) * np.r_[1, np.cumprod(rest)[:-1]]
        return w / w.sum()

    def roots(self) -> list[np.ndarray]:
        """For each component the upper triangular matrix whose product with itself is its precision."""
        return [np.linalg.inv(np.linalg.cholesky(c)).T for c in self.covariance]

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """log of weight times density, expected under the posterior, by row and component."""
        d = x.shape[1]
        out = np.empty((len(x), len(self.kappa)))
        half = np.arange(d)
        for k, root in enumerate(self.roots()):
            z = x @ root - self.mean[k] @ root
            gauss = np.log(np.diag(root)).sum() - 0.5 * (d * math.log(2 * math.pi) + (z * z).sum(1)) - 0.5 * d * math.log(self.dof[k])
            lam = d * math.log(2) + digamma(0.5 * (self.dof[k] - half)).sum()
            out[:, k] = gauss + 0.5 * (lam - d / self.kappa[k])
        return out + self.log_weights()

    def log_responsibilities(self, x: np.ndarray) -> np.ndarray:
        p = self.log_densities(x)
        top = p.max(axis=1, keepdims=True)
        return p - top - np.log(np.exp(p - top).sum(axis=1, keepdims=True))


@dataclass
class Prior:
    alpha: float
    mean: np.ndarray
    kappa: float
    dof: float
    covariance: np.ndarray
    ridge: float

    def posterior(self, s: Sums) -> Mixture:
        """The update of all parameters from one round's sums."""
        d = len(self.mean)
        n = s.n + 10 * np.finfo(float).eps
        x = s.x / n[:, None]
        within = s.xx / n[:, None, None] - x[:, :, None] * x[:, None, :] + self.ridge * np.eye(d)
        kappa, dof = self.kappa + n, self.dof + n
        off = x - self.mean
        spread = self.covariance + n[:, None, None] * within + (n * self.kappa / kappa)[:, None, None] * off[:, :, None] * off[:, None, :]
        out = Mixture(1 + n, self.alpha + np.r_[np.cumsum(n[::-1])[-2::-1], 0], kappa, (self.kappa * self.mean + n[:, None] * x) / kappa[:, None], dof, spread / dof[:, None, None])
        roots = out.roots()
        half = np.arange(d)[:, None]
        root_log = np.array([np.log(np.diag(r)).sum() for r in roots]) - 0.5 * d * np.log(dof)
        wishart = -(dof * root_log + dof * d * 0.5 * math.log(2) + lgamma(0.5 * (dof - half)).sum(0))
        beta = (lgamma(out.stick_a) + lgamma(out.stick_b) - lgamma(out.stick_a + out.stick_b)).sum()
        out.bound = float(-s.entropy - wishart.sum() + beta - 0.5 * d * np.log(kappa).sum())
        return out


def vectors_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype(float)


def sums_of(x: np.ndarray, log_r: np.ndarray) -> Sums:
    r = np.exp(log_r)
    return Sums(r.sum(0), r.T @ x, np.stack([(x * r[:, k : k + 1]).T @ x for k in range(r.shape[1])]), float((r * np.where(r > 0, log_r, 0)).sum()))


def aggregated(rows: DataFrame, names: Sequence[str], k: int, responsibilities, extra: Sequence[str] = ()) -> Sums:
    """One round's sums over all rows; responsibilities makes log responsibilities of a matrix and, if asked for, a batch's extra columns."""
    names, d = list(names), len(names)

    def part(batches):
        total = np.zeros(k + k * d + k * d * d + 1)
        for b in batches:
            x = vectors_of(b, names)
            total += sums_of(x, responsibilities(x, b)).flat()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    found = rows.select(*names, *extra).mapInArrow(part, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas().sort_values("cell")
    return Sums.of(found["v"].to_numpy(float) if len(found) else np.zeros(k + k * d + k * d * d + 1), k, d)


def fit(rows: DataFrame, names: Sequence[str], k: int, rounds: int = 200, least: float = 1e-5, ridge: float = 1e-4, start: str | None = None, seed: int = 42) -> Mixture:
    """The posterior from rows (no nulls among names); k is the truncation. start: a column with a first component of each row, else k-means gives one.

    Priors: concentration 1 / k, the data's mean with factor 1, as many degrees of freedom as features, the data's covariance. It ends when the bound changes by less than least a row.
    """
    d = len(names)
    m = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    mean = np.array([m[f"m{i}"] for i in range(d)])
    spread = np.array([[m[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]).reshape(d, d)
    prior = Prior(1 / k, mean, 1.0, float(d), spread + (0 if np.linalg.matrix_rank(spread) == d else ridge * np.eye(d)), ridge)
    if start is None:
        v = VectorAssembler(inputCols=list(names), outputCol="_v").transform(rows)
        rows, start = KMeans(featuresCol="_v", predictionCol="_start", k=k, seed=seed).fit(v).transform(v).drop("_v"), "_start"

    def first(x, b):
        out = np.full((len(x), k), -np.inf)
        out[np.arange(len(x)), b.column(start).to_numpy(zero_copy_only=False)] = 0
        return out

    with np.errstate(divide="ignore"):
        model = prior.posterior(aggregated(rows, names, k, first, [start]))
    bound = -math.inf
    for _ in range(rounds):
        model = prior.posterior(aggregated(rows, names, k, lambda x, b, model=model: model.log_responsibilities(x)))
        if abs(model.bound - bound) < least * m["n"]:
            break
        bound = model.bound
    return model


def assigned(rows: DataFrame, names: Sequence[str], model: Mixture, keys: Sequence[str]) -> DataFrame:
    """keys, component, confidence: the likeliest component of each row and its probability."""
    names, keys = list(names), list(keys)

    def run(batches):
        for b in batches:
            r = model.log_responsibilities(vectors_of(b, names))
            best = r.argmax(1) if len(r) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(best.astype(np.int32)), pa.array(np.exp(r[np.arange(len(r)), best]))], names=[*keys, "component", "confidence"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.select(*dict.fromkeys([*keys, *names])).mapInArrow(run, f"{kinds}, component int, confidence double")


def process_clusters(events: DataFrame, features: Sequence[str], k: int, keys: Sequence[str] = ("row_index",), rounds: int = 200, seed: int = 42) -> DataFrame:
    """keys, label, confidence: 2 k components at most (no more than a twentieth of the rows, 2 at least); labels of those that got rows count from 0. Rows with a null or NaN feature are left out."""
    stages = Stages(events.sparkSession)
    rows = events.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).filter(F.forall(F.array(*features), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    rows = stages.store(rows, "mixture-rows")
    n = rows.count()
    if n < 2:
        return rows.select(*keys, F.lit(0).alias("label"), F.lit(1.0).alias("confidence"))
    found = assigned(rows, features, fit(rows, features, min(2 * k, max(2, n // 20)), rounds, seed=seed), keys)
    used = sorted(r["component"] for r in found.select("component").distinct().collect())  # 2 k numbers at most
    label = F.array_position(F.array(*map(F.lit, used)), F.col("component")).cast("int") - 1
    return found.select(*keys, label.alias("label"), "confidence")
