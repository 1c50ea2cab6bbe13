"""Sparse variational Gaussian processes over places: posteriors, bounds, prediction at unseen places.

A process has m inducing points.  A pass over the known places adds up their kernel
products in each partition; what reaches the driver is m by m for an output,
whatever the number of places.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import neighbours, reduce

#: Places whose kernel products are held at once in a task.
STRIPE = 4096


def covariance(kind: str, a: np.ndarray, b: np.ndarray, s: float) -> np.ndarray:
    """A covariance function between rows of a and of b: eq, cauchy, laplacian, matern12, matern32, matern52."""
    square = np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)
    r = np.sqrt(square) / s
    return {
        "eq": lambda: np.exp(-square / s), "cauchy": lambda: 1 / (1 + square / s), "laplacian": lambda: np.exp(-np.abs(a[:, None, :] - b[None]).sum(axis=2) / s),
        "matern12": lambda: np.exp(-r), "matern32": lambda: (1 + 3**0.5 * r) * np.exp(-(3**0.5) * r), "matern52": lambda: (1 + 5**0.5 * r + 5 / 3 * r * r) * np.exp(-(5**0.5) * r),
    }[kind]()


def grid_of(places: DataFrame, steps: int) -> np.ndarray:
    """A grid of steps by steps points over the extent of places (cell, v of two numbers)."""
    low_x, high_x, low_y, high_y = places.agg(*[f(F.get("v", i)) for i in (0, 1) for f in (F.min, F.max)]).first()
    at = lambda low, high: np.linspace(low, high, steps)
    return np.array([(x, y) for x in at(low_x, high_x) for y in at(low_y, high_y)])


class SparseProcess:
    """A Gaussian process for each output of (cell, v, y, noise): y and noise hold a number, and its variance, an output.

    With K between inducing points, k to them from a place and precision 1 / noise:
    S = K + sum of k k' / noise, the mean at a place is k' S^-1 sum of k y / noise, its
    variance k(x, x) - k' (K^-1 - S^-1) k.
    """

    def __init__(self, inducing: np.ndarray, kind: str = "cauchy", scale: float = 1.0, jitter: float = 1e-8) -> None:
        self.inducing, self.kind, self.scale, self.jitter = np.asarray(inducing, float), kind, float(scale), float(jitter)
        self.k_mm = covariance(kind, self.inducing, self.inducing, self.scale)
        self.inner, self.right = np.zeros((0, 0, 0)), np.zeros((0, 0))

    def _safe(self, m: np.ndarray) -> np.ndarray:
        return m + self.jitter * np.eye(len(m))

    def _stripes(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Kernels to the inducing points, values and precisions, some places at a time."""
        for b in batches:
            for low in range(0, len(b), STRIPE):
                part = b.iloc[low : low + STRIPE]
                v, y, noise = (np.stack(part[c].to_numpy()) for c in ("v", "y", "noise"))
                yield covariance(self.kind, v, self.inducing, self.scale), y, 1 / noise

    def fit(self, known: DataFrame) -> SparseProcess:
        """Adds up the known places; a noise that isn't above 0 is an error."""
        if known.where(F.exists("noise", lambda x: ~(x > 0)) | (F.size("noise") != F.size("y"))).limit(1).count():
            raise ValueError("every value needs a variance above 0")
        m, me = len(self.inducing), self

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for k, y, precision in me._stripes(batches):
                part = np.stack([np.column_stack([(k * precision[:, i, None]).T @ k, k.T @ (y[:, i] * precision[:, i])]) for i in range(y.shape[1])])
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"v": [total.reshape(-1)]})

        total = reduce.added(known.select("v", "y", "noise").mapInPandas(add, "v array<double>"))
        total = total.reshape(-1, m, m + 1)
        self.inner, self.right = total[:, :, :m], total[:, :, m]
        return self

    def _solved(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the mean, the matrices of the variance, and S^-1, an output each."""
        inverse = np.linalg.inv(self._safe(self.k_mm))
        s = np.array([np.linalg.inv(self._safe(self.k_mm + x)) for x in self.inner]).reshape(-1, *self.k_mm.shape)
        return np.einsum("lij,lj->li", s, self.right), inverse - s, s

    def predict(self, places: DataFrame) -> DataFrame:
        """(cell, mean, var) at places (cell, v), an entry an output."""
        weights, spread, _ = self._solved()
        kind, inducing, scale = self.kind, self.inducing, self.scale

        def at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for low in range(0, len(b), STRIPE):
                    part = b.iloc[low : low + STRIPE]
                    k = covariance(kind, np.stack(part["v"].to_numpy()), inducing, scale)
                    yield pd.DataFrame({"cell": part["cell"], "mean": list(k @ weights.T.reshape(k.shape[1], len(spread))), "var": list(np.array([1 - ((k @ x) * k).sum(axis=1) for x in spread]).reshape(len(spread), len(k)).T)})

        return places.select("cell", "v").mapInPandas(at, "cell long, mean array<double>, var array<double>")

    def posterior(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the values at the inducing points, an output each."""
        weights, _, s = self._solved()
        return weights @ self.k_mm, np.array([self.k_mm @ x @ self.k_mm for x in s])

    def bound(self, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The evidence's lower bound an output: the expected log likelihood of the known places, and the divergence to be subtracted."""
        mean, cov = self.posterior()
        inverse = np.linalg.inv(self._safe(self.k_mm))
        me = self

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(mean))
            for k, y, precision in me._stripes(batches):
                a = k @ inverse
                left = 1 - (a * k).sum(axis=1)
                for i in range(len(mean)):
                    p = precision[:, i]
                    spread = ((a @ cov[i]) * a).sum(axis=1)
                    total[i] += -0.5 * (p * left + p * spread - np.log(p) + math.log(2 * math.pi) + p * (y[:, i] - a @ mean[i]) ** 2).sum()
            yield pd.DataFrame({"v": [total]})

        likely = reduce.added(known.select("v", "y", "noise").mapInPandas(add, "v array<double>"))
        log_k = np.linalg.slogdet(self._safe(self.k_mm))[1]
        apart = [0.5 * (log_k - np.linalg.slogdet(self._safe(c))[1] - len(m) + np.trace(inverse @ c) + m @ inverse @ m) for m, c in zip(mean, cov, strict=True)]
        return likely, np.array(apart)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes what was learned as a line of numbers."""
        held = {"kind": self.kind, "scale": self.scale, "jitter": self.jitter, **{name: getattr(self, name).tolist() for name in ("inducing", "inner", "right")}}
        spark.createDataFrame([(json.dumps(held),)], "process string").write.mode("overwrite").text(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SparseProcess:
        """What ``save`` wrote."""
        held = json.loads(spark.read.text(path).first()["value"])
        found = cls(np.array(held["inducing"]), held["kind"], held["scale"], held["jitter"])
        found.inner, found.right = np.array(held["inner"]), np.array(held["right"])
        return found


def best_scale(known: DataFrame, inducing: np.ndarray, scales: list[float], kind: str = "cauchy", jitter: float = 1e-8) -> SparseProcess:
    """The process whose scale has the greatest bound over all outputs, the first of equals."""
    fits = [SparseProcess(inducing, kind, s, jitter).fit(known) for s in scales]
    bounds = [float(np.subtract(*p.bound(known)).sum()) for p in fits]
    return fits[int(np.argmax(bounds))]


class Balance:
    """The weight of a divergence, steered so that the divergence comes near a wanted value: an incremental proportional and integral control."""

    def __init__(self, wanted: float, proportional: float = 0.01, integral: float = -0.005, start: float = 10.0, least: float = 4.0, most: float = 25.0) -> None:
        self.wanted, self.proportional, self.integral, self.least, self.most = wanted, proportional, integral, least, most
        self.weight, self.error = start, 0.0

    def step(self, divergence: float) -> float:
        """The weight after a divergence was seen; errors count five times, and below the least weight nothing is integrated."""
        soft = lambda e: 1 / (1 + math.exp(min(e, 700.0)))
        error = 5 * (self.wanted - divergence)
        step = self.proportional * (soft(error) - soft(self.error)) + (0.0 if self.weight < self.least else self.integral * error)
        self.weight, self.error = self.weight + step, error
        return min(max(self.weight, self.least), self.most)


def latents_at(process: SparseProcess, known: DataFrame, places: DataFrame) -> DataFrame:
    """(cell, v, var): latent numbers of unseen places (cell, v).

    The first come from the process, one an output; the rest are those of the nearest known
    place, from known (cell, v, z, spread), whose z and spread go on after the outputs.
    """
    outputs = len(process.right)
    near = neighbours.knn(places, known.select("cell", "v"), 1).select(F.col("src").alias("cell"), "dst")
    rest = near.join(known.select(F.col("cell").alias("dst"), "z", "spread"), "dst")
    tail = lambda c: F.slice(c, outputs + 1, F.greatest(F.size(c) - outputs, F.lit(0)))
    return process.predict(places).join(rest, "cell").select("cell", F.concat("mean", tail("z")).alias("v"), F.concat("var", tail("spread")).alias("var"))


class LinearDecoder:
    """Counts of features as linear functions of latent numbers, by least squares; features stay a table.

    A linear stand-in for decoders with hidden layers: it is fitted exactly, not trained.
    """

    #: Features whose coefficients meet a cell at once.
    BLOCK = 1024

    def __init__(self, ridge: float = 1e-6) -> None:
        self.ridge, self.table = ridge, None

    def fit(self, latents: DataFrame, counts: DataFrame) -> LinearDecoder:
        """From latents (cell, v) and counts (cell, feature, x) of the same cells; absent counts are zeros."""
        with_one = latents.select("cell", F.concat(F.col("v"), F.array(F.lit(1.0))).alias("v"))
        _, _, g = reduce.moments(with_one)
        width = len(g)
        inverse = np.linalg.inv(g + self.ridge * np.eye(width))
        sums = counts.join(with_one, "cell").groupBy("feature").agg(F.array(*[F.sum(F.col("x") * F.get("v", i)) for i in range(width)]).alias("v"))
        self.table = cut(reduce.turned(sums, inverse, "feature"))
        return self

    def decode(self, latents: DataFrame) -> DataFrame:
        """(cell, feature, x): every feature of every cell, dense as asked for; below 0 is 0."""
        blocks = -(-self.table.count() // self.BLOCK) or 1
        held = self.table.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("feature", F.col("v").alias("b"))).alias("held"))
        spread = latents.select("cell", F.concat(F.col("v"), F.array(F.lit(1.0))).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        told = spread.join(held, "block").select("cell", "v", F.explode("held").alias("h"))
        dot = F.aggregate(F.zip_with("v", F.col("h.b"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        return told.select("cell", F.col("h.feature").alias("feature"), F.greatest(dot, F.lit(0.0)).alias("x"))
