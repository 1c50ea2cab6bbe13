"""Gradient descent on a few parameters whose gradients are sums over partitions, with a log that runs resume from.

Parameters are small arrays on the driver; a model's gradient function is a Spark job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

Parameters = dict[str, np.ndarray]


def flat(p: Parameters) -> np.ndarray:
    """All numbers of the parameters, by name."""
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)]) if p else np.zeros(0)


def shaped(numbers: np.ndarray, like: Parameters) -> Parameters:
    """Numbers in the shapes of ``like``."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.asarray(numbers[at : at + like[k].size], float).reshape(like[k].shape)
        at += like[k].size
    return out


def uniform_start(shapes: dict[str, tuple[int, int]], seed: int = 0) -> Parameters:
    """Matrices drawn evenly from within the root of 6 over rows plus columns; the same for the same names and seed."""
    dice = np.random.default_rng(seed)
    return {k: dice.uniform(-1, 1, shapes[k]) * np.sqrt(6 / sum(shapes[k])) for k in sorted(shapes)}


class Patience:
    """Says when a loss has not fallen by ``delta`` for ``patience`` steps in a row."""

    def __init__(self, patience: int = 10, delta: float = 1e-4) -> None:
        self.patience, self.delta, self.best, self.waited = patience, delta, np.inf, 0

    def over(self, loss: float) -> bool:
        """Takes the next loss; whether to stop."""
        if self.best - loss < self.delta:
            self.waited += 1
        else:
            self.best, self.waited = loss, 0
        return self.waited >= self.patience


@dataclass
class Run:
    """Where a descent stands: step, parameters, moments, losses so far."""

    parameters: Parameters
    step: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))
    second: np.ndarray = field(default_factory=lambda: np.zeros(0))
    losses: list[float] = field(default_factory=list)


class Log:
    """A folder, shared by driver and cluster, with a file of losses, parameters and moments for each step that was written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, run: Run) -> None:
        """Adds the run's last step; the file appears whole or not at all."""
        row = (run.step, [float(x) for x in run.losses], flat(run.parameters).tolist(), run.first.tolist(), run.second.tolist())
        self.spark.createDataFrame([row], "step long, losses array<double>, numbers array<double>, first array<double>, second array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/step={run.step}")

    def last(self, like: Parameters) -> Run | None:
        """The run as of the last step that was written whole, if any."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        steps = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder) if s.getPath().getName().startswith("step=")]
        for step in sorted(steps, reverse=True):
            if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/step={step}/_SUCCESS")):
                row = self.spark.read.parquet(f"{self.path}/step={step}").select("losses", "numbers", "first", "second").first()
                return Run(shaped(np.array(row["numbers"]), like), step, np.array(row["first"]), np.array(row["second"]), list(row["losses"]))
        return None


def descend(gradient: Callable[[Parameters], tuple[float, Parameters]], start: Parameters, steps: int, rate: float = 1e-3, decay: float = 0.0, patience: Patience | None = None, log: Log | None = None, every: int = 10) -> Run:
    """Adam from ``start``: ``gradient`` gives the loss and its gradient.

    With a log, the state is written every ``every`` steps and at the end, and a run that
    finds a log goes on from its last step: a run that was killed and started again
    ends as one that was not.  Weight decay adds decay times the parameter to its gradient.
    """
    run = (log.last(start) if log else None) or Run({k: v.astype(float) for k, v in start.items()})
    if not len(run.first):
        run.first, run.second = np.zeros_like(flat(start)), np.zeros_like(flat(start))
    if patience:
        for loss in run.losses:
            if patience.over(loss):
                return run
    written = run.step
    while run.step < steps:
        loss, found = gradient(run.parameters)
        g = flat(found) + decay * flat(run.parameters)
        run.step += 1
        run.first = 0.9 * run.first + 0.1 * g
        run.second = 0.999 * run.second + 0.001 * g * g
        move = rate * (run.first / (1 - 0.9**run.step)) / (np.sqrt(run.second / (1 - 0.999**run.step)) + 1e-8)
        run.parameters = shaped(flat(run.parameters) - move, start)
        run.losses.append(float(loss))
        if log and run.step % every == 0:
            log.write(run)
            written = run.step
        if patience and patience.over(loss):
            break
    if log and run.step > written:
        log.write(run)
    return run


def total(rows, names: list[str]) -> dict[str, np.ndarray]:
    """Sums by name of rows (name, v) with vectors of equal length a name: added where they are, and one a name arrives."""
    found = rows.select("name", F.posexplode("v").alias("at", "x")).groupBy("name", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[str, dict[int, float]] = {k: {} for k in names}
    for r in found:
        out[r["name"]][r["at"]] = r["x"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}
