"""An encoder of two modalities with attention, trained by full-batch gradient descent.

Each modality is seen over places and over features; attention weighs the two views,
then the two modalities.  What is decoded over places should be the input (two
losses), and a modality's code should survive decoding and encoding by the other (two more).

Graphs enter by products with vectors.  Those with the inputs are taken once; a step
takes one join forward (A C and A A L together) and one backward.  Gradients are
worked out by hand, in numpy, partition by partition, and added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .training import Log, Parameters, Patience, Run, descend, total, uniform_start

VIEWS = ("place1", "near1", "place2", "near2")
ATTENTIONS = ("first", "second", "cross")


def start(in1: int, in2: int, width: int, seed: int = 0) -> Parameters:
    """Parameters: encoders w1, w2, decoders d1, d2, and of each attention a matrix and a vector."""
    shapes = {"w1": (in1, width), "w2": (in2, width), "d1": (width, in1), "d2": (width, in2)}
    for a in ATTENTIONS:
        shapes |= {f"{a}_w": (width, width), f"{a}_u": (width, 1)}
    return uniform_start(shapes, seed)


def attend(a: np.ndarray, b: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Rows of a and b weighed by the softmax of tanh(x w) u, and what the way back needs."""
    va, vb = np.tanh(a @ w), np.tanh(b @ w)
    alpha = 1 / (1 + np.exp(np.clip(vb @ u - va @ u, -700, 700)))
    return alpha * a + (1 - alpha) * b, (a, b, va, vb, alpha)


def attended(d: np.ndarray, kept: tuple, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The way back through attend(): gradients of a, b, w and u."""
    a, b, va, vb, alpha = kept
    slope = alpha * (1 - alpha) * (d * (a - b)).sum(axis=1, keepdims=True)
    ga, gb = slope * u.T * (1 - va * va), -slope * u.T * (1 - vb * vb)
    return alpha * d + ga @ w.T, (1 - alpha) * d + gb @ w.T, a.T @ ga + b.T @ gb, va.T @ slope - vb.T @ slope


def codes(p: Parameters, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Both modalities' codes and the common one, from the inputs seen over the graphs."""
    one, kept1 = attend(x["place1"] @ p["w1"], x["near1"] @ p["w1"], p["first_w"], p["first_u"])
    two, kept2 = attend(x["place2"] @ p["w2"], x["near2"] @ p["w2"], p["second_w"], p["second_u"])
    both, kept = attend(one, two, p["cross_w"], p["cross_u"])
    return one, two, both, (kept1, kept2, kept)


def losses(p: Parameters, x1: np.ndarray, x2: np.ndarray, one: np.ndarray, two: np.ndarray, q: np.ndarray, t1: np.ndarray, t2: np.ndarray, n: int, weights: tuple[float, ...]) -> tuple[float, Parameters, tuple]:
    """Losses of rows, gradients of what decodes, and gradients of codes and of products with graphs.

    q is A C, t1 and t2 are A A L of each modality.  The mean is over all n rows.
    """
    s = [weights[0] / (n * x1.shape[1]), weights[1] / (n * x2.shape[1]), weights[2] / (n * one.shape[1]), weights[3] / (n * one.shape[1])]
    e1, e2 = q @ p["d1"] - x1, q @ p["d2"] - x2
    y1, y2 = t1 @ p["d2"], t2 @ p["d1"]
    c1, c2 = one - y1 @ p["w2"], two - y2 @ p["w1"]
    loss = s[0] * (e1 * e1).sum() + s[1] * (e2 * e2).sum() + s[2] * (c1 * c1).sum() + s[3] * (c2 * c2).sum()
    g1, g2, h1, h2 = 2 * s[0] * e1, 2 * s[1] * e2, 2 * s[2] * c1, 2 * s[3] * c2
    back1, back2 = -h1 @ p["w2"].T, -h2 @ p["w1"].T
    found = {"d1": q.T @ g1 + t2.T @ back2, "d2": q.T @ g2 + t1.T @ back1, "w1": -y2.T @ h2, "w2": -y1.T @ h1}
    return float(loss), found, (h1, h2, g1 @ p["d1"].T + g2 @ p["d2"].T, back1 @ p["d2"].T, back2 @ p["d1"].T)


def codes_back(p: Parameters, x: dict[str, np.ndarray], kept: tuple, d1: np.ndarray, d2: np.ndarray, d: np.ndarray) -> Parameters:
    """Gradients of encoders and attentions from those of the three codes."""
    a, b, found_w, found_u = attended(d, kept[2], p["cross_w"], p["cross_u"])
    out = {"cross_w": found_w, "cross_u": found_u}
    for name, side, g, k in (("first", "1", d1 + a, kept[0]), ("second", "2", d2 + b, kept[1])):
        place, near, out[f"{name}_w"], out[f"{name}_u"] = attended(g, k, p[f"{name}_w"], p[f"{name}_u"])
        out[f"w{side}"] = x[f"place{side}"].T @ place + x[f"near{side}"].T @ near
    return out


def _spread(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(cell, v): of vectors (cell, v of three times ``width`` numbers), w times the first third and w2 times the others, added up over edges (src, dst, w, w2)."""
    joined = edges.join(vectors.select(F.col("cell").alias("dst"), "v"), "dst")
    sums = [F.sum(F.col("w" if i < width else "w2") * F.get("v", i)) for i in range(3 * width)]
    return joined.groupBy(F.col("src").alias("cell")).agg(F.array(*sums).alias("v"))


def _stack(b: pd.DataFrame, c: str) -> np.ndarray:
    return np.stack(b[c].to_numpy())


class Encoder:
    """Trains and applies the encoder on cells with two modalities.

    features: two tables (cell, v) over the same cells; places and near: normalised graphs (src, dst, w) over places
    (one for both modalities) and over each modality's features.  Cells without an edge have zero products.
    """

    def __init__(self, features: tuple[DataFrame, DataFrame], places: DataFrame, near: tuple[DataFrame, DataFrame], width: int = 16, weights: tuple[float, ...] = (1.0, 5.0, 1.0, 1.0), seed: int = 0) -> None:
        one, two = features
        self.width, self.weights = width, weights
        sizes = [f.select(F.size("v")).first()[0] for f in features]
        self.start = start(*sizes, width, seed)
        table = one.select("cell", F.col("v").alias("x1")).join(two.select("cell", F.col("v").alias("x2")), "cell")
        for name, f, edges, size in (("place1", one, places, sizes[0]), ("near1", one, near[0], sizes[0]), ("place2", two, places, sizes[1]), ("near2", two, near[1], sizes[1])):
            joined = edges.join(f.select(F.col("cell").alias("dst"), "v"), "dst")
            seen = joined.groupBy(F.col("src").alias("cell")).agg(F.array(*[F.sum(F.col("w") * F.get("v", i)) for i in range(size)]).alias(name))
            table = table.join(seen, "cell", "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0.0), size)))
        self.cells = cut(table)
        self.n = self.cells.count()
        e = places.groupBy("src", "dst").agg(F.sum("w").alias("w"))
        twice = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("w").alias("v")), "dst").groupBy("src", F.col("far").alias("dst")).agg(F.sum(F.col("w") * F.col("v")).alias("w2"))
        self.edges = cut(e.join(twice, ["src", "dst"], "full").fillna(0.0, ["w", "w2"]).select("src", "dst", "w", "w2"))
        self.back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "w2")

    def _codes(self, p: Parameters) -> DataFrame:
        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    one, two, both, _ = codes(p, {c: _stack(b, c) for c in VIEWS})
                    yield pd.DataFrame({"cell": b["cell"], "v": list(np.hstack([both, one, two]))})

        return self.cells.select("cell", *VIEWS).mapInPandas(encode, "cell long, v array<double>")

    def gradient(self, p: Parameters) -> tuple[float, Parameters]:
        """The loss over all cells and its gradient."""
        k, n, weights = self.width, self.n, self.weights
        zeros = F.array_repeat(F.lit(0.0), 3 * k)
        seen = _spread(self.edges, self._codes(p), k)
        here = self.cells.join(seen.withColumnRenamed("v", "seen"), "cell", "left").withColumn("seen", F.coalesce("seen", zeros))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    one, two, _, _ = codes(p, {c: _stack(b, c) for c in VIEWS})
                    q, t1, t2 = np.split(_stack(b, "seen"), 3, axis=1)
                    loss, found, (h1, h2, *back) = losses(p, _stack(b, "x1"), _stack(b, "x2"), one, two, q, t1, t2, n, weights)
                    yield pd.DataFrame({"name": ["cell"] * len(b), "cell": b["cell"], "v": list(np.hstack([*back, h1, h2]))})
                    yield pd.DataFrame({"name": ["loss", *found], "cell": -1, "v": [np.array([loss]), *(g.reshape(-1) for g in found.values())]})

        judged = cut(here.mapInPandas(judge, "name string, cell long, v array<double>"))
        rows = judged.where("name = 'cell'")
        back = _spread(self.back, rows.select("cell", F.slice("v", 1, 3 * k).alias("v")), k)
        there = self.cells.select("cell", *VIEWS).join(rows.select("cell", F.slice("v", 3 * k + 1, 2 * k).alias("own")), "cell").join(back, "cell", "left").withColumn("v", F.coalesce("v", zeros))

        def encoders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            summed: dict[str, np.ndarray] = {}
            for b in batches:
                if len(b):
                    x = {c: _stack(b, c) for c in VIEWS}
                    d, d1, d2 = np.split(_stack(b, "v"), 3, axis=1)
                    h1, h2 = np.split(_stack(b, "own"), 2, axis=1)
                    for name, g in codes_back(p, x, codes(p, x)[3], d1 + h1, d2 + h2, d).items():
                        summed[name] = summed.get(name, 0) + g
            if summed:  # a column without rows has no arrays
                yield pd.DataFrame({"name": list(summed), "v": [g.reshape(-1) for g in summed.values()]})

        parts = there.mapInPandas(encoders, "name string, v array<double>").unionAll(judged.where("name <> 'cell'").select("name", "v"))
        found = total(parts, ["loss", *p])
        return float(found.pop("loss")[0]), {name: found[name].reshape(p[name].shape) for name in p}

    def train(self, steps: int = 200, rate: float = 1e-3, decay: float = 0.0, patience: Patience | None = None, log: Log | None = None, every: int = 10) -> Run:
        """Descends from the start, or from where the log ends."""
        return descend(self.gradient, self.start, steps, rate, decay, patience, log, every)

    def encoded(self, p: Parameters) -> DataFrame:
        """(cell, v): the common codes at unit length (zeros stay)."""
        k = self.width
        both = F.slice("v", 1, k)
        norm = F.sqrt(F.aggregate(both, F.lit(0.0), lambda t, x: t + x * x))
        return self._codes(p).select("cell", F.transform(both, lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("v"))


def imputed(p: Parameters, known: DataFrame, missing: int, places: DataFrame, near: DataFrame) -> DataFrame:
    """(cell, v): the features of modality ``missing`` (1 or 2) for cells that have only the other, ``known`` (cell, v).

    The cells' graphs over places and over the known features stand in for those of
    training.  With one modality the common code is that modality's; it is decoded over places.
    """
    side, name = (2, "second") if missing == 1 else (1, "first")
    w, d = p[f"w{side}"], p[f"d{missing}"]
    size, width = w.shape

    def seen(edges: DataFrame, rows: DataFrame, many: int) -> DataFrame:
        joined = edges.join(rows.select(F.col("cell").alias("dst"), "v"), "dst")
        sums = joined.groupBy(F.col("src").alias("cell")).agg(F.array(*[F.sum(F.col("w") * F.get("v", i)) for i in range(many)]).alias("v"))
        return rows.select("cell").join(sums, "cell", "left").select("cell", F.coalesce("v", F.array_repeat(F.lit(0.0), many)).alias("v"))

    both = seen(places, known, size).join(seen(near, known, size).withColumnRenamed("v", "u"), "cell")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                code, _ = attend(_stack(b, "v") @ w, _stack(b, "u") @ w, p[f"{name}_w"], p[f"{name}_u"])
                yield pd.DataFrame({"cell": b["cell"], "v": list(code)})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell": b["cell"], "v": list(_stack(b, "v") @ d)})

    code = both.mapInPandas(encode, "cell long, v array<double>")
    return seen(places, code, width).mapInPandas(decode, "cell long, v array<double>")
