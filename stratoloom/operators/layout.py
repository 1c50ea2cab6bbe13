"""Layouts in two dimensions: fuzzy neighbour weights, a spectral start, edge-sampled gradient steps in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_anew, release
from . import reduce, spectral
from .neighbours import knn

#: Edges that one block holds, about: blocks of points are moved side by side.
PART = 1 << 19
#: Products with the graph before the first epoch.
STEPS = 8
#: Parts of an epoch's edges that are moved one after another.
SLICES = 16


def fuzzy_weights(near: DataFrame, k: int) -> DataFrame:
    """(src, dst, w) from neighbours (src, dst, dist), k to a point with itself: union of the points' fuzzy neighbourhoods.

    A point's nearest other has weight 1; farther ones fall off at the rate, found
    by bisection, at which all weights add up to log2(k).  An edge's weight is
    a + b - a b of its two directions.
    """
    lists = near.where("src <> dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("near"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            many = b["near"].map(len).to_numpy()
            d = np.full((len(b), many.max()), np.inf)
            for i, row in enumerate(b["near"]):
                d[i, : many[i]] = [x["dist"] for x in row]
            rho = np.where(d > 0, d, np.inf).min(axis=1)
            rho = np.where(np.isfinite(rho), rho, 0.0)[:, None]
            low, high, rate = np.zeros(len(b)), np.full(len(b), np.inf), np.ones(len(b))
            for _ in range(64):
                total = np.exp(-np.maximum(d - rho, 0) / rate[:, None]).sum(axis=1)
                over = total > np.log2(k)
                high, low = np.where(over, rate, high), np.where(over, low, rate)
                rate = np.where(np.isfinite(high), (low + high) / 2, rate * 2)
            mean = np.where(np.isfinite(d), d, 0).sum(axis=1) / many
            rate = np.maximum(rate, 1e-3 * mean + 1e-12)
            w = np.exp(-np.maximum(d - rho, 0) / rate[:, None])
            yield pd.DataFrame({"src": np.repeat(b["src"].to_numpy(), many), "dst": [x["dst"] for row in b["near"] for x in row], "w": w[np.isfinite(d)]})

    one = cut_anew(lists.mapInPandas(weigh, "src long, dst long, w double"))
    other = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w2"))
    a, b = F.coalesce("w", F.lit(0.0)), F.coalesce("w2", F.lit(0.0))
    return one.join(other, ["src", "dst"], "full").select("src", "dst", (a + b - a * b).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b), nearest in squares to 1 up to ``min_dist`` and exp(-(x - min_dist) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    log_a, b = 0.0, 1.0
    damp = 1e-2
    loss = lambda p, q: ((1 / (1 + np.exp(p) * x ** (2 * q)) - want) ** 2).sum()
    for _ in range(200):
        t = np.exp(log_a) * x ** (2 * b)
        f = 1 / (1 + t)
        j = np.column_stack([-f * f * t, -f * f * t * 2 * np.log(x)])
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h)), j.T @ (want - f))
        if loss(log_a + step[0], b + step[1]) < loss(log_a, b):
            log_a, b, damp = log_a + step[0], b + step[1], damp / 3
        else:
            damp *= 4
    return float(np.exp(log_a)), float(b)


def _moved(src: np.ndarray, dst: np.ndarray, w: np.ndarray, cells: np.ndarray, at: np.ndarray, own: int, epochs: range, total: int, a: float, b: float, negatives: int, top: float, dice: np.random.Generator) -> np.ndarray:
    """Positions after some epochs of gradient steps.  The first ``own`` cells move, the others stand; src and dst are places in ``cells``."""
    at = at.copy()
    rate = w / top
    for epoch in epochs:
        step = 1.0 - epoch / total
        due = np.flatnonzero(np.floor((epoch + 1) * rate) > np.floor(epoch * rate))
        dice.shuffle(due)
        for part in np.array_split(due, SLICES):
            if not len(part):
                continue
            i, j = src[part], dst[part]
            apart = at[i] - at[j]
            d = (apart * apart).sum(axis=1)
            near = np.where(d > 0, -2 * a * b * np.maximum(d, 1e-300) ** (b - 1) / (1 + a * d**b), 0.0)
            pull = np.clip(near[:, None] * apart, -4, 4) * step
            moves = np.zeros_like(at)
            np.add.at(moves, i, pull)
            np.add.at(moves, j, -pull)
            for _ in range(negatives):
                other = dice.integers(0, own, len(part))
                apart = at[i] - at[other]
                d = (apart * apart).sum(axis=1)
                far = np.where((d > 0) & (other != i), 2 * b / ((0.001 + d) * (1 + a * d**b)), 0.0)
                np.add.at(moves, i, np.clip(far[:, None] * apart, -4, 4) * step)
            at[:own] += moves[:own]
    return at[:own]


def layout(points: DataFrame, k: int = 15, epochs: int = 200, min_dist: float = 0.5, negatives: int = 5, seed: int = 0, rounds: int = 10) -> DataFrame:
    """(cell, x, y) of points (cell, v): near points stay near.  The same table and seed give the same layout.

    Points start at their first two principal components, driven towards the leading
    eigenvectors of the normalised fuzzy graph by STEPS products with it (eigenvectors
    themselves are not unique where groups fall apart).  An edge is pulled in as many epochs as its weight's share of the largest; each pull
    comes with ``negatives`` pushes from points drawn at random.  Points are dealt by
    hash into blocks of about PART edges, whatever the table's size; a block moves its own for
    epochs / rounds epochs while the others stand, then blocks see each other's
    new places.  Fewer than four points lie on a line.
    """
    n = points.count()
    if n < 4:
        order = sorted(r["cell"] for r in points.select("cell").collect())
        return points.sparkSession.createDataFrame([(c, float(i), 0.0) for i, c in enumerate(order)], "cell long, x double, y double")
    k = min(k, n)
    edges = cut_anew(fuzzy_weights(knn(points, points, k), k))
    operator = spectral.Operator(edges, points.select("cell", F.lit(0.0).alias("e")))
    at, _ = reduce.pca(points, 2)
    for _ in range(STEPS):
        at = cut_anew(operator.times(at.select("cell", F.lit(0.0).alias("u"), "v"), np.zeros(2)).withColumnRenamed("y", "v"))
    # without the part along the first eigenvector, which says nothing, and over the root of the degrees
    held = at.join(operator.nodes.select("cell", "root", "scale"), "cell")
    square, x, y = held.agg(F.sum(F.col("root") * F.col("root")), *[F.sum(F.col("root") * F.get("v", i)) for i in (0, 1)]).first()
    flat = [F.get("v", i) * F.col("scale") - F.lit((x, y)[i] / (square or 1.0)) for i in (0, 1)]
    start = cut_anew(held.select("cell", F.array(*flat).alias("v")))
    reach = [r or 1.0 for r in start.agg(*[F.max(F.abs(F.get("v", i))) for i in (0, 1)]).first()]
    shaken = lambda i: (F.pmod(F.xxhash64("cell", F.lit(f"{seed}s{i}")), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3
    # rounded, so that the order of additions cannot show
    at = cut_anew(start.select("cell", F.array(*[F.round(F.get("v", i) / F.lit(reach[i]) * 10, 3) + shaken(i) for i in (0, 1)]).alias("v")))
    many, top = edges.agg(F.count("*"), F.max("w")).first()
    blocks = max(1, -(-many // PART))
    a, b = curve(min_dist)
    placed = edges.select(F.pmod(F.xxhash64("src"), F.lit(blocks)).alias("block"), "src", "dst", "w")

    def mover(turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        here = range(turn * epochs // rounds, (turn + 1) * epochs // rounds)

        def move(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["src", "dst"], ignore_index=True)
            own, first = np.unique(part["src"].to_numpy(), return_index=True)
            ends, last = np.unique(part["dst"].to_numpy(), return_index=True)
            others = ~np.isin(ends, own)
            cells = np.concatenate([own, ends[others]])
            where = np.vstack([np.stack(part["v"].to_numpy()[first]), *([np.stack(part["u"].to_numpy()[last[others]])] if others.any() else [])])
            order = np.argsort(cells)
            place = lambda c: order[np.searchsorted(cells, c, sorter=order)]
            dice = np.random.default_rng([seed, turn, int(part["block"].iloc[0])])
            new = _moved(place(part["src"].to_numpy()), place(part["dst"].to_numpy()), part["w"].to_numpy(), cells, where, len(own), here, epochs, a, b, negatives, top, dice)
            return pd.DataFrame({"cell": own, "v": list(new)})

        return move

    for turn in range(rounds):
        seen = placed.join(at.select(F.col("cell").alias("src"), "v"), "src").join(at.select(F.col("cell").alias("dst"), F.col("v").alias("u")), "dst")
        before = at
        moved = seen.groupBy("block").applyInPandas(mover(turn), "cell long, v array<double>")
        at = cut_anew(before.join(moved.withColumnRenamed("v", "new"), "cell", "left").select("cell", F.coalesce("new", "v").alias("v")))
        release(before)
    return at.select("cell", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
