"""Eigenvectors of normalised graphs and of affinities between their rows, and clusters from them.

Matrices stay tables of edges.  A block of vectors is a table (cell, v); what reaches
the driver are the products of its columns, a few dozen numbers squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, cut_anew, release
from . import cluster, reduce


#: Rows of a matrix that a task multiplies at once, at most; and pairs of rows, or steps to them, on average.
ROWS, STEPS = 8192, 1 << 22
#: Entries of a column that travel as one row, on average.
PIECE = 1 << 16


def _block(name: str, blocks: int) -> Column:
    """The block of a node."""
    return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")


def _met(gamma: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a block's entries (src, c, w, n) and the columns (to, column, other, x, m) they are in: pairs of rows and their affinity above that of rows apart."""

    def meet(own: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(columns):
            columns = columns.sort_values("column", kind="stable")
            many = columns["other"].map(len).to_numpy()
            other, x, m = (np.concatenate(columns[name].to_numpy()) for name in ("other", "x", "m"))
            names, first = np.unique(columns["column"].to_numpy(), return_index=True)
            size = np.add.reduceat(many, first)
            start = np.cumsum(size) - size
            ends, to, back = np.unique(other, return_index=True, return_inverse=True)
            norm = m[to]
            own = own.sort_values(["src", "c"], ignore_index=True)
            src, w, n = (own[name].to_numpy() for name in ("src", "w", "n"))
            at = np.searchsorted(names, own["c"].to_numpy())
            steps = np.cumsum(size[at])
            rows = np.flatnonzero(np.diff(src, prepend=src[0] - 1))
            low = 0
            while low < len(src):
                # whole rows, about so many steps
                high = np.searchsorted(steps, steps[low] + STEPS, side="right")
                later = rows[np.searchsorted(rows, high, side="right") - 1] if high < len(src) else len(src)
                high = later if later > low else np.append(rows, len(src))[np.searchsorted(rows, low, side="right")]
                length = size[at[low:high]]
                entry = np.repeat(np.arange(low, high), length)
                place = np.arange(len(entry)) - np.repeat(np.cumsum(length) - length, length) + start[at[entry]]
                name, row = np.unique(src[low:high], return_inverse=True)
                i, j, s = cluster._links(row[entry - low], back[place], w[entry] * x[place], len(name), len(ends))
                apart = n[low + np.searchsorted(src[low:high], name)][i] + norm[j]
                out.append(pd.DataFrame({"src": name[i], "dst": ends[j], "w": np.exp(-gamma * np.maximum(apart - 2 * s, 0.0)) - np.exp(-gamma * apart)}))
                low = high
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "w": []})

    return meet


def row_affinity(edges: DataFrame, gamma: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """exp(-gamma * squared distance) of the rows of an adjacency (src, dst, w): pairs (src, dst, w) and nodes (cell, e).

    Of two nodes without a common neighbour the affinity is e times e, whatever
    else; pairs hold what those with one have above that, and each node with
    itself.  Every node of an end of an edge is a row, and nothing dense is made.
    A column goes once to each block of rows that has an entry in it; pairs are
    summed there.
    """
    held = cut(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    ends = held.select(F.col("src").alias("cell")).unionAll(held.select(F.col("dst").alias("cell"))).distinct()
    squares = held.groupBy(F.col("src").alias("cell")).agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    nodes = cut_anew(ends.join(squares, "cell", "left").fillna(0.0, ["n"]))
    rows, steps, top = held.groupBy("dst").agg(F.count("*").alias("d")).agg(F.count("*"), F.sum(F.col("d") * F.col("d")), F.max("d")).first()
    blocks, pieces = max(1, math.ceil((rows or 0) / ROWS), math.ceil((steps or 0) / STEPS)), max(1, math.ceil((top or 0) / PIECE))
    whole = held.join(nodes.select(F.col("cell").alias("src"), "n"), "src")
    own = cut_anew(whole.select(_block("src", blocks).alias("block"), "src", F.col("dst").alias("c"), F.col("w").cast("double").alias("w"), "n"))
    lists = own.groupBy("c", F.pmod(F.xxhash64("src", F.lit(1)), F.lit(pieces)).alias("piece")).agg(F.collect_list(F.struct("src", "w", "n")).alias("e"))
    columns = lists.select("c", F.col("e.src").alias("other"), F.col("e.w").alias("x"), F.col("e.n").alias("m"))
    sent = columns.join(own.select("c", "block").distinct(), "c").select(F.col("block").alias("to"), F.col("c").alias("column"), "other", "x", "m")
    pairs = own.groupBy("block").cogroup(sent.groupBy("to")).applyInPandas(_met(gamma), "src long, dst long, w double")
    return pairs, nodes.select("cell", F.exp(-gamma * F.col("n")).alias("e"))


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    """A block's pairs in one row: the different ends, and sorted by the first, the places of both ends and the weight."""
    part = part.sort_values(["src", "dst"], ignore_index=True)
    row, i = np.unique(part["src"].to_numpy(), return_inverse=True)
    col, j = np.unique(part["dst"].to_numpy(), return_inverse=True)
    return pd.DataFrame({"block": part["block"].iloc[:1], "rows": [row.tobytes()], "cols": [col.tobytes()], "i": [i.astype(np.int32).tobytes()], "j": [j.astype(np.int32).tobytes()], "w": [part["w"].to_numpy().tobytes()]})


def _product(width: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a packed block and the numbers (cell, v0, v1...) of its columns: (cell, y)."""

    def multiply(held: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame({"cell": [], "y": []})
        row, col, i, j, w = (np.frombuffer(held[name].iloc[0], kind) for name, kind in (("rows", np.int64), ("cols", np.int64), ("i", np.int32), ("j", np.int32), ("w", np.float64)))
        x, y = np.zeros((len(col), width)), np.zeros((len(row), width))
        x[np.searchsorted(col, sent["cell"].to_numpy())] = sent[[f"v{c}" for c in range(width)]].to_numpy()
        for low in range(0, len(i), 1 << 18):
            at = i[low : low + (1 << 18)]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            y[at[first]] += np.add.reduceat(w[low : low + len(at), None] * x[j[low : low + len(at)]], first, axis=0)
        return pd.DataFrame({"cell": row, "y": list(y)})

    return multiply


class Operator:
    """D^-1/2 (W + e e') D^-1/2 for symmetric pairs W (src, dst, w) and numbers e of nodes (cell, e); D holds the row sums.

    Pairs lie packed in blocks of rows and stay where they are; a product sends
    each node's numbers once to every block with a pair that ends in it.
    """

    def __init__(self, pairs: DataFrame, nodes: DataFrame) -> None:
        total = nodes.agg(F.sum("e")).first()[0] or 0.0
        pairs = cut_anew(pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")))
        blocks = max(1, math.ceil(nodes.count() / ROWS), math.ceil(pairs.count() / STEPS))
        sums = pairs.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("w"))
        sent = pairs.groupBy(F.col("dst").alias("cell")).agg(F.collect_set(_block("src", blocks)).alias("to"))
        degree = F.coalesce("w", F.lit(0.0)) + F.col("e") * total
        scale = F.when(degree > 0, 1 / F.sqrt(degree)).otherwise(0.0)
        self.nodes = cut_anew(nodes.join(sums, "cell", "left").join(sent, "cell", "left").select("cell", scale.alias("scale"), (F.col("e") * scale).alias("u"), F.sqrt(degree).alias("root"), "to"))
        self.tasks = min(blocks, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.held = pairs.select(_block("src", blocks).alias("block"), "src", "dst", "w").repartition(self.tasks, "block").groupBy("block").applyInPandas(_packed, "block int, rows binary, cols binary, i binary, j binary, w binary")
        # dealt by block and kept so: a product doesn't move them
        self.held = self.held.repartition(self.tasks, "block").persist(StorageLevel.DISK_ONLY)

    def times(self, x: DataFrame, along: np.ndarray) -> DataFrame:
        """(cell, y): the product with (cell, u, v), where ``along`` holds the sums of u times each column of v."""
        width = len(along)
        scaled = x.select("cell", "v").join(self.nodes.select("cell", "scale", "to"), "cell")
        sent = scaled.select(F.explode("to").alias("block"), "cell", *[(F.col("scale") * F.get("v", i)).alias(f"v{i}") for i in range(width)]).repartition(self.tasks, "block")
        sums = self.held.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(_product(width), "cell long, y array<double>")
        there = x.select("cell", "u").join(self.nodes.select("cell", "scale"), "cell").join(sums, "cell", "left")
        return there.select("cell", F.array(*[F.coalesce(F.col("scale") * F.get("y", i), F.lit(0.0)) + F.col("u") * float(along[i]) for i in range(width)]).alias("y"))


def _mapped(rows: DataFrame, turn: np.ndarray, wide: int) -> DataFrame:
    """(cell, u, b, p, v): the columns of b and p together times a matrix; ``wide`` of the product's are b, as many p, the rest v."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                y = np.hstack([np.stack(part["b"].to_numpy()), np.stack(part["p"].to_numpy())]) @ turn
                yield pd.DataFrame({"cell": part["cell"], "u": part["u"], "b": list(y[:, :wide]), "p": list(y[:, wide : 2 * wide]), "v": list(y[:, 2 * wide :])})

    return rows.mapInPandas(multiply, BLOCK)


def _orthogonal(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """Rows whose v is b and v together times a matrix."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                part["v"] = list(np.hstack([np.stack(part["b"].to_numpy()), np.stack(part["v"].to_numpy())]) @ turn)
                yield part

    return rows.mapInPandas(multiply, BLOCK)


BLOCK = "cell long, u double, b array<double>, p array<double>, v array<double>"


def largest(operator: Operator, k: int, tol: float = 1e-7, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The k largest eigenvalues and their eigenvectors (cell, v): block Lanczos with restarts.

    A basis b and the operator's product p with it grow by a block of residuals a
    round; Rayleigh-Ritz values come from their inner products.  A basis of five blocks
    is cut down to the best two.  Rounds end when every wanted residual is below
    ``tol``, or after ``rounds``.  Columns are orthonormal over the nodes; a column's
    largest entry is positive.  With fewer nodes than columns all eigenvectors return.
    """
    n = operator.nodes.count()
    k = min(k, n)
    block = min(n, k + 4)
    normal = lambda i: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("cell", F.lit(f"{seed}a{i}")), F.lit(1 << 30)) + 0.5) / float(1 << 30))) * F.cos(2 * np.pi * F.pmod(F.xxhash64("cell", F.lit(f"{seed}b{i}")), F.lit(1 << 30)) / float(1 << 30))
    # the root of the degrees is the first eigenvector of a connected graph
    start = operator.nodes.select("cell", "u", F.array().cast("array<double>").alias("b"), F.array().cast("array<double>").alias("p"), F.array("root", *[normal(i) for i in range(block - 1)]).alias("v"))
    rows, width = start, 0
    for _ in range(rounds):
        # the new block, orthogonal to the basis and in itself; residuals nearly are before
        _, _, g = reduce.moments(rows.select(F.concat("b", "v", F.array("u")).alias("v")))
        inner, own = g[:width, width:-1], g[width:-1, width:-1] - g[:width, width:-1].T @ g[:width, width:-1]
        values, axes = np.linalg.eigh((own + own.T) / 2)
        kept = values > max(values[-1], 1e-300) * 1e-13
        axes = axes[:, kept] / np.sqrt(values[kept])
        turn = np.vstack([-inner @ axes, axes])
        fresh = axes.shape[1]
        rows = cut_anew(_orthogonal(rows, turn))
        product = operator.times(rows, g[-1, :-1] @ turn)
        with_product = cut_anew(rows.join(product, "cell").select("cell", "u", F.concat("b", "v").alias("b"), F.concat("p", "y").alias("p")))
        release(rows)
        rows = with_product
        width += fresh
        _, _, g = reduce.moments(rows.select(F.concat("b", "p").alias("v")))
        h = g[:width, width:]
        values, axes = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, axes = values[order], axes[:, order]
        wanted = min(block, width)
        residual = np.vstack([-axes[:, :wanted] * values[:wanted], axes[:, :wanted]])
        size = np.sqrt(np.maximum(np.diag(residual.T @ g @ residual), 0))
        if width >= n or size[:k].max() < tol:
            break
        # settled columns give no direction any more, only rounding
        open_ = np.flatnonzero(size > max(tol / 10, 1e-9))
        keep = axes[:, : 2 * block] if width > 5 * block else np.eye(width)
        many = keep.shape[1]
        turn = np.zeros((2 * width, 2 * many + len(open_)))
        turn[:width, :many], turn[width:, many : 2 * many], turn[:, 2 * many :] = keep, keep, residual[:, open_] / size[open_]
        rows = _mapped(rows, turn, many)
        width = many
    out = cut_anew(reduce.turned(rows.select("cell", F.col("b").alias("v")), axes[:, :k], "cell"))
    ends = out.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.max_by("x", F.struct(F.abs("x"), "x")).alias("x")).orderBy("i").collect()  # k rows
    return values[:k], reduce.turned(out, np.diag([1.0 if r["x"] >= 0 else -1.0 for r in ends]), "cell")


def embedding(edges: DataFrame, k: int, gamma: float = 1.0, tol: float = 1e-7, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The k largest eigenvalues of the normalised affinity of an adjacency's rows, and (cell, v): eigenvectors over the root of the degrees."""
    operator = Operator(*row_affinity(edges, gamma))
    values, vectors = largest(operator, k, tol, seed=seed)
    operator.held.unpersist()
    scaled = vectors.join(operator.nodes.select("cell", "scale"), "cell").select("cell", F.transform("v", lambda x: x * F.col("scale")).alias("v"))
    return values, cut_anew(scaled)


def clusters(edges: DataFrame, k: int, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """(cell, cluster): k-means of the spectral embedding of an adjacency (src, dst, w), whose rows are compared by a Gaussian."""
    return cluster.kmeans(embedding(edges, k, gamma, seed=seed)[1], k, seed)
