"""Algebra of edge tables (src, dst, w): symmetry, normalisation, propagation, fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import mean_of, numbers
from ..lineage import cut
from . import neighbours
from .components import connected_components
from .neighbours import knn

#: Pairs of points that share a neighbour, made at once.
PAIRS = 1 << 22


def reverse(edges: DataFrame) -> DataFrame:
    """Edges the other way round."""
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst): edges in both directions, each once."""
    # a union would make the edges twice
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.explode(F.array(there, back)).alias("e")).select("e.src", "e.dst").distinct()


def normalised(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """w / sqrt(degree of both ends); with ``nodes`` (cell) each gets a loop of weight 1 first.

    A degree of 0 gives 0.
    """
    if nodes is not None:
        edges = edges.select("src", "dst", "w").unionAll(nodes.select(F.col("cell").alias("src"), F.col("cell").alias("dst"), F.lit(1.0).alias("w")))
        edges = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    degree = edges.groupBy("src").agg(F.sum("w").alias("d"))
    joined = edges.join(degree.withColumnRenamed("d", "ds"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst", "left")
    power = F.sqrt(F.col("ds") * F.col("dd"))
    return joined.select("src", "dst", F.when((F.col("ds") > 0) & (F.col("dd") > 0), F.col("w") / power).otherwise(0.0).alias("w"))


def merged(intra: DataFrame, matches: DataFrame, weight: float) -> DataFrame:
    """(src, dst, w): edges of weight 1 plus matches (a, b) of ``weight`` in both directions, equal edges added up."""
    a = intra.select("src", "dst", F.lit(1.0).alias("w"))
    there = matches.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(weight).alias("w"))
    return a.unionAll(there).unionAll(reverse(there).select("src", "dst", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def edge_classes(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """Edges with ``etype``: the batch of both ends, -1 across batches."""
    out = edges.join(batches.select(F.col("cell").alias("src"), F.col("batch").alias("b1")), "src").join(batches.select(F.col("cell").alias("dst"), F.col("batch").alias("b2")), "dst")
    return out.withColumn("etype", F.when(F.col("b1") == F.col("b2"), F.col("b1")).otherwise(-1)).drop("b1", "b2")


def mean_vector(v: Column | str, dim: int) -> Column:
    """Element-wise mean of a group's vectors."""
    return mean_of(v, dim)


def _weighed_sum(dim: int) -> Column:
    return F.array(*[F.sum(F.col("w") * x) for x in numbers("v", dim)])


def propagate(edges: DataFrame, vectors: DataFrame, dim: int, hops: int = 1, typed: bool = False) -> DataFrame:
    """(cell, v): features and their weighted neighbour sums over 1..hops steps, concatenated.

    ``typed``: each step sums over edges within batches (etype >= 0) and across
    (etype -1) separately and concatenates both; hops must then be 1.
    """
    out = vectors.select("cell", "v", F.col("v").alias("__all"))
    kinds = [F.col("etype") >= 0, F.col("etype") < 0] if typed else [F.lit(True)]
    if typed and hops != 1:
        raise ValueError("typed propagation takes one step")
    zero = F.array(*[F.lit(0.0)] * dim)
    for _ in range(hops):
        base = out
        for kind in kinds:
            summed = edges.where(kind).join(base.select(F.col("cell").alias("src"), "v"), "src").groupBy(F.col("dst").alias("cell")).agg(_weighed_sum(dim).alias("__n"))
            out = out.join(summed, "cell", "left").withColumn("__n", F.coalesce("__n", zero)).select("cell", F.col("__n").alias("v"), F.concat("__all", "__n").alias("__all"))
    return out.select("cell", F.col("__all").alias("v"))


def smoothed_counts(edges: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(cell, feature, x): sums of the neighbours' counts over k."""
    return edges.join(counts.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "feature").agg((F.sum("x") / k).alias("x"))


def impute(targets: DataFrame, pools: list[tuple[DataFrame, DataFrame]], k: int) -> DataFrame:
    """(cell, feature, x): a missing modality from the k nearest measured cells (unit length, city-block distance).

    pools: for each measured modality its embeddings (cell, v) and counts; the
    means over neighbours are averaged over the modalities.
    """
    out = None
    for vectors, counts in pools:
        one = smoothed_counts(knn(targets, vectors, k, "unit_manhattan"), counts, k)
        out = one if out is None else out.unionAll(one)
    return out.groupBy("cell", "feature").agg((F.sum("x") / len(pools)).alias("x"))


def merged_vectors(parts: list[DataFrame], dim: int, concat: bool = False) -> DataFrame:
    """(cell, v): element-wise mean of a cell's vectors over the modalities that have it, or all of them in a row."""
    if concat:
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p.select("cell", F.col("v").alias("__v")), "cell").select("cell", F.concat("v", "__v").alias("v"))
        return out
    every = parts[0].select("cell", "v")
    for p in parts[1:]:
        every = every.unionAll(p.select("cell", "v"))
    return every.groupBy("cell").agg(mean_vector("v", dim).alias("v"))


def attention_edges(edges: DataFrame, scores: DataFrame, slope: float = 0.2) -> DataFrame:
    """Edges with ``w``: softmax, over the edges into each point, of leaky sums of both ends' scores (cell, s_src, s_dst)."""
    s = edges.select("src", "dst").join(scores.select(F.col("cell").alias("src"), "s_src"), "src").join(scores.select(F.col("cell").alias("dst"), "s_dst"), "dst")
    raw = F.col("s_src") + F.col("s_dst")
    e = F.exp(F.when(raw >= 0, raw).otherwise(slope * raw))
    return s.select("src", "dst", e.alias("e")).select("src", "dst", (F.col("e") / F.sum("e").over(Window.partitionBy("dst"))).alias("w"))


def learned_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A parameter matrix as a graph: mean with its transpose, negatives cut off, loops, normalised."""
    both = edges.select("src", "dst", (F.col("w") / 2).alias("w")).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / 2).alias("w")))
    summed = both.groupBy("src", "dst").agg(F.greatest(F.sum("w"), F.lit(0.0)).alias("w")).where("w > 0")
    return normalised(summed, nodes)


def fused(parts: list[DataFrame], scores: DataFrame) -> DataFrame:
    """(cell, v): vectors of the modalities, weighed by the softmax of scores (cell, s array)."""
    def weigh(i: int):
        return lambda x: x * F.col("p")[i]

    e = F.transform("s", lambda x: F.exp(x - F.array_max("s")))
    out = scores.select("cell", e.alias("e")).select("cell", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    for i, part in enumerate(parts):
        out = out.join(part.select("cell", F.col("v").alias(f"v{i}")), "cell")
    terms = [F.transform(f"v{i}", weigh(i)) for i in range(len(parts))]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), terms)
    return out.select("cell", total.alias("v"))


def component_share(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, largest, share): the largest connected part of each label's own subgraph."""
    e = edges.join(labels.select(F.col("cell").alias("src"), F.col("label").alias("l1")), "src").join(labels.select(F.col("cell").alias("dst"), F.col("label").alias("l2")), "dst").where("l1 = l2")
    parts = connected_components(e.select("src", "dst"))
    whole = labels.join(parts, F.col("cell") == F.col("node"), "left").select("label", F.coalesce("component", "cell").alias("component"))
    sizes = whole.groupBy("label", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("label").agg(F.sum("n").alias("n"), F.max("n").alias("largest")).withColumn("share", F.col("largest") / F.col("n"))


def modality_components(measured: DataFrame) -> DataFrame:
    """(batch, component) of batches linked by modalities they share: (modality, batch)."""
    m = measured.select("modality", F.col("batch").cast("long").alias("batch")).distinct()
    edges = m.join(m.groupBy("modality").agg(F.min("batch").alias("hub")), "modality").select(F.col("batch").alias("src"), F.col("hub").alias("dst"))
    parts = connected_components(edges)
    return m.select("batch").distinct().join(parts, F.col("batch") == F.col("node"), "left").select("batch", F.coalesce("component", "batch").alias("component"))


def bridge_batches(measured: DataFrame) -> DataFrame:
    """(batch, modalities, bridge): batches with two or more modalities are bridges."""
    return measured.groupBy("batch").agg(F.count_distinct("modality").alias("modalities")).withColumn("bridge", F.col("modalities") >= 2)


# weighted nearest neighbours of two modalities


def _pack(points: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order and vectors of points (cell, v, near), and those near any, in order, with the places of the points that they are near."""
    ids, v, _ = neighbours.arrays(points)
    order = np.argsort(ids, kind="stable")
    near = points["near"].to_numpy()[order]
    flat = np.concatenate([np.zeros(0, np.int64), *near])
    by = np.argsort(flat, kind="stable")
    return ids[order], v[order], flat[by], np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in near])[by]


def _largest(key: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest distances of each key."""
    by = np.lexsort((-dist, key))
    return by[np.arange(len(by)) - np.searchsorted(key[by], key[by]) < k]


def _least_overlap(near: tuple[np.ndarray, np.ndarray], v: np.ndarray, k: int, many: np.ndarray, held: tuple, found: list[np.ndarray]) -> list[np.ndarray]:
    """(row, overlap, distance) of points that share neighbours with those of a slice: of each row and overlap the k furthest.

    many: for each row the number of points by overlap so far, which is added to.  Pairs
    whose overlap too many others fall below already aren't measured.
    """
    (row, mid), (ids, w, mids, who) = near, held
    low = np.searchsorted(mids, mid)
    size = np.searchsorted(mids, mid, "right") - low
    ends = np.concatenate([np.searchsorted(row, np.arange(len(v))), [len(row)]])
    total, start = np.concatenate([[0], np.cumsum(size)])[ends], 0
    while start < len(v):  # as many rows as share so many neighbours, one at least
        stop = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, "right")) - 1)
        part = slice(ends[start], ends[stop])
        key, n = np.unique(np.repeat(row[part], size[part]) * len(ids) + who[neighbours.spans(low[part], size[part])], return_counts=True)
        r, p = key // max(1, len(ids)), key % max(1, len(ids))
        many += np.bincount(r * many.shape[1] + n, minlength=many.size).reshape(many.shape)
        open_ = (many.cumsum(axis=1) - many)[r, n] <= k
        r, p, n = r[open_], p[open_], n[open_]
        dist = neighbours.at_pairs(v.T, w.T, r, p, "euclidean")
        found = [np.concatenate(x) for x in zip(found, (r, n, dist), strict=True)]
        best = _largest(found[0] * many.shape[1] + found[1], found[2], k)
        found, start = [x[best] for x in found], stop
    return found


def _surroundings(edges: DataFrame, vectors: DataFrame, k: int, others: DataFrame) -> DataFrame:
    """(cell, bw, within, cross): the bandwidth, see ``bandwidths``, and the distance to the mean of a point's neighbours and of its neighbours by ``others``.

    Points and their neighbours are sent in slices; pairs are made, counted and measured
    in the task of their first point, and only its numbers leave it.
    """
    lists = lambda e, name: e.groupBy(F.col("src").alias("cell")).agg(F.array_sort(F.collect_list("dst")).alias(name))
    none = F.array().cast("array<bigint>")
    points = vectors.select("cell", "v").join(lists(edges, "near"), "cell", "left").join(lists(others, "far"), "cell", "left")
    points = cut(points.select("cell", "v", F.coalesce("near", none).alias("near"), F.coalesce("far", none).alias("far")))
    count, size = neighbours.extent(points)
    held = neighbours.slices(points.select("cell", "v", "near"), -(-size // max(1, count)) + 24 * k, _pack)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in neighbours.gathered(batches, neighbours.MET >> 2):
            cell, v, _ = neighbours.arrays(q)
            flat = {c: (np.repeat(np.arange(len(q)), [len(x) for x in q[c]]), np.concatenate([np.zeros(0, np.int64), *q[c]])) for c in ("near", "far")}
            many = np.zeros((len(q), 1 + max((len(x) for x in q["near"]), default=0)), np.int64)
            found, sums = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], {c: np.zeros(v.shape) for c in flat}
            for part in held:
                ids, w, mids, who = neighbours.taken(part)
                if not len(ids):
                    continue
                found = _least_overlap(flat["near"], v, k, many, (ids, w, mids, who), found)
                for c, (row, dst) in flat.items():
                    at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
                    here = ids[at] == dst
                    first = np.flatnonzero(np.diff(row[here], prepend=-1))
                    if len(first):
                        sums[c][row[here][first]] += np.add.reduceat(w[at[here]], first, axis=0)
            row, n, dist = found
            open_ = (many.cumsum(axis=1) - many)[row, n] <= k
            row, dist = row[open_], dist[open_]
            best = _largest(row, dist, k)
            taken = np.bincount(row[best], minlength=len(q))
            bw = np.bincount(row[best], dist[best], len(q)) / np.maximum(taken, 1)
            off = {c: np.sqrt(((v - s / (k - 1)) ** 2).cumsum(axis=1)[:, -1]) for c, s in sums.items()}
            yield pd.DataFrame({"cell": cell, "bw": bw, "within": off["near"], "cross": off["far"]})[(taken > 0) & (q["far"].map(len).to_numpy() > 0)]

    return neighbours.spread(points, count).mapInPandas(look, "cell long, bw double, within double, cross double")


def bandwidths(edges: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(cell, bw): mean of the k largest distances to the points of least Jaccard overlap.

    Of the points that share a neighbour, those of the k + 1 smallest overlaps and
    all that tie with the last are looked at.  With fewer points than k + 1 it is an
    error in the origin of this method; here all are taken.
    """
    edges = cut(edges.select("src", "dst"))
    return _surroundings(edges, vectors, k, edges).select("cell", "bw")


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def with_distance(edges: DataFrame, vectors: DataFrame, name: str = "dist") -> DataFrame:
    """Edges with the distance of their ends."""
    joined = edges.join(vectors.select(F.col("cell").alias("src"), F.col("v").alias("v1")), "src").join(vectors.select(F.col("cell").alias("dst"), F.col("v").alias("v2")), "dst")
    return joined.withColumn(name, euclidean(F.col("v1"), F.col("v2"))).drop("v1", "v2")


def affinity(dist: Column, nearest: Column, bw: Column) -> Column:
    """exp(-(distance beyond the nearest) / (bandwidth - nearest)), 1 within the nearest."""
    return F.exp(-F.greatest(dist - nearest, F.lit(0.0)) / (bw - nearest))


def modality_weights(reps: tuple[DataFrame, DataFrame], graphs: tuple[DataFrame, DataFrame], k: int, dim: int) -> DataFrame:
    """(cell, d0, bw0, d1, bw1, w0, w1): for each modality the nearest distance, the bandwidth and the weight.

    A modality weighs more where its own neighbours predict a cell better than the
    other modality's.  graphs: (src, dst, dist, place), k - 1 neighbours a cell,
    itself not among them.
    """
    graphs, reps = tuple(map(cut, graphs)), tuple(map(cut, reps))  # each is read several times
    out = None
    for i in (0, 1):
        near = graphs[i].where("place = 1").select(F.col("src").alias("cell"), F.col("dist").alias(f"d{i}"))
        both = near.join(_surroundings(graphs[i], reps[i], k, graphs[1 - i]).withColumnRenamed("bw", f"bw{i}"), "cell")
        d, b = F.col(f"d{i}"), F.col(f"bw{i}")
        ratio = affinity(F.col("within"), d, b) / (affinity(F.col("cross"), d, b) + 0.0001)
        part = both.select("cell", f"d{i}", f"bw{i}", ratio.alias(f"r{i}"))
        out = part if out is None else out.join(part, "cell")
    w0 = 1 / (1 + F.exp(F.col("r1") - F.col("r0")))
    return out.select("cell", "d0", "bw0", "d1", "bw1", w0.alias("w0"), (1 - w0).alias("w1"))


def weighted_neighbours(reps: tuple[DataFrame, DataFrame], k: int, wide: int, dim: int) -> DataFrame:
    """(src, dst, w, dist, place): the k most similar points over both modalities.

    Vectors are taken at unit length; candidates are the union of the ``wide``
    nearest of each modality.
    """
    unit = tuple(r.select("cell", unit_length(F.col("v")).alias("v")) for r in reps)
    narrow = tuple(cut(knn(u, u, k - 1, itself=False)) for u in unit)
    weights = cut(modality_weights(unit, narrow, k, dim))
    points = cut(unit[0].join(unit[1].withColumnRenamed("v", "t"), "cell"))
    count, size = neighbours.extent(points)
    held = neighbours.slices(points, 2 * -(-size // max(1, count)), lambda p: (p["cell"].to_numpy(), *(np.stack(p[c].to_numpy()) if len(p) else np.zeros((0, dim)) for c in ("v", "t"))))

    def strongest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in neighbours.gathered(batches, max(1, min(neighbours.MET, neighbours.LISTS // (2 * wide)))):
            cell, own, best = q["cell"].to_numpy(), [np.stack(q[c].to_numpy()) for c in ("v", "t")], [neighbours.NONE.assign(other=0.0)] * 2
            for part in held:
                ids, *both = neighbours.taken(part)
                for i in (0, 1):
                    near = list(neighbours._nearest(cell, own[i], None, neighbours.Held(ids, both[i], None, "euclidean"), wide - 1, False, None))
                    if near:
                        best[i] = _with_other(best[i], pd.concat(near), wide - 1, cell, ids, own[1 - i], both[1 - i])
            yield _strongest(q, best, k)

    rows = points.join(weights, "cell")
    top = neighbours.spread(rows, count).mapInPandas(strongest, "src long, dst long, w double, place int")
    return top.withColumn("dist", F.sqrt(F.least(F.greatest((1 - F.col("w")) / 2, F.lit(0.0)), F.lit(1.0))))


def _with_other(best: pd.DataFrame, near: pd.DataFrame, k: int, cell: np.ndarray, ids: np.ndarray, v: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """The k nearest of each point so far and of a slice, with their distances in the other modality as well."""
    first = neighbours.first_k([best, near.assign(other=np.nan)], k)
    at, place = np.argsort(cell, kind="stable"), np.argsort(ids, kind="stable")
    new = np.flatnonzero(first["other"].isna())
    src, dst = first["src"].to_numpy()[new], first["dst"].to_numpy()[new]
    other = first["other"].to_numpy(copy=True)
    other[new] = neighbours.at_pairs(v.T, w.T, at[np.searchsorted(cell, src, sorter=at)], place[np.searchsorted(ids, dst, sorter=place)], "euclidean")
    return first.assign(other=other)


def _strongest(q: pd.DataFrame, best: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """(src, dst, w, place): of points with their modalities' weights, the k most similar among the neighbours of either modality."""
    a, b = (x[["src", "dst", "dist", "other"]] for x in best)
    every = pd.concat([a, b.rename(columns={"dist": "other", "other": "dist"})[["src", "dst", "dist", "other"]]])
    src, dst, d0, d1 = (every[c].to_numpy() for c in every)
    by = np.lexsort((dst, src))
    by = by[(np.diff(src[by], prepend=src[:1] - 1) != 0) | (np.diff(dst[by], prepend=dst[:1] - 1) != 0)] if len(by) else by
    src, dst, d = src[by], dst[by], (d0[by], d1[by])
    order = np.argsort(q["cell"].to_numpy(), kind="stable")
    row = order[np.searchsorted(q["cell"].to_numpy(), src, sorter=order)]
    with np.errstate(all="ignore"):
        near, bw, weight = ([q[f"{c}{i}"].to_numpy()[row] for i in (0, 1)] for c in ("d", "bw", "w"))
        w = sum(weight[i] * np.exp(-(d[i] - near[i]) / (bw[i] - near[i])) for i in (0, 1))
    by = np.lexsort((dst, np.where(np.isnan(w), -np.inf, -w), src))
    src, place = src[by], np.arange(len(by)) - np.searchsorted(src[by], src[by])
    kept = place < k
    return pd.DataFrame({"src": src[kept], "dst": dst[by][kept], "w": w[by][kept], "place": place[kept].astype(np.int32) + 1})


def unit_length(v: Column) -> Column:
    """A vector over its length (as it is, if that is 0)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm == 0, x).otherwise(x / norm))


def batched_cauchy(a: Column, b: Column, scale_a: Column, scale_b: Column) -> Column:
    """The Cauchy kernel whose scale is the geometric mean of both points' batches' scales."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return 1 / (1 + square / F.sqrt(scale_a * scale_b))


def kernel(kind: str, a: Column, b: Column, s: float = 1.0) -> Column:
    """A covariance function of two vectors: eq, cauchy, laplacian, matern12, matern32, matern52, dot."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    city = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)
    r = F.sqrt(square) / s
    return {
        "eq": lambda: F.exp(-square / s), "cauchy": lambda: 1 / (1 + square / s), "laplacian": lambda: F.exp(-city / s),
        "matern12": lambda: F.exp(-r), "matern32": lambda: (1 + 3**0.5 * r) * F.exp(-(3**0.5) * r),
        "matern52": lambda: (1 + 5**0.5 * r + 5 / 3 * r * r) * F.exp(-(5**0.5) * r),
        "dot": lambda: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x),
    }[kind]()
