"""Compositions of the other operators: preprocessing of modalities, alignment by kind, thresholds, likelihoods."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.statistics import log_gamma
from ..lineage import cut
from . import align, cluster, graph, label_metrics, neighbours, prep, reduce
from .running import hash_order, quantile


def super_resolution(points: DataFrame) -> DataFrame:
    """(cell, corner, x, y): every place with four around it, a quarter of the median nearest distance off along both axes."""
    near = neighbours.knn(points.select("cell", F.array("x", "y").alias("v")), points.select("cell", F.array("x", "y").alias("v")), 1, itself=False)
    step = quantile(near, "dist", 0.5, "m").select((F.col("m") / 4).alias("s"))
    corner = lambda i, a, b: F.struct(F.lit(i).alias("corner"), (F.col("x") + a * F.col("s")).alias("x"), (F.col("y") + b * F.col("s")).alias("y"))
    corners = F.array(corner(0, 0, 0), corner(1, -1, -1), corner(2, -1, 1), corner(3, 1, -1), corner(4, 1, 1))
    return points.crossJoin(F.broadcast(step)).select("cell", F.explode(corners).alias("c")).select("cell", "c.*")  # one row is sent


class Normaliser:
    """Size factors, ln(1 + x) and z-scores learned from training cells and applied to others."""

    def fit(self, counts: DataFrame, n_cells: int) -> Normaliser:
        """Learns the median total and each feature's mean and deviation."""
        self.median = quantile(counts.groupBy("cell").agg(F.sum("x").alias("t")), "t", 0.5, "m").first()[0]
        self.stats = cut(prep.feature_stats(self._logged(counts), n_cells))
        return self

    def save(self, path: str) -> None:
        """Writes what was learned: a table of features with the median in every row."""
        self.stats.withColumn("median", F.lit(float(self.median))).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Normaliser:
        """What ``save`` wrote."""
        found, rows = cls(), spark.read.parquet(path)
        found.median, found.stats = rows.first()["median"], rows.drop("median")
        return found

    def _logged(self, counts: DataFrame) -> DataFrame:
        total = F.sum("x").over(Window.partitionBy("cell"))
        return counts.withColumn("x", F.log1p(F.col("x") / (total / F.lit(float(self.median)))))

    def transform(self, counts: DataFrame) -> DataFrame:
        """(cell, feature, x, zero)."""
        return prep.scale(self._logged(counts), 0, self.stats)


def negative_edges(edges: DataFrame, nodes: DataFrame, per_node: int = 1, seed: int = 0) -> DataFrame:
    """(src, dst): ``per_node`` pairs a node that are no edges nor loops, other ends dealt by md5.

    Nodes are numbered in the order of their hashes, and each draws places among them.
    """
    count = nodes.count()
    placed = hash_order(nodes.select("cell"), [], F.concat(F.col("cell").cast("string"), F.lit(f":{seed}")), "p").select(F.col("cell").alias("dst"), (F.col("p") - 1).alias("p"))
    draw = F.conv(F.substring(F.md5(F.concat(F.col("src").cast("string"), F.lit(":"), F.col("t").cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") % F.lit(count)
    wanted = nodes.select(F.col("cell").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(4 * per_node))).alias("t")).withColumn("p", draw)
    drawn = wanted.join(placed, "p").where("src <> dst")
    free = drawn.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("t").alias("t"))
    return free.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("t"))).where(F.col("k") <= per_node).select("src", "dst")


def align_reference(reference: DataFrame, other: DataFrame, kind: str, **widths: int) -> list[DataFrame] | DataFrame:
    """Features of two samples aligned by kind: names for rna and adt, merged intervals for the rest."""
    if kind in ("rna", "adt"):
        return align.aligned([reference, other])
    rows = [t.withColumn("r", align.parse_region(F.col("feature"))).select("cell", "r.seqname", "r.start", "r.end", "x", F.lit(i).alias("dataset")) for i, t in enumerate((reference, other))]
    return align.align_peaks(rows[0].unionAll(rows[1]), 2, **widths)


def _vectors(scaled: DataFrame, cells: DataFrame) -> DataFrame:
    """Dense vectors (cell, v), features in order."""
    rows = prep.densify(scaled, cells).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("feature", "x"))).alias("a"))
    return rows.select("cell", F.transform("a", lambda s: s["x"]).alias("v"))


def _without_batches(found: DataFrame, batches: DataFrame | None) -> DataFrame:
    return found if batches is None else reduce.correct_batches(found.join(batches, "cell"))


def rna_vectors(counts: DataFrame, cells: DataFrame, n_features: int, n_components: int, batches: DataFrame | None = None, method: str = "pca", lognorm: bool = True, scale: bool = True) -> DataFrame:
    """(cell, v) of genes and, with ``batches`` (cell, batch), their removal.

    ``pca``: totals and logarithm, variable features by dispersion, z-scores,
    principal components.  ``lsi``: features by stabilised variance (by batch, if
    there are any), then shares, logarithm, singular vectors and row z-scores.
    """
    n = cells.count()
    if method == "lsi":
        chosen = prep.stabilised_features(counts, n_features, n) if batches is None else prep.features_by_batch(counts, batches, n_features)
        kept = prep.keep_features(counts, chosen.where("chosen"))
        return _without_batches(reduce.Lsi(n_components, drop_first=False, tfidf=False).fit(kept, n).transform(kept), batches)
    logged = prep.log1p(prep.normalize_total(counts)) if lognorm else counts
    kept = prep.keep_features(logged, prep.dispersion_features(logged, n_features, n).where("chosen"))
    dense = prep.scale(kept, n) if scale else kept.withColumn("zero", F.lit(0.0))
    return _without_batches(reduce.pca(_vectors(dense, cells), n_components)[0], batches)


def adt_vectors(counts: DataFrame, cells: DataFrame, n_components: int, batches: DataFrame | None = None, method: str = "clr", scale: bool = True) -> DataFrame:
    """(cell, v) of proteins: centred log-ratio or totals and logarithm, z-scores if wanted, principal components and, with batches, their removal."""
    n, features = cells.count(), counts.select("feature").distinct().count()
    level = prep.clr_all(counts, features) if method == "clr" else prep.log1p(prep.normalize_total(counts))
    dense = prep.scale(level, n) if scale else level.withColumn("zero", F.lit(0.0))
    return _without_batches(reduce.pca(_vectors(dense, cells), n_components)[0], batches)


def peak_vectors(counts: DataFrame, cells: DataFrame, n_features: int, n_components: int, batches: DataFrame | None = None) -> DataFrame:
    """(cell, v) of peaks: variable features (by batch, if there are any), latent semantic indexing and, with batches, their removal."""
    n = cells.count()
    chosen = prep.stabilised_features(counts, n_features, n) if batches is None else prep.features_by_batch(counts, batches, n_features)
    kept = prep.keep_features(counts, chosen.where("chosen"))
    return _without_batches(reduce.Lsi(n_components).fit(kept, n).transform(kept), batches)


def best_information(edges: DataFrame, labels: DataFrame, resolutions: tuple[float, ...] = tuple(k / 10 for k in range(1, 21))) -> DataFrame:
    """One row: the largest normalised mutual information of communities at several resolutions with the labels."""
    found = cut(cluster.communities_at(edges, list(resolutions)).join(labels, "cell"))
    rows = [label_metrics.information_metrics(label_metrics.contingency(found.where(F.col("resolution") == float(r)))).select("nmi") for r in resolutions]
    return fold(DataFrame.unionAll, rows).agg(F.max("nmi").alias("nmi"))


def predict_at(places: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """(cell, feature, x): counts of the nearest measured place (the smallest id of equally near ones), for new places (cell, v)."""
    near = neighbours.knn(places, known, 1).select(F.col("src").alias("to"), F.col("dst").alias("cell"))
    return counts.join(near, "cell").select(F.col("to").alias("cell"), "feature", "x")


def denoised(counts: DataFrame, places: DataFrame, k: int = 10, kind: str = "cauchy", s: float = 1.0) -> DataFrame:
    """(cell, feature, x): each cell's mean counts over its k nearest places, itself among them, weighed by a kernel of the distance."""
    near = neighbours.knn(places, places, k)
    ends = near.join(places.select(F.col("cell").alias("src"), F.col("v").alias("a")), "src").join(places.select(F.col("cell").alias("dst"), F.col("v").alias("b")), "dst")
    weighed = ends.select("src", "dst", graph.kernel(kind, F.col("a"), F.col("b"), s).alias("w"))
    total = weighed.groupBy("src").agg(F.sum("w").alias("t"))
    sums = weighed.join(counts.select(F.col("cell").alias("dst"), "feature", "x"), "dst").groupBy("src", "feature").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return sums.join(total, "src").select(F.col("src").alias("cell"), "feature", (F.col("x") / F.col("t")).alias("x"))


def change_threshold(changes: DataFrame, seed: int = 0) -> float:
    """A least fold change worth calling: six tenths of the mean size of the outer means of a three-part mixture, 0.3 at least."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    model = GaussianMixture(k=3, seed=seed).fit(changes.select(array_to_vector(F.array("lfc")).alias("features")))
    means = sorted(float(g.mean[0]) for g in model.gaussians)
    return max(0.3, 0.6 * (abs(means[0]) + abs(means[-1])) / 2)


def background_means(counts: DataFrame, seed: int = 0) -> DataFrame:
    """(feature, background, signal): means of a two-part mixture of each feature's logged counts, one task a feature."""
    def split(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.log1p(rows["x"].to_numpy(float))
        m, s, w = np.quantile(x, [0.25, 0.75]), np.full(2, x.std() + 1e-6), np.full(2, 0.5)
        for _ in range(100):
            like = w * np.exp(-0.5 * ((x[:, None] - m) / s) ** 2) / s + 1e-300
            part = like / like.sum(axis=1, keepdims=True)
            n = part.sum(axis=0) + 1e-9
            m = (part * x[:, None]).sum(axis=0) / n
            s, w = np.sqrt((part * (x[:, None] - m) ** 2).sum(axis=0) / n) + 1e-6, n / len(x)
        return pd.DataFrame({"feature": [str(rows["feature"].iloc[0])], "background": [m.min()], "signal": [m.max()]})

    return counts.select(F.col("feature").cast("string").alias("feature"), "x").groupBy("feature").applyInPandas(split, "feature string, background double, signal double")


def nb_loss(x: Column, mean: Column, dispersion: Column) -> Column:
    """Negative log likelihood of a count under a negative binomial."""
    return (
        log_gamma(dispersion) + log_gamma(x + 1) - log_gamma(x + dispersion)
        + (dispersion + x) * F.log(1 + mean / dispersion) + x * (F.log(dispersion) - F.log(mean))
    )


def mixture_nb_loss(x: Column, background: Column, mean: Column, dispersion: Column, logit: Column) -> Column:
    """Negative log likelihood under two negative binomials of one dispersion, the second with the log odds ``-logit``."""
    one, two = -nb_loss(x, background, dispersion), -nb_loss(x, mean, dispersion) - logit
    top = F.greatest(one, two)
    return F.log1p(F.exp(-logit)) - top - F.log(F.exp(one - top) + F.exp(two - top))


def zinb_loss(x: Column, mean: Column, dispersion: Column, zeros: Column, ridge: float = 0.0) -> Column:
    """The negative binomial's with a share of extra zeros, and a penalty on the share's square."""
    none = F.exp(dispersion * (F.log(dispersion) - F.log(dispersion + mean)))
    return F.when(x > 0, nb_loss(x, mean, dispersion) - F.log(1 - zeros)).otherwise(-F.log(zeros + (1 - zeros) * none)) + ridge * zeros * zeros


def zip_loss(x: Column, mean: Column, zeros: Column, ridge: float = 0.0) -> Column:
    """The Poisson's with a share of extra zeros, and a penalty on the share's square."""
    return F.when(x > 0, poisson_loss(x, mean) - F.log(1 - zeros)).otherwise(-F.log(zeros + (1 - zeros) * F.exp(-mean))) + ridge * zeros * zeros


def contrast_loss(vectors: DataFrame, positives: DataFrame, negatives: DataFrame, tau: float = 0.1) -> DataFrame:
    """One row: mean over points of -ln(P / (P + N)), P and N sums of exp(cosine / tau) over their partners (src, dst) of both kinds."""
    unit = vectors.select("cell", graph.unit_length(F.col("v")).alias("v"))
    both = positives.select("src", "dst", F.lit(1.0).alias("p")).unionAll(negatives.select("src", "dst", F.lit(0.0).alias("p")))
    ends = both.join(unit.select(F.col("cell").alias("src"), F.col("v").alias("a")), "src").join(unit.select(F.col("cell").alias("dst"), F.col("v").alias("b")), "dst")
    pull = ends.select("src", "p", F.exp(graph.kernel("dot", F.col("a"), F.col("b")) / tau).alias("e"))
    sums = pull.groupBy("src").agg(F.sum(F.col("p") * F.col("e")).alias("pos"), F.sum((1 - F.col("p")) * F.col("e")).alias("neg"), F.sum("p").alias("n"), F.sum(1 - F.col("p")).alias("m"))
    return sums.where("n > 0 AND m > 0").agg(F.avg(-F.log(F.col("pos") / (F.col("pos") + F.col("neg")))).alias("contrast_loss"))


def poisson_loss(x: Column, mean: Column) -> Column:
    """Negative log likelihood of a count under a Poisson distribution."""
    return mean - x * F.log(mean) + log_gamma(x + 1)


class NormalPrior:
    """A normal inverse Wishart prior: mean, its weight, spread and degrees of freedom.

    Marginal likelihoods come from moments (count, sum, sum of outer products).
    """

    def __init__(self, mean: np.ndarray, scale: float = 0.005, kappa: float = 1e-4, nu: float | None = None) -> None:
        self.mean, self.kappa, self.psi = mean, kappa, np.eye(len(mean)) * scale
        self.nu = len(mean) + 2.0 if nu is None else nu

    def likelihood(self, n: float, s: np.ndarray, g: np.ndarray, centre: np.ndarray) -> float:
        """Log marginal likelihood of points with these moments, spread around ``centre``."""
        d, kappa, nu = len(self.mean), self.kappa + n, self.nu + n
        spread = g - np.outer(s, centre) - np.outer(centre, s) + n * np.outer(centre, centre)
        off = centre - self.mean
        psi = self.psi + spread + self.kappa * n / kappa * np.outer(off, off)
        gammas = sum(math.lgamma((nu - j) / 2) - math.lgamma((self.nu - j) / 2) for j in range(d))
        return -n * d / 2 * math.log(math.pi) + gammas + self.nu / 2 * np.linalg.slogdet(self.psi)[1] - nu / 2 * np.linalg.slogdet(psi)[1] + d / 2 * math.log(self.kappa / kappa)


def _by_cluster(rows: DataFrame, dim: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of each cluster (cell, v, cluster): one small matrix a cluster and partition, added up."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, own in b.groupby("cluster"):
                v = np.stack(own["v"].to_numpy())
                held[c] = held.get(c, 0.0) + np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).reshape(-1)])
        for c, t in held.items():
            yield pd.DataFrame({"cluster": [c], "t": [t]})

    parts = rows.select("v", F.col("cluster").cast("int").alias("cluster")).mapInPandas(add, "cluster int, t array<double>")
    found: dict[int, np.ndarray] = {}
    for c, at, x in parts.select("cluster", F.posexplode("t").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x")).collect():  # numbers of one matrix a cluster
        found.setdefault(c, np.zeros(1 + dim + dim * dim))[at] = x
    return {c: (int(round(t[0])), t[1 : 1 + dim], t[1 + dim :].reshape(dim, dim)) for c, t in sorted(found.items())}


def split_and_merge(points: DataFrame, k: int, dim: int, seed: int = 0, scale: float = 0.005, kappa: float = 1e-4, nu: float | None = None, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Centroids (cluster, c) after splits and merges of a mixture's clusters, and each point's nearest (cell, cluster).

    A cluster of more than five points is split in two (by k-means) where the
    Hastings ratio of marginal likelihoods under a normal inverse Wishart prior
    favours it; the centroids become those of the halves.  The nearest of the
    others, if that ratio favours it, merge, at the mean of their centroids.
    Decisions come from moments of clusters, never from points on the driver.
    """
    rows = cut(points.select("cell", "v"))
    marked = cut(rows.join(cluster.mixture(rows, k, seed), "cell"))
    whole = _by_cluster(marked, dim)
    total = sum(m[0] for m in whole.values())
    prior = NormalPrior(sum(m[1] for m in whole.values()) / total, scale, kappa, nu)
    centre = {c: m[1] / m[0] for c, m in whole.items()}
    halves: dict[int, dict[int, tuple]] = {}
    for c, m in whole.items():
        if m[0] > 5:
            own = marked.where(F.col("cluster") == c).select("cell", "v")
            halves[c] = _by_cluster(own.join(cluster.kmeans(own, 2, seed), "cell"), dim)

    def like(m: tuple, at: np.ndarray) -> float:
        return prior.likelihood(*m, at)

    split, single = {}, []
    for c, m in whole.items():
        two = halves.get(c, {})
        if len(two) == 2:
            a, b = two.values()
            ratio = math.log(alpha) + math.lgamma(a[0]) + like(a, a[1] / a[0]) + math.lgamma(b[0]) + like(b, b[1] / b[0]) - math.lgamma(m[0]) - like(m, centre[c])
            if ratio > 0:
                split[c] = [a[1] / a[0], b[1] / b[0]]
                continue
        single.append(c)
    merged: dict[int, int] = {}
    for c in single:
        others = [d for d in single if d != c]
        if not others:
            continue
        d = min(others, key=lambda o: (float(np.linalg.norm(centre[o] - centre[c])), o))  # noqa: B023
        if c in merged or d in merged or c in merged.values() or d in merged.values():
            continue
        a, b = whole[c], whole[d]
        both = tuple(x + y for x, y in zip(a, b, strict=True))
        ratio = math.lgamma(both[0]) - math.log(alpha) - math.lgamma(a[0]) - math.lgamma(b[0]) + like(both, both[1] / both[0]) - like(a, centre[c]) - like(b, centre[d])
        if ratio > 0:
            merged[c] = d
    gone = {*merged, *merged.values()}
    found = [centre[c] for c in single if c not in gone] + [h for two in split.values() for h in two] + [(centre[c] + centre[d]) / 2 for c, d in merged.items()]
    centroids = points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cluster int, c array<double>")
    return centroids, cluster.nearest_centroid(rows, centroids)


def differential_expression(counts: DataFrame, groups: DataFrame, delta: float) -> DataFrame:
    """prep.fold_changes with a data-given pseudocount and ``changed``: whether the size reaches ``delta``."""
    found = prep.fold_changes(counts, groups, prep.pseudocount(counts))
    return found.withColumn("changed", F.abs("lfc") >= delta)


def linear_surrogate(reps: tuple[DataFrame, DataFrame], coords: DataFrame, dim: int, k: int = 3) -> DataFrame:
    """(cell, v): both modalities smoothed over places and averaged, a linear stand-in for a trained encoder."""
    edges = graph.normalised(graph.symmetric(neighbours.knn(coords, coords, k, itself=False)).withColumn("w", F.lit(1.0)), coords)
    smooth = [graph.propagate(edges, r, dim, 2).select("cell", F.slice("v", 2 * dim + 1, dim).alias("v")) for r in reps]
    return graph.merged_vectors(smooth, dim)
