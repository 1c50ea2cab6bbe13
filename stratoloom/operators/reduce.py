"""Linear dimension reduction and batch correction."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import mean_of, once
from ..lineage import cut
from . import prep


#: Share of the way that a round of batch correction goes.
DAMPED = 0.25
#: Counts of a block that stays in place, on average; fewer while blocks are few.
BLOCK = 1 << 22


def added(parts: DataFrame) -> np.ndarray:
    """The sum of equally long vectors (v), one from each partition: they are added where they are, and one arrives."""
    rows = parts.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return np.array([r["x"] for r in rows])


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of (v): one small matrix a partition, added up."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if n:
            yield pd.DataFrame({"v": [np.concatenate([[n], s, g.reshape(-1)])]})

    total = added(vectors.select("v").mapInPandas(add, "v array<double>"))
    if not len(total):
        return 0, np.zeros(0), np.zeros((0, 0))
    dim = int((np.sqrt(4 * len(total) - 3) - 1) / 2)
    return int(total[0]), total[1 : 1 + dim], total[1 + dim :].reshape(dim, dim)


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(cell, v): the k first principal components, and the loadings (dimensions by k).

    From the covariance of the dimensions, which stays small; each component's
    largest loading is positive.
    """
    n, s, g = moments(vectors)
    mean = s / n
    values, load = np.linalg.eigh((g - n * np.outer(mean, mean)) / (n - 1))
    load = load[:, np.argsort(-values, kind="stable")[:k]]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    return _project(vectors, mean, load), load


def _project(vectors: DataFrame, mean: np.ndarray, load: np.ndarray) -> DataFrame:
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell": b["cell"], "v": list((np.stack(b["v"].to_numpy()) - mean) @ load) if len(b) else []})

    return vectors.select("cell", "v").mapInPandas(project, "cell long, v array<double>")


def turned(rows: DataFrame, turn: np.ndarray, key: str) -> DataFrame:
    """Rows (key, v) with every vector multiplied by a small matrix."""
    kind = rows.schema[key].dataType.simpleString()

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "v": list(np.stack(b["v"].to_numpy()) @ turn) if len(b) else []})

    return rows.select(key, "v").mapInPandas(multiply, f"{key} {kind}, v array<double>")


class Blocks:
    """Counts (cell, feature, x), packed in blocks of whole features: they stay where they are, and vectors come to them.

    A feature's vector goes to one block, a cell's to each block that has the cell;
    cells' sums are partly added in the blocks.
    """

    def __init__(self, counts: DataFrame) -> None:
        many = counts.count()
        blocks = max(1, math.ceil(many / BLOCK), min(12, math.ceil(16 * many / BLOCK)))
        self.tasks = min(blocks, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.kind = {end: counts.schema[end].dataType.simpleString() for end in ("feature", "cell")}
        rows = counts.select(F.pmod(F.xxhash64("feature"), F.lit(blocks)).cast("int").alias("block"), "feature", "cell", F.col("x").cast("double").alias("x"))
        held = rows.repartition(self.tasks, "block").groupBy("block").applyInPandas(_packed, f"block int, i binary, j binary, x binary, feature array<{self.kind['feature']}>, cell array<{self.kind['cell']}>")
        self.held = held.repartition(self.tasks, "block").persist(StorageLevel.DISK_ONLY)
        self.ends = {end: cut(self.held.select(F.col("block").alias("to"), F.posexplode(end).alias("place", end))) for end in self.kind}

    def sums(self, side: DataFrame, width: int, on: str, by: str) -> DataFrame:
        """(by, v): sums of x times the vectors of one end of the counts, for the other end."""

        def multiply(held: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            if not len(held):
                return pd.DataFrame({c: [] for c in (by, *columns)})
            place = {end: np.frombuffer(held[name].iloc[0], np.int32) for end, name in (("feature", "i"), ("cell", "j"))}
            v = np.zeros((len(held[on].iloc[0]), width))
            v[sent["place"].to_numpy()] = sent[columns].to_numpy()
            names, x = held[by].iloc[0], np.frombuffer(held["x"].iloc[0])
            return pd.DataFrame({by: names} | {c: np.bincount(place[by], x * v[place[on], i], len(names)) for i, c in enumerate(columns)})

        columns = [f"v{i}" for i in range(width)]
        sent = self.ends[on].join(side.select(on, "v"), on).select("to", "place", *[F.get("v", i).alias(c) for i, c in enumerate(columns)]).repartition(self.tasks, "to")
        parts = self.held.groupBy("block").cogroup(sent.groupBy("to")).applyInPandas(multiply, f"{by} {self.kind[by]}, " + ", ".join(f"{c} double" for c in columns))
        # a feature is whole in its block
        return cut(parts.select(by, F.array(*columns).alias("v")) if by == "feature" else parts.groupBy(by).agg(F.array(*[F.sum(c) for c in columns]).alias("v")))

    def release(self) -> None:
        """Gives up the blocks, which nothing reads again."""
        self.held.unpersist()


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    """A block's counts in one row: places of both ends and numbers; and the ends by their places."""
    (i, feature), (j, cell) = pd.factorize(part["feature"]), pd.factorize(part["cell"])
    return pd.DataFrame({"block": part["block"].iloc[:1], "i": [i.astype(np.int32).tobytes()], "j": [j.astype(np.int32).tobytes()], "x": [part["x"].to_numpy().tobytes()], "feature": [list(feature)], "cell": [list(cell)]})


class Lsi:
    """Latent semantic indexing: TF-IDF, L1 norm, logarithm, singular vectors, row z-scores, the first dropped.

    Every step can be left out.  fit() learns inverse frequencies and singular
    vectors from chosen features; transform() applies them to any cells.  Tables
    of features and of cells stay distributed; only matrices of k + 10 numbers
    squared reach the driver.
    """

    def __init__(self, k: int = 20, drop_first: bool = True, log: bool = True, norm: bool = True, z_score: bool = True, tfidf: bool = True, svd: bool = True, seed: int = 0) -> None:
        self.drop_first, self.log, self.norm, self.z_score, self.tfidf, self.svd = drop_first, log, norm, z_score, tfidf, svd
        self.k, self.seed, self.load, self.idf = k + drop_first, seed, None, None

    def _weigh(self, counts: DataFrame) -> DataFrame:
        if self.tfidf:
            counts = prep.tfidf(counts, 0, "guarded", self.idf)
        if self.norm:
            counts = prep.l1_share(counts)
        return counts.withColumn("x", F.log1p(F.col("x") * 1e4)) if self.log else counts

    def fit(self, counts: DataFrame, n_cells: int, features: DataFrame | None = None) -> Lsi:
        """Learns from counts (cell, feature, x), of the named features (feature) if any; the projection stays a table."""
        if features is not None:
            counts = prep.keep_features(counts, features)
        self.idf = cut(prep.tfidf_fit(counts, n_cells, 1e-8)) if self.tfidf else None
        weighed = cut(self._weigh(counts))
        names = weighed.select("feature").distinct()
        width = min(self.k + 10, names.count())
        blocks = Blocks(weighed)
        # the same start wherever features are: numbers drawn by the hash of their names
        draw = [F.sqrt(-2 * F.log((F.pmod(F.xxhash64("feature", F.lit(f"{self.seed}a{i}")), F.lit(1 << 30)) + 0.5) / float(1 << 30))) * F.cos(2 * np.pi * F.pmod(F.xxhash64("feature", F.lit(f"{self.seed}b{i}")), F.lit(1 << 30)) / float(1 << 30)) for i in range(width)]
        basis, width = self._orthogonal(names.select("feature", F.array(*draw).alias("v")))
        for step in range(6):  # power steps of X'X, orthogonal again after each
            there = blocks.sums(basis, width, "feature", "cell")
            basis, width = self._orthogonal(blocks.sums(there, width, "cell", "feature"), 1 + (step == 5))
        _, _, g = moments(blocks.sums(basis, width, "feature", "cell"))
        blocks.release()
        values, turn = np.linalg.eigh(g)
        self.load = cut(turned(basis, turn[:, np.argsort(-values)[: self.k]], "feature"))
        # a vector's largest loading is positive
        ends = self.load.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.max_by("x", F.struct(F.abs("x"), "x")).alias("x")).orderBy("i").collect()
        self.load = cut(turned(self.load, np.diag([1.0 if r["x"] >= 0 else -1.0 for r in ends]), "feature"))
        self.k = len(ends)  # fewer, if the counts have no more independent columns
        return self

    @staticmethod
    def _orthogonal(rows: DataFrame, times: int = 1) -> tuple[DataFrame, int]:
        """Orthonormal columns that span the same, by the Gram matrix, and how many (twice to the last digits)."""
        for _ in range(times):
            _, _, g = moments(rows)
            values, axes = np.linalg.eigh(g)
            kept = values > values[-1] * 1e-12
            rows = cut(turned(rows, axes[:, kept] / np.sqrt(values[kept]), "feature"))
        return rows, int(kept.sum())

    def transform(self, counts: DataFrame) -> DataFrame:
        """(cell, v); without singular vectors (cell, feature, x)."""
        if self.svd and self.load is None:
            raise RuntimeError("fit() comes before transform()")
        weighed = self._weigh(counts)
        if not self.svd:
            return weighed
        out = weighed.join(self.load.withColumnRenamed("v", "b"), "feature").groupBy("cell").agg(F.array(*[F.sum(F.col("x") * F.get("b", i)) for i in range(self.k)]).alias("v"))
        if self.z_score:
            out = out.withColumn("v", row_z_scores(F.col("v"), 1e-8))
        return out.withColumn("v", F.slice("v", 2, self.k)) if self.drop_first else out

    def save(self, path: str) -> None:
        """Writes what was learned and how: tables of features, and a line of settings."""
        spark = self.load.sparkSession
        settings = {k: v for k, v in vars(self).items() if k not in ("load", "idf")}
        spark.createDataFrame([(json.dumps(settings),)], "settings string").write.mode("overwrite").json(f"{path}/settings")
        self.load.write.mode("overwrite").parquet(f"{path}/load")
        if self.idf is not None:
            self.idf.write.mode("overwrite").parquet(f"{path}/idf")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Lsi:
        """What ``save`` wrote."""
        found = cls()
        vars(found).update(json.loads(spark.read.json(f"{path}/settings").first()["settings"]))
        found.load = spark.read.parquet(f"{path}/load")
        found.idf = spark.read.parquet(f"{path}/idf") if found.tfidf else None
        return found


def row_z_scores(v: Column, guard: float = 0.0) -> Column:
    """A vector less its mean over its sample deviation (and a guard)."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    std = lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(v) - 1))
    # what stands in a lambda is worked out for every number; a list of one holds it
    return once(mean, lambda m: once(std(m), lambda s: F.transform(v, lambda x: (x - m) / (s + guard))))


def _taken_off(v: np.ndarray, part: np.ndarray, effect: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Vectors less their batches' effects (clusters, batches, dimensions) by their shares in the clusters: a product a batch, nothing is held for each point, cluster and dimension."""
    out = v.copy()
    for i in np.unique(batch):
        own = batch == i
        out[own] -= part[own] @ effect[:, i]
    return out


def correct_batches(vectors: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 10, inner: int = 20, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    """(cell, v): batch effects removed by soft clusters and a linear correction in each (cell, v, batch).

    Points at unit length are dealt softly to clusters in which every batch
    should have its share: a cluster that holds more of a batch than chance gives
    less of it (weight ``theta``, softness ``sigma``).  Then each cluster's batches
    are fitted by ridge regression on the original vectors and their effects taken
    off, by the points' shares in the clusters.  Rounds end when the objective
    changes by less than ``tol``.

    A pass sends centres and batch totals to every partition and adds up, for
    each cluster and batch, points and vectors; nothing else moves.
    """
    from .cluster import kmeans

    rows = cut(vectors.select("cell", "v", F.col("batch").cast("string").alias("batch")))
    per_batch = {r["batch"]: r["count"] for r in rows.groupBy("batch").count().orderBy("batch").collect()}  # one row a batch
    names, count = list(per_batch), sum(per_batch.values())
    if len(names) < 2:
        return rows.select("cell", "v")
    share = np.array([per_batch[b] for b in names]) / count
    dim = len(rows.first()["v"])
    k = clusters or max(2, min(100, round(count / 30)))
    place = {b: i for i, b in enumerate(names)}
    effect: np.ndarray | None = None  # clusters, batches, dimensions
    state: dict = {}

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)

    def soft(z: np.ndarray, batch: np.ndarray, centre: np.ndarray, log_pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = 2 * (1 - z @ centre.T)
        log = -far / sigma + log_pull[:, batch].T
        log -= log.max(axis=1, keepdims=True)
        part = np.exp(log)
        return part / part.sum(axis=1, keepdims=True), far

    def read(v: np.ndarray, batch: np.ndarray) -> np.ndarray:
        """The corrected vectors of the last round: shares that the effects were fitted with, then the effects taken off."""
        if effect is None:
            return v
        part = np.ones((len(v), 0))
        z = v
        for e, centre, log_pull in state["past"]:
            z = _taken_off(v, soft(unit(z), batch, centre, log_pull)[0], e, batch)
        return z

    def sums(centre: np.ndarray, log_pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """For clusters and batches: points, their corrected unit vectors, their original vectors; and the objective's first part."""
        size = k * len(names)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + size * (1 + 2 * dim))
            for b in batches:
                if len(b):
                    v, of = np.stack(b["v"].to_numpy()), b["batch"].map(place).to_numpy()
                    z = unit(read(v, of))
                    part, far = soft(z, of, centre, log_pull)
                    total[0] += (part * far).sum() + sigma * (part * np.log(np.maximum(part, 1e-300))).sum()
                    for i in np.unique(of):
                        own = of == i
                        p = part[own]
                        block = np.concatenate([p.sum(axis=0)[:, None], p.T @ z[own], p.T @ v[own]], axis=1)
                        total[1:].reshape(k, len(names), 1 + 2 * dim)[:, i] += block
            yield pd.DataFrame({"v": [total]})

        total = added(rows.select("v", "batch").mapInPandas(add, "v array<double>"))
        found = total[1:].reshape(k, len(names), 1 + 2 * dim)
        return found[..., 0], found[..., 1 : 1 + dim], found[..., 1 + dim :], float(total[0])

    state["past"] = []
    start = rows.select("cell", row_unit("v").alias("v"))
    centre = unit(np.array([r["c"] for r in start.join(kmeans(start, k, seed), "cell").groupBy("cluster").agg(mean_of("v", dim).alias("c")).orderBy("cluster").collect()]))  # k rows
    k = len(centre)
    log_pull = np.zeros((k, len(names)))
    before = np.inf
    for _ in range(rounds):
        last = np.inf
        for _ in range(inner):
            n, z, v, cost = sums(centre, log_pull)
            expected = np.outer(n.sum(axis=1), share)
            diverse = theta * sigma * (n * np.log((n + 1) / (expected + 1))).sum()
            # a step towards the pull that these totals ask for: all points move at once, and would swap for ever
            next_centre, next_pull = unit(z.sum(axis=1)), log_pull + DAMPED * (theta * np.log((expected + 1) / (n + 1)) - log_pull)
            if abs(last - cost - diverse) <= tol * abs(cost + diverse):
                break
            last, centre, log_pull = cost + diverse, next_centre, next_pull
        # the shares behind n and v are those of centre and log_pull
        fitted = np.zeros((k, len(names), dim))
        for c in range(k):
            design = np.zeros((len(names) + 1, len(names) + 1))
            design[0, 0], design[0, 1:], design[1:, 0] = n[c].sum(), n[c], n[c]
            design[1:, 1:] = np.diag(n[c])
            penalty = np.diag([0.0] + [ridge] * len(names))
            fitted[c] = np.linalg.solve(design + penalty, np.concatenate([v[c].sum(axis=0)[None], v[c]]))[1:]
        effect = fitted
        state["past"] = [*state["past"], (fitted, centre, log_pull)]
        centre, log_pull = next_centre, next_pull
        if abs(before - cost - diverse) <= tol * abs(cost + diverse):
            break
        before = cost + diverse

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell": b["cell"], "v": list(read(np.stack(b["v"].to_numpy()), b["batch"].map(place).to_numpy())) if len(b) else []})

    return rows.mapInPandas(out, "cell long, v array<double>")


def row_unit(v: str) -> Column:
    """A vector at length 1 (a vector of zeros stays)."""
    length = F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(length == 0, 0.0).otherwise(x / length))
