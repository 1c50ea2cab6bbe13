"""Filters, normalisation and statistics of sparse counts (cell, feature, x) in long form.

Zeros are absent rows.  Every operator that needs the number of cells or
features takes it as a number or counts it from the table of cells, because
cells without a count have no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .running import hash_order, quantile

#: Places along the features' means at which a local regression is fitted.
VERTICES = 4096
#: Bytes of the texts of a group of cells, which one call weighs.
TEXTS = 2 << 20


def filter_features(counts: DataFrame, min_cells: int | None = None, min_counts: float | None = None, fraction: float | None = None, n_cells: int | None = None) -> DataFrame:
    """Rows of features found in at least ``min_cells`` cells (or a fraction of them) with a total of ``min_counts``."""
    if fraction is not None:
        min_cells = int((n_cells if n_cells is not None else counts.select("cell").distinct().count()) * fraction)
    kept = counts.where("x <> 0").groupBy("feature").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    if min_cells is not None:
        kept = kept.where(F.col("n") >= min_cells)
    if min_counts is not None:
        kept = kept.where(F.col("total") >= min_counts)
    return counts.join(kept.select("feature"), "feature", "left_semi")


def filter_cells(counts: DataFrame, min_features: int | None = None, min_counts: float | None = None) -> DataFrame:
    """Rows of cells with at least so many features found, and such a total."""
    kept = counts.where("x <> 0").groupBy("cell").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    if min_features is not None:
        kept = kept.where(F.col("n") >= min_features)
    if min_counts is not None:
        kept = kept.where(F.col("total") >= min_counts)
    return counts.join(kept.select("cell"), "cell", "left_semi")


def keep_features(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the features named in ``chosen`` (feature)."""
    return counts.join(chosen.select("feature").distinct(), "feature", "left_semi")


def keep_cells(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the cells named in ``chosen`` (cell)."""
    return counts.join(chosen.select("cell").distinct(), "cell", "left_semi")


def drop_zero_cells(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the cells that are all zero in either."""
    both = a.where("x <> 0").select("cell").intersect(b.where("x <> 0").select("cell"))
    return keep_cells(a, both), keep_cells(b, both)


def check_whole(counts: DataFrame) -> DataFrame:
    """``counts``, refused if any count isn't a whole number."""
    if not counts.where(F.col("x") != F.floor("x")).isEmpty():
        raise ValueError("counts must be whole numbers")
    return counts


def unique_names(names: DataFrame, order: str, name: str = "name") -> DataFrame:
    """``names`` with repeats after the first, by ``order``, suffixed -1, -2 and so on."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return names.withColumn(name, F.when(place > 1, F.concat(name, F.lit("-"), (place - 1).cast("string"))).otherwise(F.col(name)))


def marker_name(name: Column) -> Column:
    """A protein marker's name with underscores, and species in small letters."""
    out = F.replace(name, F.lit("-"), F.lit("_"))
    for species in ("Mouse", "Human", "Rat"):
        out = F.replace(out, F.lit(species), F.lit(species.lower()))
    return out


def binarize(counts: DataFrame, threshold: float = 0) -> DataFrame:
    """x above the threshold as 1, else 0."""
    return counts.withColumn("x", (F.col("x") > threshold).cast("int"))


def reads_to_fragments(counts: DataFrame) -> DataFrame:
    """Reads as fragments: half of them, rounded up."""
    return counts.withColumn("x", F.ceil(F.col("x") / 2))


def codes(rows: DataFrame, label: str, out: str = "code") -> DataFrame:
    """``rows`` with each label's place (from 0) among the sorted distinct labels."""
    known = rows.select(label).distinct().withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)
    return rows.join(known, label)


def rescale(points: DataFrame, span: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Coordinates moved and stretched to 0..span along each axis."""
    ends = points.agg(*[f(a).alias(f"__{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    out = points.crossJoin(F.broadcast(ends))  # one row
    for a in axes:
        out = out.withColumn(a, (F.col(a) - F.col(f"__min_{a}")) / (F.col(f"__max_{a}") - F.col(f"__min_{a}")) * span)
    return out.drop(*ends.columns)


def inducing_points(spark, steps: int, span: float) -> DataFrame:
    """A grid of steps * steps points over 0..span."""
    at = lambda name: spark.range(steps).select((F.col("id") * (span / (steps - 1) if steps > 1 else 0.0)).alias(name))
    return at("x").crossJoin(at("y"))


def inducing_grid(points: DataFrame, steps: int) -> DataFrame:
    """(x, y): a grid of steps by steps points over the extent of ``points`` (x, y); none of no points."""
    ends = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 IS NOT NULL")
    at = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    grid = ends.select("*", at.alias("a")).select("*", at.alias("b"))
    along = lambda low, high, i: F.col(low) + F.col(i) * ((F.col(high) - F.col(low)) / F.lit(max(1, steps - 1)))
    return grid.select(along("x0", "x1", "a").alias("x"), along("y0", "y1", "b").alias("y"))


def flip(points: DataFrame, axis: str = "x") -> DataFrame:
    """One axis mirrored."""
    return points.withColumn(axis, -F.col(axis))


# normalisation


def normalize_total(counts: DataFrame, target: float | None = 1e4) -> DataFrame:
    """Each cell's counts scaled to the total ``target``; by default (None) the median of the cells' totals."""
    total = F.sum("x").over(Window.partitionBy("cell"))
    if target is not None:
        return counts.withColumn("x", F.col("x") / total * target)
    median = quantile(counts.groupBy("cell").agg(F.sum("x").alias("t")).where("t > 0"), "t", 0.5, "__median")
    return counts.withColumn("__t", total).crossJoin(F.broadcast(median)).withColumn("x", F.col("x") / F.col("__t") * F.col("__median")).drop("__t", "__median")


def size_factors(counts: DataFrame) -> DataFrame:
    """(cell, total, size_factor): totals over their median."""
    totals = counts.groupBy("cell").agg(F.sum("x").alias("total"))
    return totals.crossJoin(F.broadcast(quantile(totals, "total", 0.5, "m"))).select("cell", "total", (F.col("total") / F.col("m")).alias("size_factor"))


def log1p(counts: DataFrame) -> DataFrame:
    """ln(1 + x)."""
    return counts.withColumn("x", F.log1p("x"))


def feature_stats(counts: DataFrame, n_cells: int | Column, ddof: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(feature, n, mean, std) over all cells, absent rows as zeros; ``by``: for each value of these columns, of which ``n_cells`` is made.

    The stored counts' central moments, added up where they are, are moved to the
    mean over all cells: no differences of large sums.
    """
    found = counts.groupBy(*by, "feature").agg(F.count("*").alias("n"), F.avg("x").alias("a"), F.var_pop("x").alias("v"))
    n, mean = F.col("n"), F.col("a") * F.col("n") / n_cells
    square = F.col("v") * n + n * (F.col("a") - mean) * (F.col("a") - mean) + (n_cells - n) * mean * mean
    less = F.greatest(F.lit(1), n_cells - ddof) if isinstance(n_cells, Column) else max(1, n_cells - ddof)
    return found.select(*by, "feature", "n", mean.alias("mean"), F.sqrt(square / less).alias("std"))


def scale(counts: DataFrame, n_cells: int, stats: DataFrame | None = None) -> DataFrame:
    """z-scores of the stored counts, with ``zero``: the score of the feature's absent rows (deviation 0 counts as 1)."""
    stats = feature_stats(counts, n_cells) if stats is None else stats
    std = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return counts.join(stats, "feature").select("cell", "feature", ((F.col("x") - F.col("mean")) / std).alias("x"), (-F.col("mean") / std).alias("zero"))


def densify(scaled: DataFrame, cells: DataFrame) -> DataFrame:
    """All cells by all features: the stored score, else the feature's ``zero``.  Rows are cells times features."""
    grid = scaled.groupBy("feature").agg(F.first("zero").alias("zero")).crossJoin(cells.select("cell"))
    return grid.join(scaled.select("cell", "feature", "x"), ["cell", "feature"], "left").select("cell", "feature", F.coalesce("x", "zero").alias("x"))


def clr_all(counts: DataFrame, n_features: int) -> DataFrame:
    """Centred log-ratio over all features: ln(1 + x / exp(sum of ln(1 + x) / features))."""
    return counts.withColumn("x", F.log1p(F.col("x") / F.exp(F.sum(F.log1p("x")).over(Window.partitionBy("cell")) / n_features)))


def clr_present(counts: DataFrame) -> DataFrame:
    """Centred log-ratio over what is present: ln(x / geometric mean of the cell's counts), with the mean as ``gmean``."""
    centre = F.avg(F.log("x")).over(Window.partitionBy("cell"))
    return counts.where("x > 0").select("cell", "feature", (F.log("x") - centre).alias("x"), F.exp(centre).alias("gmean"))


def tfidf_fit(counts: DataFrame, n_cells: int, guard: float = 0.0) -> DataFrame:
    """(feature, idf): cells over the feature's total."""
    return counts.groupBy("feature").agg((F.lit(float(n_cells)) / (F.sum("x") + guard)).alias("idf"))


def tfidf(counts: DataFrame, n_cells: int, kind: str = "plain", idf: DataFrame | None = None) -> DataFrame:
    """Term frequency by inverse frequency, in one of five forms.

    plain: tf * N / total; guarded: the same with 1e-8 added to both sums (``idf``
    may come from other cells); log: tf * ln(1 + N / total); scaled: ln(1 + 1e4 *
    tf * N / total); documents: x * ln(N / cells with the feature), each cell to
    length 1.
    """
    if kind == "guarded":
        known = tfidf_fit(counts, n_cells, 1e-8) if idf is None else idf
        tf = counts.withColumn("tf", F.col("x") / (F.sum("x").over(Window.partitionBy("cell")) + 1e-8))
        return tf.join(known, "feature").select("cell", "feature", (F.col("tf") * F.col("idf")).alias("x"))
    if kind == "documents":
        counts = counts.where("x <> 0")
        known = counts.groupBy("feature").agg(F.log(F.lit(float(n_cells)) / F.count("*")).alias("idf"))
        weighed = counts.join(known, "feature").withColumn("x", F.col("x") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("cell")))
        return weighed.select("cell", "feature", F.when(norm == 0, 0.0).otherwise(F.col("x") / norm).alias("x"))
    tf, inverse = F.col("x") / F.sum("x").over(Window.partitionBy("cell")), F.col("idf")
    value = {"plain": tf * inverse, "log": tf * F.log1p(inverse), "scaled": F.log1p(F.lit(1e4) * tf * inverse)}[kind]
    return counts.join(tfidf_fit(counts, n_cells), "feature").select("cell", "feature", value.alias("x"))


def tfidf_texts(texts: DataFrame) -> DataFrame:
    """(cell, feature, x): ``tfidf`` of the form documents, over the words of texts (cell, text): what lies between spaces, in lower case.

    Texts are dealt into groups of cells, once, and their words' rows never travel: a group's
    different words do, with the number of cells that hold them, to be summed, and back with
    their weights.
    """
    n_cells, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // TEXTS))
    dealt = texts.where("text <> ''").select(F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("grp"), "cell", F.lower("text").alias("text")).repartition("grp")

    def by_cell(part: pa.Table) -> list[tuple[int, list[str]]]:
        whole: dict = {}
        for i, (cell, text) in enumerate(zip(part["cell"].to_pylist(), part["text"].to_pylist())):
            whole.setdefault(cell, (i, []))[1].extend(filter(None, text.split(" ")))
        return list(whole.values())

    def held(part: pa.Table) -> pa.Table:
        cells = Counter(w for _, words in by_cell(part) for w in set(words))
        return pa.table({"grp": pa.array([part["grp"][0].as_py()] * len(cells), pa.int64()), "feature": pa.array(cells.keys(), pa.string()), "n": pa.array(cells.values(), pa.int64())})

    cells = F.sum("n").over(Window.partitionBy("feature"))
    known = dealt.groupBy("grp").applyInArrow(held, "grp long, feature string, n long").select("grp", "feature", F.log(F.lit(float(n_cells)) / cells).alias("idf"))

    def weigh(part: pa.Table, weights: pa.Table) -> pa.Table:
        words, idf = weights["feature"].combine_chunks(), weights["idf"].to_numpy()
        place = {w: i for i, w in enumerate(words.to_pylist())}
        rows, codes, x = [], [], []
        for i, found in by_cell(part):
            code, times = np.unique(np.array([place[w] for w in found], np.int64), return_counts=True)
            weight = times * idf[code]
            norm = math.sqrt((weight * weight).sum())
            rows.append(np.full(len(code), i))
            codes.append(code)
            x.append(weight / norm if norm else weight * 0.0)
        rows, codes, x = (np.concatenate([np.zeros(0, kind), *some]) for some, kind in ((rows, np.int64), (codes, np.int64), (x, float)))
        return pa.table({"cell": part["cell"].combine_chunks().take(pa.array(rows)), "feature": words.take(pa.array(codes)), "x": x})

    return dealt.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(weigh, f"cell {texts.schema['cell'].dataType.simpleString()}, feature string, x double")


def l1_share(counts: DataFrame) -> DataFrame:
    """Each cell's counts over the sum of their sizes."""
    return counts.withColumn("x", F.col("x") / F.sum(F.abs("x")).over(Window.partitionBy("cell")))


def l1_log(counts: DataFrame, factor: float = 1e4) -> DataFrame:
    """ln(1 + factor * share of the cell)."""
    return l1_share(counts).withColumn("x", F.log1p(F.col("x") * factor))


# variable features


def dispersion_features(logged: DataFrame, n_top: int, n_cells: int, bins: int = 20, flavour: str = "mean") -> DataFrame:
    """(feature, mean, score, place, chosen): the most variable features for their mean.

    Dispersion is variance over mean of ln(1 + x)'s inverse.  ``mean``: z-scores
    within equal bins of the mean; ``percentile``: distance to the median in
    units of the median absolute deviation, within percentile bins.
    """
    stats = feature_stats(logged.withColumn("x", F.expm1("x")), n_cells).where("mean > 0")
    var = F.col("std") * F.col("std")
    disp = stats.select("feature", F.log1p("mean").alias("m"), F.log(F.when(var == 0, None).otherwise(var / F.col("mean"))).alias("d") if flavour == "mean" else (var / F.col("mean")).alias("d"))
    if flavour == "mean":
        low, width = F.min("m").over(Window.partitionBy()), (F.max("m").over(Window.partitionBy()) - F.min("m").over(Window.partitionBy())) / bins
        binned = disp.withColumn("bin", F.least(F.floor((F.col("m") - low) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1)))
        by = Window.partitionBy("bin")
        std, mean = F.stddev("d").over(by), F.avg("d").over(by)
        single = std.isNull()
        score = (F.col("d") - F.when(single, 0.0).otherwise(mean)) / F.when(single, mean).otherwise(std)
    else:
        binned = disp.withColumn("bin", F.ntile(bins).over(Window.orderBy(F.round(F.expm1("m"), 9), "feature")))
        medians = binned.groupBy("bin").agg(F.percentile("d", F.lit(0.5)).alias("median"))
        spread = binned.join(medians, "bin").withColumn("off", F.abs(F.col("d") - F.col("median")))
        binned = spread.join(spread.groupBy("bin").agg(F.percentile("off", F.lit(0.5)).alias("mad")), "bin")
        score = (F.col("d") - F.col("median")) / F.when(F.col("mad") == 0, None).otherwise(F.col("mad"))
    ranked = binned.select("feature", F.col("m").alias("mean"), score.alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "feature")))
    return ranked.withColumn("chosen", F.col("place") <= n_top)


def local_fit(u: np.ndarray, w: np.ndarray, span: float = 0.3, vertices: int = VERTICES) -> np.ndarray:
    """Local regression of w on u at every u: quadratics over the nearest ``span`` of the points, weighed by the cube of what is left of the cubed distance.

    With more than ``vertices`` points it is fitted at so many of them, evenly along
    their order, and read off on straight lines between; points then count by the
    moments of their stretches, so a vertex costs the same however many there are.
    """
    few = len(u) <= vertices
    order = np.argsort(u, kind="stable") if few else np.lexsort((w, u))
    x, y, n = u[order], w[order], len(u)
    many = min(n, max(1, int(n * span + 1e-5)))
    at = x if few else x[np.linspace(0, n - 1, vertices).round().astype(int)]
    # the first place from which on the window's far end is no nearer than its start
    low, high = np.zeros(len(at), np.int64), np.full(len(at), n - many)
    while (low < high).any():
        mid = np.minimum((low + high) // 2, max(n - many - 1, 0))
        further = (low < high) & (x[mid + many] - at < at - x[mid])
        low, high = np.where(further, mid + 1, low), np.where(further, high, np.where(low < high, mid, high))
    stretches = None if few else _Stretches(x, y, vertices)
    fitted = np.array([_fit_at(x, y, p, i, i + many, stretches) for p, i in zip(at, low, strict=True)])
    out = np.zeros(n)
    out[order] = fitted if few else np.interp(x, *(v[np.unique(at, return_index=True)[1]] for v in (at, fitted)))
    return out


def _fit_at(x: np.ndarray, y: np.ndarray, p: float, low: int, high: int, stretches: _Stretches | None) -> float:
    """The local quadratic's value at p over the points from ``low`` to ``high``; by moments where those are well conditioned."""
    far = max(abs(x[low] - p), abs(x[high - 1] - p))
    if stretches is not None and far > 0:
        a, b = stretches.normal(p, far, low, high)
        if np.linalg.cond(a) < 1e6:
            return float(np.linalg.solve(a, b)[0])
    d = x[low:high] - p
    root = np.sqrt((1 - (np.abs(d) / far) ** 3) ** 3 if far > 0 else np.ones(high - low))
    return float(np.linalg.lstsq(np.stack([np.ones(high - low), d, d * d], axis=1) * root[:, None], y[low:high] * root, rcond=None)[0][0])


def _powers(t: np.ndarray, many: int) -> np.ndarray:
    """The powers of numbers from 0 on, one a row."""
    out = np.ones((many, len(t)))
    for m in range(1, many):
        np.multiply(out[m - 1], t, out=out[m])
    return out


class _Stretches:
    """Sorted points in stretches of equally many, each with the moments of its points about its middle.

    The weights are polynomials on either side of a vertex, so sums of whole stretches
    follow from moments; points of the stretches at the window's ends and at the
    vertex are added one by one.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, many: int) -> None:
        self.x, self.y, self.size = x, y, max(1, -(-len(x) // many))
        first = np.arange(0, len(x), self.size)
        last = np.minimum(first + self.size, len(x)) - 1
        self.middle = (x[first] + x[last]) / 2
        d = x - np.repeat(self.middle, last + 1 - first)
        powers = np.ones(len(x))
        self.of_x, self.of_y = np.empty((14, len(first))), np.empty((12, len(first)))
        for m in range(14):
            self.of_x[m] = np.add.reduceat(powers, first)
            if m < 12:
                self.of_y[m] = np.add.reduceat(powers * y, first)
            powers = powers * d
        self.choose = np.array([[math.comb(m, k) for k in range(14)] for m in range(14)], float)

    def _shifted(self, moments: np.ndarray, p: float, far: float, a: int, b: int) -> np.ndarray:
        """Moments of the points of stretches a to b about p, in units of ``far``."""
        top = len(moments)
        inner = _powers((self.middle[a:b] - p) / far, top) @ moments[:, a:b].T / far ** np.arange(top)  # by power of the middle and order of the moment
        return np.array([sum(self.choose[m, k] * inner[m - k, k] for k in range(m + 1)) for m in range(top)])

    def normal(self, p: float, far: float, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The normal equations of the weighed quadratic at p, in units of ``far``."""
        size, middle = self.size, min(max(int(np.searchsorted(self.x, p)), low), high)
        s, t = np.zeros(5), np.zeros(3)
        for side, i, j in ((-1.0, low, middle), (1.0, middle, high)):
            a, b = -(-i // size), j // size
            x, y = np.zeros(14), np.zeros(12)
            if a < b:
                x, y = self._shifted(self.of_x, p, far, a, b), self._shifted(self.of_y, p, far, a, b)
            single = [(i, min(a * size, j)), (b * size, j)] if a <= b else [(i, j)]
            for k, m in single:
                power = _powers((self.x[k:m] - p) / far, 14)
                x, y = x + power.sum(axis=1), y + power[:12] @ self.y[k:m]
            weighed = lambda v, n: v[:n] - 3 * side * v[3 : n + 3] + 3 * v[6 : n + 6] - side * v[9 : n + 9]
            s, t = s + weighed(x, 5), t + weighed(y, 3)
        return np.array([s[0:3], s[1:4], s[2:5]]), t


def stabilised_features(counts: DataFrame, n_top: int, n_cells: int) -> DataFrame:
    """(feature, score, place, chosen) by variance of clipped standardised counts.

    The expected standard deviation comes from a local regression of log variance
    on log mean: two numbers a feature in one task, so some millions of features are
    the most.
    """
    return _stabilised(counts.withColumn("batch", F.lit(0)).withColumn("cells", F.lit(n_cells).cast("long")), n_top).drop("batch")


def _stabilised(counts: DataFrame, n_top: int) -> DataFrame:
    """(batch, feature, score, place, chosen) of counts (batch, cells, cell, feature, x): each batch, of so many cells, by itself, all in the same joins."""
    by, n = ("batch", "cells"), F.col("cells")
    stats = feature_stats(counts, n, by=by).where("mean > 0 and std > 0").select("batch", "feature", "mean", F.log10("mean").alias("u"), F.log10(F.col("std") * F.col("std")).alias("w"))
    kind = {c: stats.schema[c].dataType.simpleString() for c in ("batch", "feature")}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["batch", "feature", "mean"]].assign(expected=10 ** (local_fit(rows["u"].to_numpy(), rows["w"].to_numpy()) / 2))

    fitted = stats.groupBy("batch").applyInPandas(fit, f"batch {kind['batch']}, feature {kind['feature']}, mean double, expected double")
    z = F.least(F.sqrt(n), (F.col("x") - F.col("mean")) / F.col("expected"))
    zero = -F.first("mean") / F.first("expected")
    spread = counts.join(fitted, ["batch", "feature"]).groupBy(*by, "feature").agg(((F.sum(z * z) + (n - F.count("*")) * zero * zero) / (n - 1)).alias("score")).drop("cells")
    # scores that differ by rounding alone are ties
    return spread.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(F.round("score", 9).desc(), "feature"))).withColumn("chosen", F.col("place") <= n_top)


def features_by_batch(counts: DataFrame, batches: DataFrame, n_top: int) -> DataFrame:
    """(feature, batches, rank, chosen): features by how often, then by the median of how high, each batch ranks them."""
    cells = batches.select("cell", "batch").distinct().join(batches.groupBy("batch").agg(F.count("*").alias("cells")), "batch")
    ranked = _stabilised(counts.join(cells, "cell"), n_top).where("chosen").select("feature", "place")
    both = ranked.groupBy("feature").agg(F.count("*").alias("batches"), F.percentile("place", F.lit(0.5)).alias("rank"))
    place = F.row_number().over(Window.orderBy(F.col("rank"), F.col("batches").desc(), "feature"))
    return both.withColumn("chosen", place <= n_top)


def gene_selection(counts: DataFrame, n_cells: int, threshold: float = 0, atleast: int = 10, xoffset: float = 5.0, yoffset: float = 0.02, decay: float = 1.5, n: int | None = None, steps: int = 100) -> tuple[DataFrame, float]:
    """(feature, zero_rate, mean_log2, chosen), and the offset used.

    A feature is chosen if its share of zeros lies above exp(-decay * (mean log2 -
    xoffset)) + yoffset and at least ``atleast`` cells detect it.  With ``n`` the
    offset is bisected from 0..10 until so many are chosen; each step is a count.
    """
    seen = counts.where(F.col("x") > threshold).groupBy("feature").agg(F.count("*").alias("cells"), F.avg(F.log2("x")).alias("mean_log2"))
    stats = cut(seen.where(F.col("cells") >= atleast).select("feature", (1 - F.col("cells") / n_cells).alias("zero_rate"), "mean_log2"))
    rule = lambda at: F.col("zero_rate") > F.exp(-decay * (F.col("mean_log2") - at)) + yoffset
    if n is not None:
        low, up = 0.0, 10.0
        for _ in range(steps):
            found = stats.where(rule(xoffset)).count()
            if found == n:
                break
            if found < n:
                up, xoffset = xoffset, (xoffset + low) / 2
            else:
                low, xoffset = xoffset, (xoffset + up) / 2
    return stats.withColumn("chosen", rule(xoffset)), xoffset


# aggregation


def pseudo_bulk(counts: DataFrame, labels: DataFrame, min_samples: int | None = None, seed: int = 0) -> DataFrame:
    """(sample, feature, x): mean counts of each label's cells, zeros included.

    If there are fewer labels than ``min_samples`` + 1, each label adds means of
    random subsets of its cells, chosen by the order of md5: the label's name and the
    subset's number name the sample.
    """
    members = labels.select("cell", F.col("label").cast("string").alias("sample"))
    groups = members.select("sample").distinct().count()
    if min_samples is not None and groups and min_samples + 1 > groups:
        times = (min_samples + 1) // groups
        share = (1 / times + 1) / 2
        sizes = labels.groupBy("label").agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("n"))
        for t in range(times):
            placed = hash_order(labels.select("cell", "label"), ["label"], F.concat(F.col("cell").cast("string"), F.lit(f":{seed}:{t}")), "p")
            part = placed.join(sizes, "label").where("p <= n").select("cell", F.concat(F.col("label").cast("string"), F.lit(f"_{t}")).alias("sample"))
            members = members.unionAll(part)
    sizes = members.groupBy("sample").agg(F.count("*").alias("n"))
    sums = counts.join(members, "cell").groupBy("sample", "feature").agg(F.sum("x").alias("x"))
    return sums.join(sizes, "sample").select("sample", "feature", (F.col("x") / F.col("n")).alias("x"))


def fold_changes(counts: DataFrame, groups: DataFrame, pseudo: float = 0.05) -> DataFrame:
    """(feature, mean_a, mean_b, lfc): log2 ratio of the means in groups a and b, a pseudocount added to both."""
    sizes = {r["group"]: r["n"] for r in groups.groupBy("group").agg(F.count("*").alias("n")).collect()}  # two rows
    part = lambda g: F.sum(F.when(F.col("group") == g, F.col("x")).otherwise(0.0)) / sizes.get(g, 1)
    means = counts.join(groups, "cell").groupBy("feature").agg(part("a").alias("mean_a"), part("b").alias("mean_b"))
    return means.withColumn("lfc", F.log2(F.col("mean_a") + pseudo) - F.log2(F.col("mean_b") + pseudo))


def pseudocount(counts: DataFrame, share: float = 0.9, low: float = 0.05, high: float = 0.5) -> float:
    """A quantile of the features' means, kept within bounds."""
    q = quantile(counts.groupBy("feature").agg(F.avg("x").alias("m")), "m", share, "q").first()[0]
    return float(min(high, max(low, q if q is not None else low)))


def posterior_summary(samples: DataFrame, delta: float) -> DataFrame:
    """(feature, mean, median, sd, p_de): summaries of sampled log fold changes (feature, lfc)."""
    return samples.groupBy("feature").agg(
        F.avg("lfc").alias("mean"), F.percentile("lfc", F.lit(0.5)).alias("median"), F.stddev_pop("lfc").alias("sd"), F.avg((F.abs("lfc") >= delta).cast("double")).alias("p_de")
    )
