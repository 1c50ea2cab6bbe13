"""Metrics of neighbour graphs: batch mixing, label separation, spatial autocorrelation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import chi2_critical
from ..lineage import small
from .graph import component_share
from .neighbours import knn
from .prep import codes
from .running import quantile


def neighbour_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, label, n): how many neighbours have each label (cell, label)."""
    return edges.join(labels.select(F.col("cell").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))


def lisi(edges: DataFrame, labels: DataFrame, least: int = 5) -> DataFrame:
    """(cell, lisi): 1 / sum of squared shares of labels among the neighbours; points of fewer than ``least`` are left out."""
    w = Window.partitionBy("src")
    counted = neighbour_counts(edges, labels).withColumn("k", F.sum("n").over(w)).where(F.col("k") >= least)
    share = F.col("n") / F.col("k")
    return counted.groupBy(F.col("src").alias("cell")).agg((1 / F.sum(share * share)).alias("lisi"))


def ilisi(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: (median LISI - 1) / (batches - 1), 0 for one batch (batches: cell, label)."""
    kinds = batches.agg(F.count_distinct("label").alias("b"))
    median = quantile(lisi(edges, batches), "lisi", 0.5, "m")
    return median.crossJoin(kinds).select(F.when(F.col("b") > 1, (F.col("m") - 1) / (F.col("b") - 1)).otherwise(0.0).alias("ilisi"))


def clisi(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: (labels - median LISI) / (labels - 1), 0 for one label."""
    kinds = labels.agg(F.count_distinct("label").alias("b"))
    median = quantile(lisi(edges, labels), "lisi", 0.5, "m")
    return median.crossJoin(kinds).select(F.when(F.col("b") > 1, (F.col("b") - F.col("m")) / (F.col("b") - 1)).otherwise(0.0).alias("clisi"))


def batch_shares(batches: DataFrame) -> DataFrame:
    """(batch, share) of all cells."""
    return batches.groupBy("batch").agg(F.count("*").alias("n")).select("batch", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def batch_tests(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """(src, k, chi2, dof): neighbours' batches against the shares of all cells; batches not seen count as 0."""
    shares = batch_shares(batches)
    counted = neighbour_counts(edges, batches.withColumnRenamed("batch", "label"))
    sizes = counted.groupBy("src").agg(F.sum("n").alias("k"))
    grid = sizes.crossJoin(small(shares)).join(counted.withColumnRenamed("label", "batch"), ["src", "batch"], "left")
    expected = F.col("share") * F.col("k")
    off = F.coalesce("n", F.lit(0)) - expected
    return grid.groupBy("src").agg(F.first("k").alias("k"), F.sum(off * off / expected).alias("chi2"), (F.count("*") - 1).alias("dof"))


def kbet(edges: DataFrame, batches: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: the share of cells whose neighbours' batches are as in all cells."""
    dof = batches.select("batch").distinct().count() - 1
    if dof < 1:
        return batches.agg(F.lit(1.0).alias("kbet"))
    tests = batch_tests(edges, batches)
    return batches.select("cell").join(tests, F.col("cell") == F.col("src"), "left").agg((1 - F.avg(F.coalesce((F.col("chi2") > chi2_critical(dof, alpha)).cast("int"), F.lit(0)))).alias("kbet"))


def kbet_by_label(edges: DataFrame, cells: DataFrame, k: int = 50, alpha: float = 0.05) -> DataFrame:
    """(label, kbet): rejected over tested cells of each label with ten cells or more in several batches (cells: cell, label, batch).

    A label tests its cells on as many neighbours as a quarter of its mean batch
    size, from 10 to 70, taken by id; cells of fewer than five aren't tested.
    """
    sizes = cells.groupBy("label", "batch").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("cells"), F.count("*").alias("batches"), F.avg("n").alias("mean"))
    fine = sizes.where("cells >= 10 AND batches > 1").select("label", F.least(F.lit(70), F.greatest(F.lit(10), F.floor(F.col("mean") / 4))).alias("k0"))
    owned = edges.select("src", "dst").join(cells.select(F.col("cell").alias("src"), "label").join(small(fine), "label"), "src")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    taken = owned.withColumn("p", place).where(F.col("p") <= F.least("k0", F.lit(k)))
    tests = batch_tests(taken.select("src", "dst"), cells.select("cell", "batch")).where("k >= 5 AND dof >= 1")
    dof = max(1, cells.select("batch").distinct().count() - 1)
    judged = tests.join(cells.select(F.col("cell").alias("src"), "label"), "src")
    return judged.groupBy("label").agg(F.avg((F.col("chi2") > chi2_critical(dof, alpha)).cast("int")).alias("kbet"))


def kbet_labelled(edges: DataFrame, cells: DataFrame, k: int = 50) -> DataFrame:
    """One row: 1 - the mean rejection of the labels tested."""
    return kbet_by_label(edges, cells, k).agg((1 - F.avg("kbet")).alias("kbet_labelled"))


def graph_connectivity(points: DataFrame, k: int = 15) -> DataFrame:
    """One row: mean over labels of the share of their largest connected part in the neighbour graph (cell, v, label)."""
    edges = knn(points, points, k - 1, itself=False)
    return component_share(edges, points.select("cell", "label")).agg(F.avg("share").alias("graph_connectivity"))


def moran_geary(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One row: morans_i and gearys_c of (cell, value), each cell's neighbours weighing the same and 1 in all."""
    n, mean = values.agg(F.count("*"), F.avg("value")).first()
    z = values.select("cell", (F.col("value") - mean).alias("z"))
    weight = 1 / F.count("*").over(Window.partitionBy("src"))
    pairs = edges.select("src", "dst", weight.alias("w")).join(z.select(F.col("cell").alias("src"), F.col("z").alias("zi")), "src").join(z.select(F.col("cell").alias("dst"), F.col("z").alias("zj")), "dst")
    sums = pairs.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), F.sum(F.col("w") * (F.col("zi") - F.col("zj")) * (F.col("zi") - F.col("zj"))).alias("gap"))
    total = z.agg(F.sum(F.col("z") * F.col("z")).alias("sq"))
    return sums.crossJoin(total).select((n / F.col("s0") * F.col("cross") / F.col("sq")).alias("morans_i"), ((n - 1) / (2 * F.col("s0")) * F.col("gap") / F.col("sq")).alias("gearys_c"))


def moran_columns(edges: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """(name, morans_i) of several columns of (cell, ...) at once; text stands for its place among the sorted values."""
    kinds = dict(table.dtypes)
    for c in columns:
        if kinds[c] == "string":
            table = codes(table, c, f"__{c}").drop(c).withColumnRenamed(f"__{c}", c)
    long = table.select("cell", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["cell"], columns, "name", "x")
    means = long.groupBy("name").agg(F.avg("x").alias("mean"), F.count("*").alias("n"), (F.var_pop("x") * F.count("*")).alias("sq"))
    z = long.join(F.broadcast(means), "name").select("cell", "name", (F.col("x") - F.col("mean")).alias("z"))  # a row a column
    weighed = edges.select("src", "dst", (1 / F.count("*").over(Window.partitionBy("src"))).alias("w"))
    ends = weighed.join(z.select(F.col("cell").alias("src"), "name", F.col("z").alias("a")), "src").join(z.select(F.col("cell").alias("dst"), "name", F.col("z").alias("b")), ["dst", "name"])
    sums = ends.groupBy("name").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("a") * F.col("b")).alias("cross"))
    return sums.join(means, "name").select("name", (F.col("n") / F.col("s0") * F.col("cross") / F.col("sq")).alias("morans_i"))


def perplexity_lisi(edges: DataFrame, labels: DataFrame, perplexity: float, tries: int = 50) -> DataFrame:
    """(cell, lisi) with neighbours (src, dst, dist) weighed by a Gaussian kernel of a fixed perplexity.

    Each cell's bandwidth is bisected inside its own row, in SQL functions.
    """
    lists = edges.join(labels.select(F.col("cell").alias("dst"), "label"), "dst").groupBy("src").agg(F.collect_list(F.struct("dist", "label")).alias("near"))
    goal = math.log(perplexity)
    state = "named_struct('low', 0D, 'high', 1e12D, 'beta', 1D)"
    entropy = "ln(aggregate(near, 0D, (t, y) -> t + exp(-s.beta * y.dist))) + s.beta * aggregate(near, 0D, (t, y) -> t + y.dist * exp(-s.beta * y.dist)) / aggregate(near, 0D, (t, y) -> t + exp(-s.beta * y.dist))"
    step = f"CASE WHEN {entropy} > {goal}D THEN named_struct('low', s.beta, 'high', s.high, 'beta', CASE WHEN s.high > 1e11D THEN s.beta * 2 ELSE (s.beta + s.high) / 2 END) ELSE named_struct('low', s.low, 'high', s.beta, 'beta', (s.beta + s.low) / 2) END"
    tuned = lists.withColumn("beta", F.expr(f"aggregate(sequence(1, {tries}), {state}, (s, i) -> {step}).beta"))
    parts = tuned.select("src", F.explode("near").alias("y"), "beta").select("src", F.col("y.label").alias("label"), F.exp(-F.col("beta") * F.col("y.dist")).alias("w")).groupBy("src", "label").agg(F.sum("w").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("src"))
    return parts.withColumn("p", share).groupBy(F.col("src").alias("cell")).agg((1 / F.sum(F.col("p") * F.col("p"))).alias("lisi"))
