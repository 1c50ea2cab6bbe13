"""Agreement of two labelings, all from one contingency table.

Rows are (cluster, label); every metric is computed from counts, never from
pairs of cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import log_gamma
from ..lineage import small


def contingency(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """(cluster, label, n, a, b, total): cells in both, in the cluster, with the label, and in all."""
    table = rows.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return table.select(
        "*", F.sum("n").over(Window.partitionBy("cluster")).alias("a"), F.sum("n").over(Window.partitionBy("label")).alias("b"), F.sum("n").over(Window.partitionBy()).alias("total")
    )


def _pairs(x: Column) -> Column:
    return x * (x - 1) / 2


def pair_counts(table: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn, total) as doubles: pairs of cells together in both, in the cluster only, by label only, in neither."""
    n, a, b = (F.col(c).cast("double") for c in ("n", "a", "b"))
    # a cluster's own pairs, shared out over its rows
    sums = table.agg(F.sum(_pairs(n)).alias("tp"), F.sum(n * (a - 1) / 2).alias("same"), F.sum(n * (b - 1) / 2).alias("alike"), F.sum(n).alias("total"))
    return sums.select("tp", (F.col("same") - F.col("tp")).alias("fp"), (F.col("alike") - F.col("tp")).alias("fn"), (_pairs(F.col("total")) - F.col("same") - F.col("alike") + F.col("tp")).alias("tn"), "total")


def pair_metrics(table: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: precision, recall, f_measure, jaccard, dice, fmi, ari (null where undefined)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    over = lambda x, y: F.when(y != 0, x / y)
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    spread = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    return pair_counts(table).select(
        p.alias("precision"), r.alias("recall"), over((beta * beta + 1) * p * r, beta * beta * p + r).alias("f_measure"),
        over(tp, tp + fp + fn).alias("jaccard"), over(2 * tp, 2 * tp + fp + fn).alias("dice"), over(tp, F.sqrt((tp + fp) * (tp + fn))).alias("fmi"),
        F.when((fn == 0) & (fp == 0), 1.0).otherwise(over(2 * (tp * tn - fn * fp), spread)).alias("ari"),
    )


def purity(table: DataFrame) -> DataFrame:
    """One row: the share of cells whose label is the commonest of their cluster."""
    return table.groupBy("cluster").agg(F.max("n").alias("m"), F.first("total").alias("total")).agg((F.sum("m") / F.first("total")).alias("purity"))


def information(table: DataFrame) -> DataFrame:
    """One row: mi, h_cluster, h_label (nats)."""
    share = F.col("n") / F.col("total")
    return table.agg(
        F.sum(share * F.log(F.col("total") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(share * F.log(F.col("a") / F.col("total")))).alias("h_cluster"), (-F.sum(share * F.log(F.col("b") / F.col("total")))).alias("h_label"),
    )


def information_metrics(table: DataFrame) -> DataFrame:
    """One row: nmi (arithmetic mean), homogeneity, completeness, v_measure; 1 where a labeling has no entropy."""
    mi, hc, hl = F.col("mi"), F.col("h_cluster"), F.col("h_label")
    base = information(table).select(
        F.when((hc == 0) & (hl == 0), 1.0).otherwise(mi / ((hc + hl) / 2)).alias("nmi"),
        F.when(hl == 0, 1.0).otherwise(mi / hl).alias("homogeneity"), F.when(hc == 0, 1.0).otherwise(mi / hc).alias("completeness"),
    )
    h, c = F.col("homogeneity"), F.col("completeness")
    return base.withColumn("v_measure", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)))


def adjusted_information(table: DataFrame) -> DataFrame:
    """One row: emi (expected mutual information of random labelings) and ami.

    Every pair of margins contributes over the overlaps it may have.  Overlaps more
    than 40 deviations off what is expected are left out: their share is below
    10^-300, and no sum of doubles shows them.
    """
    total = float(table.agg(F.first("total")).first()[0])
    a, b = table.select("cluster", F.col("a").cast("double").alias("a")).distinct(), table.select("label", F.col("b").cast("double").alias("b")).distinct()
    mean = F.col("a") * F.col("b") / total
    off = 40 * F.sqrt(mean * (1 - F.col("a") / total) * (1 - F.col("b") / total) * (total / max(1.0, total - 1))) + 40
    low = F.greatest(F.lit(1.0), F.col("a") + F.col("b") - total, F.floor(mean - off).cast("double"))
    high = F.least("a", "b", F.ceil(mean + off).cast("double"))
    # the parts that don't depend on the overlap are taken once a pair
    pairs = a.crossJoin(b).where(low <= high).withColumn("fixed", sum((log_gamma(x + 1) for x in (F.col("a"), F.col("b"), total - F.col("a"), total - F.col("b"))), -log_gamma(F.lit(total) + 1)))  # clusters by labels
    terms = pairs.withColumn("k", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    k = F.col("k").cast("double")
    power = F.exp(F.col("fixed") - log_gamma(k + 1) - log_gamma(F.col("a") - k + 1) - log_gamma(F.col("b") - k + 1) - log_gamma(total - F.col("a") - F.col("b") + k + 1))
    emi = terms.agg(F.sum(k / total * F.log(total * k / (F.col("a") * F.col("b"))) * power).alias("emi"))
    half = (F.col("h_cluster") + F.col("h_label")) / 2
    return information(table).crossJoin(emi).select("emi", ((F.col("mi") - F.col("emi")) / (half - F.col("emi"))).alias("ami"))


def assignment(table: DataFrame) -> list[tuple]:
    """The one-to-one matching of clusters to labels that covers most cells.

    Only the contingency table, clusters by labels, is on the driver.
    """
    cells = {(r["cluster"], r["label"]): r["n"] for r in table.select("cluster", "label", "n").collect()}
    rows, cols = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    size = max(len(rows), len(cols))
    cost = [[-cells.get((r, c), 0) for c in cols] + [0] * (size - len(cols)) for r in rows] + [[0] * size for _ in range(size - len(rows))]
    if size <= 7:
        best = min(permutations(range(size)), key=lambda p: sum(cost[i][j] for i, j in enumerate(p)))
    else:
        best = _cheapest(cost)
    return [(rows[i], cols[j]) for i, j in enumerate(best) if i < len(rows) and j < len(cols)]


def _cheapest(cost: list[list[int]]) -> list[int]:
    """Columns of a cheapest matching of a square matrix: one shortest augmenting path a row."""
    size = len(cost)
    by_row, by_col, owner = [0.0] * size, [0.0] * size, [-1] * size
    for start in range(size):
        reach, came, seen, col, row = [float("inf")] * size, [-1] * size, set(), -1, start
        while True:
            free = [j for j in range(size) if j not in seen]
            for j in free:
                d = cost[row][j] - by_row[row] - by_col[j]
                base = reach[col] if col >= 0 else 0.0
                if base + d < reach[j]:
                    reach[j], came[j] = base + d, col
            col = min(free, key=reach.__getitem__)
            seen.add(col)
            if owner[col] < 0:
                break
            row = owner[col]
        far = reach[col]
        by_row[start] += far
        for j in seen - {col}:
            by_row[owner[j]] += far - reach[j]
            by_col[j] -= far - reach[j]
        while col >= 0:
            owner[col] = owner[came[col]] if came[col] >= 0 else start
            col = came[col]
    out = [0] * size
    for j, i in enumerate(owner):
        out[i] = j
    return out


def cluster_accuracy(table: DataFrame) -> DataFrame:
    """One row: the share of cells that the best one-to-one matching covers."""
    matched = table.sparkSession.createDataFrame(assignment(table), table.select("cluster", "label").schema)
    return table.join(small(matched), ["cluster", "label"]).agg((F.sum("n") / F.first("total")).alias("accuracy"))


def isolated_labels(rows: DataFrame, threshold: int | None = None) -> DataFrame:
    """(label, batches) of labels in few batches: at most ``threshold``, by default the fewest any label is in; none if that is all batches."""
    seen = rows.groupBy("label").agg(F.count_distinct("batch").alias("batches"))
    least = F.min("batches").over(Window.partitionBy()) if threshold is None else F.lit(threshold)
    every = rows.agg(F.count_distinct("batch").alias("every"))
    return seen.withColumn("least", least).crossJoin(F.broadcast(every)).where("least <> every AND batches <= least").select("label", "batches")


def isolated_f1(rows: DataFrame) -> DataFrame:
    """One row: mean over isolated labels of the best F1 of any cluster (rows: label, batch, cluster); null without any."""
    best = contingency(rows).groupBy("label").agg(F.max(2 * F.col("n") / (F.col("a") + F.col("b"))).alias("f1"))
    return best.join(isolated_labels(rows), "label").agg(F.avg("f1").alias("isolated_f1"))
