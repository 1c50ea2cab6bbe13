"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_anew, release


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _apart(least: DataFrame) -> DataFrame:
    """The same rows, whose partitioning the planner no longer knows.

    A join deals them out anew then, by themselves, and adaptive execution may split a
    hub's edges over tasks; it never does where a side comes straight from an aggregate.
    """
    return least.withColumn("src", F.greatest("src", "least"))  # no node's least is larger


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = _neighbours(edges)
    least = _apart(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least")))
    return (
        both.join(least, "src")
        .where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = _apart(down.groupBy("src").agg(F.min("dst").alias("least")))
    joined = down.join(least, "src")
    return (
        joined.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        .unionAll(least.select("src", F.col("least").alias("dst")))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """One row per node that has an edge: ``node``, ``component`` (its smallest node).

    The rounds alternate large-star and small-star until the edges are a forest
    of stars that no round changes, O(log^2) rounds at worst.  Nothing but a
    count and a checksum per round reaches the driver; each round is cut off
    through the shared checkpoint folder, and its predecessor's files are deleted.  Self loops and nulls are ignored.
    """
    now = cut_anew(
        edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        last, now = now, cut_anew(_small_star(_large_star(now)))
        release(last)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
