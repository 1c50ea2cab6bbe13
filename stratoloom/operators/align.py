"""Feature and cell alignment: intersections, interval joins, unions of batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .running import running_max, running_sum

#: Width of the bins that intervals meet in.
BIN = 1 << 14


def shared_names(tables: list[DataFrame], name: str = "feature", fold: bool = False, required: bool = False) -> DataFrame:
    """(name) found in every table; ``fold`` compares small letters; ``required`` refuses an empty result."""
    key = F.lower(name) if fold else F.col(name)
    every = reduce(DataFrame.unionAll, [t.select(key.alias(name), F.lit(i).alias("i")).distinct() for i, t in enumerate(tables)])
    out = every.groupBy(name).agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(tables)).select(name)
    if required and out.isEmpty():
        raise ValueError(f"no {name} is shared by all tables")
    return out


def aligned(tables: list[DataFrame], name: str = "feature") -> list[DataFrame]:
    """Each table's rows of the names that all have."""
    shared = shared_names(tables, name)
    return [t.join(shared, name, "left_semi") for t in tables]


def shared_cells(tables: list[DataFrame]) -> DataFrame:
    """(cell) measured in every table."""
    return shared_names(tables, "cell")


def parse_region(region: Column, separators: tuple[str, str] = (":", "-")) -> Column:
    """Struct seqname, start, end of "chr:start-end"; with equal separators the last two parts are numbers."""
    a, b = separators
    if a == b:
        parts = F.split(region, a.replace(".", r"\."))
        n = F.size(parts)
        return F.struct(
            F.concat_ws(a, F.slice(parts, F.lit(1), n - 2)).alias("seqname"), F.get(parts, n - 2).cast("long").alias("start"), F.get(parts, n - 1).cast("long").alias("end")
        )
    rest = F.substring_index(region, a, -1)
    return F.struct(F.substring_index(region, a, 1).alias("seqname"), F.split_part(rest, F.lit(b), F.lit(1)).cast("long").alias("start"), F.split_part(rest, F.lit(b), F.lit(2)).cast("long").alias("end"))


def merge_intervals(rows: DataFrame, gap: int = 1) -> DataFrame:
    """(seqname, start, end, n): intervals less than ``gap`` apart, as one.

    With the default, half-open intervals that touch are one.  Equal intervals
    are counted first; the others are ordered inside bins of their starts, and
    only what a bin reaches and opens crosses to the next ones.
    """
    counted = cut(rows.groupBy("seqname", "start", "end").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("start") / F.lit(BIN))))
    order = [F.col("start"), F.col("end")]
    reached = running_max(counted, ["seqname"], "bin", order, "end", "reach")
    opens = cut(reached.withColumn("opens", F.coalesce((F.col("start") >= F.col("reach") + gap).cast("long"), F.lit(1).cast("long"))))
    islands = running_sum(opens, ["seqname"], "bin", order, F.col("opens"), "before").withColumn("island", F.col("before") + F.col("opens"))
    return islands.groupBy("seqname", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("island")


def contained(query: DataFrame, keys: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of ``keys`` with q_start, q_end of each interval of ``query`` that holds them.

    A query is listed in all bins it touches, a key in the bin of its start, so
    the join is on equal bins and no key meets a query twice.
    """
    q = query.select(F.col("seqname"), F.col("start").alias("q_start"), F.col("end").alias("q_end")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("q_start") / width), F.floor(F.col("q_end") / width))))
    k = keys.withColumn("bin", F.floor(F.col("start") / width))
    return k.join(q, ["seqname", "bin"]).where("start >= q_start AND end <= q_end").drop("bin")


def align_peaks(peaks: DataFrame, datasets: int, low: int = 20, high: int = 10_000, gap: int = 1) -> DataFrame:
    """(dataset, cell, feature, x): counts on merged intervals that every dataset has, of a width between the bounds.

    peaks: (dataset, cell, seqname, start, end, x).
    """
    merged = merge_intervals(peaks, gap)
    inside = contained(merged, peaks)
    seen = inside.groupBy("seqname", "q_start", "q_end").agg(F.count_distinct("dataset").alias("n"))
    width = F.col("q_end") - F.col("q_start")
    kept = seen.where((F.col("n") == datasets) & (width > low) & (width < high)).drop("n")
    name = F.concat("seqname", F.lit(":"), F.col("q_start").cast("string"), F.lit("-"), F.col("q_end").cast("string"))
    return inside.join(kept, ["seqname", "q_start", "q_end"], "left_semi").groupBy("dataset", "cell", name.alias("feature")).agg(F.sum("x").alias("x"))


def concat_batches(tables: list[DataFrame], keys: list, suffix: bool = True) -> DataFrame:
    """The union of count tables on the features they share, with ``batch`` and ids suffixed -batch."""
    parts = aligned(tables)
    rows = [t.select(F.concat(F.col("cell").cast("string"), F.lit(f"-{b}")).alias("cell") if suffix else F.col("cell"), "feature", "x", F.lit(b).alias("batch")) for t, b in zip(parts, keys, strict=True)]
    return reduce(DataFrame.unionAll, rows)


def stack_batches(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, numbered by ``src``."""
    return reduce(DataFrame.unionByName, [t.withColumn("src", F.lit(i)) for i, t in enumerate(tables)])


def split_batches(rows: DataFrame, keys: list, batch: str = "batch") -> list[DataFrame]:
    """One table a batch."""
    return [rows.where(F.col(batch) == k) for k in keys]


def prefixed(rows: DataFrame, batch: str = "batch", cell: str = "cell") -> DataFrame:
    """Ids as s{batch}_{id}, unique across batches."""
    return rows.withColumn(cell, F.concat(F.lit("s"), F.col(batch).cast("string"), F.lit("_"), F.col(cell).cast("string")))


def first_batch(tables: list[DataFrame]) -> DataFrame:
    """(cell, batch): the batch by the first table, in order, that has the cell."""
    every = reduce(DataFrame.unionAll, [t.select("cell", "batch", F.lit(i).alias("i")) for i, t in enumerate(tables)])
    return every.groupBy("cell").agg(F.min_by("batch", F.struct("i", "batch")).alias("batch"))


def missing(every: DataFrame, measured: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``every`` that ``measured`` lacks."""
    return every.join(measured, on, "left_anti")


def wide_table(long: DataFrame, rows: list[str], columns: str, value: str, names: list | None = None) -> DataFrame:
    """Row names (joined by -) by columns."""
    return long.groupBy(F.concat_ws("-", *rows).alias("row")).pivot(columns, names).agg(F.first(value))


def signed_rank(wide: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and w_plus of the paired differences a - b, zeros left out, ties sharing their mean rank."""
    d = wide.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select("d", F.abs("d").alias("m"))
    rank = F.rank().over(Window.orderBy("m")) + (F.count("*").over(Window.partitionBy("m")) - 1) / 2
    return d.withColumn("r", rank).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"))
