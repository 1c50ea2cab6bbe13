"""Reading and writing bundles: counts, labels, vectors, coordinates, in open formats.

A bundle is a folder of Parquet tables keyed by ``cell`` and ``feature``; the
reference form of positional files (one label a line) gets its key on reading.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A group of columns of one prefix is a vector if it has at least so many.
LEAST_COLUMNS = 5
#: Prefixes of vector columns and the name each goes by.
PREFIXES = {"PC": "embedding", "joint": "embedding", "LSI": "embedding", "RNA": "rna", "CAS": "cas", "ADT": "adt"}


@dataclass
class Bundle:
    """Tables of one sample; any may be missing."""

    counts: DataFrame | None = None
    cells: DataFrame | None = None
    features: DataFrame | None = None
    vectors: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, path: str, mode: str = "overwrite") -> None:
        """One Parquet table for each part."""
        for name, df in (("counts", self.counts), ("cells", self.cells), ("features", self.features), *((f"vectors_{k}", v) for k, v in self.vectors.items())):
            if df is not None:
                df.write.mode(mode).parquet(f"{path}/{name}")


def load(spark: SparkSession, source: str | DataFrame | Bundle, vectors: tuple[str, ...] = ()) -> Bundle:
    """A bundle from a folder, from a table of counts, or as it is."""
    if isinstance(source, Bundle):
        return source
    if isinstance(source, DataFrame):
        return Bundle(counts=source)

    def part(name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return spark.read.parquet(f"{source}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    return Bundle(part("counts"), part("cells"), part("features"), {k: part(f"vectors_{k}") for k in vectors})


def read_many(spark: SparkSession, paths: list[str | None], batches: list) -> DataFrame:
    """Counts of several samples with their ``batch``; a path of None is a modality that was not measured."""
    parts = [load(spark, p).counts.withColumn("batch", F.lit(b)) for p, b in zip(paths, batches, strict=True) if p is not None]
    if not parts:
        raise ValueError("no sample was measured")
    return reduce(DataFrame.unionByName, parts)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cell, label): one whole number a line; the line's place, from 0, is the cell."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    # numbers rise along the lines, with gaps between partitions: what a partition begins with closes them
    parts = lines.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row a partition
    place = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part").select(place.alias("cell"), F.col("value").cast("int").alias("label"))


def write_labels(labels: DataFrame, path: str) -> None:
    """One label a line, by cell, as one file."""
    labels.orderBy("cell").select(F.col("label").cast("string")).coalesce(1).write.mode("overwrite").text(path)


def dense_to_counts(vectors: DataFrame) -> DataFrame:
    """(cell, feature, x) of dense rows (cell, v), zeros left out."""
    return vectors.select("cell", F.posexplode("v").alias("feature", "x")).where("x <> 0")


def read_wide_csv(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a CSV with a column for each dimension: vectors by prefix, and ``annotation`` with the rest.

    The first column names the cell.
    """
    wide = spark.read.csv(path, header=True)
    key, *columns = wide.columns
    groups = {p: [c for c in columns if c.startswith(p)] for p in PREFIXES}
    kept = {p: g for p, g in groups.items() if len(g) >= LEAST_COLUMNS}
    out = {p: wide.select(F.col(f"`{key}`").alias("cell"), F.array(*[F.col(f"`{c}`").cast("double") for c in g]).alias("v")) for p, g in kept.items()}
    used = {c for g in kept.values() for c in g}
    out["annotation"] = wide.select(F.col(f"`{key}`").alias("cell"), *[F.col(f"`{c}`") for c in columns if c not in used])
    return out


def write_matrix_csv(vectors: DataFrame, path: str, digits: int = 6) -> None:
    """Rows of comma-separated numbers, by cell, as text."""
    line = F.concat_ws(",", F.transform("v", lambda x: F.format_string(f"%.{digits}e", x)))
    vectors.orderBy("cell").select(line.alias("line")).write.mode("overwrite").text(path)


def write_triples(bundle: Bundle, path: str) -> None:
    """counts (i, j, x), cell_meta and feature_meta as CSV, the exchange form of sparse matrices."""
    for name, df in (("counts", bundle.counts.select(F.col("cell").alias("i"), F.col("feature").alias("j"), "x")), ("cell_meta", bundle.cells), ("gene_meta", bundle.features)):
        if df is not None:
            df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def write_metrics(metrics: DataFrame, path: str, name: str) -> None:
    """A two-column result: Metric and the run's name."""
    metrics.select(F.col("metric").alias("Metric"), F.col("value").alias(name)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_results(vectors: DataFrame, domains: DataFrame, path: str) -> None:
    """Vectors (cell, v) and domains (cell, cluster) as CSV, a column for each dimension and the domain last."""
    dim = len(vectors.first()["v"])
    wide = vectors.join(domains, "cell").select("cell", *[F.col("v")[i].alias(f"embedding{i}") for i in range(dim)], F.col("cluster").alias("domain"))
    wide.write.mode("overwrite").csv(path, header=True)


def write_resources(spark: SparkSession, path: str, seconds: float) -> None:
    """A run's seconds and what executors hold in memory, one line each, as text."""
    memory = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    rows, it = [], memory.iterator()
    while it.hasNext():
        entry = it.next()
        rows.append((f"executor {entry._1()}: {(entry._2()._1() - entry._2()._2()) / 2**20:.1f} of {entry._2()._1() / 2**20:.1f} MB",))
    spark.createDataFrame([(f"seconds: {seconds:.3f}",), *sorted(rows)], "line string").coalesce(1).write.mode("overwrite").text(path)


def melt(wide: DataFrame, ids: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Columns as rows, for plots of weights and scores."""
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], name, value)


def plot_points(coords: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cell, x, y, cluster): what a scatter plot needs."""
    return coords.select("cell", "x", "y").join(clusters.select("cell", "cluster"), "cell")


COUNTS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("feature", T.LongType()), T.StructField("x", T.DoubleType())])
