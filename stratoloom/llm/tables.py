"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, by Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the bytes of the Arrow batches that workers get: texts are long, and a bound on rows alone is none."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
