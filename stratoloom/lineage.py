"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Only where all runs in this one process (tests, a laptop) and none is named
    a temporary folder is made; elsewhere executors would write where nobody reads.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratoloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """A replicated copy of ``df`` without its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_anew(df: DataFrame) -> DataFrame:
    """As ``cut``, and the planner forgets how large it took the rows to be.

    A checkpoint keeps the estimate of what it came from, and a join multiplies its sides' estimates:
    in loops of joins they grow to numbers of millions of digits, and planning never ends.
    """
    done = cut(df)
    rows = done._jdf.queryExecution().analyzed().rdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), df.sparkSession)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, written once: to be broadcast if it turns out to have at most ``rows`` rows, else like any other."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def release(df: DataFrame) -> None:
    """Deletes the files behind ``cut``'s result ``df``, which nothing will read again."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
