"""Tables of the driver in the roles of the data model: cells, features, counts, embeddings, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts (cell, feature, x): suppliers, parts, summed quantities."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("x"))


def adt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a small, dense modality: users, event types, events."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("feature")).agg(F.count("*").cast("double").alias("x"))


def cell_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, batch): suppliers and their nation's region."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cell"), F.col("n_regionkey").alias("batch"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, v, gt, pred, batch): vectors in double precision, labels, the place of the largest of the first eight numbers, id modulo 3."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    head = F.slice("embedding", 1, 8)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell"), v.alias("v"), F.col("label").alias("gt"),
        (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("pred"), (F.col("vec_id") % 3).cast("int").alias("batch"),
    )


def modality(emb: DataFrame, which: int) -> DataFrame:
    """The first (1) or second (2) half of every vector, as one of two modalities."""
    return emb.withColumn("v", F.slice("v", 32 * (which - 1) + 1, 32))


def coordinates(emb: DataFrame) -> DataFrame:
    """(cell, x, y, v): the first two numbers of every vector as a place."""
    return emb.select("cell", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.slice("v", 1, 2).alias("v"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, cell, seqname, start, end, dataset): events as intervals of at least a second."""
    start = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("cell"), F.col("event_type").alias("seqname"), start.alias("start"),
        (start + F.greatest(F.lit(1), F.round(60 * F.col("value")).cast("long"))).alias("end"), (F.col("user_id") % 3).alias("dataset"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, text): documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell"), "text")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts (cell, feature, x): documents, their space-separated tokens, occurrences."""
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return texts(spark, sf_dir).select("cell", F.explode(words).alias("feature")).groupBy("cell", "feature").agg(F.count("*").cast("double").alias("x"))


#: The same roles as DuckDB common table expressions.
SQL = {
    "counts": "counts AS (SELECT l_suppkey AS cell, l_partkey AS feature, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)",
    "adt": "adt AS (SELECT user_id AS cell, event_type AS feature, count(*)::DOUBLE AS x FROM events GROUP BY ALL)",
    "cell_batches": "cell_batches AS (SELECT s_suppkey AS cell, n_regionkey AS batch FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "emb": "emb AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS v, label AS gt, (list_position(embedding[1:8], list_max(embedding[1:8])) - 1)::INT AS pred, (vec_id % 3)::INT AS batch FROM embeddings)",
    "m1": "m1 AS (SELECT cell, v[1:32] AS v, gt, batch FROM emb)",
    "m2": "m2 AS (SELECT cell, v[33:64] AS v, gt, batch FROM emb)",
    "coords": "coords AS (SELECT cell, v[1] AS x, v[2] AS y, v[1:2] AS v FROM emb)",
    "peaks": "peaks AS (SELECT event_id, user_id AS cell, event_type AS seqname, epoch(date_trunc('second', ts))::BIGINT AS \"start\", epoch(date_trunc('second', ts))::BIGINT + greatest(1, round(60 * value)::BIGINT) AS \"end\", user_id % 3 AS dataset FROM events)",
    "terms": "terms AS (SELECT doc_id AS cell, w AS feature, count(*)::DOUBLE AS x FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL)",
}


def with_roles(*names: str, body: str, recursive: bool = False) -> str:
    """A query over the named roles."""
    need: list[str] = []
    for n in names:
        if n in ("m1", "m2", "coords") and "emb" not in need:
            need.append("emb")
        if n not in need:
            need.append(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in need) + body
