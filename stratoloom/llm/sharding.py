"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.running import bucket_count, running_sum
from .tables import table

#: Bits of an md5 that a double holds exactly.
BITS = 52


def unit_hash(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of ``text``."""
    return (hash_bits(text) + F.lit(0.5)) / F.lit(float(2**BITS))


def hash_bits(text: Column) -> Column:
    """The first 52 bits of the md5 of ``text`` as a long."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard that scores highest for ``key``: -weight / ln(hash of key and shard).

    Only the key and the weights decide.  A new shard takes rows only into
    itself, and a shard that goes gives its rows to the others.  A null key is
    the text 'null'.  Shards of weight 0 or less take nothing; ties, which 52
    bits leave improbable, go to the lowest shard number.
    """
    live = {s: w for s, w in sorted(weights.items()) if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct(
            (F.lit(-float(w)) / F.log(unit_hash(F.concat(name, F.lit(f":{s}"))))).alias("score"),
            F.lit(-s).alias("minus"),
        )
        for s, w in live.items()
    ]
    return (-F.array_max(F.array(*scores))["minus"]).cast("int")


def shard_rows(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus 1, ``slot`` the gapless place
    in the shard from 0, along the key's hash, then key, checksum and size (rows
    equal in all of these are alike, so any order of them gives the same rows).
    ``grown_shard`` is where ``grown`` weights would put the row.  A null text
    has no bytes and the checksum of no bytes, 0; null keys share one shard.
    Other columns of ``docs`` are not read, whatever their names.  An empty
    table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            rendezvous(F.col(key), weights).alias("shard"),
            (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            hash_bits(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("along"),
        )
    )
    buckets = bucket_count(rows.count())
    placed = rows.withColumn("bucket", F.floor(F.col("along") / F.lit(float(2**BITS)) * buckets).cast("int"))
    order = [F.col(c) for c in ("along", "doc_id", "text_crc32", "size")]
    return running_sum(placed, ["shard"], "bucket", order, F.lit(1).cast("long"), "slot")


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards, and where a 17th would take them."""
    rows = shard_rows(table(spark, sf_dir, "documents"), dict.fromkeys(range(16), 1.0), dict.fromkeys(range(17), 1.0))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


#: DuckDB has no crc32: the table of its 256 steps follows from the polynomial, and a fold over the bytes applies it.
ORACLE_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda j: ('0x' || substr(h, j, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS text_crc32
  FROM bytes, tab
), scores AS (
  SELECT d.doc_id, s AS shard,
    -1.0 / ln((('0x' || substr(md5(d.doc_id || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS score
  FROM documents d, range(17) r(s)
), best AS (
  SELECT doc_id, arg_max(shard, score) FILTER (shard < 16) AS shard, arg_max(shard, score) AS grown_shard FROM scores GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT, doc_id, text_crc32, size) - 1)::BIGINT AS slot,
  grown_shard::INT AS grown_shard
FROM sums JOIN best USING (doc_id)
"""

QUERIES = {"op7_rendezvous_sharding": op7_rendezvous_sharding}
ORACLES = {"op7_rendezvous_sharding": ORACLE_SQL}
