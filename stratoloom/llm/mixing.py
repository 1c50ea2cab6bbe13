"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.running import bucket_count, numbered, running_sum
from .sharding import BITS, hash_bits
from .tables import table

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: floor(2^32 / golden ratio), odd: multiples of it modulo 2^32 are the golden-ratio points.
GOLDEN = 2654435769
#: Parts of the schedule that sources and slots are joined on.
CELLS = 4096
#: Blocks a source has at least (if it has the words), and words a block has at most.
BLOCKS, BLOCK_WORDS = 1024, 1024
#: Sources whose slots are added up together.
SOME = 4096
#: Slots a schedule has at most: beyond that the blocks get longer, so that slot * GOLDEN fits a long.
SLOTS = 2**30


def words(text: Column) -> Column:
    """The number of words of ``text``; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """``sources`` (source, source_size) with ``rank``, ``weight`` and ``target``.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn.
    The targets share the sum of all sizes by weight, none above ``cap`` times
    its source's size; what a capped source leaves is shared by weight among the
    others until none is above.  That is one level L with target = min(weight *
    L, cap * size): over sources ordered by cap * size / weight, L is the first
    level at which the next source isn't capped.  Sources may be many: their order
    and their running sums are dealt out, too, and L alone reaches the driver.
    """
    ranked = numbered(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], "rank")
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights)).cast("int") + 1))
    bound = cut(weighed.withColumn("bound", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("bound") / F.col("weight")))
    total, weight, low, high, count = bound.agg(F.sum("source_size"), F.sum("weight"), F.min("ratio"), F.max("ratio"), F.count("*")).first()
    width = ((high - low) / bucket_count(count) if count else 0.0) or 1.0
    along = bound.withColumn("bucket", F.floor((F.col("ratio") - F.lit(low or 0.0)) / F.lit(width)))
    found = running_sum(along, [], "bucket", [F.col("ratio"), F.col("rank")], [F.col("bound"), F.col("weight")], ["taken", "lighter"])
    level = (F.lit(float(total or 0)) - F.col("taken")) / (F.lit(float(weight or 0)) - F.col("lighter"))
    # the levels at which the next source is open only fall from the first such source on
    highest = found.agg(F.max(F.when(level <= F.col("ratio"), level))).first()[0]
    return bound.withColumn("target", F.least(F.col("weight") * F.lit(float(highest or 0.0)), F.col("bound"))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def plan_slots(sources: DataFrame, block_words: int, cap: float = 3) -> DataFrame:
    """Adds ``block`` (words of a block), ``blocks``, ``slots`` and the slots before (``first``)."""
    size = F.col("source_size")
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(size / F.lit(BLOCKS)))).cast("long")
    planned = (
        sources.withColumn("block", block)
        .withColumn("blocks", F.ceil(size / F.col("block")).cast("long"))
        .withColumn("slots", F.least(F.round(F.col("target") / F.col("block")).cast("long"), (F.col("blocks") * cap).cast("long")))
    )
    # ranks have no gaps, so buckets of some are even
    return running_sum(planned.withColumn("bucket", F.floor(F.col("rank") / SOME)), [], "bucket", [F.col("rank")], F.col("slots"), "first").drop("bucket")


def schedule(spark: SparkSession, planned: DataFrame) -> DataFrame:
    """The schedule: ``slot``, its source's ``rank``, the ``turn`` among the source's slots and the ``part`` (block) it reads.

    Slot i is at the golden-ratio point frac(i / phi) of all slots laid end to
    end by source, in integers.  A source's turns walk through its blocks in
    order, and again from the first when they are used up.
    """
    total = int(planned.agg(F.sum("slots")).first()[0] or 0)
    span = max(1, -(-total // CELLS))
    buckets = bucket_count(total)
    slots = spark.range(total).select(
        F.col("id").alias("slot"),
        F.shiftright(F.expr(f"((id + 1) * {GOLDEN}) & 4294967295") * F.lit(total), 32).alias("point"),
        F.floor(F.col("id") * buckets / F.lit(max(1, total))).cast("int").alias("bucket"),
    )
    ranges = planned.where("slots > 0").select(
        "rank", "first", "slots", "blocks",
        F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("slots") - 1) / span))).alias("cell"),
    )
    placed = slots.withColumn("cell", F.floor(F.col("point") / span)).join(ranges, "cell").where("point >= first and point < first + slots")
    turns = running_sum(placed, ["rank"], "bucket", [F.col("slot")], F.lit(1).cast("long"), "turn")
    return turns.select("slot", "rank", "turn", (F.col("turn") % F.col("blocks")).alias("part"), "blocks")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    A source's rows are shuffled by the md5 of their key and laid end to end;
    equal-token blocks of that stream (the last may be shorter) are joined with
    the schedule's slots, and ``taken`` is the words of the row that all slots of
    its source read, repeats counted, at most ``cap`` times its size.

    Null text has no words, and rows without words are never taken.  Null source
    is a source of its own; null keys are shuffled as the text 'null'.  Rows that
    are equal in all columns used are interchangeable, so reruns agree.  Columns
    other than the three named are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), hash_bits(F.concat(F.lit("mix:"), name)).alias("along")))
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    planned = cut(plan_slots(sources, max(BLOCK_WORDS, -(-(total or 0) // SLOTS)), cap))
    turns = schedule(spark, planned).where(F.col("turn") < F.col("blocks") * cap).groupBy("rank", "part").agg(F.count("*").alias("turns"))
    known = rows.join(planned.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight", "slots", "first", "blocks")
    buckets = bucket_count(count)
    laid = running_sum(
        known.withColumn("bucket", F.floor(F.col("along") / F.lit(float(2**BITS)) * buckets).cast("int")),
        ["rank"], "bucket", [F.col("along"), F.col("doc_id"), F.col("size")], F.col("size"), "start",
    )
    kept = ["doc_id", "source", "size", "source_size", "target"]
    end = F.col("start") + F.col("size")
    parts = laid.where("size > 0").withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block")))))
    inside = F.least(end, (F.col("part") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("part") * F.col("block"))
    taken = parts.withColumn("inside", inside).join(turns, ["rank", "part"], "left").groupBy(*kept, "rank", "start").agg(F.sum(F.col("inside") * F.coalesce(F.col("turns"), F.lit(0))).alias("taken"))
    return taken.select(*kept, "taken").unionAll(known.where("size = 0").select(*kept, F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the mix takes its words, to the nearest whole.

    Columns stay as they are and texts stay whole; rows the mix hardly takes, and
    rows without words, are left out.  Rows equal in key and size are taken alike.
    """
    taken = mix(docs, key, text, source, weights, cap).where("size > 0").select(
        F.col("doc_id").alias("__key"), F.col("size").alias("__size"), F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int").alias("__copies")
    )
    times = taken.groupBy("__key", "__size").agg(F.max("__copies").alias("__copies")).where("__copies > 0")
    rows = docs.join(times, F.col(key).eqNullSafe(F.col("__key")) & (words(F.col(text)) == F.col("__size")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op4_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3, at most three times each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT AS along
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM docs GROUP BY source
), bounds AS (
  SELECT *, (rnk % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS bound FROM sizes
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE
      - coalesce(sum(bound) OVER (ORDER BY bound / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY bound / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM bounds
), goals AS (
  SELECT *, least(weight * (SELECT max(level) FROM levels WHERE level <= bound / weight), bound) AS target,
    greatest(1, least(1024, ceil(source_size / 1024.0)))::BIGINT AS block FROM levels
), planned AS (
  SELECT *, ceil(source_size / block)::BIGINT AS blocks, least(round(target / block)::BIGINT, ceil(source_size / block)::BIGINT * 3) AS slots FROM goals
), firsts AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM planned
), points AS (
  SELECT slot, ((((slot + 1) * 2654435769) & 4294967295) * (SELECT sum(slots)::BIGINT FROM firsts)) >> 32 AS point
  FROM range((SELECT sum(slots)::BIGINT FROM firsts)) r(slot)
), turns AS (
  SELECT rnk, blocks, row_number() OVER (PARTITION BY rnk ORDER BY slot) - 1 AS turn
  FROM points JOIN firsts ON point >= first AND point < first + slots
), counts AS (
  SELECT rnk, turn % blocks AS part, count(*) AS turns FROM turns WHERE turn < blocks * 3 GROUP BY ALL
), laid AS (
  SELECT d.*, f.rnk, f.source_size, f.target, f.block,
    (coalesce(sum(size) OVER (PARTITION BY f.rnk ORDER BY along, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM docs d JOIN firsts f ON d.source IS NOT DISTINCT FROM f.source
), parts AS (
  SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS part FROM laid WHERE size > 0
)
SELECT doc_id, size, source_size, target,
  sum((least(start + size, (p.part + 1) * block) - greatest(start, p.part * block)) * coalesce(turns, 0))::BIGINT AS taken
FROM parts p LEFT JOIN counts c ON p.rnk = c.rnk AND p.part = c.part GROUP BY doc_id, size, source_size, target, p.rnk, start
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM laid WHERE size = 0
"""

QUERIES = {"op4_low_discrepancy_mix": op4_low_discrepancy_mix}
ORACLES = {"op4_low_discrepancy_mix": ORACLE_SQL}
