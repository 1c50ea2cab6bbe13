"""Document fingerprints: Merkle trees over sections and paragraphs.

A fingerprint is a string that carries the whole tree: the root (64 hexadecimal
digits), then for each section a slash, its branch (16 digits) and, each after a
point, its paragraphs' leaves (8 digits).  Roots tell equality; where they
differ, branches and then leaves tell where, and how near two texts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .tables import table

#: Where a section ends (behind a line feed), and a paragraph of it (behind a mark of the sentence and a space).
SECTION, PARAGRAPH = r"(?<=\n)", r"(?<=[.!?|] )"
#: Hexadecimal digits of a hash that the fingerprint shows.
ROOT, BRANCH, LEAF = 64, 16, 8
#: Stands for a null id, below every other.
NULL_ID = -(2**63)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _parts(text: Column, end: str) -> Column:
    return F.filter(F.split(text, end, -1), lambda x: x != "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text: equal for equal texts alone (by SHA-256)."""
    hashes = F.transform(_parts(text, SECTION), lambda s: F.transform(_parts(s, PARAGRAPH), lambda p: F.sha2(p, 256)))
    branches = F.transform(hashes, lambda leaves: F.struct(F.sha2(F.concat_ws("", leaves), 256).alias("hash"), F.concat_ws(".", F.transform(leaves, lambda x: F.substring(x, 1, LEAF))).alias("leaves")))
    return _let(branches, lambda tree: F.concat_ws(
        "/", F.sha2(F.concat_ws("", F.transform(tree, lambda b: b["hash"])), 256), F.transform(tree, lambda b: F.concat_ws(".", F.substring(b["hash"], 1, BRANCH), b["leaves"]))
    ))


def root(print_: Column) -> Column:
    """The root of a fingerprint."""
    return F.substring(print_, 1, ROOT)


def _sections(print_: Column) -> Column:
    return _let(F.split(print_, "/"), lambda x: F.slice(x, F.lit(2), F.size(x)))


def _agree(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common before the first that differ."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return _let(first, lambda k: F.when(k == 0, F.size(a).cast("long")).otherwise(k - 1)).cast("int")


def _aligned(a: Column, b: Column, use: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``use(a, b, head, tail)`` with what the arrays share at their beginnings, and behind that at their ends."""
    rest = lambda x, head: F.reverse(F.slice(x, head + 1, F.size(x)))
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda s: _let(_agree(s["a"], s["b"]), lambda head: _let(
        _let(F.struct(rest(s["a"], head).alias("a"), rest(s["b"], head).alias("b")), lambda r: _agree(r["a"], r["b"])), lambda tail: use(s["a"], s["b"], head, tail)
    )))


def _middle(x: Column, head: Column, tail: Column) -> Column:
    return F.slice(x, head + 1, F.size(x) - head - tail)


def _leaves(sections: Column) -> Column:
    """The leaves of some sections of a fingerprint."""
    return _let(F.concat_ws(".", F.transform(sections, lambda x: F.substring(x, F.lit(BRANCH + 2), F.length(x)))), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"\.")))


def _count(sections: Column) -> Column:
    """How many leaves some sections have, by their lengths."""
    return F.aggregate(sections, F.lit(0), lambda n, x: n + ((F.length(x) - BRANCH) / (LEAF + 1)).cast("int"))


def _place(first: Column, last: Column) -> Column:
    return F.concat_ws("-", first.cast("string"), F.when(last >= first, last.cast("string")).otherwise(""))


def compare(a: Column, b: Column) -> Column:
    """Two fingerprints: ``near``, and where b differs from a, in ``sections`` and ``paragraphs``.

    Branches that agree at the beginning and at the end are passed over; only the
    sections between them are opened.  ``near`` is 0 to 1, and 1 for equal texts
    alone: leaves that agree at the beginning and at the end count in full; between
    them a leaf that both have counts half, and so does one that both have next to
    the same leaf, so order matters.  The result is twice the count over all leaves.

    Places are first-last in b, from 1; first- where parts are only gone; empty if
    nothing differs.
    """
    def pairs(x: Column) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.size(x)), lambda p, q: F.concat(p, q))

    def both(x: Column, y: Column) -> Column:
        # texts without a leaf in common have no pair in common, either
        return _let(F.size(F.array_intersect(x, y)), lambda n: n + F.when(n > 0, F.size(F.array_intersect(pairs(x), pairs(y)))).otherwise(0))

    def judge(sa: Column, sb: Column, head: Column, tail: Column) -> Column:
        def inside(la: Column, lb: Column, more: Column, less: Column) -> Column:
            shared = _let(F.struct(_middle(la, more, less).alias("x"), _middle(lb, more, less).alias("y")), lambda m: both(m["x"], m["y"]))
            return F.struct(more.alias("head"), less.alias("tail"), shared.alias("shared"), F.size(la).alias("n"), F.size(lb).alias("m"))

        opened = _aligned(_leaves(_middle(sa, head, tail)), _leaves(_middle(sb, head, tail)), inside)
        ends = F.struct(_count(F.slice(sa, F.lit(1), head)).alias("head"), _count(F.slice(sa, F.size(sa) - tail + 1, tail)).alias("tail"))
        return _let(F.struct(opened.alias("o"), ends.alias("e")), lambda x: F.struct(
            ((F.lit(2.0) * (x["e"]["head"] + x["e"]["tail"] + x["o"]["head"] + x["o"]["tail"]) + x["o"]["shared"]) / (F.lit(2) * (x["e"]["head"] + x["e"]["tail"]) + x["o"]["n"] + x["o"]["m"])).alias("near"),
            _place(head + 1, F.size(sb) - tail).alias("sections"),
            _place(x["e"]["head"] + x["o"]["head"] + 1, x["e"]["head"] + x["o"]["m"] - x["o"]["tail"]).alias("paragraphs"),
        ))

    same = F.struct(F.lit(1.0).alias("near"), F.lit("").alias("sections"), F.lit("").alias("paragraphs"))
    return F.when(a == b, same).otherwise(_aligned(_sections(a), _sections(b), judge))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``fingerprint``.

    A null text is empty: its tree has no sections and its root is the hash of
    nothing.  Other columns are not read, ids may be null or repeat, and an empty
    table gives no rows.
    """
    return docs.select(F.col(key).alias("doc_id"), fingerprint(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))


def _succession(light: DataFrame) -> DataFrame:
    """From rows (k, h, n): the same, and who has a row as next document in descending order: before_k, before_h, before_n.

    Rows are sorted by range into a checkpoint, so partitions are fixed; only each
    partition's last row crosses to the next.
    """
    parts = max(1, int(light.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("k").desc(), F.col("h")]
    ranged = cut(light.repartitionByRange(parts, *order).select(F.struct("k", "h", "n").alias("own"), F.spark_partition_id().alias("part")))
    place = [F.col("own.k").desc(), F.col("own.h")]
    tails = ranged.groupBy("part").agg(F.max_by("own", F.struct(-F.col("own.k").cast("decimal(20,0)"), F.col("own.h"))).alias("tail"))
    every = Window.partitionBy(F.lit(0)).orderBy("part")  # a row a partition
    last = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = tails.select("part", F.coalesce(F.lag("tail").over(every), F.last("tail").over(last)).alias("tail"))
    near = ranged.withColumn("lag", F.lag("own").over(Window.partitionBy("part").orderBy(*place)))
    before = F.coalesce("lag", "tail")
    return near.join(ends, "part").select("own.*", *[before[c].alias(f"before_{c}") for c in ("k", "h", "n")])


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, how near they are, and where the edit is.

    The edited text ends in the first half as many code points of the next
    document, by descending id, the first after the last; a lone document is its
    own next.  Documents that repeat an id follow each other by the hash of their
    texts; rows equal in id and text are one document, and as many rows of the
    result.  A null id is below every other, and a null text is empty.
    ``edit_sections`` and ``edit_paragraphs`` locate the edit, as in ``compare``.
    Columns beside the two named are not read.  An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.sha2("text", 256))
    light = rows.select("k", "h", F.length("text").alias("n"))
    order = cut(_succession(light.distinct()))
    repeats = light.count() != order.count()
    known = rows.join(order, ["k", "h"]).withColumn("fingerprint", fingerprint(F.col("text")))
    given = known.select(
        F.col("before_k").alias("k"), F.col("before_h").alias("h"),
        F.substring("text", F.lit(1), F.floor(F.col("before_n") / 2).cast("int")).alias("patch"), F.col("fingerprint").alias("next_fingerprint"),
    )
    if repeats:
        given = given.dropDuplicates(["k", "h"])
    n = F.col("n")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("patch"))
    pairs = known.select("k", "h", "n", "text", "fingerprint").join(given, ["k", "h"]).withColumn("edited", edited)
    prints = pairs.select("k", "n", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    judged = prints.withColumn("edit", compare(F.col("fingerprint"), F.col("edited_fingerprint")))
    return judged.select(
        F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        F.col("edit.near").alias("near_edited"),
        compare(F.col("fingerprint"), F.col("next_fingerprint"))["near"].alias("near_next"),
        F.col("edit.sections").alias("edit_sections"),
        F.col("edit.paragraphs").alias("edit_paragraphs"),
    )


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    return compare_edits(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
nexts AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM docs
), edits AS (
  SELECT *, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS edited FROM nexts
), versions AS (
  SELECT doc_id, unnest([text, edited, next_text]) AS t, unnest([1, 2, 3]) AS v FROM edits
), hashes AS (
  SELECT doc_id, v, list_transform(regexp_extract_all(t, '[^\n]*\n|[^\n]+'), lambda s: list_transform(regexp_extract_all(s, '(?s:.*?[.!?|] |.+)'), lambda p: sha256(p))) AS h FROM versions
), trees AS (
  SELECT doc_id, v, list_transform(h, lambda s: sha256(array_to_string(s, ''))) AS b, list_transform(h, lambda s: list_transform(s, lambda p: substr(p, 1, 8))) AS l FROM hashes
), prints AS (
  SELECT doc_id, v, list_transform(b, lambda x: substr(x, 1, 16)) AS branches, flatten(l) AS leaves,
    array_to_string(list_prepend(sha256(array_to_string(b, '')), list_transform(range(1, len(b) + 1), lambda i: substr(b[i], 1, 16) || '.' || array_to_string(l[i], '.'))), '/') AS print
  FROM trees
), sides AS (
  SELECT a.doc_id, b.v, k, a.print AS p, b.print AS q, CASE k WHEN 1 THEN a.leaves ELSE a.branches END AS x, CASE k WHEN 1 THEN b.leaves ELSE b.branches END AS y
  FROM prints a JOIN prints b ON a.doc_id = b.doc_id AND a.v = 1 AND b.v > 1, (SELECT unnest([1, 2]) AS k)
), heads AS (
  SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS NOT DISTINCT FROM y[i]), false), 0) - 1, len(x)) AS head FROM sides
), rests AS (
  SELECT *, list_reverse(x[head + 1:]) AS rx, list_reverse(y[head + 1:]) AS ry FROM heads
), tails AS (
  SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(rx), len(ry)) + 1), lambda i: rx[i] IS NOT DISTINCT FROM ry[i]), false), 0) - 1, len(rx)) AS tail FROM rests
), middles AS (
  SELECT *, x[head + 1:len(x) - tail] AS mx, y[head + 1:len(y) - tail] AS my FROM tails
), judged AS (
  SELECT doc_id, v, k, q,
    CASE WHEN p = q THEN 1.0 ELSE (2.0::DOUBLE * (head + tail) + len(list_intersect(mx, my)) + len(list_intersect(list_transform(range(1, len(mx)), lambda i: mx[i] || mx[i + 1]), list_transform(range(1, len(my)), lambda i: my[i] || my[i + 1])))) / (len(x) + len(y)) END::DOUBLE AS near,
    CASE WHEN x = y THEN '' ELSE (head + 1) || '-' || CASE WHEN len(y) - tail > head THEN (len(y) - tail)::VARCHAR ELSE '' END END AS place
  FROM middles
)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.print AS fingerprint, l.q AS edited_fingerprint, l.near AS near_edited, o.near AS near_next, s.place AS edit_sections, l.place AS edit_paragraphs
FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.v = 1 JOIN judged l ON l.doc_id = e.doc_id AND l.v = 2 AND l.k = 1
JOIN judged s ON s.doc_id = e.doc_id AND s.v = 2 AND s.k = 2 JOIN judged o ON o.doc_id = e.doc_id AND o.v = 3 AND o.k = 1
"""

QUERIES = {"op10_merkle_fingerprints": op10_merkle_fingerprints}
ORACLES = {"op10_merkle_fingerprints": ORACLE_SQL}
