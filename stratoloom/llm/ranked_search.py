"""Ranked lexical search: sort-based accumulation of integer impacts.

A first pass reads every text once and writes what ranking needs: a document's
number of terms, and the items' terms that it holds with their occurrences.  Counts
over all documents give the weights.  The second pass concatenates a batch's
matched (item, document, impact) entries, sorts their packed keys by radix, sums runs
with reduceat, and each task keeps a heap of the best for an item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut, release
from .tables import small_batches, table

#: Everything in ASCII but letters and digits separates terms.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of items' texts that are ranked together: what is shared with all tasks has this bound.
ITEMS = 1 << 23
#: Matched entries that are sorted at once, unless a single document has more.
ENTRIES = 1 << 21
#: Parts that an item's candidates are first ranked in.
PARTS = 64


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, A-Z as a-z, and where each text's begin (nulls have none)."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern(pc.replace_substring_regex(low, SEPARATORS, " "), " ")
    terms, at = lists.values, np.asarray(lists.offsets)
    real = np.asarray(pc.greater(pc.binary_length(terms), 0).cast(pa.int8())).astype(bool)
    return terms.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[at]


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned 64-bit keys: stable passes over 16 bits each, which numpy sorts by radix."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, 64, 16):
        if top >> shift:
            order = order[np.argsort(((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
    return order


def _packed(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) pairs, by owner, and how often each occurs."""
    pairs, times = np.unique(owner.astype(np.int64) << 32 | term.astype(np.int64), return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, times


def _postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (terms of the text), terms (places in ``vocabulary``), times: a row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            terms, at = terms_of(batch.column("text"))
            coded = terms.dictionary_encode()
            place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, known), -1)).astype(np.int64)
            term = place[np.asarray(coded.indices)] if len(terms) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            owner, term, times = _packed(owner[term >= 0], term[term >= 0])
            ends = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), *lists], ["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(read, "doc_id long, n long, terms array<int>, times array<int>")


def _held(postings: DataFrame) -> DataFrame:
    """term, df: documents that hold each term, counted inside tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(total))
            found[: len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    return postings.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The highest-scoring documents of each item, a heap an item."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(items)]

    def add(self, item: int, docs: list, at: np.ndarray, scores: np.ndarray) -> None:
        """Offers an item's documents, those at some places of ``docs``; null ids come after all others."""
        heap = self.heaps[item]
        least = heap[0][0] if len(heap) == self.k else 1
        good = scores >= least
        at, scores = at[good], scores[good]
        if len(at) > self.k:  # no document below the k-th score can stay
            good = scores >= np.partition(scores, len(at) - self.k)[len(at) - self.k]
            at, scores = at[good], scores[good]
        for j, score in zip(at.tolist(), scores.tolist(), strict=True):
            entry = (score, docs[j] is not None, -(docs[j] or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def _accumulate(postings: DataFrame, first: np.ndarray, holders: np.ndarray, items: int, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place), doc_id, score: each task's ``k`` best of every item."""
    shared = postings.sparkSession.sparkContext.broadcast((first, holders, weight))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, holders, weight = shared.value
        best = Best(items, k)
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs = batch.column("doc_id").to_pylist()
            m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            term, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(docs)), np.diff(ends))
            impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[owner]))
            many = first[term + 1] - first[term]
            so_far = np.concatenate([[0], np.cumsum(many)])[ends]  # entries before each document
            low = 0
            while low < len(docs):
                high = max(low + 1, int(np.searchsorted(so_far, so_far[low] + ENTRIES, "right")) - 1)
                part = slice(ends[low], ends[high])
                wide = many[part]
                if wide.sum():
                    at = np.arange(wide.sum()) + np.repeat(first[term[part]] - (np.cumsum(wide) - wide), wide)
                    keys = (holders[at].astype(np.uint64) << np.uint64(32)) | np.repeat(owner[part], wide).astype(np.uint64)
                    order = radix_order(keys)
                    keys = keys[order]
                    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    scores = np.add.reduceat(np.repeat(impact[part], wide)[order], starts)
                    item, doc = (keys[starts] >> np.uint64(32)).astype(np.int64), (keys[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        best.add(int(item[a]), docs, doc[a:b], scores[a:b])
                low = high
        rows = [(i, -minus if known else None, score) for i, heap in enumerate(best.heaps) for score, known, minus in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return postings.mapInArrow(rank, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", items_at_once: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every row of ``items``.

    Terms are the runs of letters, digits and anything outside ASCII, A-Z as a-z.
    With N the documents that have a term, L all terms and n a document's, df the
    documents that hold a term and tf its occurrences: a term weighs
    floor(1000 * ln((2 N + 2) / (2 df + 1))), m is 10 + (90 n N) div L, and a document's
    score is the sum of weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct
    terms, in 64-bit integers.  Only scores above 0 are returned.

    Every document is scored for every item; what is shared with all tasks is one
    block of items of about ``items_at_once`` bytes, and blocks go one after
    another.  Ranks are decided in parts of an item's candidates first.

    Defined cases: null and empty texts have no terms and are never found, but
    neither count for N; an item without a term, or null, has no rows.  Equal scores
    go by ascending id, null ids last.  Rows that repeat an id are documents, or items,
    of their own.  Only the named columns are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = cut(items.select(F.col(item).alias("item_id"), F.coalesce(F.col(query).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    size = wanted.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = -(-size // items_at_once)
    found = spark.createDataFrame([], wanted.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))
    for block in range(blocks):
        here = wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").select("row", "text").toArrow()  # items_at_once bytes, about
        if not here.num_rows:
            continue
        terms, at = terms_of(here.column("text").combine_chunks())
        coded = terms.dictionary_encode()
        owner, term, _ = _packed(np.repeat(np.arange(here.num_rows), np.diff(at)), np.asarray(coded.indices))
        order = np.argsort(term, kind="stable")
        many = len(coded.dictionary)
        first, holders = np.searchsorted(term[order], np.arange(many + 1)), owner[order]
        postings = cut(_postings(docs, coded.dictionary))
        n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(many, np.int64)
        for r in _held(postings).toLocalIterator():  # a number a term of the block
            weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        scored = cut(_accumulate(postings, first, holders, here.num_rows, weight, n_docs, n_terms, k))
        release(postings)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(here.num_rows), pa.int64()), "row": here.column("row")}))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        parts = scored.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("at", place("item", "part")).where(F.col("at") <= k)
        ranked = parts.withColumn("rank", place("item")).where(F.col("rank") <= k)
        named = ranked.join(F.broadcast(names), "item").join(wanted.select("row", "item_id"), "row")
        found = found.unionAll(named.select("item_id", "rank", "doc_id", "score"))
    return found


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each item of ``benchmark``."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
wanted AS (SELECT DISTINCT item, item_id, unnest(found) AS term FROM (SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM benchmark)),
totals AS (SELECT count(*) FILTER (len(found) > 0) AS big_n, coalesce(sum(len(found)), 0)::BIGINT AS big_l FROM terms),
held AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(found) AS term FROM terms) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, totals GROUP BY term, big_n),
impacts AS (SELECT h.r, h.doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(t.found)::BIGINT * big_n) // big_l))) AS impact
    FROM held h JOIN weights USING (term) JOIN terms t ON t.r = h.r, totals),
scores AS (SELECT item, item_id, r, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores) WHERE rank <= 10
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": SQL}
