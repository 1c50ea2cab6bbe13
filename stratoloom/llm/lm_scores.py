"""Cross-entropy difference between matched target and background n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..lineage import cut
from .tables import small_batches, table

#: Symbols that the uniform distribution has at least, and, where a vocabulary is bounded, the beginning of a text, any other character, and the most frequent characters.
SYMBOLS = 128
BEGIN, OTHER = 0, 1
#: Characters that are counted at once, unless a text is longer.
CHUNK = 1 << 20
#: Bits of a code point, so that a trigram is one number; the beginning of a text is a symbol beyond all code points.
BITS, START = 21, 0x110000
#: Characters of a block of documents that are counted, and scored, in one place, about.
BLOCK_CHARS = 1 << 21


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def vocabulary(docs: DataFrame, text: str = "text", symbols: int = SYMBOLS) -> np.ndarray:
    """The symbol of every code point, from counts over all texts (in lower case; ties by code point)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, *np.unique(_points(x.as_py() or ""), return_counts=True))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["point", "n"])

    counted = docs.select(text).mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.col("n").desc(), "point").limit(symbols - 2).collect()  # as many rows as symbols
    symbol = np.full(0x110000, OTHER, np.uint8)
    for k, (point, _) in enumerate(best):
        symbol[point] = k + 2
    return symbol


def _sequence(texts: list[str], symbol: np.ndarray) -> np.ndarray:
    """The symbols of the texts, each after two beginnings."""
    out = []
    for t in texts:
        out += [np.array([BEGIN, BEGIN], np.int64), symbol[_points(t)].astype(np.int64)]
    return np.concatenate(out)


def _trigrams(s: np.ndarray, symbols: int) -> np.ndarray:
    """Cells of the trigrams that end in a character."""
    return ((s[:-2] * symbols + s[1:-1]) * symbols + s[2:])[s[2:] != BEGIN]


def trigram_counts(docs: DataFrame, symbol: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Counts of all trigrams: of the rows whose ``target`` is true, and of all rows. 2 by symbols^3 cells."""
    shared = docs.sparkSession.sparkContext.broadcast(symbol)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, symbols**3), np.int64)
        held: tuple[list[str], list[str]] = ([], [])

        def flush(k: int) -> None:
            if held[k]:
                total[k] += np.bincount(_trigrams(_sequence(held[k], shared.value), symbols), minlength=symbols**3)
                held[k].clear()

        size = 0
        for batch in batches:
            for x, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
                held[bool(target)].append(x.as_py() or "")
                size += len(held[bool(target)][-1])
                if size >= CHUNK:
                    flush(0), flush(1)
                    size = 0
        flush(0), flush(1)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[1, at]), pa.array(total.sum(axis=0)[at])], ["cell", "target", "everything"])

    summed = docs.select("text", "target").mapInArrow(count, "cell int, target long, everything long").groupBy("cell").agg(F.sum("target").alias("target"), F.sum("everything").alias("everything"))
    found = summed.toArrow()  # symbols^3 rows at most
    counts = np.zeros((2, symbols**3))
    counts[:, found.column("cell").to_numpy()] = found.column("target").to_numpy(), found.column("everything").to_numpy()
    return counts


def losses(counts: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """-ln p(c | a, b) of every trigram, by Witten-Bell interpolation down to the uniform distribution."""
    three = counts.reshape(symbols, symbols, symbols)
    p = np.full(symbols, 1 / symbols)
    for c in (three.sum(axis=(0, 1)), three.sum(axis=0), three):
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        total = c.sum(axis=-1, keepdims=True)
        p = (c + kinds * p) / np.maximum(total + kinds, 1) + (total + kinds == 0) * p
    return -np.log(p).reshape(-1)


def score(docs: DataFrame, symbol: np.ndarray, target: np.ndarray, background: np.ndarray, key: str = "doc_id", text: str = "text", symbols: int = SYMBOLS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, loss_target, loss_background, score.

    Losses are means over the text's characters; ``score`` is the mean of the
    per-token differences, target less background: the lower, the more like the
    target.  A null or empty text has no tokens and null losses and score.
    """
    shared = docs.sparkSession.sparkContext.broadcast((symbol, target, background))  # symbols^3 numbers each
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = rows.select("doc_id").schema
    for name, kind in (("n_tokens", "long"), ("loss_target", "double"), ("loss_background", "double"), ("score", "double")):
        out = out.add(name, kind)
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, target, background = shared.value
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                cells = _trigrams(_sequence([x.as_py() or ""], symbol), symbols)
                if len(cells):
                    t, b = target[cells], background[cells]
                    rows.append((len(cells), t.mean(), b.mean(), (t - b).mean()))
                else:
                    rows.append((0, None, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], [f.name for f in out.fields])

    return rows.mapInArrow(read, out)


def _grams(text: str) -> np.ndarray:
    """The trigrams that end in each character of a text, as numbers."""
    s = np.concatenate([np.array([START, START], np.int64), _points(text).astype(np.int64)])
    return s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]


def _tally(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of the texts, in order, and their counts."""
    keys, counts, held, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for k, t in enumerate(texts):
        held.append(_grams(t))
        size += len(t)
        if size >= CHUNK or k == len(texts) - 1:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            keys.append(key), counts.append(n)
            held, size = [], 0
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return key, total


def gram_counts(blocks: DataFrame) -> DataFrame:
    """(block, gram, target, everything): counts of the trigrams of each block of rows (block, text, target)."""

    def count(rows: pa.Table) -> pa.Table:
        held: tuple[list[str], list[str]] = ([], [])
        for x, target in zip(rows.column("text"), rows.column("target").to_pylist(), strict=True):
            held[target].append(x.as_py() or "")
        found = [_tally(texts) for texts in held]
        grams = np.union1d(found[0][0], found[1][0])
        counts = np.zeros((2, len(grams)), np.int64)
        for row, (gram, n) in zip(counts, found, strict=True):
            row[np.searchsorted(grams, gram)] = n
        block = np.full(len(grams), rows.column("block")[0].as_py(), np.int32)
        return pa.table({"block": block, "gram": grams, "target": counts[1], "everything": counts.sum(axis=0)})

    return blocks.groupBy("block").applyInArrow(count, "block int, gram long, target long, everything long")


MODELS = ("target", "everything")


def _interpolated(grams: DataFrame, context: str) -> DataFrame:
    """``grams`` with the probability p_* of each under both models, from counts and the shorter context's low_*, by Witten-Bell."""
    seen = grams.groupBy(context).agg(*[f(v).alias(f"{name}_{v}") for v in MODELS for name, f in (("n", F.sum), ("kinds", lambda v: F.count_if(F.col(v) > 0)))])
    out = grams.join(seen, context)
    for v in MODELS:
        n, kinds, low = F.col(f"n_{v}"), F.col(f"kinds_{v}"), F.col(f"low_{v}")
        out = out.withColumn(f"p_{v}", (F.col(v) + kinds * low) / F.greatest(n + kinds, F.lit(1)) + F.when(n + kinds == 0, low).otherwise(0.0))
    return out


def gram_losses(counted: DataFrame) -> DataFrame:
    """(gram, loss_target, loss_background): -ln p(c | a, b) of every trigram that occurs, as in ``losses``, over all characters.

    Counts stay in tables keyed by trigram, bigram and character.  The uniform
    distribution has a symbol for each character that occurs, and SYMBOLS at least.
    """
    sums = [F.sum(v).alias(v) for v in MODELS]
    lowest = F.lit((1 << BITS) - 1)
    three = counted.groupBy("gram").agg(*sums).withColumn("ab", F.shiftright("gram", BITS)).withColumn("bc", F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)))
    two = three.groupBy("bc").agg(*sums).withColumn("b", F.shiftright("bc", BITS)).withColumn("c", F.col("bc").bitwiseAND(lowest))
    one = cut(two.groupBy("c").agg(*sums))
    uniform = F.lit(1.0 / max(SYMBOLS, one.count() + 2))
    p1 = _interpolated(one.select("*", F.lit(0).alias("none"), *[uniform.alias(f"low_{v}") for v in MODELS]), "none")
    lows = [F.col(f"p_{v}").alias(f"low_{v}") for v in MODELS]
    p2 = _interpolated(two.join(p1.select("c", *lows), "c"), "b")
    p3 = _interpolated(three.join(p2.select("bc", *lows), "bc"), "ab")
    return p3.select("gram", (-F.log("p_target")).alias("loss_target"), (-F.log("p_everything")).alias("loss_background"))


def score_blocks(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``score`` of rows (block, doc_id, text), by the losses (block, gram, loss_target, loss_background) of the trigrams of their block."""
    out = blocks.select("doc_id").schema
    for name, kind in (("n_tokens", "long"), ("loss_target", "double"), ("loss_background", "double"), ("score", "double")):
        out = out.add(name, kind)
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def read(rows: pa.Table, losses: pa.Table) -> pa.Table:
        losses = losses.sort_by("gram")
        grams, target, background = (losses.column(c).to_numpy() for c in ("gram", "loss_target", "loss_background"))
        found = []
        for x in rows.column("text"):
            at = np.searchsorted(grams, _grams(x.as_py() or ""))
            if len(at):
                t, b = target[at], background[at]
                found.append((len(at), t.mean(), b.mean(), (t - b).mean()))
            else:
                found.append((0, None, None, None))
        columns = list(zip(*found, strict=True)) or [()] * 4
        ids = rows.column("doc_id").cast(types[0])
        return pa.table([ids, *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names=[f.name for f in out.fields])

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(read, out)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", symbols: int | None = None) -> DataFrame:
    """Scores all of ``docs`` by models of the rows named in ``targets`` and of all rows.

    The models are matched: one vocabulary (every character that occurs), one
    order, one smoothing; both count every text in full.  Documents are dealt
    into blocks of about BLOCK_CHARS characters.  Counts of trigrams stay in
    tables that grow with the input; each block gets the losses of the trigrams
    that occur in it, and nothing is gathered in one place.

    With ``symbols`` the vocabulary is bounded to the most frequent characters,
    and tables of ``symbols``^3 cells are sent to every worker.

    ``targets`` needs the column ``key``; repeated and null keys there count
    nothing more.  Without target rows the target model is uniform.  Null texts
    are empty; only the named columns are read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    # the labels grow with the corpus: the same join at every size, not a broadcast that stops fitting
    named = targets.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id")).distinct().withColumn("target", F.lit(True)).hint("merge")
    if symbols is not None:
        symbol = vocabulary(rows, "text", symbols)
        marked = rows.join(named, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
        target, background = (losses(c, symbols) for c in trigram_counts(marked, symbol, symbols))
        return score(rows, symbol, target, background, symbols=symbols)
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-characters // BLOCK_CHARS)))).cast("int"))
    marked = blocks.join(named, "doc_id", "left").select("block", "text", F.coalesce("target", F.lit(False)).alias("target"))
    counted = cut(gram_counts(marked))
    return score_blocks(blocks, counted.select("block", "gram").join(gram_losses(counted), "gram"))


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored against those labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    scored = cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("loss_target", "loss_background", "score")])


def _model_sql(v: str, counts: str) -> str:
    """Common table expressions of one model: v1, v2, v3 hold its probabilities."""
    out, lower, keys = "", "", []
    for n, context in ((1, ""), (2, "b"), (3, "a, b")):
        by = f"{context}, c" if context else "c"
        base = f"(1 / {SYMBOLS}::DOUBLE)" if n == 1 else "w.p"
        on = f"JOIN {v}{n - 1} w ON {' AND '.join(f'u.{k} = w.{k}' for k in keys)}" if n > 1 else ""
        seen = f"JOIN t USING ({context})" if context else ", t"
        out += f""", {v}{n} AS (WITH u AS (SELECT {by}, sum({counts})::DOUBLE AS k FROM g GROUP BY ALL), t AS (SELECT {context + ', ' if context else ''}sum(k) AS n, (count(*) FILTER (k > 0))::DOUBLE AS t FROM u {'GROUP BY ' + context if context else ''}), x AS (SELECT u.*, n, t FROM u {seen})
SELECT {', '.join('u.' + k for k in by.split(', '))}, (u.k + t * {base}) / greatest(n + t, 1) + CASE WHEN n + t = 0 THEN {base} ELSE 0 END AS p FROM x u {on})"""
        keys = by.split(", ")
    return out


ORACLE_SQL = (
    rf"""
WITH ch AS (
  SELECT doc_id, t, unnest(l) AS ch, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS t, regexp_extract_all(lower(coalesce(text, '')), '(?s).') AS l FROM documents)
), vocab AS (
  SELECT ch, row_number() OVER (ORDER BY n DESC, unicode(ch)) + 1 AS sym FROM (SELECT ch, count(*) AS n FROM ch GROUP BY ch) QUALIFY row_number() OVER (ORDER BY n DESC, unicode(ch)) <= {SYMBOLS - 2}
), s AS (
  SELECT doc_id, t, i, coalesce(sym, 1) AS c FROM ch LEFT JOIN vocab USING (ch)
), tri AS (
  SELECT doc_id, t, coalesce(lag(c, 2) OVER w, 0) AS a, coalesce(lag(c, 1) OVER w, 0) AS b, c FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (SELECT a, b, c, count(*) AS n, count(*) FILTER (t) AS m FROM tri GROUP BY ALL)"""
    + _model_sql("bg", "n") + _model_sql("tg", "m")
    + """, sc AS (
  SELECT doc_id, count(*) AS n_tokens, avg(-ln(x.p)) AS lt, avg(-ln(y.p)) AS lb, avg(ln(y.p) - ln(x.p)) AS d
  FROM tri JOIN tg3 x ON x.a = tri.a AND x.b = tri.b AND x.c = tri.c JOIN bg3 y ON y.a = tri.a AND y.b = tri.b AND y.c = tri.c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, round(lt, 6) AS loss_target, round(lb, 6) AS loss_background, round(sc.d, 6) AS score FROM documents d LEFT JOIN sc USING (doc_id)"""
)

QUERIES = {"op1_cross_entropy_difference": op1_cross_entropy_difference}
ORACLES = {"op1_cross_entropy_difference": ORACLE_SQL}
