"""Language identification: known words first, shorter and shorter character n-grams for the others.

Texts are read a batch at a time: Arrow cuts them into words and numbers the
distinct ones, and every distinct word is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..lineage import cut
from .sharding import unit_hash
from .shingles import U, mix
from .tables import small_batches, table

#: Documents of a language to learn from, about, at most.
SAMPLE = 3000
#: Words of a language that are known, and n-grams of each length, the most frequent first.
WORDS, GRAMS = 50_000, 20_000
#: Lengths of n-grams, longest first; a word's ends count as characters.
LENGTHS = (5, 4, 3, 2, 1)
#: Numbers of a table of words by languages that is held at once.
CELLS = 1 << 22


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters of all texts in lower case, and where each text's begin (nulls have none)."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(pc.replace_substring_regex(low, r"\PL+", " "))
    words, at = lists.values, np.asarray(lists.offsets)
    # a text's split begins and ends with nothing where no letter stands there
    real = np.asarray(pc.greater(pc.binary_length(words), 0).cast(pa.int8())).astype(bool)
    return words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[at]


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters of the words, ends marked; each place's word, and how many characters it has left with itself."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(U)
    of = np.repeat(np.arange(len(words)), lengths)
    return np.concatenate([points, np.zeros(max(LENGTHS), U)]), of, np.cumsum(lengths)[of] - np.arange(len(of))


def _grams(points: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The n-grams at some places as numbers: code points have 21 bits, three to a number, and the rest is mixed in."""
    part = [points[at + k] if k < length else U(0) for k in range(max(LENGTHS))]
    return mix(mix(part[0] | part[1] << U(21) | part[2] << U(42)) + (part[3] | part[4] << U(21))).view(np.int64)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """A model from the rows of ``docs`` that have a text and a language: every language that occurs is learned.

    Counts come from about ``sample`` documents of each language, chosen by the
    hash of the key.  What reaches the driver is bounded by the parameters: for a
    language WORDS words and GRAMS n-grams of each length, the most frequent first
    (ties by code point, and by number).
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return _model([], None, None)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["count"]))])
    chosen = rows.where(unit_hash(F.concat(F.lit("lang:"), F.coalesce("key", F.lit("null")))) < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = words_of(batch.column("text"))
            names = np.repeat(np.arange(batch.num_rows), np.diff(at))
            counted = pa.table({"lang": batch.column("lang").take(pa.array(names)), "word": found}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from counted.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()

    words = cut(chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            points, of, left = _places(batch.column("word").to_pylist())
            which, times = np.asarray(names.indices)[of], batch.column("n").to_numpy()[of]
            for length in LENGTHS:
                at = np.flatnonzero(left >= length)
                found = pa.table({"lang": which[at], "gram": _grams(points, at, length), "n": times[at]}).group_by(["lang", "gram"]).aggregate([("n", "sum")])
                name = names.dictionary.take(found.column("lang").combine_chunks())
                many = found.num_rows
                yield pa.RecordBatch.from_arrays([name, pa.array(np.full(many, length, np.int32)), found.column("gram").combine_chunks(), found.column("n_sum").combine_chunks()], ["lang", "length", "gram", "n"])

    grams = words.mapInArrow(split, "lang string, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))

    def most(counted: DataFrame, by: list[str], name: str, many: int) -> pa.Table:
        best = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), name))
        return counted.withColumn("total", F.sum("n").over(Window.partitionBy(*by))).withColumn("best", best).where(F.col("best") <= many).drop("best").toArrow()

    return _model(langs, most(words, ["lang"], "word", WORDS), most(grams, ["lang", "length"], "gram", GRAMS))


def _model(langs: list[str], words: pa.Table | None, grams: pa.Table | None) -> dict:
    """What is known, and log frequencies by language: a floor for each length (0: words), and what entries have above it.

    Of an entry's languages only those that have it take room.
    """
    if not langs:
        return {"langs": []}
    floors = np.zeros((max(LENGTHS) + 1, len(langs)))
    parts = []
    for counted, name in ((words, "word"), (grams, "gram")):
        lang = np.asarray(pc.index_in(counted.column("lang").combine_chunks(), pa.array(langs)))
        lengths = counted.column("length").to_numpy() if name == "gram" else np.zeros(len(lang), np.int32)
        n, total = counted.column("n").to_numpy().astype(float), counted.column("total").to_numpy().astype(float)
        known = pc.unique(counted.column(name)) if name == "word" else pa.array(np.unique(counted.column(name).to_numpy()))
        entry = np.asarray(pc.index_in(counted.column(name).combine_chunks(), known))
        totals = np.zeros_like(floors)
        totals[lengths, lang] = total
        room = 0.5 * len(known)
        used = np.unique(lengths)
        floors[used] = np.log(0.5 / (totals[used] + room))
        above = np.log((n + 0.5) / (total + room)) - floors[lengths, lang]
        order = np.argsort(entry, kind="stable")
        first = np.searchsorted(entry[order], np.arange(len(known) + 1))
        parts.append({"known": known, "first": first, "lang": lang[order].astype(np.int32), "above": above[order].astype(np.float32)})
        if name == "gram":
            length = np.zeros(len(known), np.int32)
            length[entry] = lengths
            parts[-1] |= {"known": np.asarray(known), "length": length}
    return {"langs": langs, "floors": floors, "words": parts[0], "grams": parts[1]}


class Reader:
    """Scores texts by a model."""

    def __init__(self, model: dict) -> None:
        self.model, self.langs = model, model["langs"]

    def _add(self, total: np.ndarray, row: np.ndarray, part: dict, entry: np.ndarray, weight: np.ndarray) -> None:
        """Adds to rows what entries have above their floors."""
        many = part["first"][entry + 1] - part["first"][entry]
        at = np.repeat(part["first"][entry] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(entry) else np.zeros(0, np.int64)
        cell = np.repeat(row, many) * len(self.langs) + part["lang"][at]
        total += np.bincount(cell, np.repeat(weight, many) * part["above"][at], total.size).reshape(total.shape)

    def scores(self, words: pa.Array) -> np.ndarray:
        """Of each word its log frequency in each language; of an unseen one the mean over its places of the longest known n-gram's."""
        floors, known, grams = self.model["floors"], self.model["words"], self.model["grams"]
        entry = pc.index_in(words, known["known"].cast(words.type))
        seen = np.asarray(entry.is_valid().cast(pa.int8())).astype(bool)
        out = np.zeros((len(words), len(self.langs)))
        out[seen] = floors[0]
        self._add(out, np.flatnonzero(seen), known, np.asarray(entry.filter(entry.is_valid())).astype(np.int64), np.ones(int(seen.sum())))
        rest = np.flatnonzero(~seen)
        if len(rest) and len(grams["known"]):
            points, of, left = _places(words.take(pa.array(rest)).to_pylist())
            found = np.full(len(of), -1, np.int64)
            todo = np.arange(len(of))
            for length in LENGTHS:
                at = todo[left[todo] >= length]
                gram = _grams(points, at, length)
                place = np.minimum(np.searchsorted(grams["known"], gram), len(grams["known"]) - 1)
                hit = (grams["known"][place] == gram) & (grams["length"][place] == length)
                found[at[hit]] = place[hit]
                todo = todo[found[todo] < 0]
            at = np.flatnonzero(found >= 0)
            times = np.bincount(of[at], minlength=len(rest))
            weight = 1 / times[of[at]]
            for length in LENGTHS:
                here = grams["length"][found[at]] == length
                out[rest] += np.bincount(of[at[here]], weight[here], len(rest))[:, None] * floors[length]
            self._add(out, rest[of[at]], grams, found[at], weight)
        return out

    def read(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language of each text and how probable the model holds it; ``und`` and 0 without a letter."""
        words, at = words_of(texts)
        if not self.langs or not len(words):
            return ["und"] * len(texts), [0.0] * len(texts)
        coded = words.dictionary_encode()
        index, of = np.asarray(coded.indices), np.repeat(np.arange(len(texts)), np.diff(at))
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, CELLS // len(self.langs))
        for low in range(0, len(coded.dictionary), step):
            table = self.scores(coded.dictionary.slice(low, step))
            here = slice(None) if len(coded.dictionary) <= step else np.flatnonzero((index >= low) & (index < low + step))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(of[here], table[index[here] - low, k], len(texts))
        best = total.argmax(axis=1)
        score = 1 / np.exp(np.maximum(total - total[np.arange(len(texts)), best][:, None], -700)).sum(axis=1)
        empty = np.diff(at) == 0
        return ["und" if e else self.langs[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)], np.where(empty, 0.0, score).tolist()


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", kept: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1), and ``kept`` columns.

    Only the text decides.  A null text or one without a letter is ``und`` with
    score 0, as is every text if the model has learned no language; of equally
    good languages the first by code point stands.  Keys may be null or repeat.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB a language, by the parameters of learn()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *kept)
    names = [c for c in rows.columns if c != "text"]
    out = rows.select(*names).schema.add("lang_pred", "string").add("score", "double")
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            found = reader.read(batch.column("text"))
            columns = [batch.column(c) for c in names] + [pa.array(x, types[len(names) + i]) for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out.fields])

    return rows.mapInArrow(read, out)


def keep_identified(docs: DataFrame, model: dict, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, all columns kept, ``lang`` set to it if the table has it.

    Rows are judged as in predict(): only texts that are null or hold no letter go
    (every row, if the model has learned no language).
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)
    types = [to_arrow_type(f.dataType) for f in docs.schema.fields]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            found, _ = reader.read(batch.column(at))
            columns = list(batch.columns)
            if lang in names:
                columns[names.index(lang)] = pa.array(found, types[names.index(lang)])
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([f != "und" for f in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its key as text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model, kept=(held_out(F.col("doc_id")).alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op6_word_first_language": op6_word_first_language}
ORACLES: dict[str, str] = {}
