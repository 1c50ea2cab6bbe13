"""Byte-level BPE: long texts are pre-tokenised in overlapping chunks and stitched."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..lineage import cut
from .tables import small_batches, table

#: Code points of a chunk, and how far it reads on into the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Bytes of texts or ids of one Arrow batch that go out together, unless a single one is longer.
BATCH = 1 << 22
#: A run of one class longer than this is merged here, not by the library, whose regular expressions have limits.
LONG = 50_000


class Codec:
    """Ranks, pattern and library encoder; built once in each worker."""

    made: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    @classmethod
    def of(cls, lines: bytes, pattern: str) -> Codec:
        key = (str(hash(lines)), pattern)
        if key not in cls.made:
            cls.made[key] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}, pattern)
        return cls.made[key]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, each match of the pattern by itself."""
        if len(text) < LONG or not regex.search(r"(?:\p{L}{%d}|\p{N}{%d}|\s{%d}|[^\s\p{L}\p{N}]{%d})" % (LONG, LONG, LONG, LONG), text):
            return np.array(self.library.encode_ordinary(text), np.uint32)
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            ids.extend(self.library._encode_single_piece(m.group().encode()))
        return np.array(ids, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of the ids, one after another."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def boundaries(pattern: regex.Pattern, text: str) -> np.ndarray:
    """Where pre-tokens end in ``text`` after something other than white space.

    Such an end splits safely: no match before it looks beyond it, and no match
    after it looks back.  (After white space a split would change what the
    look-ahead sees.)
    """
    return np.array([m.end() for m in pattern.finditer(text) if not text[m.end() - 1].isspace()], np.int64)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about BATCH bytes in the column ``sized``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized]) + 64
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for x in batch.column(name):
        yield x.as_py() or ""


def pieces_of(spread: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts (name, text; no name twice) cut where chunks are stitched: name, k (from 1), part."""
    step = F.lit(chunk)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for body, many, left in zip(_texts(batch, "part"), batch.column("m").to_pylist(), batch.column("left").to_pylist(), strict=True):
                ends = boundaries(splitter, body)
                if left > len(body):  # the last tokens may look beyond what this segment reads
                    ends = ends[ends <= len(body) - 4]
                heads.append(ends[ends <= overlap].tolist())
                tails.append((ends[ends >= many * chunk] - many * chunk).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "k", "m")), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["name", "k", "m", "head", "tail"])

    def read(segments: DataFrame) -> DataFrame:
        """Segments (name, text, k, m: m chunks from the k-th on) with the safe ends in their first overlap and behind their chunks."""
        body = F.substring("text", F.col("k") * step + 1, F.col("m") * step + overlap)
        parts = segments.select("name", "k", "m", body.alias("part"), (F.length("text") - F.col("k") * step).alias("left"))
        return parts.repartition("name", "k").mapInArrow(pretokenise, "name string, k int, m int, head array<int>, tail array<int>")

    ends = cut(read(spread.select("name", "text", F.posexplode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step)))).select("name", "text", F.col("pos").alias("k"), F.lit(1).alias("m"))))
    while True:
        before = ends.select("name", (F.col("k") + F.col("m")).alias("k"), "tail")
        stitched = cut(ends.drop("tail").join(before, ["name", "k"], "left").withColumn("cut", F.array_min(F.array_intersect("head", "tail")) + F.col("k") * step).drop("tail"))
        missing = stitched.where("k > 0 AND cut IS NULL")
        if missing.isEmpty():
            break
        # a segment without a stitch is read on with the one before it
        first = F.max(F.when((F.col("k") == 0) | F.col("cut").isNotNull(), F.col("k"))).over(Window.partitionBy("name").orderBy("k"))
        merged = stitched.withColumn("first", first).groupBy("name", "first").agg(F.sum("m").cast("int").alias("m"), F.count("*").alias("parts")).withColumnRenamed("first", "k")
        again = merged.where("parts > 1").select("name", "k", "m")
        kept = ends.join(merged.where("parts = 1").select("name", "k"), ["name", "k"], "left_semi")
        ends = cut(kept.select("name", "k", "m", "head", "tail").unionAll(read(again.join(spread, "name"))))
    cuts = stitched.where("cut IS NOT NULL").groupBy("name").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    joined = spread.join(cuts, "name", "left").withColumn("cuts", F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce(F.col("cuts").cast("array<bigint>"), F.array().cast("array<bigint>")), F.array(F.length("text").cast("bigint"))))
    return joined.select("name", "text", "cuts", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)).alias("k")).select(
        "name", "k", F.expr("substring(text, CAST(cuts[k - 1] + 1 AS INT), CAST(cuts[k] - cuts[k - 1] AS INT))").alias("part")
    )


def encode(docs: DataFrame, lines: bytes, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit).

    ``lines`` is a rank file's content (base64 piece and rank a line), shipped
    once to each executor; its size is that of the vocabulary, whatever the data.
    Texts of at most ``chunk`` code points are one chunk.  Longer ones are dealt
    out in overlapping chunks: each is pre-tokenised from its own start, and two
    neighbours are stitched at the first pre-token end that both found in their
    overlap, for matching from there on depends only on what follows.  Where an
    overlap holds no common end (one token spans it), the two chunks become one
    segment that is read on from its start, until every two neighbours are stitched.
    The pieces between stitches are encoded in parallel and their ids put together by
    document.

    A null text is empty and has no ids; rows that repeat an id and text are one
    result each, as often as they occur; null ids are kept.  Only the two named
    columns are read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(lines)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of_key = rows.schema["doc_id"].dataType
    kind = of_key.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)

        def found() -> Iterator[tuple]:
            for batch in batches:
                for name, body in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text"), strict=True):
                    ids = codec.encode(body)
                    yield name, len(ids), ids.tobytes()

        first = pa.schema([("doc_id", to_arrow_type(of_key)), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        yield from _batches(found(), first, 2)

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {kind}, n_tokens long, ids binary")
    # texts are named by their hash: copies are cut once, and ids may repeat or be null
    long = rows.where(F.length("text") > chunk).withColumn("name", F.sha2("text", 256))
    if long.isEmpty():
        return short
    spread = long.select("name", "text").dropDuplicates(["name"])
    pieces = pieces_of(spread, pattern, chunk, overlap)

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)

        def found() -> Iterator[tuple]:
            for batch in batches:
                for name, k, body in zip(batch.column("name").to_pylist(), batch.column("k").to_pylist(), _texts(batch, "part"), strict=True):
                    yield name, k, codec.encode(body).tobytes()

        yield from _batches(found(), pa.schema([("name", pa.string()), ("k", pa.int32()), ("ids", pa.binary())]), 2)

    def put(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("k")
        ids = b"".join(x.as_buffer() for x in pieces.column("ids"))
        return pa.table({"name": pieces.column("name")[:1], "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    # a text's ids meet where the text is put together: its own size, whatever the table's
    coded = pieces.repartition("name", "k").mapInArrow(encode_pieces, "name string, k int, ids binary")
    done = long.select("doc_id", "name").join(coded.groupBy("name").applyInArrow(put, "name string, n_tokens long, ids binary"), "name").select("doc_id", "n_tokens", "ids")
    return short.unionAll(done)


def decode(coded: DataFrame, lines: bytes, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``coded``'s key, n_tokens and ids with ``decoded``: the raw bytes of the ids, concatenated.

    Null ids decode to no bytes; an id outside the vocabulary is an error.  An
    empty table gives no rows.
    """
    small_batches(coded.sparkSession)
    ranks = coded.sparkSession.sparkContext.broadcast(lines)
    rows = coded.select(F.col(key).alias("doc_id"), "n_tokens", F.col(ids).alias("ids"))
    of_key = rows.schema["doc_id"].dataType
    kind = of_key.simpleString()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)

        def found() -> Iterator[tuple]:
            for batch in batches:
                for name, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                    raw = raw.as_py() or b""
                    yield name, n, raw, codec.decode(np.frombuffer(raw, "<u4"))

        yield from _batches(found(), pa.schema([("doc_id", to_arrow_type(of_key)), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]), 3)

    return rows.mapInArrow(restore, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, lines: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the encoded ids and of the bytes they decode to."""
    coded = decode(encode(docs, lines, pattern), lines, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def public_ranks(path: str | None = None) -> tuple[bytes, str]:
    """The content of a rank file (by default the installed one for many languages) and the installed pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return digests(table(spark, sf_dir, "documents"), *public_ranks())


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
