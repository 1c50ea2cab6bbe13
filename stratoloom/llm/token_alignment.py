"""Alignment of two tokenizers: which tokens of one overlap which tokens of the other, and how common each pair is.

Texts are read a batch at a time and cut at spaces where both tokenizers end a token
whatever stands around (see Sides); every distinct piece is encoded once.  A
batch's pair multiplicities, its postings, are packed by the side id (the first
tokenizer's id, in BUCKETS).  Postings and the documents' counts of pairs meet in one
shuffle by side id, in sorted streams that spill: counts come first, their maximum of
an id is taken locally, and the postings that follow give what each document gets.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from .tables import small_batches, table

#: Parts of the first tokenizer's ids; an id's pairs are in one part.
BUCKETS = 64
#: Bytes of a part's packed postings that one stream reads, about; larger parts have several streams.
STREAM = 1 << 27
#: Distinct pieces of texts that a worker remembers, and pairs that a task counts before it passes them on.
PIECES, COUNTED = 250_000, 1 << 20
#: Two or more white spaces together, or white space at an end: such texts are cut with more care.
UNEVEN = re.compile(r"\s\s|^\s|\s$")
#: A space between two characters that aren't white space.
SINGLE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


class Sides:
    """Both tokenizers and what a worker has aligned so far.

    A text is cut at a space between two characters that aren't white space where
    the vocabularies allow it: the byte-level pattern begins a token at such a space,
    and no piece of the other tokenizer has a space behind its first characters.
    Then the parts encode by themselves as they do inside the text.  With other
    vocabularies a text is one part.
    """

    made: dict[str, Sides] = {}

    def __init__(self, first: bytes, second: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        named = lambda side, end: np.array([f"{i}{end}" for i in range(len(side))], object)
        self.a_more, self.a_last, self.b_more, self.b_last = named(self.a_bytes, ","), named(self.a_bytes, "|"), named(self.b_bytes, ","), named(self.b_bytes, ";")
        self.all_pairs = len(self.a_bytes) * len(self.b_bytes)
        before = json.loads(first).get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    @classmethod
    def of(cls, first: bytes, second: bytes) -> Sides:
        key = hashlib.sha256(first + second).hexdigest()
        if key not in cls.made:
            cls.made = {key: cls(first, second)}
        return cls.made[key]

    def forget(self) -> None:
        """Drops all pieces."""
        self.index: dict[str, int] = {}
        self.texts: list[str] = []  # the groups of each piece
        self.numbers = np.zeros((4, 0), np.int64)  # tokens of both sides, groups, links
        self.good = np.zeros(0, bool)
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def parts(self, text: str) -> list[str]:
        """The parts of a text; joined by spaces they are the text."""
        if not self.cuts:
            return [text]
        return SINGLE.split(text) if UNEVEN.search(text) else text.split(" ")

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a pair of ids; the part of the first id leads."""
        return (a % BUCKETS) * self.all_pairs + a * len(self.b_bytes) + b

    def learn(self, new: list[str]) -> None:
        """Aligns pieces not seen before, all at once."""
        spaced = [f" {p}" for p in new]
        raw = [p.encode() for p in spaced]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        good = self._same(raw, a, b)
        kept = np.flatnonzero(good)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side if good.all() else [side[k] for k in kept.tolist()]), np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        ends = np.cumsum(np.array(list(map(len, raw)), np.int64)[kept])
        # between two neighbouring ends of any side lies one overlap of one token of each
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        both, common = both[_starts(both)], both[1:][both[1:] == both[:-1]]
        pairs = self.pair(ids_a[np.searchsorted(ends_a, both)], ids_b[np.searchsorted(ends_b, both)])
        numbers = np.zeros((4, len(new)), np.int64)
        for row, at in enumerate((ends_a, ends_b, common, both)):
            numbers[row, kept] = np.diff(np.searchsorted(at, ends, "right"), prepend=0)
        # a token's name and what stands behind it; tokens in the order of groups, the first side's first
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        named = np.concatenate([np.where(common[group_a] == ends_a, self.a_last[ids_a], self.a_more[ids_a]), np.where(common[group_b] == ends_b, self.b_last[ids_b], self.b_more[ids_b])])
        named = named[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        done = np.concatenate([[0], np.cumsum(numbers[0] + numbers[1])]).tolist()
        self.texts.extend("".join(named[i:j])[:-1] for i, j in zip(done[:-1], done[1:], strict=True))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.numbers = np.concatenate([self.numbers, numbers], axis=1)
        self.good = np.concatenate([self.good, good])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(numbers[3])])

    def _same(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether both sides' bytes are a piece's."""
        all_bytes = b"".join(raw)
        ends = np.cumsum(np.array(list(map(len, raw)), np.int64))
        for side, names, sizes in ((a, self.a_bytes, self.a_sizes), (b, self.b_bytes, self.b_sizes)):
            ids = list(chain.from_iterable(side))
            total = np.concatenate([[0], np.cumsum(sizes[np.array(ids, np.int64)])])
            if b"".join(map(names.__getitem__, ids)) != all_bytes or (total[np.cumsum(list(map(len, side)))] != ends).any():
                # some piece is changed: one by one
                return np.array([b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for x, y, r in zip(a, b, raw, strict=True)], bool)
        return np.ones(len(raw), bool)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers (tokens, groups, links) and the groups' digest of each text; postings: pairs, texts, multiplicities, sorted."""
        if len(self.index) > PIECES:
            self.forget()
        split = [self.parts(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.index))
        if new:
            self.learn(new)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in split])
        piece = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64)
        whole = np.bincount(owner[~self.good[piece]], minlength=len(texts)) == 0
        numbers = np.array([np.bincount(owner, row[piece], len(texts)) for row in self.numbers]).astype(np.int64) * whole
        edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        digests = []
        for k, t in enumerate(texts):
            if t and whole[k]:
                digests.append(hashlib.sha256(";".join([self.texts[p] for p in piece[edges[k] : edges[k + 1]].tolist()]).encode()).hexdigest())
            else:
                digests.append("")
        # a piece of a text counts once with its occurrences, before its pairs are laid out
        keys = np.sort((owner * len(self.index) + piece)[whole[owner]])
        starts = _starts(keys)
        keys, times = keys[starts], np.diff(starts, append=len(keys))
        owner, piece = np.divmod(keys, max(len(self.index), 1))
        many = self.numbers[3][piece]
        at = np.arange(many.sum()) + np.repeat(self.first[piece] - (np.cumsum(many) - many), many)
        keys = self.pairs[at] * len(texts) + np.repeat(owner, many)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = _starts(keys)
        summed = np.add.reduceat(np.repeat(times, many)[order], starts) if len(starts) else np.zeros(0, np.int64)
        pairs, owner = np.divmod(keys[starts], max(len(texts), 1))
        return numbers, digests, (pairs, owner, summed)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, in the fewest bytes a number, compressed."""
    parts = []
    for x in arrays:
        size = np.min_scalar_type(int(x.max()) if len(x) else 0).itemsize
        parts += [struct.pack("<BQ", size, len(x)), x.astype(f"<u{size}").tobytes()]
    raw = b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    """The arrays of pack()."""
    raw = pa.decompress(packed[8:], struct.unpack_from("<Q", packed)[0], "zstd", asbytes=True)
    arrays, at = [], 0
    while at < len(raw):
        size, many = struct.unpack_from("<BQ", raw, at)
        arrays.append(np.frombuffer(raw, f"<u{size}", many, at + 9).astype(np.int64))
        at += 9 + size * many
    return arrays


def pack_postings(pairs: np.ndarray, owner: np.ndarray, times: np.ndarray) -> bytes:
    """Postings sorted by pair and text: pairs once, texts as steps."""
    starts = _starts(pairs)
    steps = np.diff(owner, prepend=0)
    steps[starts] = owner[starts]
    return pack(np.diff(pairs[starts], prepend=0), np.diff(starts, append=len(pairs)), steps, times - 1)


def unpack_postings(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, how many texts hold each, those texts, and multiplicities."""
    steps_of_pairs, many, steps, times = unpack(packed)
    total = np.cumsum(steps)
    starts = np.cumsum(many) - many
    return np.cumsum(steps_of_pairs), many, total - np.repeat(total[starts] - steps[starts], many), times + 1


def _added(pairs: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal pairs added up."""
    p = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    order = np.argsort(p, kind="stable")
    p = p[order]
    starts = _starts(p)
    return p[starts], np.add.reduceat(np.concatenate(n)[order], starts) if len(p) else np.zeros(0, np.int64)


def align(docs: DataFrame, first: bytes, second: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` is the JSON of a byte-level tokenizer, ``second`` the model of a piece
    tokenizer that adds a space; each is shipped once to an executor.  Both
    encode a space and the text, without special tokens.  Token bytes cut the text;
    where tokens of both end, a group ends.  Two tokens whose bytes overlap are linked,
    and a pair of ids counts in as many documents (rows) as hold it linked.  ``n_best``
    counts the links whose pair counts as much as any of its first id, ``count_sum`` adds
    up the counts of all links, and the digest is of ``a1,a2|b1;a3|b2,b3``.

    All pairs count: no pair or document is sampled, capped or dropped.  A stream
    holds one part's pairs and counts (bounded by the vocabularies); the postings pass
    through it.

    Defined cases: null and empty texts, and texts that either tokenizer changes, have
    zeros and an empty digest.  Rows that repeat an id, or have none, are documents of
    their own.  Only the two named columns are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((first, second))
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides.of(*shared.value)
        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("pos", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("groups_sha256", pa.string()), ("blob", pa.binary())])
        for number, batch in enumerate(batches):
            here = (TaskContext.get().partitionId() << 32) + number
            numbers, digests, (pairs, owner, times) = sides.align(batch.column("text").to_pylist())
            edges = np.searchsorted(pairs // sides.all_pairs, np.arange(BUCKETS + 1)).tolist()
            blobs = [(k, pack_postings(pairs[i:j], owner[i:j], times[i:j])) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
            n, m = batch.num_rows, len(blobs)
            columns = [
                np.full(n + m, here), [-1] * n + [k for k, _ in blobs], [*range(n), *[None] * m], batch.column("doc_id").to_pylist() + [None] * m,
                *(row.tolist() + [None] * m for row in numbers), digests + [None] * m, [None] * n + [blob for _, blob in blobs],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = cut(rows.mapInArrow(read, f"batch long, bucket int, pos int, doc_id long, {', '.join(f'{c} long' for c in names)}, groups_sha256 string, blob binary"))
    blobs = base.where("bucket >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _added([p for p, _ in held], [n for _, n in held])], ["pair", "n"])

        for batch in batches:
            for blob in batch.column("blob"):
                held.append(unpack_postings(blob.as_py())[:2])
                if sum(len(p) for p, _ in held) > COUNTED:
                    held = [_added([p for p, _ in held], [n for _, n in held])]
                    if len(held[0][0]) > COUNTED // 2:
                        yield out()
                        held = []
        yield out()

    counts = blobs.select("blob").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    size = blobs.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    streams = max(1, -(-size // (BUCKETS * STREAM)))
    n_second = len(Sides.of(first, second).b_bytes)
    all_pairs = Sides.of(first, second).all_pairs
    bucket = F.floor(F.col("pair") / F.lit(all_pairs)).cast("int")
    stream = F.explode(F.sequence(F.lit(0), F.lit(streams - 1)))
    nothing = F.lit(None)
    told = counts.select(bucket.alias("bucket"), stream.alias("stream"), F.lit(0).alias("kind"), "pair", "n", nothing.cast("long").alias("batch"), nothing.cast("binary").alias("blob"))
    posted = blobs.select("bucket", F.pmod(F.xxhash64("batch"), F.lit(streams)).cast("int").alias("stream"), F.lit(1).alias("kind"), nothing.cast("long").alias("pair"), nothing.cast("long").alias("n"), "batch", "blob")
    met = told.unionAll(posted).repartitionById(BUCKETS * streams, F.col("bucket") * F.lit(streams) + F.col("stream")).sortWithinPartitions("bucket", "stream", "kind", "pair", "batch")

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, told, known = None, [], None
        for batch in batches:
            place = batch.column("bucket").to_numpy() * np.int64(streams) + batch.column("stream").to_numpy()
            kind = batch.column("kind").to_numpy()
            turns = [*np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])])).tolist(), len(kind)]
            found: list[tuple] = []
            for i, j in zip(turns[:-1], turns[1:], strict=True):
                if place[i] != where:
                    where, told, known = place[i], [], None
                if kind[i] == 0:
                    told.append([batch.column(c).slice(i, j - i).to_numpy() for c in ("pair", "n")])
                    continue
                if known is None:
                    pair, n = (np.concatenate(x) for x in zip(*told, strict=True))
                    side = (pair % all_pairs) // n_second
                    starts = _starts(side)
                    most = np.repeat(np.maximum.reduceat(n, starts), np.diff(starts, append=len(n)))
                    known = pair, n, n == most
                pair, n, best = known
                for b, blob in zip(batch.column("batch").slice(i, j - i).to_pylist(), batch.column("blob").slice(i, j - i), strict=True):
                    pairs, many, owner, times = unpack_postings(blob.as_py())
                    at = np.repeat(np.searchsorted(pair, pairs), many)
                    texts = np.flatnonzero(np.bincount(owner))
                    found.append((b, texts, *(np.bincount(owner, times * x[at])[texts].astype(np.int64) for x in (best, n))))
            if found:
                numbers, *lists = zip(*found, strict=True)
                ends = pa.array(np.cumsum([0, *map(len, lists[0])]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in lists)], ["batch", "pos", "best", "total"])

    given = met.mapInArrow(contribute, "batch long, pos array<long>, best array<long>, total array<long>")

    def put(here: pa.Table, given: pa.Table) -> pa.Table:
        many = here.num_rows
        at = given.column("pos").combine_chunks().flatten().to_numpy() if given.num_rows else np.zeros(0, np.int64)
        sums = [np.bincount(at, given.column(c).combine_chunks().flatten().to_numpy() if given.num_rows else None, many).astype(np.int64) for c in ("best", "total")]
        pos = here.column("pos").to_numpy()
        columns = {c: here.column(c) for c in ("doc_id", *names)} | {"n_best": pa.array(sums[0][pos]), "count_sum": pa.array(sums[1][pos]), "groups_sha256": here.column("groups_sha256")}
        return pa.table(columns)

    texts = base.where("bucket < 0").drop("bucket", "blob")
    schema = f"doc_id long, {', '.join(f'{c} long' for c in [*names, 'n_best', 'count_sum'])}, groups_sha256 string"
    return texts.groupBy("batch").cogroup(given.groupBy("batch")).applyInArrow(put, schema)


def public_tokenizers(first: str | None = None, second: str | None = None) -> tuple[bytes, bytes]:
    """The contents of two tokenizer files, by default the installed byte-level one and the installed piece model."""
    import public_tokenizers as installed

    with open(first or installed.path("byte_bpe_50k.json"), "rb") as a, open(second or installed.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned."""
    return align(table(spark, sf_dir, "documents"), *public_tokenizers())


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
