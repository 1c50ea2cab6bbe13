"""Secret scans: fixed shapes, and random-looking strings by two character Markov models.

One model is of random strings, the other of ordinary identifiers; both are
trained from labelled samples.  A stretch of key characters is a secret if its
log-likelihood ratio is high enough, wherever it stands in a longer run.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..lineage import cut
from .sharding import unit_hash
from .tables import small_batches, table

# The base shapes, and the least length of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

# Words of identifiers in code, beside those of the corpus.
CODE_WORDS = (
    "abstract access account action active adapter add address admin after agent alert all api app application archive args array asset async attribute audio auth author auto back background "
    "base batch before block body bool border bucket buffer build bundle button byte cache call cancel card cell center change channel char check child class clean client clock close cluster code "
    "color column command commit common compare component config connect console container content context control cookie copy core count create current cursor data database date debug default "
    "delete delta deploy depth detail device dialog diff dir disable display document domain download draft driver drop edit element email empty enable encode end engine entity entry env error event "
    "exception export external factory failure feature field file filter final find first flag folder font form format frame function gateway get global graph grid group handler hash header height"
).split()

#: Documents that the models learn from, about, at most, and how many of their words, the most frequent first, identifiers are made of.
SAMPLE, WORDS = 4000, 2000
#: Random strings and identifiers made as labelled samples, and the alphabets of the first.
MADE = 20_000
ALPHABETS = ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
#: A candidate's least length; the log-likelihood ratio (nats) that a stretch of it must have in all, each character having paid a toll.
LENGTH, TOTAL, TOLL = 12, 14.0, 0.35
#: Candidates of small letters alone (but for the first) are words below this length.
WORDLIKE = 20
#: Symbols of the models: the beginning (0) and ASCII.
SYMBOLS = 128

_assign = re.compile(ASSIGN, re.I | re.A)
_access, _hex = re.compile(ACCESS), re.compile(HEX.replace("+", "{%d,}" % LEAST["hex"]))
_candidate = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % LENGTH)
_ordinary = re.compile(r"[A-Za-z0-9_-]{4,}")
_word = re.compile(r"[a-z]{3,12}")
#: Identifiers by shape: hexadecimal groups as in UUIDs, and numbers, dates and times.
_regular = re.compile(r"(?:[0-9a-f]{4,12}(?:-[0-9a-f]{4,12})+|[0-9A-F]{4,12}(?:-[0-9A-F]{4,12})+|[0-9TZ+/=_-]+)")
_core = re.compile(r"[A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed shapes, leftmost and not overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign", m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _access.finditer(text) if len(m[0]) >= LEAST["access"]]
    # a run of the class is matched whole, so asking for its length at once changes no match
    found += [(m.start(), m.end(), "hex", m[0]) for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _codes(value: str) -> np.ndarray:
    """The characters, after two marks of the beginning (0), as numbers below 128."""
    return np.frombuffer(b"\0\0" + value.encode("ascii", "replace"), np.uint8).astype(np.int32)


def _cells(value: str) -> np.ndarray:
    """The trigrams that end in each character."""
    c = _codes(value)
    return (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]


def made_random(many: int, seed: int) -> list[str]:
    """Labelled samples of random strings."""
    dice = random.Random(seed)
    return ["".join(dice.choices(ALPHABETS[k % len(ALPHABETS)], k=dice.randint(16, 48))) for k in range(many)]


def made_identifiers(words: list[str], many: int, seed: int) -> list[str]:
    """Labelled samples of identifiers: words in the styles of code, paths and constants, some with numbers."""
    dice = random.Random(seed)
    styles = (
        lambda w: w[0] + "".join(map(str.capitalize, w[1:])), lambda w: "".join(map(str.capitalize, w)), "_".join, "-".join, "/".join, lambda w: "_".join(w).upper(),
        lambda w: "-".join(map(str.capitalize, w)), lambda w: "/".join(w[:-1]) + "/" + "".join(map(str.capitalize, w[-2:])), "".join,
    )
    out = []
    for k in range(many):
        name = styles[k % len(styles)](dice.choices(words, k=dice.randint(2, 5)))
        if dice.random() < 0.3:
            name += dice.choice(("", "-", "_", "/v", "V")) + str(dice.choice((dice.randint(0, 9), dice.randint(10, 999), dice.randint(1980, 2040))))
        out.append(name)
    return out


def _witten_bell(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Probabilities from counts, with the shorter context's for what is left."""
    kinds, total = (counts > 0).sum(axis=-1, keepdims=True), counts.sum(axis=-1, keepdims=True)
    return (counts + kinds * low) / np.maximum(total + kinds, 1) + (total + kinds == 0) * low


def _classes() -> np.ndarray:
    """The class of every symbol: the beginning, other, digit, capital, small letter."""
    return np.array([0, *(4 if c.islower() else 3 if c.isupper() else 2 if c.isdigit() else 1 for c in map(chr, range(1, SYMBOLS)))])


def _by_class(counts: np.ndarray) -> np.ndarray:
    """Probabilities of trigrams from their classes' counts, all symbols of a class alike but for symbols that are no letters."""
    of = _classes()
    member = np.eye(5)[of]
    three = np.einsum("abc,ai,bj,ck->ijk", counts, member, member, member, optimize=True)
    p = _witten_bell(three, _witten_bell(three.sum(axis=0), np.full(5, 0.2)))
    inside = member * (counts.sum(axis=(0, 1)) + 1)[:, None]
    inside = (member / member.sum(axis=0) * (np.arange(5) != 1) + inside / inside.sum(axis=0) * (np.arange(5) == 1)).sum(axis=1)
    return p[of][:, of][:, :, of] * inside


def fit(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios of all trigrams, random over ordinary, from their counts: SYMBOLS^3 numbers.

    Random strings depend on nothing before them, so their model sees one
    character back (for what alphabet it is).  That of identifiers sees two, half
    as characters and half as classes only, so that words of other languages
    than the samples' are still made of letters that follow letters.
    """
    def pairs(counts: np.ndarray) -> np.ndarray:
        two = counts.sum(axis=0)
        return _witten_bell(two, _witten_bell(two.sum(axis=0), np.full(SYMBOLS, 1 / SYMBOLS)))

    random_counts, ordinary_counts = (c.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float) for c in (random_counts, ordinary_counts))
    ordinary = (_witten_bell(ordinary_counts, pairs(ordinary_counts)) + _by_class(ordinary_counts)) / 2
    return (np.log(pairs(random_counts)) - np.log(ordinary)).astype(np.float32).reshape(-1)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The models' log-likelihood ratios of all trigrams of characters (see ``fit``).

    Labelled samples of random strings are the values of the fixed shapes and
    ``MADE`` strings over common alphabets; those of ordinary identifiers are the
    other runs of letters and digits and ``MADE`` identifiers of the corpus's ``WORDS``
    most frequent words and CODE_WORDS (fixed seeds).  What comes from the corpus
    comes from about ``sample`` documents, by the hash of their key; the counts
    of trigrams that reach the driver have a fixed size.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.where(unit_hash(F.concat(F.lit("secret:"), F.coalesce("key", F.lit("null")))) < share).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SYMBOLS**3), np.int64)
        words: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0):
                body, at, values = x.as_py(), 0, ([], [])
                for start, end, _, value in base_spans(body):
                    values[1].append(_cells(value))
                    if start >= at:
                        values[0].extend(_cells(m[0]) for m in _ordinary.finditer(body, at, start))
                    at = max(at, end)
                values[0].extend(_cells(m[0]) for m in _ordinary.finditer(body, at))
                for label in (0, 1):
                    if values[label]:
                        np.add.at(counts[label], np.concatenate(values[label]), 1)
                words.update(_word.findall(body.lower()))
        for label in (0, 1):
            cell = np.flatnonzero(counts[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), label)), pa.array(cell.astype(str).tolist(), pa.string()), pa.array(counts[label, cell])], ["label", "what", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2] * len(words), pa.int64()), pa.array(words, pa.string()), pa.array(words.values(), pa.int64())], ["label", "what", "n"])

    found = cut(chosen.mapInArrow(count, "label long, what string, n long").groupBy("label", "what").agg(F.sum("n").alias("n")))
    counts = np.zeros((2, SYMBOLS**3))
    for label, cell, n in found.where("label < 2").collect():  # 2 * SYMBOLS^3 rows at most
        counts[label, int(cell)] = n
    words = [r["what"] for r in found.where("label = 2").orderBy(F.col("n").desc(), "what").limit(WORDS).collect()]
    for label, strings in ((1, made_random(MADE, 7)), (0, made_identifiers([*words, *CODE_WORDS], MADE, 7))):
        np.add.at(counts[label], np.concatenate([_cells(x) for x in strings]), 1)
    return fit(counts[1], counts[0])


def random_stretches(run: str, ratios: np.ndarray) -> list[tuple[int, int]]:
    """Where a run of key characters looks random: the stretch of most log-likelihood ratio, if it has enough, then what is left on both sides."""
    if len(run) < LENGTH or _regular.fullmatch(run) or (len(run) < WORDLIKE and run.isalpha() and run[1:].islower()):
        return []
    gain = np.concatenate([[0.0], np.cumsum(ratios[_cells(run)] - TOLL, dtype=np.float64)])
    least = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - least))
    if gain[end] - least[end] < TOTAL:
        return []
    start = int(np.argmin(gain[: end + 1]))
    # no letter or digit of a secret stays behind
    while start and run[start].isalnum() and run[start - 1].isalnum():
        start -= 1
    while end < len(run) and run[end - 1].isalnum() and run[end].isalnum():
        end += 1
    if end - start < LENGTH:
        return []
    return [*random_stretches(run[:start], ratios), (start, end), *((end + a, end + b) for a, b in random_stretches(run[end:], ratios))]


def scan(text: str | None, ratios: np.ndarray) -> list[tuple[int, int, str]]:
    """All spans of a text: (start, end, kind) in code points, by start, then kind.

    Candidates of the models are the runs of key characters.  A run that holds
    spans of the fixed shapes is judged whole, and its stretches are added
    where they reach beyond those spans; what looks ordinary adds nothing.
    """
    if not text:
        return []
    found = [(start, end, kind) for start, end, kind, _ in base_spans(text)]
    covered: list[list[int]] = []
    for start, end, _ in found:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    ends = [end for _, end in covered]
    more = []
    for m in _candidate.finditer(text):
        for start, end in random_stretches(m[0], ratios):
            start, end = start + m.start(), end + m.start()
            k = bisect.bisect_left(ends, end)
            if k == len(ends) or covered[k][0] > start:
                more.append((start, end, "markov"))
    return sorted(found + more, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_markov, base (string), spans (string).

    Spans read kind:start:end, in code points with the end exclusive, comma-joined
    by start, then kind; ``base`` holds those of the fixed shapes.  A null text is
    empty and holds nothing.  Only the two named columns are read, keys may be
    null or repeat, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = rows.select("doc_id").schema
    for k in KINDS:
        out = out.add(f"n_{k}", "long")
    out = out.add("base", "string").add("spans", "string")
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                spans = scan(x.as_py(), table)
                said = [(kind, f"{kind}:{start}:{end}") for start, end, kind in spans]
                rows.append((name, *(sum(k == kind for k, _ in said) for kind in KINDS), ",".join(s for k, s in said if k != "markov"), ",".join(s for _, s in said)))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.name for f in out.fields])

    return rows.mapInArrow(find, out)


def redact(text: str | None, ratios: np.ndarray, mark: str = "[SECRET]") -> str | None:
    """The text with ``mark`` in place of every span, overlapping spans as one."""
    if text is None:
        return None
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in scan(text, ratios):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, ratios: np.ndarray, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced; ``n_chars``, if the table has it, follows.

    All rows and columns stay; null texts stay null.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    shape = docs.schema
    names, types = docs.columns, [to_arrow_type(f.dataType) for f in shape.fields]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            columns = list(batch.columns)
            at = names.index(text)
            done = [redact(x.as_py(), table) for x in columns[at]]
            columns[at] = pa.array(done, types[at])
            if n_chars in names:
                k = names.index(n_chars)
                columns[k] = pa.array([old if t is None else len(t) for old, t in zip(columns[k].to_pylist(), done, strict=True)], types[k])
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(clean, shape)


def digest(spans: str) -> str:
    """SHA-256 in hex."""
    return hashlib.sha256(spans.encode()).hexdigest()


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, learn(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_markov")


QUERIES = {"op3_markov_secrets": op3_markov_secrets}
ORACLES: dict[str, str] = {}
