"""Token alignment against plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import AWKWARD, documents, empty

from stratoloom.llm import token_alignment as ta

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_hand(texts, ids):
    """Whole texts encoded by the libraries, tokens compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = ta.public_tokenizers()
    a, b = Tokenizer.from_str(first.decode()), sentencepiece.SentencePieceProcessor(model_proto=second)
    a.encode_special_tokens = True
    alphabet = ta.byte_alphabet()
    named = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        want = f" {text}".encode()
        sides = []
        for ids_of, raw in ((a.encode(f" {text}", add_special_tokens=False).ids, lambda i: named[i]), (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            spans, at = [], 0
            for i in ids_of:
                spans.append((i, at, at + len(raw(i))))
                at = spans[-1][2]
            sides.append((spans, b"".join(map(raw, ids_of))))
        if any(joined != want for _, joined in sides):
            rows.append(None)
            continue
        (sa, _), (sb, _) = sides
        links, k = [], 0
        for i, low, high in sa:
            while sb[k][2] <= low:
                k += 1
            m = k
            while m < len(sb) and sb[m][1] < high:
                links.append((i, sb[m][0]))
                m += 1
        cuts = sorted({x[2] for x in sa} & {x[2] for x in sb})
        groups, low = [], 0
        ga, gb = defaultdict(list), defaultdict(list)
        for side, out in ((sa, ga), (sb, gb)):
            k = 0
            for i, _, high in side:
                while cuts[k] < high:
                    k += 1
                out[k].append(str(i))
        groups = [",".join(ga[k]) + "|" + ",".join(gb[k]) for k in range(len(cuts))]
        rows.append((len(sa), len(sb), links, groups))
    count = Counter(p for r in rows if r for p in set(r[2]))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for doc, r in zip(ids, rows, strict=True):
        if r is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(count[p] == most[p[0]] for p in r[2])
            out.append((doc, r[0], r[1], len(r[3]), len(r[2]), best, sum(count[p] for p in r[2]), hashlib.sha256(";".join(r[3]).encode()).hexdigest()))
    return out


def test_alignment_by_hand(spark, monkeypatch):
    """White space of all kinds, specials, symbols the model changes, repeats: as plain loops over whole texts find."""
    dice = random.Random(5)
    parts = ["foo", " bar", "  ", "\n", "'s", "'re", "12", "!!", "é", "日本", " ", "\t\t", "z" * 30, " ", "😀", "'", " a", " the", "<s>", "<|endoftext|>", "<0x41>", " ", "　", "\x1c", "x\n y", "ﬁ", "é"]
    texts = [*AWKWARD, " lead", "trail ", "▁x y", "a ▁", "a \n b", "a\n\nb c", *("".join(dice.choices(parts, k=dice.randint(1, 60))) for _ in range(80))]
    texts += ["the same text", "the same text"]
    ids = [*range(len(texts) - 2), None, 3]
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    want = sorted(by_hand(texts, ids), key=key)
    got = [tuple(r[c] for c in COLUMNS) for r in ta.align(documents(spark, texts, ids), *ta.public_tokenizers()).collect()]
    assert sorted(got, key=key) == want
    assert sum(r[1] > 0 for r in want) > 60 and sum(r[1] == 0 for r in want) >= 4
    # several streams for a part of the ids
    monkeypatch.setattr(ta, "STREAM", 200)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in ta.align(documents(spark, texts, ids).repartition(7), *ta.public_tokenizers()).collect()), key=key) == want


def test_alignment_of_the_table(spark, small):
    """All documents of the smallest table."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = ta.op13_token_alignment(spark, small).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(by_hand([r["text"] for r in rows], [r["doc_id"] for r in rows]))


def test_alignment_without_rows(spark):
    """No documents, none with tokens."""
    assert ta.align(empty(spark), *ta.public_tokenizers()).count() == 0
    assert [tuple(r) for r in ta.align(documents(spark, [None]), *ta.public_tokenizers()).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("many", [0, 1, 5000])
def test_packing(many):
    """Postings come back."""
    dice = np.random.default_rng(many)
    keys = np.unique(dice.integers(0, 40 * 300, many) if many else np.zeros(0, np.int64))
    pairs, owner = np.divmod(keys, 300)
    pairs, times = pairs * 10**7, dice.integers(1, 700, len(keys))
    got = ta.unpack_postings(ta.pack_postings(pairs, owner, times))
    assert (np.repeat(got[0], got[1]) == pairs).all() and (got[2] == owner).all() and (got[3] == times).all()
