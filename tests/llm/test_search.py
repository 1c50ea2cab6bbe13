"""Ranked search against plain loops."""

import math
import random
import re

import numpy as np
from cases import AWKWARD, documents, empty

from stratoloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    """A text's terms, only A-Z lower-cased."""
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(texts, ids, queries, k):
    """The definition, document by document."""
    all_terms = [terms(t) for t in texts]
    n_docs, n_terms = sum(bool(t) for t in all_terms), sum(map(len, all_terms))
    out = []
    for item, query in queries:
        scored = []
        for doc, found in zip(ids, all_terms, strict=True):
            score = 0
            for t in set(terms(query)):
                if found.count(t):
                    df, tf = sum(t in f for f in all_terms), found.count(t)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 8 * (10 + 90 * len(found) * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -minus) for rank, (minus, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search_by_hand(spark):
    """Awkward texts, ties, repeated and null ids, items without terms: as plain loops find; also in blocks of items."""
    dice = random.Random(4)
    words = ["Alpha", "beta", "GAMMA-ray", "delta,", "é́tude", "x_y", "日本", "it's", "42", "the", "the", "the"]
    texts = [*AWKWARD, *(" ".join(dice.choices(words, k=dice.randint(1, 30))) for _ in range(60)), "tie of alpha", "tie of alpha", "tie of alpha"]
    ids = [*range(len(texts) - 3), 5, None, 5]
    queries = [(1, "alpha BETA the"), (1, "alpha BETA the"), (2, None), (3, " -- "), (None, "ray 日本 zebra"), (4, "quick quick fox tie")]
    items = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS doc_id")
    key = lambda r: tuple((v is None, v or 0) for v in r)
    for size in (1 << 23, 150):
        got = [tuple(r) for r in ranked_search.ranked_search(documents(spark, texts, ids), items, k=4, items_at_once=size).collect()]
        assert sorted(got, key=key) == sorted(by_hand(texts, ids, queries, 4), key=key)


def test_search_without_rows(spark):
    """No documents, or no items: no rows."""
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked_search.ranked_search(empty(spark), items).count() == 0
    assert ranked_search.ranked_search(documents(spark, ["alpha"]), items.limit(0)).count() == 0


def test_radix_order():
    """Sorts as numpy does, ties in their order."""
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) % np.uint64(1 << 50)
    keys = np.concatenate([keys, keys[:100], np.zeros(3, np.uint64)])
    assert (ranked_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranked_search.radix_order(keys[:0])) == 0


def test_many_matches(spark, monkeypatch):
    """Entries are sorted in slices of whole documents: same result."""
    texts = [f"alpha beta {'gamma ' * (i % 7)}" for i in range(300)]
    items = spark.createDataFrame([(i, "alpha beta gamma") for i in range(20)], "item_id long, text string")
    want = sorted(map(tuple, ranked_search.ranked_search(documents(spark, texts), items).collect()))
    monkeypatch.setattr(ranked_search, "ENTRIES", 50)
    assert sorted(map(tuple, ranked_search.ranked_search(documents(spark, texts), items).collect())) == want and len(want) == 200
