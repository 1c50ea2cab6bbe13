"""The Jaccard join and the vector join against brute force."""

import random
import re

import numpy as np
import pytest
from cases import AWKWARD, documents, empty

import corpus_pipeline
from stratoloom.llm import jaccard_join, near_vectors


def brute(rows, size, percent):
    """(n_shingles, component, links) of each row, by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    n = len(rows)
    root, links = list(range(n)), [0] * n
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(n):
        for j in range(i):
            a = len(sets[i] & sets[j])
            if a and 100 * a >= percent * (len(sets[i]) + len(sets[j]) - a):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(len(sets[i]), least[find(i)], links[i]) for i in range(n)]


def corpus(seed, n=160):
    """Documents in families of near copies at every distance from the threshold."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choices("abcdeXYZ", k=3))
    passage = " ".join(word() for _ in range(30))
    out = []
    while len(out) < n:
        base = [word() for _ in range(dice.randint(1, 90))]
        for _ in range(dice.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(dice.randint(0, 4)):
                w[dice.randrange(len(w))] = word()
            text = "  ".join(w) + (" " + passage if dice.random() < 0.3 else "")
            out.append(text if dice.random() < 0.8 else text.lower())
    return out[:n]


@pytest.mark.parametrize(("size", "percent", "group", "bundle"), [(4, 85, 256, 2048), (5, 80, 4, 20), (3, 60, 4, 1)])
def test_jaccard(spark, monkeypatch, size, percent, group, bundle):
    """All links and components, whatever the sizes of groups and bundles."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", bundle)
    texts = corpus(size)
    rows = list(zip(random.Random(1).sample(range(10_000), len(texts)), texts, strict=True))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(documents(spark, texts, [i for i, _ in rows]), size, percent).collect()}
    want = {i: w for (i, _), w in zip(rows, brute(rows, size, percent), strict=True)}
    assert got == want
    assert max(w[2] for w in want.values()) > 5


def test_jaccard_cases(spark):
    """Nulls, empty and very long texts, repeated rows and ids; no rows."""
    texts = [*AWKWARD, "Q r s", "q R s"]
    ids = [*range(len(AWKWARD)), 6, None]
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(documents(spark, texts, ids), 4, 85).collect()]
    assert len(rows) == len(texts)
    by = {r[0]: r for r in rows if r[0] != 6}
    assert by[0] == (0, 0, 0, 0) and by[1][1:] == (0, 1, 0) and by[2][3] == 0
    assert by[5][2:] == (5, 1) and by[None][2:] == (None, 0)
    assert sorted(r[1:] for r in rows if r[0] == 6) == sorted([(1, 6, 0), (by[5][1], 5, 1)])
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0
    kept = jaccard_join.one_of_each(documents(spark, texts, ids))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert kept.columns == documents(spark, texts, ids).columns


def test_rows_of_repeated_ids(spark):
    """A near copy goes without the other rows of its id; each component keeps one row."""
    base, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in ("a", "b", "c"))
    rows = [(5, base), (6, base + " x"), (6, other), (6, other), (7, third), (7, other + " y"), (8, None), (8, ""), (None, base), (None, base)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = corpus_pipeline.join_near_copies(spark, docs, "")
    want = [(5, base), (6, other), (7, third), (8, None), (8, ""), (None, base), (None, base)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))
    assert kept.columns == docs.columns


def test_regular_words(spark):
    """Words whose bytes cancel out in linear hashes differ."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = jaccard_join.jaccard_join(documents(spark, [word, word.translate(str.maketrans("ab", "ba")), word.upper()]), 4, 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in rows) == [(0, 0, 1), (1, 1, 0), (2, 0, 1)]


def test_common_tokens(spark, monkeypatch):
    """A token that many groups hold is dealt into lists that meet in pairs; nothing is lost."""
    monkeypatch.setattr(jaccard_join, "LISTED", 3)
    texts = corpus(11, 120)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(documents(spark, texts), 2, 50).collect()}
    assert got == dict(enumerate(brute(list(enumerate(texts)), 2, 50)))


@pytest.mark.parametrize("block", [7, 2048])
def test_vectors(spark, block):
    """Links, components and what stands, against all pairs in double precision."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 16))
    v = np.concatenate([base[rng.integers(0, 20, 150)] + rng.standard_normal((150, 16)) * rng.choice([0, 0.15, 0.25], (150, 1)), np.repeat(base[:1], 12, 0) * 1e6]).astype(np.float32)
    labels = [int(x) if x < 3 else None for x in rng.integers(0, 4, len(v))]
    rows = [(int(i), v[i].tolist(), labels[i]) for i in range(len(v))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [], 1), (905, [1.0] * 3, 1), (None, [1.0] * 16, 1), (906, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, own string, `row` int, i int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, 0.93, block=block).collect()}
    assert len(got) == len(rows)
    d = v.astype(float)
    cos = d @ d.T / np.sqrt((d * d).sum(1))[:, None] / np.sqrt((d * d).sum(1))[None]
    link = (cos >= 0.93) & np.array([[a is not None and a == b for b in labels] for a in labels]) & ~np.eye(len(v), dtype=bool)
    least = np.arange(len(v))
    for _ in range(len(v)):
        least = np.minimum(least, np.where(link, least[None], len(v)).min(1))
    assert {i: got[i] for i in range(len(v))} == {i: (int(link[i].sum()), int(least[i]), bool(least[i] == i)) for i in range(len(v))}
    assert link.any() and all(got[i][0] == 0 and got[i][2] for i in (900, 901, 902, 903, 904, 905, 906, None))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_repeated_vector_ids(spark):
    """Rows that repeat an id are vectors of their own: none hides another."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [-1.0, 0.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()), key=str)
    want = [(1, 3, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 3, 1, False), (5, 3, 1, False), (5, 3, 1, False), (7, 0, 7, True), (0, 0, None, True), (0, 0, None, True)]
    assert got == sorted(want, key=str)


def test_open_pairs(spark, monkeypatch):
    """With any error bound, the pairs that stay open are decided in double precision."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((90, 5))
    cos = v @ v.T / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))[None]
    df = spark.createDataFrame([(k, x.tolist(), "l") for k, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    for at in (np.sort(cos[np.triu_indices(90, 1)])[-200], 0.8):  # a threshold that some pair meets to the last bit, or nearly
        link = (np.einsum("ik,jk->ij", v, v) / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1))) >= at - 1e-12) & ~np.eye(90, dtype=bool)
        got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(df, float(at) - 1e-12, block=20).collect()}
        assert got == dict(enumerate(link.sum(1).tolist())) and link.any()


def test_bounds_hold():
    """No quantised product is further from the cosine than its bound."""
    rng = np.random.default_rng(6)
    u = rng.standard_normal((200, 64))
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    codes, scale, error = near_vectors.quantise(u)
    about = (codes.astype(float) * scale[:, None]) @ (codes.astype(float) * scale[:, None]).T
    assert (np.abs(about - u @ u.T) <= error[:, None] + (1 + error[:, None]) * error[None] + 1e-12).all()
