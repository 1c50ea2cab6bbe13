"""Mixing, sharding and fingerprints: laws and awkward cases."""

import hashlib

from cases import AWKWARD, documents, empty

from stratoloom.llm import merkle, mixing, sharding


def test_shards(spark):
    """Slots are gapless, a new shard takes rows only into itself, weights count."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    rows = sharding.shard_rows(docs, dict.fromkeys(range(16), 1.0), dict.fromkeys(range(17), 1.0)).collect()
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and 150 < len(slots) < 350
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    heavy = sharding.shard_rows(docs, {0: 3.0, 1: 1.0, 2: 0.0}).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] for r in heavy}
    assert set(share) == {0, 1} and 0.7 < share[0] / 4000 < 0.8


def test_shard_cases(spark):
    """Nulls, repeated rows and no rows."""
    rows = sharding.shard_rows(documents(spark, [*AWKWARD, "a"], [*range(len(AWKWARD)), None]), {0: 1.0}).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(AWKWARD) + 1))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}[0] == (1, 0)
    twice = documents(spark, ["a", "a"], [1, 1])
    assert sorted(r["slot"] for r in sharding.shard_rows(twice, {0: 1.0}).collect()) == [0, 1]
    assert sharding.shard_rows(empty(spark), {0: 1.0}).count() == 0


def water(sizes):
    """Targets by the rule: share by weight, cap at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in capped]
        total = sum(weight[s] for s in open_)
        target |= {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        capped |= set(over)


def test_mix(spark):
    """Targets follow the rule, takes come near them, and no row is taken more than three times over."""
    texts, sources = [], []
    for source, n in (("a", 400), ("b", 30), (None, 90), ("B", 5), ("é", 700), ("empty", 3)):
        texts += [None if source == "empty" else "w " * (k % 40 + 1) for k in range(n)]
        sources += [source] * n
    docs = documents(spark, texts, sources=sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water(sizes)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 3 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and 0.9 < mixed.where("text IS NOT NULL").count() / len(texts) < 1.6


def test_mix_cases(spark):
    """Awkward texts, repeated rows, no words at all, no rows."""
    assert mixing.mix(documents(spark, [*AWKWARD, "a"], [*range(len(AWKWARD)), None])).count() == len(AWKWARD) + 1
    assert [r["taken"] for r in mixing.mix(documents(spark, [None, ""])).collect()] == [0, 0]
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_edits(spark):
    """Edited texts follow the order of ids; equal texts have equal fingerprints; likeness lies in 0..1."""
    ids = [50, 3, 17, 4, 9, -8, 100, 21, 22, 23, 24]
    rows = {r["doc_id"]: r for r in merkle.compare_edits(documents(spark, AWKWARD, ids)).collect()}
    order = sorted(ids, reverse=True)
    text = {i: t or "" for i, t in zip(ids, AWKWARD, strict=True)}
    for k, i in enumerate(order):
        other, half = text[order[(k + 1) % len(order)]], len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + other[:half]
        assert rows[i]["n_chars"] == len(text[i]) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) == (edited == text[i]) == (rows[i]["near_edited"] == 1)
        assert rows[i]["fingerprint"][:64] == tree(text[i])[0] and rows[i]["edited_fingerprint"][:64] == tree(edited)[0]
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    prints = {t: rows[i]["fingerprint"] for i, t in text.items()}
    assert len(set(prints.values())) == len(prints) and rows[-8]["fingerprint"] == rows[100]["fingerprint"]


def test_edit_cases(spark):
    """A lone document is its own next; repeated ids are documents of their own; no rows."""
    lone = merkle.compare_edits(documents(spark, ["one. two. three."], [7])).first()
    assert lone["near_next"] == 1 and lone["edited_sha256"] == hashlib.sha256(b"one. two" + b"one. two").hexdigest()
    rows = merkle.compare_edits(documents(spark, ["a", "bb", "bb", "c", None, "dd"], [1, 1, 1, None, None, 2])).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (0, 1), (1, 1), (1, 2), (1, 2), (2, 2)]
    # by descending id, then by the text's hash
    order = ["dd", *sorted(["a", "bb"], key=sha), *sorted(["c", ""], key=sha)]
    for r in rows:
        at = next(k for k, t in enumerate(order) if r["fingerprint"].startswith(tree(t)[0]))
        edited = order[at][: len(order[at]) - len(order[at]) // 2] + order[(at + 1) % 5][: len(order[at]) // 2]
        assert r["edited_sha256"] == sha(edited)
    assert merkle.compare_edits(empty(spark)).count() == 0


def sha(text):
    """SHA-256 in hex."""
    return hashlib.sha256(text.encode()).hexdigest()


def tree(text):
    """Root, branches and leaves, by plain loops."""
    found, section = [], [""]
    for k, c in enumerate(text):
        section[-1] += c
        if c == "\n":
            found.append(section)
            section = [""]
        elif c == " " and k and text[k - 1] in ".!?|":
            section.append("")
    found.append(section)
    found = [[sha(p) for p in s if p] for s in found if any(s)]
    branch = [sha("".join(s)) for s in found]
    return sha("".join(branch)), [b[:16] for b in branch], [p[:8] for s in found for p in s]


TREES = ["", "a", "b. a. ", "a. b. ", "a. a. a. b. ", "a. b.\nc. d.\ne. f.", "a. b.\nc. X.\ne. f.", "\n\n. . x! y? z|", "a. x. y. b. ", "a. y. x. b. ", "a. b.\ne. f."]


def test_likeness(spark):
    """Trees are those of plain code; only equal texts have likeness 1, and order counts."""
    rows = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(documents(spark, TREES)).collect()}
    for k, t in enumerate(TREES):
        root, branch, leaf = tree(t)
        assert rows[k][:64] == root and [x[:16] for x in rows[k].split("/")[1:]] == branch and [y for x in rows[k].split("/")[1:] for y in x.split(".")[1:]] == leaf
    table = spark.createDataFrame([(i, j, rows[i], rows[j]) for i in rows for j in rows], "i int, j int, a string, b string")
    near = {(r["i"], r["j"]): r["n"] for r in table.select("i", "j", merkle.compare(merkle.F.col("a"), merkle.F.col("b"))["near"].alias("n")).collect()}
    for (i, j), n in near.items():
        assert 0 <= n <= 1 and (n == 1) == (i == j) and n == near[j, i]
    # equal middles in another order: leaves alone; one of two ends; all but one of six
    assert near[2, 3] == 0.5 and near[8, 9] == (2 * 2 + 2) / 8 and near[5, 6] == 10 / 12 and near[0, 1] == 0
    places = table.select("i", "j", merkle.compare(merkle.F.col("a"), merkle.F.col("b")).alias("c")).select("i", "j", "c.*")
    said = {(r["i"], r["j"]): (r["sections"], r["paragraphs"]) for r in places.collect()}
    assert said[5, 6] == ("2-2", "4-4") and said[5, 10] == ("2-", "3-") and said[10, 5] == ("2-2", "3-4") and said[5, 5] == ("", "") and said[0, 1] == ("1-1", "1-1")
