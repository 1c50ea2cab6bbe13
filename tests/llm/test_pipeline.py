"""The pipeline's stages against brute force, one after another, and on awkward documents."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from cases import AWKWARD, documents, empty
from test_join import brute
from test_native import water
from test_text import brute_base

from stratoloom.llm import byte_bpe
from stratoloom.llm.tables import table


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """What each stage returns on the small table, written and read again."""
    docs, out = table(spark, small, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    """Rows by id."""
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(steps):
    """All stages but the last return the columns of documents."""
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "secret_scan", "source_mix", "byte_bpe"]


def test_language_stage(steps):
    """Documents with a letter stay as they are, but for their language."""
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) == {i for i, r in before.items() if any(map(str.isalpha, r["text"] or ""))}
    assert all(after[i]["text"] == before[i]["text"] for i in after) and np.mean([after[i]["lang"] == before[i]["lang"] for i in after]) > 0.95


def test_join_stage(steps):
    """The smallest id of each component stays."""
    before = sorted((r["doc_id"], r["text"]) for r in steps[1].collect())
    want = {c for (i, _), (_, c, _) in zip(before, brute(before, 5, 80), strict=True)}
    assert set(rows(steps[2])) == want and steps[2].count() == len(want) < len(before)


def test_secret_stage(steps):
    """Every document stays; what the fixed shapes find is gone, marks stand for it, and the rest of a text is as it was."""
    before, after = rows(steps[2]), rows(steps[3])
    assert set(before) == set(after)
    hidden = 0
    for i, r in after.items():
        kept = re.fullmatch("(.+?)".join(map(re.escape, r["text"].split("[SECRET]"))), before[i]["text"], re.S)
        assert kept and r["n_chars"] == len(r["text"]) and brute_base(r["text"]) == ""
        assert all(brute_base(x) or len(x) >= 12 for x in kept.groups())
        assert kept.groups() or not brute_base(before[i]["text"])
        hidden += len(kept.groups())
    assert hidden >= sum(brute_base(r["text"]) != "" for r in before.values())


def test_secret_stage_on_secrets(spark):
    """Planted secrets go, each document stays, and clean ones are as they were."""
    bad = ["say password = hunter2-hunter2 twice", "AKIA" + "ABCDEFGH12345678" + " is a key", "hash " + "0123456789abcdef" * 2 + " end", "api_key: 'Zx9/Zx9+Zx9' and secret=abcdef1"]
    clean = ["nothing to hide here", "a password is not shown", None, ""]
    docs = documents(spark, bad + clean)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.scan_secrets(spark, docs, "").collect()}
    assert sorted(got) == list(range(8)) and [got[k] for k in range(4, 8)] == clean
    assert all(brute_base(t) for t in bad)
    assert all("[SECRET]" in got[k] and brute_base(got[k]) == "" for k in range(4)) and got[3].count("[SECRET]") == 2


def test_mix_stage(steps):
    """Whole documents, three times at most, whose words come near the targets of their sources by the rule."""
    before, times = rows(steps[3]), Counter(r["doc_id"] for r in steps[4].collect())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in before.items()}
    sizes, taken = Counter(), Counter()
    for i, r in before.items():
        sizes[r["source"]] += size[i]
        taken[r["source"]] += size[i] * times[i]
    assert set(times) <= set(before) and max(times.values()) <= 3 and all(r["text"] == before[r["doc_id"]]["text"] for r in steps[4].collect())
    for source, want in water(sizes).items():
        assert abs(taken[source] - want) <= 0.15 * want + max(size.values())


def test_encoding_stage(steps):
    """Ids are those of the library."""
    library = byte_bpe.Codec.of(*byte_bpe.public_ranks()).library
    before = rows(steps[4])
    assert steps[5].count() == steps[4].count()
    for r in steps[5].collect():
        assert r["ids"] == np.array(library.encode_ordinary(before[r["doc_id"]]["text"]), "<u4").tobytes()


def test_run(spark, small, steps):
    """All stages at once give the same rows."""
    key = lambda df: sorted((r["doc_id"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, small)) == key(steps[5])


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward(spark, small, texts):
    """Every stage takes awkward documents, repeated rows, and none."""
    docs = documents(spark, [*texts, *texts[3:5]], [*range(len(texts)), *([3, None] if texts else [])]) if texts else empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert name == "byte_bpe" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert (docs.count() > 0) == bool(texts)
