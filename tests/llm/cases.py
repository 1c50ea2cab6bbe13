"""Awkward documents that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `shard` string, size string, n string, k string"


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names clash with what operators make."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    langs = ["en"] * n if langs is None else langs
    sources = ["s"] * n if sources is None else sources
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, "x", "y", "z", "w") for i, t, lang, s in zip(ids, texts, langs, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "The quick brown fox, jumps over 12 lazy dogs. " * 3000
AWKWARD = [None, "", " \t\n", "a", "A a b", LONG, LONG, "naïve café 日本語 Ω 😀", "x" * 70_000, "one two three four five six", "12345 !!! ---"]


def empty(spark):
    """No documents."""
    return documents(spark, [])
