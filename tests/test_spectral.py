"""Spectral vectors and clusters against dense numpy."""

import numpy as np
import pytest

from stratoloom.operators import spectral
from stratoloom.plans import graphs
from stratoloom.plans.catalogue import QUERIES


def dense(rows):
    """Node ids and the adjacency of edge rows."""
    ids = sorted({r["src"] for r in rows} | {r["dst"] for r in rows})
    at = {c: i for i, c in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in rows:
        w[at[r["src"]], at[r["dst"]]] += r["w"]
    return ids, w


def by_numpy(w, k, gamma=1.0):
    """Eigenvalues, eigenvectors and embedding of the rows' Gaussian affinity."""
    square = (w * w).sum(axis=1)
    a = np.exp(-gamma * np.maximum(square[:, None] + square - 2 * w @ w.T, 0))
    d = a.sum(axis=1)
    values, vectors = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order], d


def close(values, got, vectors, limit=1e-5):
    """The same spaces: column by column, or together where eigenvalues are nearly equal."""
    low = 0
    for high in range(1, len(values) + 1):
        if high == len(values) or values[high - 1] - values[high] > 1e-4:
            a, b = got[:, low:high], vectors[:, low:high]
            if high < len(values) or low == 0:  # the last group may go on beyond the columns
                assert np.abs(a @ a.T - b @ b.T).max() < limit
            low = high


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_vectors_of_the_table(spark, size):
    """Eigenvalues and eigenvectors of the registered graph are numpy's, up to sign and rotation."""
    edges = graphs.overlaps(spark, f"/root/testdata/{size}").cache()
    ids, w = dense(edges.collect())
    values, vectors, d = by_numpy(w, 9)
    found, table = spectral.embedding(edges, 5)
    rows = {r["cell"]: r["v"] for r in table.collect()}
    got = np.array([rows[c] for c in ids]) * np.sqrt(d)[:, None]
    assert sorted(rows) == ids and np.abs(found - values[:5]).max() < 1e-6
    assert np.abs(got.T @ got - np.eye(5)).max() < 1e-6
    if values[4] - values[5] > 1e-4:
        close(values[:5], got, vectors[:, :5])
    else:
        close(values[:4], got[:, :4], vectors[:, :4])


def planted(spark, sizes, seed):
    """A graph with a dense group of each size and a few edges between."""
    dice = np.random.default_rng(seed)
    group = np.repeat(np.arange(len(sizes)), sizes)
    n = len(group)
    p = np.where(group[:, None] == group, 0.5, 0.02)
    hit = np.triu(dice.random((n, n)) < p, 1)
    hit |= hit.T
    rows = [(int(i) * 7, int(j) * 7, 0.3) for i, j in zip(*np.nonzero(hit), strict=True)]
    return spark.createDataFrame(rows, "src long, dst long, w double"), {i * 7: int(g) for i, g in enumerate(group)}


def test_planted_groups(spark):
    """Groups come back, and the clusters are k-means of numpy's embedding."""
    edges, truth = planted(spark, [40, 30, 50], 2)
    got = {r["cell"]: r["cluster"] for r in spectral.clusters(edges, 3).collect()}
    assert set(got) == set(truth) and len(set(zip(got.values(), (truth[c] for c in got), strict=True))) == 3


def test_plain_graph_operator(spark):
    """Without a rank-one part the operator is the normalised graph; one component's first vector is the degrees' root."""
    edges, _ = planted(spark, [30, 30], 5)
    ids, w = dense(edges.collect())
    nodes = edges.selectExpr("src AS cell").distinct().selectExpr("cell", "0.0D AS e")
    values, table = spectral.largest(spectral.Operator(edges, nodes), 4)
    d = w.sum(axis=1)
    want = np.sort(np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d))))[::-1][:4]
    assert np.abs(values - want).max() < 1e-6
    rows = {r["cell"]: r["v"] for r in table.collect()}
    assert np.abs(np.abs([rows[c][0] for c in ids]) - np.sqrt(d / d.sum())).max() < 1e-6


def test_few_nodes(spark):
    """Fewer nodes than columns; a node that is only an end; isolated loops."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (9, 9, 2.0)], "src long, dst long, w double")
    ids, w = dense(edges.collect())
    values, table = spectral.embedding(edges, 10)
    assert np.abs(values - by_numpy(w, 4)[0]).max() < 1e-8 and table.count() == 4


def test_query(spark, small):
    """Five clusters of all cells."""
    rows = QUERIES["c3_spectral"](spark, small).collect()
    assert len(rows) == 500 and {r["cluster"] for r in rows} == set(range(5))


def test_vectors_query(spark, small):
    """The query's columns, by the degrees' root, are orthonormal and span numpy's largest eigenvalues."""
    ids, w = dense(graphs.overlaps(spark, small).collect())
    values, _, d = by_numpy(w, 5)
    rows = {r["cell"]: r["v"] for r in QUERIES["c3_spectral_vectors"](spark, small).collect()}
    got = np.array([rows[c] for c in ids]) * np.sqrt(d)[:, None]
    square = (w * w).sum(axis=1)
    a = np.exp(-np.maximum(square[:, None] + square - 2 * w @ w.T, 0)) / np.sqrt(np.outer(d, d))
    assert sorted(rows) == ids and np.abs(got.T @ a @ got - np.diag(values)).max() < 1e-5


def test_nodes_are_sent_to_blocks(spark, monkeypatch):
    """Many small blocks give numpy's pairs and product; pairs stay where they lie, and a node goes to a block once, not to each pair."""
    monkeypatch.setattr(spectral, "ROWS", 16)
    monkeypatch.setattr(spectral, "STEPS", 2000)
    monkeypatch.setattr(spectral, "PIECE", 8)
    edges, _ = planted(spark, [40, 30, 50], 4)
    ids, w = dense(edges.collect())
    pairs, nodes = spectral.row_affinity(edges, 0.5)
    found, at = np.zeros_like(w), {c: i for i, c in enumerate(ids)}
    for r in pairs.collect():
        found[at[r["src"]], at[r["dst"]]] += r["w"]
    square = (w * w).sum(axis=1)
    e = np.exp(-0.5 * square)
    want = np.exp(-0.5 * np.maximum(square[:, None] + square - 2 * w @ w.T, 0)) - np.outer(e, e)
    assert np.abs(found - want).max() < 1e-12
    operator = spectral.Operator(pairs, nodes)
    v = np.random.default_rng(1).normal(size=(len(ids), 3))
    d = (want + np.outer(e, e)).sum(axis=1)
    x = spark.createDataFrame([(c, float(e[i] / np.sqrt(d[i])), v[i].tolist()) for i, c in enumerate(ids)], "cell long, u double, v array<double>")
    product = operator.times(x, (e / np.sqrt(d)) @ v)
    got = {r["cell"]: r["y"] for r in product.collect()}
    assert np.abs([got[c] for c in ids] - ((want + np.outer(e, e)) / np.sqrt(np.outer(d, d))) @ v).max() < 1e-10
    blocks = operator.held.count()
    assert 8 <= blocks and sum(len(r["to"]) for r in operator.nodes.collect()) <= len(ids) * blocks < pairs.count()
    plan = product._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(plan) if "InMemoryTableScan" in line)
    above = max(i for i, line in enumerate(plan[:scan]) if "FlatMapCoGroups" in line)
    assert not any("Exchange" in line or "Shuffle" in line for line in plan[above:scan])
