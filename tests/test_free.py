"""Queries without a twin, each held against plain numpy, brute force or an invariant of its own."""

import pathlib

import numpy as np
import pytest

from stratoloom.operators import cluster, graph, neighbours
from stratoloom.plans.catalogue import ORACLES, QUERIES
from stratoloom.sources import roles


@pytest.fixture(scope="module")
def points(spark, small):
    """Ids and vectors of the embeddings."""
    rows = sorted(roles.embeddings(spark, small).collect(), key=lambda r: r["cell"])
    return np.array([r["cell"] for r in rows]), np.array([r["v"] for r in rows]), np.array([r["gt"] for r in rows])


@pytest.fixture(scope="module")
def counts(spark, small):
    """Cells by features."""
    rows = roles.counts(spark, small).collect()
    cells, features = sorted({r["cell"] for r in rows}), sorted({r["feature"] for r in rows})
    x = np.zeros((len(cells), len(features)))
    for r in rows:
        x[cells.index(r["cell"]), features.index(r["feature"])] = r["x"]
    return cells, features, x


def vectors(spark, small, name):
    """A query's vectors by cell."""
    rows = sorted(QUERIES[name](spark, small).collect(), key=lambda r: r["cell"])
    return [r["cell"] for r in rows], np.array([r["v"] for r in rows])


def same_columns(a, b):
    """Equal columns, whatever their signs."""
    return a.shape == b.shape and all(np.allclose(x, y, atol=1e-6) or np.allclose(x, -y, atol=1e-6) for x, y in zip(a.T, b.T, strict=True))


def components(x, k):
    """The k first principal components."""
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return u[:, :k] * s[:k]


def test_d1_pca(spark, small, points):
    """Singular vectors of the centred matrix."""
    assert same_columns(vectors(spark, small, "d1_pca")[1], components(points[1], 10))


def test_d3_lsi(spark, small, counts):
    """Singular vectors of the weighed matrix, rows as z-scores, the first dropped."""
    x = counts[2]
    tf = x / (x.sum(1, keepdims=True) + 1e-8) * (len(x) / (x.sum(0) + 1e-8))
    w = np.log1p(tf / np.abs(tf).sum(1, keepdims=True) * 1e4)
    _, _, vt = np.linalg.svd(w, full_matrices=False)
    load = vt[:11].T
    k = load.shape[1]
    y = w @ (load * np.sign(load[np.abs(load).argmax(0), np.arange(k)]))
    z = (y - y.mean(1, keepdims=True)) / (1e-8 + y.std(1, ddof=1, keepdims=True))
    cells, got = vectors(spark, small, "d3_lsi")
    assert cells == counts[0] and np.allclose(got, z[:, 1:], atol=1e-5)


def test_d5_correct_batches(spark, small, points):
    """Every point stays, and batches come no further apart than they were."""
    cells, got = vectors(spark, small, "d5_correct_batches")
    batch = points[0] % 3
    gap = lambda v: np.linalg.norm(np.array([v[batch == b].mean(0) for b in range(3)]) - v.mean(0))
    assert cells == points[0].tolist() and np.isfinite(got).all() and gap(got) <= gap(points[1])


def test_d7_rna_vectors(spark, small, counts):
    """Uncorrelated columns of falling variance; the other method gives rows of z-scores before its batches are taken off."""
    cells, got = vectors(spark, small, "d7_rna_vectors")
    cov = np.cov(got.T)
    assert cells == counts[0] and np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-6 * cov.max()) and (np.diff(np.diag(cov)) <= 1e-6 * cov.max()).all()
    cells, got = vectors(spark, small, "d7_rna_vectors_lsi")
    assert cells == counts[0] and got.shape == (len(cells), 8) and np.isfinite(got).all()


def test_d8_adt_vectors(spark, small):
    """Centred log-ratio, z-scores and components, in numpy."""
    rows = roles.adt(spark, small).collect()
    cells, features = sorted({r["cell"] for r in rows}), sorted({r["feature"] for r in rows})
    x = np.zeros((len(cells), len(features)))
    for r in rows:
        x[cells.index(r["cell"]), features.index(r["feature"])] = r["x"]
    x = np.log1p(x / np.exp(np.log1p(x).sum(1, keepdims=True) / len(features)))
    got = vectors(spark, small, "d8_adt_vectors")
    assert got[0] == cells and same_columns(got[1], components((x - x.mean(0)) / x.std(0, ddof=1), 3))


def test_d9_peak_vectors(spark, small, counts):
    """One vector a cell."""
    cells, got = vectors(spark, small, "d9_peak_vectors")
    assert cells == counts[0] and got.shape == (len(cells), 6) and np.isfinite(got).all()


def modularity(spark, small, labels, resolution=1.0):
    """Modularity of a labeling of the evaluation graph."""
    e = roles.embeddings(spark, small)
    edges = graph.symmetric(neighbours.knn(e, e, 20)).where("src <> dst").select("src", "dst").toPandas().to_numpy()
    at = {c: k for k, c in enumerate(sorted(labels))}
    src, dst = (np.array([at[x] for x in col]) for col in edges.T)
    of = np.unique([labels[c] for c in sorted(labels)], return_inverse=True)[1]
    degree = np.bincount(src, minlength=len(at))
    total = np.bincount(of, degree)
    return (of[src] == of[dst]).mean() - resolution * (total**2).sum() / len(src) ** 2, of, src, dst


@pytest.mark.parametrize("name", ["c1_communities", "c2_louvain"])
def test_communities(spark, small, points, name):
    """Better than the labels and than any single move; Leiden's communities hang together."""
    labels = {r["cell"]: r["cluster"] for r in QUERIES[name](spark, small).collect()}
    assert sorted(labels) == points[0].tolist() and all(labels[c] == min(x for x in labels if labels[x] == labels[c]) for c in labels)
    found, of, src, dst = modularity(spark, small, labels)
    assert found > modularity(spark, small, dict(zip(points[0].tolist(), points[2].tolist(), strict=True)))[0]
    links = np.zeros((len(of), of.max() + 1))
    np.add.at(links, (src, of[dst]), 1.0)
    degree = links.sum(1)
    total = np.bincount(of, degree)
    stay = links[np.arange(len(of)), of] - degree * (total[of] - degree) / len(src)
    move = links - degree[:, None] * (total - np.where(np.arange(of.max() + 1) == of[:, None], degree[:, None], 0)) / len(src)
    assert (move.max(1) <= stay + 1e-9).all()
    if name == "c1_communities":
        root = np.arange(len(of))
        for _ in range(len(of)):
            new = root.copy()
            same = of[src] == of[dst]
            np.minimum.at(new, src[same], root[dst[same]])
            if (new == root).all():
                break
            root = new
        assert all(len(set(root[of == c])) == 1 for c in range(of.max() + 1))


@pytest.mark.parametrize(("name", "wanted"), [("c6_communities_wanted", 8), ("c9_clustering", 8)])
def test_wanted_communities(spark, small, points, name, wanted):
    """So many as asked for, over all points."""
    labels = {r["cell"]: r["cluster"] for r in QUERIES[name](spark, small).collect()}
    assert sorted(labels) == points[0].tolist() and len(set(labels.values())) == wanted


@pytest.mark.parametrize(("name", "most"), [("c3_spectral", 5), ("c4_kmeans", 10), ("c5_mixture", 5), ("c7_bisected_resolution", 500), ("c10_clusters_of", 10)])
def test_clusters(spark, small, points, name, most):
    """All points, in no more clusters than asked for; k-means leaves each at its nearest mean."""
    labels = {r["cell"]: r["cluster"] for r in QUERIES[name](spark, small).collect()}
    of = np.array([labels[c] for c in points[0].tolist()])
    assert len(labels) == len(points[0]) and 1 < len(set(of.tolist())) <= most
    if name == "c4_kmeans":
        mean = np.array([points[1][of == c].mean(0) for c in range(10)])
        near = ((points[1][:, None] - mean) ** 2).sum(-1)
        assert (near.argmin(1) == of).mean() > 0.98
    if name == "c7_bisected_resolution":
        assert abs(len(set(of.tolist())) - 8) <= 2


def test_c11_split_and_merge(spark, small, points):
    """Each point is with the nearest of the new centroids."""
    from stratoloom.operators import recipes

    places = roles.coordinates(roles.embeddings(spark, small)).select("cell", "v")
    centroids, found = recipes.split_and_merge(places, 4, 2)
    c = np.array([r["c"] for r in centroids.orderBy("cluster").collect()])
    got = {r["cell"]: r["cluster"] for r in found.collect()}
    near = ((points[1][:, None, :2] - c) ** 2).sum(-1).argmin(1)
    assert [got[x] for x in points[0].tolist()] == near.tolist()
    assert {(r["cell"], r["cluster"]) for r in QUERIES["c11_split_and_merge"](spark, small).collect()} == set(got.items())


def test_c13_c14_thresholds(spark, small):
    """A threshold of 0.3 at least; a background below its signal for every feature."""
    assert QUERIES["c13_change_threshold"](spark, small).first()["delta"] >= 0.3
    rows = QUERIES["c14_background_means"](spark, small).collect()
    seen = {r["feature"]: r for r in roles.adt(spark, small).groupBy("feature").agg({"x": "avg"}).collect()}
    assert {r["feature"] for r in rows} == set(seen)
    for r in rows:
        assert 0 < r["background"] <= np.log1p(seen[r["feature"]]["avg(x)"]) + 0.2 and r["background"] <= r["signal"]


@pytest.mark.parametrize(("name", "exact"), [("j8_approximate_knn", (None, None)), ("j10_approximate_unit_knn", (0, 1))])
def test_approximate(spark, small, points, name, exact):
    """Ten neighbours a point, nine tenths of them true ones."""
    ids, v, _ = points
    if exact[0] is not None:
        v = v[:, :32] / np.linalg.norm(v[:, :32], axis=1, keepdims=True)
    left = np.ones(len(ids), bool) if exact[0] is None else ids % 3 == 0
    right = np.ones(len(ids), bool) if exact[0] is None else ids % 3 != 0
    d = ((v[left][:, None] - v[right][None]) ** 2).sum(-1)
    true = {(int(i), int(j)) for i, row in zip(ids[left], d, strict=True) for j in ids[right][np.argsort(row, kind="stable")[:10]]}
    got = {(r["src"], r["dst"]) for r in QUERIES[name](spark, small).collect()}
    assert len(got) == len(true) and len(got & true) >= 0.9 * len(true)


def test_m17_best_information(spark, small):
    """No less than at the resolution of 1, no more than 1."""
    from stratoloom.operators import label_metrics

    e = roles.embeddings(spark, small)
    at_one = QUERIES["c1_communities"](spark, small).join(e.select("cell", "gt"), "cell")
    one = label_metrics.information_metrics(label_metrics.contingency(at_one, "cluster", "gt")).first()["nmi"]
    assert one - 1e-9 <= QUERIES["m17_best_information"](spark, small).first()["nmi"] <= 1


def test_t2_linear_surrogate(spark, small, points):
    """Two steps over the normalised graph of places, in numpy."""
    cells, got = vectors(spark, small, "t2_linear_surrogate")
    ids, v, _ = points
    d = ((v[:, None, :2] - v[None, :, :2]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    a = np.eye(len(ids))
    for i, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :3]):
        a[i, near] = a[near, i] = 1
    degree = a.sum(1)
    step = a / np.sqrt(np.outer(degree, degree))
    assert cells == ids.tolist() and np.allclose(got, step @ step @ (v[:, :32] + v[:, 32:]) / 2, atol=1e-6)


def test_none_left():
    """Every query has a twin or a test in this folder that names it."""
    here = "".join(p.read_text() for p in pathlib.Path(__file__).parent.glob("*.py"))
    assert not [n for n in set(QUERIES) - set(ORACLES) if f'"{n}"' not in here]


def test_large_graphs(spark, monkeypatch):
    """Joins and one task's numpy follow one rule: the same labels, also where only the first levels are joins, at several resolutions at once."""
    rng = np.random.default_rng(5)
    of = rng.integers(0, 3, 36)
    near = np.triu(rng.random((36, 36)) < np.where(of[:, None] == of, 0.5, 0.03), 1)
    src, dst = np.nonzero(near)
    w = rng.integers(1, 4, len(src)) / 3.0
    rows = [(int(a) * 1000003, int(b) * 1000003, float(x)) for a, b, x in zip(src, dst, w, strict=True)]
    edges = spark.createDataFrame(rows + [(b, a, x) for a, b, x in rows] + [(1000003, 1000003, 5.0)], "src long, dst long, w double")
    labels = lambda: {(r["resolution"], r["cell"]): r["cluster"] for r in cluster.communities_at(edges, [0.6, 1.0]).collect()}
    whole = labels()
    monkeypatch.setattr(cluster, "HELD", 20)
    assert labels() == whole and len(whole) == 2 * len(set(src) | set(dst))
    found = spark.createDataFrame([(c, x) for (r, c), x in whole.items() if r == 1.0], "cell long, cluster long")
    assert cluster.modularity(edges.where("src <> dst"), found).first()[0] > 0.3
    assert cluster.communities(edges.limit(0)).count() == 0


def test_tied_mixture(spark):
    """Components of one long shape are told apart where spheres are not; a singular covariance is an error, and k-means then does."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 2)) @ np.array([[6.0, 6.0], [0.1, -0.1]]) + np.where(np.arange(300) % 2, 1.2, -1.2)[:, None] * np.array([1.0, -1.0])
    points = spark.createDataFrame([(k, x[k].tolist()) for k in range(300)], "cell long, v array<double>")
    got = {r["cell"]: r["cluster"] for r in cluster.mixture(points, 2).collect()}
    share = np.mean([got[k] == got[1] for k in range(1, 300, 2)]) - np.mean([got[k] == got[1] for k in range(0, 300, 2)])
    assert share > 0.95
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(20)], "cell long, v array<double>")
    with pytest.raises(np.linalg.LinAlgError):
        cluster.mixture(flat, 2)
    assert cluster.clusters_of(flat, 2, "mixture").count() == 20


def test_batches_meet(spark):
    """Two shifted copies of three groups are brought together, groups stay apart."""
    from stratoloom.operators import reduce

    rng = np.random.default_rng(7)
    group, batch = np.arange(360) % 3, (np.arange(360) // 3) % 2
    centre = np.array([[6.0, 0, 0, 1], [0, 6, 0, 1], [0, 0, 6, 1]])
    v = centre[group] + rng.standard_normal((360, 4)) * 0.3 + batch[:, None] * np.array([0.0, 0, 0, 4])
    df = spark.createDataFrame([(k, v[k].tolist(), f"b{batch[k]}") for k in range(360)], "cell long, v array<double>, batch string")
    rows = reduce.correct_batches(df, clusters=6).orderBy("cell").collect()
    z = np.array([r["v"] for r in rows])
    gap = lambda x: max(np.linalg.norm(x[(group == g) & (batch == 0)].mean(0) - x[(group == g) & (batch == 1)].mean(0)) for g in range(3))
    apart = min(np.linalg.norm(z[group == a].mean(0) - z[group == b].mean(0)) for a in range(3) for b in range(a))
    assert gap(z) < 0.3 * gap(v) and apart > 5
    alone = reduce.correct_batches(df.where("batch = 'b0'"))
    assert {(r["cell"], tuple(r["v"])) for r in alone.collect()} == {(k, tuple(v[k].tolist())) for k in range(360) if batch[k] == 0}


def test_split_and_merge_planted(spark):
    """One part that covers two far clusters is split; two parts of one cluster merge."""
    from stratoloom.operators import recipes

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((80, 2)) * 0.2 + c for c in ([0, 0], [9, 0], [0, 9])])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cell long, v array<double>")
    for k in (2, 3, 5):
        centroids, found = recipes.split_and_merge(points, k, 2, scale=0.05)
        got = np.array([r["cluster"] for r in found.orderBy("cell").collect()])
        assert all(len(set(got[80 * g : 80 * g + 80])) == 1 for g in range(3)) or k == 5
        assert k == 5 or centroids.count() == 3


def test_empty_cluster_covariance(spark):
    """A cluster without points has a small diagonal; others are numpy's."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((50, 3))
    points = spark.createDataFrame([(k, x[k].tolist(), k % 2) for k in range(50)], "cell long, v array<double>, label int")
    got = {(r["cluster"], r["i"], r["j"]): r["cov"] for r in cluster.covariances(points, "label", 3, [0, 1, 2]).collect()}
    assert len(got) == 27 and all(got[2, i, j] == (0.0005 if i == j else 0.0) for i in range(3) for j in range(3))
    for c in (0, 1):
        want = np.cov(x[np.arange(50) % 2 == c].T, bias=True)
        assert all(got[c, i, j] == pytest.approx(want[i, j]) for i in range(3) for j in range(3))
    with pytest.raises(Exception, match="a vector of 4 numbers"):
        cluster.centroids(points, "label", 4).collect()
