"""Cases small enough to work out by hand."""

import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stratoloom.functions.statistics import chi2_critical, chi2_tail, signed_rank_tail
from stratoloom.operators import align, cluster, graph, label_metrics, mixing_metrics, neighbours, prep, reduce
from stratoloom.operators.components import connected_components
from stratoloom.operators.running import quantile, running_sum
from stratoloom.plans.catalogue import QUERIES
from stratoloom.sources import roles


def table(spark, clusters, labels):
    """A contingency table."""
    return label_metrics.contingency(spark.createDataFrame(list(zip(clusters, labels, strict=True)), "cluster int, label int"))


@pytest.mark.parametrize(("clusters", "tp", "fp", "fn", "tn"), [([0, 0, 1, 1], 2, 0, 0, 4), ([0, 0, 0, 0], 2, 4, 0, 0), ([0, 1, 2, 3], 0, 0, 2, 4)])
def test_pairs(spark, clusters, tp, fp, fn, tn):
    """Perfect agreement, one big cluster, all singletons."""
    r = label_metrics.pair_counts(table(spark, clusters, [0, 0, 1, 1])).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)


def test_pair_metrics(spark):
    """Undefined precision is null; perfect agreement is 1."""
    one = label_metrics.pair_metrics(table(spark, [0, 0, 0, 0], [0, 0, 1, 1])).first()
    assert one["precision"] == pytest.approx(1 / 3) and one["recall"] == 1 and one["jaccard"] == pytest.approx(1 / 3) and one["dice"] == 0.5
    assert label_metrics.pair_metrics(table(spark, [0, 1, 2, 3], [0, 0, 1, 1])).first()["precision"] is None
    best = label_metrics.pair_metrics(table(spark, [5, 5, 7, 7], [0, 0, 1, 1])).first()
    assert best["ari"] == best["fmi"] == best["f_measure"] == 1


def test_assignment(spark):
    """The matching beats any other, by permutations, above and below the size where the method changes."""
    rng = np.random.default_rng(1)
    for k in (3, 9):
        clusters, labels = rng.integers(0, k, 300), rng.integers(0, k, 300)
        t = table(spark, clusters.tolist(), labels.tolist())
        got = label_metrics.cluster_accuracy(t).first()[0]
        counts = np.zeros((k, k))
        np.add.at(counts, (clusters, labels), 1)
        best = {0: 0.0}
        for i in range(k):
            best = step(best, counts[i], k)
        assert got == pytest.approx(max(best.values()) / 300)


def step(best, row, k):
    """One more row assigned, over sets of used columns."""
    out = {}
    for used, total in best.items():
        for j in range(k):
            if not used >> j & 1:
                out[used | 1 << j] = max(out.get(used | 1 << j, -1), total + row[j])
    return out


def test_isolated(spark):
    """Labels in the fewest batches; none if every label is in all."""
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("C", 2)], "label string, batch int")
    assert sorted(r[0] for r in label_metrics.isolated_labels(rows).collect()) == ["B", "C"]
    assert label_metrics.isolated_labels(rows.where("label = 'A'")).count() == 0


def test_lisi(spark):
    """20 neighbours split in half have a LISI of 2; one batch alone 1."""
    edges = spark.createDataFrame([(0, j) for j in range(20)], "src long, dst long")
    for labels, want in (([j % 2 for j in range(20)], 2), ([0] * 20, 1)):
        cells = spark.createDataFrame(list(enumerate(labels)), "cell long, label int")
        assert mixing_metrics.lisi(edges, cells).first()["lisi"] == pytest.approx(want)


def test_chi2(spark):
    """15 to 5 is rejected, 14 to 6 isn't."""
    cells = spark.createDataFrame([(j, j % 2) for j in range(40)], "cell long, batch int")
    for odd, chi2 in ((15, 5.0), (14, 3.2)):
        edges = spark.createDataFrame([(0, 2 * j + 1) for j in range(odd)] + [(0, 2 * j) for j in range(20 - odd)], "src long, dst long")
        assert mixing_metrics.batch_tests(edges, cells).first()["chi2"] == pytest.approx(chi2)
    for dof, want in ((1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251179), (4, 9.487729036781154)):
        assert chi2_critical(dof) == pytest.approx(want, abs=1e-9)
    assert chi2_tail(0, 3) == 1


def test_normalisation(spark):
    """Both centred log-ratios and the first TF-IDF, by hand."""
    row = spark.createDataFrame([(0, 0, 1.0), (0, 2, 3.0)], "cell long, feature long, x double")
    assert [r["x"] for r in prep.clr_all(row, 3).orderBy("feature").collect()] == pytest.approx([0.405465, 0.916291], abs=1e-6)
    row = spark.createDataFrame([(0, 0, 1.0), (0, 2, 4.0)], "cell long, feature long, x double")
    assert [r["x"] for r in prep.clr_present(row).orderBy("feature").collect()] == pytest.approx([math.log(0.5), math.log(2)])
    two = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 2.0)], "cell long, feature long, x double")
    assert [r["x"] for r in prep.tfidf(two, 2).orderBy("cell", "feature").collect()] == pytest.approx([1, 1 / 3, 2 / 3])


def test_intervals(spark):
    """Touching intervals merge; containment is of whole keys."""
    rows = spark.createDataFrame([("a", 1, 5), ("a", 4, 9), ("a", 20, 30), ("b", 1, 5), ("b", 5, 6)], "seqname string, start long, end long")
    assert sorted(tuple(r)[:3] for r in align.merge_intervals(rows).collect()) == [("a", 1, 9), ("a", 20, 30), ("b", 1, 6)]
    query = spark.createDataFrame([("a", 1, 9)], "seqname string, start long, end long")
    keys = spark.createDataFrame([("a", 1, 5), ("a", 4, 9), ("a", 8, 12)], "seqname string, start long, end long")
    assert sorted((r["start"], r["end"]) for r in align.contained(query, keys, width=4).collect()) == [(1, 5), (4, 9)]


def test_regions(spark):
    """Both region formats."""
    df = spark.createDataFrame([("chr1:10-20", "chr1_un_10_20")], "a string, b string")
    r = df.select(align.parse_region(df["a"]).alias("a"), align.parse_region(df["b"], ("_", "_")).alias("b")).first()
    assert tuple(r["a"]) == ("chr1", 10, 20) and tuple(r["b"]) == ("chr1_un", 10, 20)


def test_knn_paths_agree(spark, monkeypatch):
    """Block by block gives what one broadcast gives, ties and duplicates included."""
    rng = np.random.default_rng(2)
    v = rng.integers(0, 3, (120, 4)).astype(float)
    points = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(120)], "cell long, v array<double>, grp int")
    for metric, groups, itself in (("euclidean", None, True), ("manhattan", "same", False), ("cosine", "other", True)):
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 1 << 26)
        whole = sorted(map(tuple, neighbours.knn(points, points, 7, metric, itself, groups).collect()))
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(neighbours, "BLOCK", 32)
        parts = sorted(map(tuple, neighbours.knn(points, points, 7, metric, itself, groups).collect()))
        assert whole == parts
        if groups is None:
            d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
            want = sorted((i, int(j)) for i in range(120) for j in np.lexsort((np.arange(120), d[i]))[:7])
            assert sorted((r[0], r[1]) for r in whole) == want


def test_approximate_knn(spark):
    """Most of the true neighbours are found, and none that isn't one of the points within reach."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((150, 6))
    points = spark.createDataFrame([(i, v[i].tolist()) for i in range(150)], "cell long, v array<double>")
    exact = {(r["src"], r["dst"]) for r in neighbours.knn(points, points, 5).collect()}
    found = {(r["src"], r["dst"]) for r in neighbours.approximate_knn(points, points, 5, 10.0, 2.0).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_approximate_knn_registered(spark, size):
    """With the query's own parameters every point of the embeddings has 10 neighbours, 0.9 of them true ones."""
    points = roles.embeddings(spark, f"{DATA}/{size}")
    exact = {(r["src"], r["dst"]) for r in neighbours.knn(points, points, 10).collect()}
    rows = QUERIES["j8_approximate_knn"](spark, f"{DATA}/{size}").collect()
    assert len(rows) == len(exact) == 10 * points.count() and {r["place"] for r in rows} == set(range(1, 11))
    assert len({(r["src"], r["dst"]) for r in rows} & exact) >= 0.9 * len(exact)


def test_approximate_knn_sparse(spark):
    """Neighbours beyond the reach, and buckets that miss, are made up for."""
    v = np.random.default_rng(9).standard_normal((150, 6))
    points = spark.createDataFrame([(i, v[i].tolist()) for i in range(150)], "cell long, v array<double>")
    exact = {(r["src"], r["dst"]) for r in neighbours.knn(points, points, 5).collect()}
    for reach, bucket in ((0.1, 2.0), (100.0, 0.1)):
        found = {(r["src"], r["dst"]) for r in neighbours.approximate_knn(points, points, 5, reach, bucket).collect()}
        assert len(found) == 750 and len(found & exact) >= 0.9 * len(exact)


def test_votes_and_components(spark):
    """The smallest of tied labels wins; components carry their smallest node."""
    edges = spark.createDataFrame([(9, j) for j in range(5)], "src long, dst long")
    labels = spark.createDataFrame(list(enumerate([2, 1, 1, 2, 3])), "cell long, label int")
    assert neighbours.vote(edges, labels).first()["label"] == 1
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 400)]
    root = {n: n for p in pairs for n in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: root[n] for a, b in pairs if a != b for n in (a, b)}


def test_running_sum(spark):
    """Null keys are a group, and buckets change nothing."""
    rows = [(None if i % 3 == 0 else i % 3, i, i * 7 % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, i int, x long").selectExpr("*", "i div 8 AS bucket")
    want, at = {}, {}
    for g, i, x in rows:
        want[i] = at.get(g, 0)
        at[g] = want[i] + x
    assert {r["i"]: r["before"] for r in running_sum(df, ["g"], "bucket", [df["i"]], df["x"], "before").collect()} == want


def test_pca_and_lsi(spark):
    """Components keep the variance; LSI rows have z-scores."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5)) * [5, 3, 1, 0.5, 0.1]
    scores, load = reduce.pca(spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "cell long, v array<double>"), 2)
    got = np.stack([r["v"] for r in scores.orderBy("cell").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2])) and load.shape == (5, 2)
    counts = spark.createDataFrame([(i, j, float((i * j) % 7 + 1)) for i in range(30) for j in range(12) if (i + j) % 3], "cell long, feature long, x double")
    rows = reduce.Lsi(4, drop_first=False).fit(counts, 30).transform(counts).collect()
    assert len(rows) == 30 and all(abs(sum(r["v"])) < 1e-9 for r in rows)


def test_communities(spark):
    """Two cliques joined by one edge come apart."""
    e = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(base, base + 6) if a != b] + [(0, 10), (10, 0)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, w double")
    got = {r["cell"]: r["cluster"] for r in cluster.communities(edges).collect()}
    assert len({got[k] for k in range(6)}) == 1 and len({got[k] for k in range(10, 16)}) == 1 and got[1] != got[11]


def test_communities_wanted(spark):
    """The wanted number of clusters is met; a number that no resolution gives is an error."""
    pair = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    assert cluster.communities_of(pair, 2, step=1.5).select("cluster").distinct().count() == 2
    with pytest.raises(ValueError, match="gives 1 clusters"):
        cluster.communities_of(pair, 1, step=1.5)


def test_signed_rank():
    """Exact tails of the signed-rank statistic."""
    assert signed_rank_tail(6, 3) == 1 / 8 and signed_rank_tail(0, 3) == 1


def test_lsi_flags(spark):
    """Each step can be left out, as in numpy; fitted vectors apply to other cells."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 4, (40, 15)).astype(float) + np.eye(40, 15)
    rows = [(i, j, float(x[i, j])) for i in range(40) for j in range(15) if x[i, j]]
    counts = spark.createDataFrame(rows, "cell long, feature long, x double")
    for log, norm, tfidf, z, drop in ((True, True, True, True, True), (False, True, False, False, False), (True, False, False, True, False), (False, False, True, False, True)):
        w = x / (x.sum(1, keepdims=True) + 1e-8) * (40 / (x.sum(0) + 1e-8)) if tfidf else x
        w = w / np.abs(w).sum(1, keepdims=True) if norm else w
        w = np.log1p(w * 1e4) if log else w
        load = np.linalg.svd(w, full_matrices=False)[2][: 3 + drop].T
        y = w @ (load * np.sign(load[np.abs(load).argmax(0), np.arange(3 + drop)]))
        y = (y - y.mean(1, keepdims=True)) / (1e-8 + y.std(1, ddof=1, keepdims=True)) if z else y
        model = reduce.Lsi(3, drop_first=drop, log=log, norm=norm, z_score=z, tfidf=tfidf).fit(counts, 40)
        got = {r["cell"]: r["v"] for r in model.transform(counts.where("cell < 10")).collect()}
        assert len(got) == 10 and all(np.allclose(got[i], y[i, drop:], atol=1e-5) for i in range(10))
    raw = reduce.Lsi(3, tfidf=False, norm=False, log=False, svd=False).transform(counts)
    assert sorted(map(tuple, raw.collect())) == sorted(rows)
    with pytest.raises(RuntimeError):
        reduce.Lsi(3, tfidf=False).transform(counts)


def test_local_fit():
    """A parabola is its own fit; between vertices lines are read off."""
    u = np.sort(np.random.default_rng(12).random(500))
    assert np.allclose(prep.local_fit(u, 2 - u + 3 * u * u), 2 - u + 3 * u * u)
    assert np.abs(prep.local_fit(u, np.sin(3 * u), vertices=50) - prep.local_fit(u, np.sin(3 * u))).max() < 0.01
    assert np.allclose(prep.local_fit(np.ones(5), np.arange(5.0), span=1.0), 2)


def test_refusals(spark):
    """Counts that aren't whole, names that none share, vectors of another length."""
    half = spark.createDataFrame([(1, 1, 0.5)], "cell long, feature long, x double")
    with pytest.raises(ValueError, match="whole"):
        prep.check_whole(half)
    with pytest.raises(ValueError, match="shared"):
        align.shared_names([half, half.withColumn("feature", half["feature"] + 1)], required=True)
    v = spark.createDataFrame([(1, [1.0, 2.0])], "cell long, v array<double>")
    assert graph.merged_vectors([v, v], 2, concat=True).first()["v"] == [1.0, 2.0, 1.0, 2.0]
    with pytest.raises(Exception, match="a vector of 3 numbers"):
        graph.merged_vectors([v, v], 3).collect()


def test_islands_across_bins(spark, monkeypatch):
    """Intervals that reach over bins, and bins over bins, are one."""
    monkeypatch.setattr(align, "BIN", 10)
    rng = np.random.default_rng(13)
    rows = [("a", int(s), int(s + rng.choice([1, 3, 45]))) for s in rng.integers(0, 900, 120)] + [("b", 5, 400), ("b", 100, 101), ("b", 399, 500), ("b", 500, 501), ("b", 502, 503)]
    got = sorted(map(tuple, align.merge_intervals(spark.createDataFrame(rows, "seqname string, start long, end long")).select("seqname", "start", "end", "n").collect()))
    want = []
    for name, s, e in sorted(rows):
        if want and want[-1][0] == name and s < want[-1][2] + 1:
            want[-1] = (name, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((name, s, e, 1))
    assert got == want


def test_numbered(spark):
    """Places along an order of all rows, nulls last."""
    from stratoloom.operators.running import numbered

    names = ["b", "a", None, "é", "B", "ab"]
    got = numbered(spark.createDataFrame([(n,) for n in names], "n string").repartition(4), [F.col("n").asc_nulls_last()], "p")
    assert {r["p"]: r["n"] for r in got.collect()} == dict(enumerate(["B", "a", "ab", "b", "é", None]))


def test_checkpoints(spark, tmp_path):
    """What is released is gone; what was made of it stays."""
    from stratoloom.lineage import cut, release

    a = cut(spark.range(10))
    b = cut(a.where("id > 4"))
    release(a)
    assert b.count() == 5


def test_pseudo_bulk_subsets(spark):
    """With too few labels, means of parts of their cells are added; parts depend on ids alone."""
    counts = spark.createDataFrame([(c, f, float(c % 7 + f)) for c in range(40) for f in range(3)], "cell long, feature long, x double")
    labels = spark.createDataFrame([(c, "ab"[c % 2]) for c in range(40)], "cell long, label string")
    got = {(r["sample"], r["feature"]): r["x"] for r in prep.pseudo_bulk(counts, labels, 5).collect()}
    assert {s for s, _ in got} == {"a", "b", "a_0", "a_1", "a_2", "b_0", "b_1", "b_2"}
    assert got["a", 1] == pytest.approx(np.mean([c % 7 + 1 for c in range(0, 40, 2)])) and got["a_0", 1] != got["a_1", 1]
    assert got == {(r["sample"], r["feature"]): r["x"] for r in prep.pseudo_bulk(counts, labels.repartition(7), 5).collect()}


def test_hubs(spark):
    """A point that is everybody's neighbour changes no overlap, whichever way it is counted."""
    dice = np.random.default_rng(14)
    near = {i: sorted({0, i, *map(int, dice.integers(1, 60, 5))}) for i in range(60)}
    edges = spark.createDataFrame([(i, j) for i, js in near.items() for j in js], "src long, dst long")
    shared = {(a, b): len(set(near[a]) & set(near[b])) for a in near for b in near}
    got = {(r["src"], r["dst"]): r["w"] for r in neighbours.shared_neighbours(edges).collect()}
    assert got == {(a, b): w for (a, b), w in shared.items() if a != b and b in near[a] and a in near[b]}
    for prune in (0.0, 0.1, 0.3):
        got = {(r["src"], r["dst"]): r["w"] for r in neighbours.jaccard_neighbours(edges, 7, prune).collect()}
        assert got == pytest.approx({p: w / (14 - w) for p, w in shared.items() if w and w / (14 - w) >= prune})


def test_unit_length(spark):
    """A zero vector stays as it is."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(graph.unit_length(df["v"])).collect()] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("values", [[], [None, None], [3.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0, None], [float(k * k % 101) for k in range(200)]])
@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantile(spark, values, share):
    """The same numbers as the built-in percentile, which holds every different one in one task."""
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    assert quantile(df, "x", share, "q").collect() == df.agg(F.percentile("x", F.lit(share)).alias("q")).collect()
