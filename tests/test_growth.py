"""What a step makes or holds doesn't grow faster than its input."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratoloom.operators import cluster, geometry_metrics, graph, neighbours, prep, reduce
from stratoloom.operators.neighbours import Held, distances


def test_edges_are_made_once(spark):
    """Symmetric edges, and their modularity, read the neighbours once."""
    made = spark.range(60).selectExpr("id as src", "(id * 7 + 1) % 60 as dst").mapInPandas(lambda b: b, "src long, dst long")
    both = graph.symmetric(made)
    labels = spark.range(60).selectExpr("id as cell", "id % 4 as cluster")
    found = cluster.modularity(both.withColumn("w", F.lit(1.0)), labels, 0.5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    pairs = {(i, (i * 7 + 1) % 60) for i in range(60)}
    pairs |= {(b, a) for a, b in pairs}
    assert sorted(map(tuple, both.collect())) == sorted(pairs)
    inner, m2 = sum(a % 4 == b % 4 for a, b in pairs), len(pairs)
    dd = sum(sum(a % 4 == c for a, _ in pairs) ** 2 for c in range(4))
    assert abs(found.first()[0] - (inner / m2 - 0.5 * dd / m2**2)) < 1e-12


def test_groups_are_compared_apart(monkeypatch):
    """Neighbours within groups: no distance across groups is taken, and the pairs are those of all compared."""
    dice = np.random.default_rng(5)
    v, grp, ids = np.round(dice.normal(size=(3000, 16)), 1), np.arange(3000) % 5, dice.permutation(3000)
    taken, rough = [0], Held.rough

    def counted(self, q, low, high, *rest):
        taken[0] += len(q) * (high - low)
        return rough(self, q, low, high, *rest)

    monkeypatch.setattr(Held, "rough", counted)
    found = [f for f in neighbours._nearest(ids[:300], v[:300], grp[:300], Held(ids, v, grp, "euclidean"), 6, False, "same")]
    assert taken[0] <= 300 * 600
    d = distances(v[:300], v, "euclidean")
    d[(grp[:300, None] != grp) | (ids[:300, None] == ids)] = np.inf
    want = {(ids[i], ids[j], d[i, j], p + 1) for i in range(300) for p, j in enumerate(np.lexsort((ids, d[i]))[:6])}
    assert {(s, t, x, p) for f in found for s, t, x, p in f.itertuples(index=False)} == want


def test_few_strips_are_looked_through():
    """Numbers up to a limit are found by the strips' least ones, those behind the last whole strip among them; the array that is given is used."""
    dice = np.random.default_rng(6)
    d = dice.normal(size=(20, 5000)).astype(np.float32)
    least, kth = neighbours._least(d, 9)
    assert least.shape == (20, 512) and ((d <= kth[:, None]).sum(axis=1) >= 9).all()
    rows, cols = neighbours._within(d, least, kth)
    assert sorted(zip(rows, cols, strict=True)) == sorted(zip(*np.nonzero(d <= kth[:, None]), strict=True))
    v, room = dice.normal(size=(700, 8)), np.empty(20 * 700, np.float32)
    assert np.shares_memory(Held(np.arange(700), v, None, "euclidean").rough(v[:20], 0, 700, np.float32, room)[0], room)


def test_local_fit_by_moments(monkeypatch):
    """Beyond the vertices few fits go through their points, and the values are those of fits that do."""
    dice = np.random.default_rng(7)
    u = np.concatenate([np.round(dice.gamma(2, 1, 6000), 2), dice.gamma(2, 1, 6000)])
    w = np.sin(u) + 0.1 * u * u + dice.normal(size=len(u))
    seen, fit = [0], np.linalg.lstsq

    def counted(*args, **named):
        seen[0] += 1
        return fit(*args, **named)

    monkeypatch.setattr(np.linalg, "lstsq", counted)
    found = prep.local_fit(u, w, vertices=200)
    assert seen[0] == 0
    order = np.lexsort((w, u))
    x, y, many = u[order], w[order], int(len(u) * 0.3 + 1e-5)
    at, values = x[np.linspace(0, len(u) - 1, 200).round().astype(int)], []
    for p in at:
        low = next(i for i in range(len(x) - many + 1) if i == len(x) - many or x[i + many] - p >= p - x[i])
        d = x[low : low + many] - p
        root = np.sqrt((1 - (np.abs(d) / np.abs(d).max()) ** 3) ** 3)
        values.append(fit(np.stack([root, root * d, root * d * d], axis=1), y[low : low + many] * root, rcond=None)[0][0])
    places = np.unique(at, return_index=True)[1]
    assert np.abs(found - np.interp(u, at[places], np.array(values)[places])).max() < 1e-8


def test_batches_are_ranked_together(spark):
    """Features by batch: the rows are read as often with five batches as with two, and ranked as batch by batch."""
    counts = spark.range(6000).selectExpr("id % 50 as cell", "pmod(hash(id), 40) as feature", "cast(pmod(hash(id, 7), 9) + 1 as double) as x").groupBy("cell", "feature").agg(F.sum("x").alias("x"))
    cells = lambda n: spark.range(50).selectExpr("id as cell", f"id % {n} as batch")
    reads = lambda n: prep.features_by_batch(counts, cells(n), 12)._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6000")
    assert reads(5) == reads(2)
    ranks = {}
    for b in range(5):
        own = cells(5).where(F.col("batch") == b)
        for r in prep.stabilised_features(prep.keep_cells(counts, own), 12, 10).where("chosen").collect():
            ranks.setdefault(r["feature"], []).append(r["place"])
    found = {r["feature"]: (r["batches"], r["rank"]) for r in prep.features_by_batch(counts, cells(5), 12).collect()}
    assert found == {f: (len(p), float(np.median(p))) for f, p in ranks.items()}


def test_effects_are_taken_off_by_products():
    """Batch effects of 3,000 points in 60 clusters: a few copies of the vectors are held, and the rest is the same."""
    dice = np.random.default_rng(8)
    v, part, effect, batch = dice.normal(size=(3000, 32)), dice.random((3000, 60)), dice.normal(size=(60, 3, 32)), np.arange(3000) % 3
    tracemalloc.start()
    found = reduce._taken_off(v, part, effect, batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * v.nbytes
    want = v - np.array([part[i] @ effect[:, batch[i]] for i in range(len(v))])
    assert np.abs(found - want).max() < 1e-12


def test_samples_share_their_neighbours(spark, monkeypatch):
    """Alignment of four samples: all points meet all once, the others are those few with too few neighbours in a sample; the score stays."""
    dice = np.random.default_rng(9)
    rows = [(int(i), dice.normal(size=3).tolist(), int(i % 3)) for i in range(150)] + [(int(i), dice.normal(size=3).tolist(), 0) for i in range(150, 190)]
    points = spark.createDataFrame(rows, "cell long, v array<double>, batch int")
    compared, knn = [], geometry_metrics.knn

    def counted(left, right, *rest, **named):
        compared.append(left.count())
        return knn(left, right, *rest, **named)

    monkeypatch.setattr(geometry_metrics, "knn", counted)
    found = geometry_metrics.alignment_score(points, 5).first()[0]
    assert compared[0] == 190 and len(compared) <= 5 and sum(compared[1:]) < 150
    compared.clear()
    monkeypatch.setattr(geometry_metrics, "SPARE", 0)
    assert abs(found - geometry_metrics.alignment_score(points, 5).first()[0]) < 1e-12
    assert compared == [150] * 4


def test_edges_stay_in_blocks(spark, monkeypatch):
    """A round of moves sends a node to a block once and moves no edge; several blocks propose what one does."""
    dice = np.random.default_rng(10)
    src, dst = dice.integers(0, 60, 900), dice.integers(0, 60, 900)
    pairs = sorted({(int(a), int(b)) for a, b in zip(src, dst, strict=True) if a != b} | {(int(b), int(a)) for a, b in zip(src, dst, strict=True) if a != b})
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double").cache()
    degree = edges.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("k"))
    now = degree.selectExpr("1.0D AS r", "cell", "k", "cell % 30 AS cluster", "0L AS home").cache()
    found = {}
    for size in (1 << 17, 200):
        monkeypatch.setattr(cluster, "BLOCK", size)
        blocks = cluster.Blocks(edges, 1)
        proposals = blocks.proposals(now, float(len(pairs)), False)
        plan = proposals._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 2 and sum(len(r["to"]) for r in blocks.to.collect()) <= 60 * blocks.held.count()
        found[size] = sorted(map(tuple, proposals.collect())), blocks.held.count()
    assert found[200][0] == found[1 << 17][0] and found[200][1] > 4
    near, label = {}, {a: a % 30 for a, _ in pairs}
    for a, b in pairs:
        near.setdefault(a, []).append(label[b])
    size = {c: sum(len(near[a]) for a in near if label[a] == c) for c in set(label.values())}
    want = []
    for a, seen in near.items():
        gain = lambda c: seen.count(c) - len(seen) / len(pairs) * (size[c] - (len(seen) if c == label[a] else 0))  # noqa: B023, E731
        best = max((c for c in set(seen) if c != label[a]), key=lambda c: (gain(c), -c))
        if gain(best) - gain(label[a]) > 1e-9:
            want.append((a, best))
    assert [(p[1], p[4]) for p in found[200][0]] == sorted(want)


def test_counts_stay_in_blocks(spark, monkeypatch):
    """Sums over counts by either end: vectors go once to a block, features' to one, and the sums are numpy's."""
    monkeypatch.setattr(reduce, "BLOCK", 1600)
    dice = np.random.default_rng(11)
    x = dice.integers(1, 9, (20, 90)) * (dice.random((20, 90)) < 0.7)
    rows = [(int(i), f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    blocks = reduce.Blocks(spark.createDataFrame(rows, "cell long, feature string, x double"))
    assert blocks.held.count() > 4 and blocks.ends["feature"].count() == 90 and blocks.ends["cell"].count() <= 20 * blocks.held.count() < len(rows)
    b = dice.normal(size=(90, 3))
    there = blocks.sums(spark.createDataFrame([(f"f{j}", b[j].tolist()) for j in range(90)], "feature string, v array<double>"), 3, "feature", "cell")
    got = {r["cell"]: r["v"] for r in there.collect()}
    assert np.abs([got[i] for i in range(20)] - x @ b).max() < 1e-10
    back = {r["feature"]: r["v"] for r in blocks.sums(there, 3, "cell", "feature").collect()}
    assert len(back) == 90 and np.abs([back[f"f{j}"] for j in range(90)] - x.T @ (x @ b)).max() < 1e-9
    blocks.release()


def test_words_stay_with_their_texts(spark, monkeypatch):
    """Weights of texts' words are those of their counts, whatever the ids and texts, and no exchange deals rows of words by cell."""
    monkeypatch.setattr(prep, "TEXTS", 64)
    dice = np.random.default_rng(3)
    rows = [(int(i) % 50, " ".join(dice.choice(["Ab", "ab", "ÄÖ", "c", "", "d\n", "e\tf", f"w{i}"], int(dice.integers(1, 30))))) for i in range(70)]
    rows += [(60, None), (61, ""), (62, "   "), (63, "ab"), (64, "ab " * 500)]
    texts = spark.createDataFrame(rows, "cell long, text string")
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    counts = texts.select("cell", F.explode(words).alias("feature")).groupBy("cell", "feature").agg(F.count("*").cast("double").alias("x"))
    found = prep.tfidf_texts(texts)
    want = {r[:2]: r[2] for r in map(tuple, prep.tfidf(counts, len(rows), "documents").collect())}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and all(abs(want[r[:2]] - r[2]) < 1e-12 for r in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(grp" in plan and "hashpartitioning(cell" not in plan
    one = prep.tfidf_texts(spark.createDataFrame([(1, "x X"), (2, "x")], "cell long, text string"))
    assert sorted(map(tuple, one.collect())) == [(1, "x", 0.0), (2, "x", 0.0)]
    assert prep.tfidf_texts(texts.where("cell > 100")).collect() == []


def two_way(dice, nodes, pairs):
    """Random edges in both directions, most of them inside three groups, as a table with weights."""
    src, dst = dice.integers(0, nodes, pairs), dice.integers(0, nodes, pairs)
    near = (src != dst) & ((src % 3 == dst % 3) | (dice.random(pairs) < 0.1))
    e = np.unique(np.concatenate([np.stack([src, dst], 1)[near], np.stack([dst, src], 1)[near]]), axis=0)
    return pd.DataFrame({"src": e[:, 0] * 7, "dst": e[:, 1] * 7, "w": 1.0 + (e.sum(axis=1) % 3)})


def test_rounds_take_what_moved(monkeypatch):
    """A round in numpy sums the links of what moved, not all edges again; what it keeps is what summing anew gives."""
    edge = two_way(np.random.default_rng(12), 600, 9000)
    degree = edge.groupby("src")["w"].sum()
    node = pd.DataFrame({"r": 1.5, "cell": degree.index, "k": degree.to_numpy(), "cluster": degree.index, "home": 0})
    summed, links = [], cluster._links

    def counted(src, *rest):
        summed.append(len(src))
        return links(src, *rest)

    monkeypatch.setattr(cluster, "_links", counted)
    found = cluster._climbed_held(float(edge["w"].sum()), True)(node, edge)
    assert len(summed) > 20 and sum(summed) < len(summed) * len(edge) / 4 and found["cluster"].nunique() < 60
    key, inside = np.array([2, 3, 7, 9]), np.array([1.0, 2.0, 3.0, 4.0])
    key, inside = cluster._added(key, inside, np.array([1, 3, 7, 8, 11]), np.array([5.0, -2.0, 1.0, 0.0, 6.0]))
    assert key.tolist() == [1, 2, 7, 9, 11] and inside.tolist() == [5.0, 1.0, 4.0, 4.0, 6.0]


def test_small_graphs_climb_in_one_job(spark, monkeypatch):
    """All climbs of a graph that a task may hold happen in its task: nothing is joined, and the labels are those of the joins."""
    edges = spark.createDataFrame(two_way(np.random.default_rng(13), 60, 400))
    plan = cluster.communities_at(edges, [0.5, 1.0, 2.0])
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.rdd.getNumPartitions() == 3
    here = sorted(map(tuple, plan.collect()))
    monkeypatch.setattr(cluster, "HELD", 100)
    assert sorted(map(tuple, cluster.communities_at(edges, [0.5, 1.0, 2.0]).collect())) == here


def test_bisections_ahead(spark, monkeypatch):
    """Where a resolution costs a task much, no more are tried ahead than cores pay for, with the same result."""
    edges, tried, counts = spark.createDataFrame(two_way(np.random.default_rng(14), 60, 400)), [], cluster.counts_at
    monkeypatch.setattr(cluster, "counts_at", lambda g, r, *rest: (tried.append(len(r)), counts(g, r, *rest))[1])
    wide = sorted(map(tuple, cluster.communities_near(edges, 6, max_steps=6).collect()))
    assert tried[0] == 31
    tried.clear()
    monkeypatch.setattr(cluster, "A_JOB", 0)
    assert sorted(map(tuple, cluster.communities_near(edges, 6, max_steps=6).collect())) == wide and max(tried) == 7


def test_pairs_that_share_stay_in_their_task(spark, monkeypatch):
    """Bandwidths: points that share neighbours are met, counted and measured in one task, slice by slice, and are those that brute force finds."""
    v, k = np.random.default_rng(17).normal(size=(200, 4)), 6
    points = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "cell long, v array<double>")
    d = distances(v, v, "euclidean")
    np.fill_diagonal(d, np.inf)
    near = np.zeros((200, 200), int)
    np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, : k - 1], 1, axis=1)
    np.fill_diagonal(d, 0)
    shared, want = near @ near.T, []
    for i in range(200):
        met = np.flatnonzero(shared[i])
        taken = [j for j in met if (shared[i][met] < shared[i][j]).sum() <= k]
        want.append(np.mean(sorted(d[i][taken])[::-1][:k]))
    for size in (1 << 26, 0):
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", size)
        monkeypatch.setattr(neighbours, "BLOCK", 60)
        monkeypatch.setattr(graph, "PAIRS", 1 << 22 if size else 300)
        found = graph.bandwidths(neighbours.knn(points, points, k - 1, itself=False), points, k)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
        got = {r["cell"]: r["bw"] for r in found.collect()}
        assert [got[i * 3] for i in range(200)] == pytest.approx(want, abs=1e-12)


def test_candidates_stay_in_their_task(spark, monkeypatch):
    """Weighted neighbours: the candidates of a point are ranked where they are found, also slice by slice, with the same result."""
    dice = np.random.default_rng(18)
    reps = tuple(spark.createDataFrame([(i, dice.normal(size=4).tolist()) for i in range(150)], "cell long, v array<double>") for _ in range(2))
    rows = lambda: sorted(map(tuple, graph.weighted_neighbours(reps, 5, 20, 4).select("src", "dst", "place", "w", "dist").collect()))
    whole = rows()
    assert len(whole) == 750 and all(0 < r[3] <= 1 + 1e-9 for r in whole)
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "LISTS", 2000)
    assert [r[:3] for r in rows()] == [r[:3] for r in whole]
    assert "Window" not in graph.weighted_neighbours(reps, 5, 20, 4)._jdf.queryExecution().optimizedPlan().toString()
