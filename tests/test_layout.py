"""Layouts and partitions: invariants and plain loops."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from stratoloom.operators import layout, partition
from stratoloom.operators.neighbours import knn
from stratoloom.plans.catalogue import QUERIES


def planted(spark, seed=1, groups=5, each=40):
    """Points in well parted groups."""
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(groups, 8)) * 6
    v = np.concatenate([c + dice.normal(size=(each, 8)) for c in centres])
    return spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "cell long, v array<double>"), v


def trustworthiness(v, at, k=15):
    """How far a layout's nearest are among the nearest of the points."""
    n = len(v)
    far = lambda x: ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag(np.full(n, np.inf))
    rank = far(v).argsort(axis=1).argsort(axis=1) + 1
    near = far(at).argsort(axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])


def test_fuzzy_weights(spark):
    """Nearest neighbours weigh 1, one-way weights add up to log2(k), the union is a + b - a b; ties at distance 0 too."""
    points, v = planted(spark, 4, 2, 20)
    k = 8
    near = knn(points, points, k)
    got = {(r["src"], r["dst"]): r["w"] for r in layout.fuzzy_weights(near, k).collect()}
    one = {}
    for i in range(len(v)):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        others = [j for j in np.argsort(d, kind="stable") if j != i][: k - 1]
        rho, low, high = min(d[j] for j in others), 0.0, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(np.exp(-max(0, d[j] - rho) / mid) for j in others) > np.log2(k) else (mid, high)
        one |= {(3 * i, 3 * j): np.exp(-max(0, d[j] - rho) / low) for j in others}
    pairs = set(one) | {(b, a) for a, b in one}
    assert set(got) == pairs
    for a, b in pairs:
        x, y = one.get((a, b), 0.0), one.get((b, a), 0.0)
        assert abs(got[a, b] - (x + y - x * y)) < 1e-6
    same = spark.createDataFrame([(i, [0.0]) for i in range(5)], "cell long, v array<double>")
    assert all(0 < r["w"] <= 1 for r in layout.fuzzy_weights(knn(same, same, 4), 4).collect())


def test_curve():
    """The curve is near 1 up to the distance, and no small change of a or b is nearer."""
    a, b = layout.curve(0.5)
    x = np.linspace(0, 3, 300)[1:]
    want = np.where(x < 0.5, 1.0, np.exp(-(x - 0.5)))
    loss = lambda p, q: ((1 / (1 + p * x ** (2 * q)) - want) ** 2).sum()
    assert all(loss(a, b) <= loss(a * p, b * q) for p in (0.99, 1, 1.01) for q in (0.99, 1, 1.01))


@pytest.mark.parametrize("part", [1 << 19, 900])
def test_layout(spark, monkeypatch, part):
    """Near points stay near, also over several blocks; the same seed gives the same layout."""
    monkeypatch.setattr(layout, "PART", part)
    points, v = planted(spark)
    got = sorted(layout.layout(points, epochs=60, rounds=3, seed=3).collect())
    at = np.array([(r["x"], r["y"]) for r in got])
    assert [r["cell"] for r in got] == [3 * i for i in range(len(v))] and np.isfinite(at).all()
    assert trustworthiness(v, at) >= 0.9
    if part == 900:
        assert sorted(layout.layout(points, epochs=60, rounds=3, seed=3).collect()) == got


def test_small_layouts(spark):
    """Three points lie on a line; no points, no rows."""
    points, _ = planted(spark)
    assert sorted(map(tuple, layout.layout(points.limit(3)).collect())) == [(0, 0.0, 0.0), (3, 1.0, 0.0), (6, 2.0, 0.0)]
    assert layout.layout(points.limit(0)).count() == 0


def groups(spark, sizes, inside, between, seed):
    """A random graph with planted groups."""
    dice = np.random.default_rng(seed)
    of = np.repeat(np.arange(len(sizes)), sizes)
    hit = np.triu(dice.random((len(of), len(of))) < np.where(of[:, None] == of, inside, between), 1)
    return spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(hit | hit.T), strict=True)], "src long, dst long, w double"), of


def parts_of(assigned):
    """Part sizes and the part of each cell."""
    of = {r["cell"]: r["part"] for r in assigned.collect()}
    return Counter(of.values()), of


def test_partition_finds_groups(spark):
    """Parts are within 5 % of equal, and the cut is at most half a hash partition's."""
    edges, of = groups(spark, [100] * 4, 0.15, 0.005, 2)
    assigned = partition.partition(edges, 4, seed=1).cache()
    sizes, part = parts_of(assigned)
    assert len(part) == 400 and set(sizes) == set(range(4)) and all(95 <= s <= 105 for s in sizes.values())
    between = partition.cut_weight(edges, assigned).first()
    hashed = partition.cut_weight(edges, assigned.selectExpr("cell", "CAST(pmod(xxhash64(cell), 4) AS int) AS part")).first()
    rows = edges.collect()
    assert between["between"] == sum(r["w"] for r in rows if part[r["src"]] != part[r["dst"]]) and between["total"] == len(rows)
    assert between["between"] <= 0.5 * hashed["between"]
    assert parts_of(partition.partition(edges.repartition(5), 4, seed=1))[1] == part


def test_partition_of_a_star(spark):
    """A hub with many leaves, and nodes without edges, are dealt out evenly, too."""
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 300)], "src long, dst long, w double")
    alone = spark.range(1000, 1101).withColumnRenamed("id", "cell")
    sizes, part = parts_of(partition.partition(star, 4, alone))
    assert len(part) == 401 and all(95 <= s <= 106 for s in sizes.values())


def test_partition_cases(spark):
    """One part; fewer nodes than parts; no edges at all."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 3, 5.0)], "src long, dst long, w double")
    assert parts_of(partition.partition(edges, 1))[1] == {1: 0, 2: 0, 3: 0}
    assert set(parts_of(partition.partition(edges, 5))[1]) == {1, 2, 3}
    assert partition.partition(edges.limit(0), 3).count() == 0


def test_mini_batches(spark):
    """Every part is in one batch, batches hold the parts asked for, and exactly the edges inside are theirs."""
    edges, of = groups(spark, [10] * 7, 0.5, 0.05, 3)
    assigned = spark.createDataFrame([(i, int(g)) for i, g in enumerate(of)], "cell long, part int")
    rows = partition.mini_batches(edges, assigned, 3, seed=2).collect()
    batches = defaultdict(set)
    for r in rows:
        batches[r["batch"]] |= {int(of[r["src"]]), int(of[r["dst"]])}
    assert sorted(map(len, batches.values())) == [1, 3, 3] and set().union(*batches.values()) == set(range(7))
    where = {g: b for b, found in batches.items() for g in found}
    assert Counter((r["src"], r["dst"]) for r in rows) == Counter((r["src"], r["dst"]) for r in edges.collect() if where[of[r["src"]]] == where[of[r["dst"]]])


def test_queries(spark, small):
    """All cells have a place and a part; parts are equal within 5 %."""
    assert QUERIES["d6_layout"](spark, small).count() == 500
    sizes, part = parts_of(QUERIES["t10_partition"](spark, small))
    assert len(part) == 500 and all(0.95 * 62.5 <= s <= 1.05 * 62.5 for s in sizes.values())
    assert QUERIES["t10_batches"](spark, small).select("batch").distinct().count() == 4
