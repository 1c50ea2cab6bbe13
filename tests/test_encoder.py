"""The trained encoder: gradients against finite differences, descent, resumed runs, imputation."""

import numpy as np
import pytest

from stratoloom.operators import encoder, graph, training
from stratoloom.operators.encoder import Encoder
from stratoloom.operators.neighbours import knn
from stratoloom.operators.training import Log, Patience, descend
from stratoloom.plans.catalogue import QUERIES


def planted(spark, n=50, seed=1):
    """Cells on a plane with two modalities that both follow three hidden numbers."""
    dice = np.random.default_rng(seed)
    at = dice.uniform(0, 4, (n, 2))
    z = np.column_stack([np.sin(at[:, 0]), np.cos(at[:, 1]), at.sum(axis=1) / 4])
    x1, x2 = z @ dice.normal(size=(3, 5)) + 0.1 * dice.normal(size=(n, 5)), z @ dice.normal(size=(3, 4)) + 0.1 * dice.normal(size=(n, 4))
    table = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell long, v array<double>").cache()
    return table(at), table(x1), table(x2), x1, x2


def links(points, k=4):
    """A normalised symmetric graph with loops."""
    return graph.normalised(graph.symmetric(knn(points, points, k, itself=False)).selectExpr("*", "1.0D AS w"), points.select("cell")).cache()


def made(spark, n=50):
    """An encoder on planted cells."""
    at, one, two, x1, x2 = planted(spark, n)
    places, near = links(at), (links(one), links(two))
    return Encoder((one, two), places, near, 3, seed=2), places, near, x1, x2


def dense(edges, n):
    """The matrix of an edge table."""
    a = np.zeros((n, n))
    for r in edges.collect():
        a[r["src"], r["dst"]] += r["w"]
    return a


def test_gradient(spark):
    """The job's loss and gradient are those of dense matrices, whose gradient is that of finite differences."""
    model, places, near, x1, x2 = made(spark)
    a, f1, f2 = dense(places, 50), dense(near[0], 50), dense(near[1], 50)
    x = {"place1": a @ x1, "near1": f1 @ x1, "place2": a @ x2, "near2": f2 @ x2}

    def loss(p):
        one, two, both, _ = encoder.codes(p, x)
        value = lambda e, w: w * (e * e).mean()
        across1, across2 = a @ (a @ (one @ p["d2"])) @ p["w2"], a @ (a @ (two @ p["d1"])) @ p["w1"]
        return value(a @ both @ p["d1"] - x1, 1.0) + value(a @ both @ p["d2"] - x2, 5.0) + value(one - across1, 1.0) + value(two - across2, 1.0)

    p = model.start
    got, found = model.gradient(p)
    assert got == pytest.approx(loss(p), rel=1e-9)
    g, at = training.flat(found), training.flat(p)
    for i in range(0, len(at), 3):
        step = np.zeros(len(at))
        step[i] = 1e-5
        slope = (loss(training.shaped(at + step, p)) - loss(training.shaped(at - step, p))) / 2e-5
        assert g[i] == pytest.approx(slope, rel=1e-5, abs=1e-8)


def test_empty_tasks(spark):
    """Tasks without cells add nothing."""
    at, one, two, _, _ = planted(spark, 3)
    few = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        model = Encoder((one, two), links(at, 1), (links(one, 1), links(two, 1)), 3, seed=2)
        assert np.isfinite(model.gradient(model.start)[0])
    finally:
        for c, v in few.items():
            spark.conf.set(c, v)


def test_training(spark, tmp_path):
    """The loss falls; a run that ends early and goes on from its log ends with the same parameters."""
    model, *_ = made(spark, 30)
    whole = model.train(6, 0.02)
    assert whole.losses[-1] < whole.losses[0] and len(whole.losses) == 6
    log = Log(spark, str(tmp_path / "log"))
    model.train(3, 0.02, log=log, every=2)
    again = model.train(6, 0.02, log=Log(spark, str(tmp_path / "log")), every=2)
    assert np.allclose(training.flat(again.parameters), training.flat(whole.parameters), atol=1e-9) and np.allclose(again.losses, whole.losses, rtol=1e-9)
    assert sorted(r["cell"] for r in model.encoded(whole.parameters).collect()) == list(range(30))


def test_killed_run(spark, tmp_path):
    """A step that fails loses nothing that was written; half a file is no step."""
    target = np.arange(4.0)
    calls = []

    def gradient(p, fail_at=None):
        calls.append(1)
        if fail_at and len(calls) == fail_at:
            raise RuntimeError("lost driver")
        return float(((p["x"] - target) ** 2).sum()), {"x": 2 * (p["x"] - target)}

    start = {"x": np.zeros(4)}
    whole = descend(gradient, start, 20, 0.1)
    calls.clear()
    log = Log(spark, str(tmp_path / "log"))
    with pytest.raises(RuntimeError, match="lost driver"):
        descend(lambda p: gradient(p, 14), start, 20, 0.1, log=log, every=4)
    (tmp_path / "log" / "step=16").mkdir()  # a file that was not finished
    assert log.last(start).step == 12
    resumed = descend(gradient, start, 20, 0.1, log=log, every=4)
    assert np.array_equal(resumed.parameters["x"], whole.parameters["x"]) and resumed.losses == whole.losses


def test_patience():
    """Stops after so many steps without a fall by delta; a fall starts the count again."""
    p = Patience(3, 0.1)
    assert [p.over(x) for x in (5.0, 4.0, 3.95, 3.9, 3.5, 3.45, 3.45, 3.45)] == [False, False, False, False, False, False, False, True]
    flat = descend(lambda p: (1.0, {"x": np.zeros(1)}), {"x": np.ones(1)}, 50, patience=Patience(4, 1e-4))
    assert flat.step == 5


def test_imputation(spark):
    """A missing modality is decoded from the other's code better than by its mean."""
    at, one, two, _, x2 = planted(spark, 60)
    parted = lambda t, held: t.where(f"cell % 3 {'=' if held else '<>'} 0").cache()
    trained = [parted(t, False) for t in (at, one, two)]
    model = Encoder((trained[1], trained[2]), links(trained[0]), (links(trained[1]), links(trained[2])), 4, seed=1)
    p = model.train(25, 0.1).parameters
    held = [parted(t, True) for t in (at, one)]
    got = {r["cell"]: np.array(r["v"]) for r in encoder.imputed(p, held[1], 2, links(held[0]), links(held[1])).collect()}
    cells = sorted(got)
    mean = x2[[i for i in range(60) if i % 3]].mean(axis=0)
    error = ((np.array([got[c] for c in cells]) - x2[cells]) ** 2).mean()
    assert cells == [i for i in range(60) if i % 3 == 0] and error < 0.8 * ((mean - x2[cells]) ** 2).mean()


def test_query(spark, small):
    """All cells have a code of unit length."""
    rows = QUERIES["t2_attention_encoder"](spark, small).collect()
    assert len(rows) == 500 and all(len(r["v"]) == 16 and abs(np.linalg.norm(r["v"]) - 1) < 1e-9 for r in rows)
