"""Sparse processes against dense numpy."""

import math

import numpy as np
import pytest

from stratoloom.operators import processes
from stratoloom.operators.processes import Balance, LinearDecoder, SparseProcess, covariance
from stratoloom.plans import recipes as plans
from stratoloom.plans.catalogue import QUERIES


def planted(spark, n=400, seed=1):
    """Places with two smooth values and noise; the same in numpy."""
    dice = np.random.default_rng(seed)
    v = dice.uniform(0, 5, (n, 2))
    y = np.column_stack([np.sin(v[:, 0]) + v[:, 1] * 0.2, np.cos(v[:, 1])])
    noise = dice.uniform(0.01, 0.2, (n, 2))
    y = y + dice.normal(size=y.shape) * np.sqrt(noise)
    rows = [(i, v[i].tolist(), y[i].tolist(), noise[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "cell long, v array<double>, y array<double>, noise array<double>"), v, y, noise


@pytest.mark.parametrize("kind", ["eq", "cauchy", "laplacian", "matern12", "matern32", "matern52"])
def test_closed_form(spark, kind):
    """Mean, variance, posterior and bound of every covariance equal the dense formulas."""
    known, v, y, noise = planted(spark, 120)
    z = np.array([(a, b) for a in range(0, 6, 2) for b in range(0, 6, 2)], float)
    p = SparseProcess(z, kind, 1.3, 1e-6).fit(known)
    places = np.random.default_rng(5).uniform(0, 5, (50, 2))
    got = sorted(p.predict(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(places)], "cell long, v array<double>")).collect())
    safe = lambda m: m + 1e-6 * np.eye(len(m))
    mm, nm, xm = covariance(kind, z, z, 1.3), covariance(kind, v, z, 1.3), covariance(kind, places, z, 1.3)
    likely, apart = p.bound(known)
    for i in range(2):
        s = np.linalg.inv(safe(mm + nm.T @ (nm / noise[:, i, None])))
        mean = xm @ s @ nm.T @ (y[:, i] / noise[:, i])
        var = 1 - np.diag(xm @ np.linalg.inv(safe(mm)) @ xm.T) + np.diag(xm @ s @ xm.T)
        assert np.allclose([r["mean"][i] for r in got], mean, atol=1e-7) and np.allclose([r["var"][i] for r in got], var, atol=1e-7)
        mu, a = mm @ s @ nm.T @ (y[:, i] / noise[:, i]), mm @ s @ mm
        assert np.allclose(p.posterior()[0][i], mu) and np.allclose(p.posterior()[1][i], a)
        inv = np.linalg.inv(safe(mm))
        b = nm @ inv
        want = -0.5 * sum((1 - b[j] @ nm[j]) / noise[j, i] + b[j] @ a @ b[j] / noise[j, i] + math.log(noise[j, i]) + math.log(2 * math.pi) + (y[j, i] - b[j] @ mu) ** 2 / noise[j, i] for j in range(len(v)))
        kl = 0.5 * (np.linalg.slogdet(safe(mm))[1] - np.linalg.slogdet(safe(a))[1] - len(z) + np.trace(inv @ a) + mu @ inv @ mu)
        assert abs(likely[i] - want) < 1e-6 * abs(want) and abs(apart[i] - kl) < 1e-6 * abs(kl)


def test_prediction_is_close(spark, tmp_path):
    """Unseen values are predicted better than by the mean, scales are told apart, and a saved process predicts alike."""
    known, *_ = planted(spark)
    z = processes.grid_of(known, 6)
    p = processes.best_scale(known, z, [0.01, 2.0, 500.0])
    assert p.scale == 2.0
    v = np.random.default_rng(8).uniform(0.2, 4.8, (80, 2))
    places = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell long, v array<double>")
    got = np.array([r["mean"] for r in sorted(p.predict(places).collect())])
    want = np.column_stack([np.sin(v[:, 0]) + v[:, 1] * 0.2, np.cos(v[:, 1])])
    assert (np.abs(got - want).mean(axis=0) < 0.15 * want.std(axis=0) + 0.05).all()
    p.save(spark, str(tmp_path / "process"))
    again = SparseProcess.read(spark, str(tmp_path / "process"))
    for a, b in zip(sorted(again.predict(places).collect()), sorted(p.predict(places).collect()), strict=True):
        assert a["cell"] == b["cell"] and np.allclose(a["mean"], b["mean"], atol=1e-8) and np.allclose(a["var"], b["var"], atol=1e-8)


def test_wrong_noise(spark):
    """A variance that isn't above 0, or is missing, is an error; no places give the prior."""
    bad = spark.createDataFrame([(1, [0.0, 0.0], [1.0], [0.0])], "cell long, v array<double>, y array<double>, noise array<double>")
    with pytest.raises(ValueError, match="variance"):
        SparseProcess(np.zeros((1, 2))).fit(bad)
    with pytest.raises(ValueError, match="variance"):
        SparseProcess(np.zeros((1, 2))).fit(bad.selectExpr("cell", "v", "y", "array() AS noise").selectExpr("cell", "v", "y", "CAST(noise AS array<double>) AS noise"))
    none = SparseProcess(np.zeros((1, 2))).fit(bad.limit(0))
    assert none.predict(bad.select("cell", "v")).first()["mean"] == []


def test_balance():
    """Too small a divergence lowers the weight, too large a one raises it, within its ends, and nothing is integrated below the least."""
    b = Balance(wanted=10.0, proportional=0.01, integral=-0.005, start=10.0, least=4.0, most=25.0)
    assert b.step(10.0) == 10.0
    first = b.step(20.0)
    assert first == pytest.approx(10.0 + 0.01 * (1 / (1 + math.exp(-50.0)) - 0.5) + 0.005 * 50)
    for _ in range(300):
        last = b.step(1000.0)
    assert last == 25.0
    low = Balance(wanted=1000.0, start=3.9)
    before = low.weight
    low.step(0.0)
    assert abs(low.weight - before) <= 0.01


def test_steered_loop():
    """A divergence that falls as its weight rises is brought near the wanted one."""
    b = Balance(wanted=5.0, start=10.0, least=0.1, most=100.0)
    seen = 50.0
    for _ in range(2000):
        seen = 60.0 / b.step(seen)
    assert abs(seen - 5.0) < 0.2


def test_linear_decoder(spark, monkeypatch):
    """Coefficients are least squares over absent zeros; blocks of features do not matter."""
    dice = np.random.default_rng(3)
    z = dice.normal(size=(60, 3))
    x = np.maximum(np.round(z @ dice.normal(size=(3, 7)) * 2 + 3), 0)
    latents = spark.createDataFrame([(i, z[i].tolist()) for i in range(60)], "cell long, v array<double>")
    counts = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(60) for j in range(7) if x[i, j]], "cell long, feature string, x double")
    monkeypatch.setattr(LinearDecoder, "BLOCK", 2)
    got = {(r["cell"], r["feature"]): r["x"] for r in LinearDecoder(0.0).fit(latents, counts).decode(latents).collect()}
    a = np.column_stack([z, np.ones(60)])
    want = np.maximum(a @ np.linalg.lstsq(a, x, rcond=None)[0], 0)
    assert len(got) == 420 and all(abs(got[i, f"f{j}"] - want[i, j]) < 1e-8 for i in range(60) for j in range(7))


def test_queries(spark, small):
    """Variances lie between 0 and the prior's; counts of unseen places come for every feature; latents join process and nearest place."""
    rows = QUERIES["t13_process_variance"](spark, small).collect()
    assert len(rows) == 333 and all(0 < r[f"var{i}"] <= 1 + 1e-6 for r in rows for i in (0, 1))
    rows = QUERIES["t13_unseen_counts"](spark, small).collect()
    assert len({r["cell"] for r in rows}) == 333 and len(rows) == 333 * len({r["feature"] for r in rows}) and all(r["x"] >= 0 for r in rows)
    e = plans.emb(spark, small).where("batch = 0")
    known = e.selectExpr("cell", "slice(v, 1, 2) AS v", "slice(v, 3, 4) AS z", "transform(slice(v, 3, 4), x -> 0.1 + abs(x)) AS spread")
    gp = known.selectExpr("cell", "v", "slice(z, 1, 2) AS y", "slice(spread, 1, 2) AS noise")
    p = SparseProcess(processes.grid_of(gp, 4), jitter=1e-6).fit(gp)
    same = {r["cell"]: r for r in processes.latents_at(p, known, known.select("cell", "v")).collect()}
    for r in known.collect():
        assert same[r["cell"]]["v"][2:] == r["z"][2:] and same[r["cell"]]["var"][2:] == r["spread"][2:] and len(same[r["cell"]]["v"]) == 4
