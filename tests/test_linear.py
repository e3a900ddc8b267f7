import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftline.operators import linear as L
from weftline.operators import models


def data(seed, n=240, m=12, classes=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, m)) * (r.random((n, m)) < 0.5)
    y = (x[:, :classes] + 0.5 * r.normal(size=(n, classes))).argmax(1)
    return x, y, np.where(y == 0, 3.0, 1.0)


def table(spark, x, y, w):
    return spark.createDataFrame([(i, Vectors.sparse(x.shape[1] * 5, [(5 * j, float(v)) for j, v in enumerate(q) if v]), float(a), float(b)) for i, (q, a, b) in enumerate(zip(x, y, w))], ["row_id", "features", "label", "weight"])


def plain_objective(kind, x, s, w, alpha, beta, shift):
    m = s * (x @ beta + shift)
    d = np.maximum(1 - m, 0)
    loss = {"hinge": d, "squared_hinge": d * d, "modified_huber": np.where(m >= -1, d * d, -4 * m)}[kind]
    return (w * loss).sum() / w.sum() + alpha / 2 * (beta @ beta)


def plain_newton(kind, x, s, w, alpha):
    """Damped Newton steps on the dense problem."""
    z, v = np.hstack((x, np.ones((len(x), 1)))), np.zeros(x.shape[1] + 1)
    hold = np.append(np.full(x.shape[1], alpha), 0.0)
    f = lambda v: plain_objective(kind, x, s, w, alpha, v[:-1], v[-1])
    for _ in range(200):
        m = s * (z @ v)
        near = (m < 1) & ((m >= -1) | (kind == "squared_hinge"))
        d = np.where(near, -2 * (1 - m), np.where(m < -1, -4.0, 0.0)) * s * w / w.sum()
        g = z.T @ d + hold * v
        h = (z * (near * 2 * w / w.sum())[:, None]).T @ z + np.diag(hold) + 1e-12 * np.eye(len(v))
        step, t = -np.linalg.solve(h, g), 1.0
        while f(v + t * step) > f(v) and t > 1e-12:
            t /= 2
        v = v + t * step
    return f(v)


def plain_dual(x, s, w, alpha):
    """Dual coordinate descent for the hinge without intercept."""
    c, a, v = w / w.sum() / alpha, np.zeros(len(x)), np.zeros(x.shape[1])
    q = (x * x).sum(1)
    for _ in range(4000):
        for i in range(len(x)):
            if q[i]:
                new = min(max(a[i] - (s[i] * (x[i] @ v) - 1) / q[i], 0), c[i])
                v += (new - a[i]) * s[i] * x[i]
                a[i] = new
    return plain_objective("hinge", x, s, w, alpha, v, 0.0)


@pytest.mark.parametrize("kind", ["squared_hinge", "modified_huber"])
def test_objective_of_a_plain_solver(spark, kind):
    x, y, w = data(1)
    config = L.LinearConfig(loss=kind, alpha=1e-2)
    model = L.fit_linear(table(spark, x, y, w).repartition(3), config, weight="weight")
    beta = np.zeros((12, 3))
    beta[model.names // 5] = model.weights
    for k in range(3):
        s = np.where(y == k, 1.0, -1.0)
        assert plain_objective(kind, x, s, w, 1e-2, beta[:, k], model.shifts[k]) <= plain_newton(kind, x, s, w, 1e-2) + 1e-6


def test_hinge_objective_of_a_plain_solver(spark):
    x, y, w = data(2, n=90, m=6, classes=2)
    config = L.LinearConfig(loss="hinge", alpha=2e-2, intercept=False)
    model = L.fit_linear(table(spark, x, y, w).repartition(2), config, weight="weight")
    beta = np.zeros((6, 2))
    beta[model.names // 5] = model.weights
    for k in range(2):
        s = np.where(y == k, 1.0, -1.0)
        assert plain_objective("hinge", x, s, w, 2e-2, beta[:, k], 0.0) <= plain_dual(x, s, w, 2e-2) + 1e-4


def test_balanced_weights_are_used(spark):
    x, y, _ = data(3)
    df = table(spark, x, np.where(y > 0, 1, 0), np.ones(len(y)))
    fitted = models.fit("svm", df.drop("weight"), c=0.5)
    again = L.fit_linear(models.balanced(df.drop("weight")), L.LinearConfig(c=0.5), weight="weight")
    assert np.allclose(fitted.weights, again.weights, atol=1e-6)
    p = {r["row_id"]: r for r in fitted.transform(df).collect()}
    assert np.mean([p[i]["prediction"] == (y[i] > 0) for i in range(len(y))]) > 0.65


def test_calibration_by_folds(spark):
    x, y, w = data(4)
    df = table(spark, x, y, w)
    config = L.LinearConfig(alpha=1e-2)
    model = L.fit_calibrated(df.repartition(3), config, "row_id", weight="weight")
    fold = {r[0]: r[1] for r in df.select("row_id", F.pmod(F.xxhash64("row_id"), F.lit(3))).collect()}
    m = np.zeros((len(y), 3))
    for f in range(3):  # each fold's model on its own
        part = L.fit_linear(df.where(F.pmod(F.xxhash64("row_id"), F.lit(3)) != f), config, weight="weight")
        beta = np.zeros((12, 3))
        beta[part.names // 5] = part.weights
        own = [i for i in range(len(y)) if fold[i] == f]
        m[own] = x[own] @ beta + part.shifts
    for k in range(3):
        t = np.where(y == k, (sum(y == k) + 1) / (sum(y == k) + 2), 1 / (sum(y != k) + 2))
        a, b = 0.0, 0.0
        for _ in range(200):  # plain Newton
            p = 1 / (1 + np.exp(a * m[:, k] + b))
            g = np.array([((t - p) * m[:, k]).sum(), (t - p).sum()])
            v = p * (1 - p)
            h = np.array([[(v * m[:, k] ** 2).sum(), (v * m[:, k]).sum()], [(v * m[:, k]).sum(), v.sum()]]) + 1e-9 * np.eye(2)
            a, b = np.array([a, b]) - 0.5 * np.linalg.solve(h, g)
        assert np.allclose(model.curves[:, k], (a, b), atol=2e-3)
    out = model.transform(df).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out)
    assert np.mean([r["prediction"] == y[r["row_id"]] for r in out]) > 0.55


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (2, [1.0, float("nan")], None), (3, [], 0.0), (4, [2.0, 0.0], 1.0)], "row_id long, features array<double>, label double")
    assert L.fit_linear(rows, L.LinearConfig()).transform(rows).count() == 4
    with pytest.raises(ValueError):
        L.LinearConfig(loss="log")
