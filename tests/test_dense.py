import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import dense as D


def test_gelu():
    x = np.linspace(-5, 5, 101)
    y, d = D._gelu(x)
    want = np.array([v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in x])
    assert np.allclose(y, want, atol=1e-6)
    assert np.allclose(d, np.gradient(want, x), atol=5e-3)


@pytest.mark.parametrize("loss, outputs", [("cross_entropy", 3), ("smooth_l1", 1)])
def test_gradients_equal_differences(loss, outputs):
    r = np.random.default_rng(1)
    c = D.DenseConfig(width=5, outputs=outputs, hidden=6, loss=loss)
    p = D.start(c)
    p["scale"] = r.normal(size=5)
    x, w = r.normal(size=(7, 5)), r.random(7)
    y = r.integers(0, 3, 7).astype(float) if outputs == 3 else 2 * r.normal(size=7)
    masks = tuple((r.random((7, n)) > 0.3) / 0.7 for n in (6, 3))
    out, kept = D.forward(p, x, masks)
    g = D.backward(p, kept, D.loss_and_slope(c, out, y, w)[1], masks)
    for name in D.NAMES:
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in p[name].shape)
            q = [{k: v.copy() for k, v in p.items()} for _ in range(2)]
            q[0][name][at] += 1e-4
            q[1][name][at] -= 1e-4
            a, b = (D.loss_and_slope(c, D.forward(z, x, masks)[0], y, w)[0] for z in q)
            assert np.isclose((a - b) / 2e-4, g[name][at], atol=2e-3)


def rows(spark, n=400):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    return spark.createDataFrame([(i, v.tolist(), float(a), i % 5 == 0) for i, (v, a) in enumerate(zip(x, y))], "row_id long, features array<double>, label double, held boolean"), x, y


def test_one_step_equals_plain_code(spark):
    df, x, y = rows(spark)
    c = D.DenseConfig(width=6, outputs=2, hidden=8, dropout=0.0, rows=10_000, epochs=1, tasks=3, rate=1e-2)
    model = D.train_dense(df, c)
    p = D.start(c)
    fit = np.arange(400) % 5 != 0
    out, kept = D.forward(p, x[fit])
    g = D.backward(p, kept, D.loss_and_slope(c, out, y[fit], np.ones(fit.sum()))[1])
    for name in D.NAMES:  # the first step of the running moments is the gradient's sign, but for the small constant
        m = g[name] / fit.sum()
        want = p[name] * (1 - c.rate * c.decay) - c.rate * m / (np.abs(m) + 1e-8)
        assert np.allclose(model.parameters[name], want, atol=1e-6)


def test_stops_on_a_plateau_and_goes_on(spark, tmp_path):
    df, x, y = rows(spark)
    c = D.DenseConfig(width=6, outputs=2, hidden=32, dropout=0.1, rows=64, epochs=6, tasks=2, rate=1e-2)
    whole = D.train_dense(df, c, folder=f"file://{tmp_path}/a")
    D.train_dense(df.repartition(7), D.DenseConfig(**(vars(c) | {"epochs": 3})), folder=f"file://{tmp_path}/b")  # ended after three epochs
    again = D.train_dense(df, c, folder=f"file://{tmp_path}/b")
    assert again.history == whole.history and len(whole.history) == 6
    assert all(np.array_equal(again.parameters[k], whole.parameters[k]) for k in D.NAMES)
    assert whole.history[-1] < whole.history[0]
    still = D.train_dense(df, D.DenseConfig(**(vars(c) | {"rate": 0.0, "epochs": 40, "patience": 3})))
    assert len(still.history) == 4 and still.best_epoch == 1
    got = whole.transform(df.where("held")).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")), F.count("*")).first()
    assert got[1] == 80 and got[0] > 0.6


def test_a_task_that_dies_is_run_again(tmp_path):
    """train_share() as the stage calls it: the second attempt goes on from the epoch that was kept."""
    r = np.random.default_rng(2)
    x, key = r.normal(size=(60, 4)), np.arange(60)
    args = (x, (x[:, 0] > 0) * 1.0, np.ones(60), key, key % 4 == 0)
    c = D.DenseConfig(width=4, outputs=2, hidden=8, rows=16, epochs=5, rate=1e-2)
    whole = D.train_share(c, *args, f"file://{tmp_path}/a", D.Alone())
    calls, write = [], D._write

    def failing(folder, state):
        write(folder, state)
        calls.append(1)
        if len(calls) == 2:
            raise OSError("executor lost")

    D._write = failing
    try:
        with pytest.raises(OSError):
            D.train_share(c, *args, f"file://{tmp_path}/b", D.Alone())
        again = D.train_share(c, *args, f"file://{tmp_path}/b", D.Alone())
    finally:
        D._write = write
    assert len(calls) == 5 and again["history"] == whole["history"]


def test_numbers_and_odd_rows(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.array(*(F.rand(j) for j in range(5))).alias("features"), (F.col("id") % 4 == 0).alias("held"))
    df = df.withColumn("label", 3 * (F.col("features")[0] - F.col("features")[1]))
    odd = spark.createDataFrame([(None, [1.0], True, 1.0), (1000, None, False, 2.0), (1001, [float("nan"), 1.0], False, None)], "row_id long, features array<double>, held boolean, label double")
    c = D.DenseConfig(width=5, outputs=1, hidden=16, loss="smooth_l1", dropout=0.0, rows=32, epochs=8, rate=1e-2)
    model = D.train_dense(df.unionByName(odd), c)
    assert model.history[-1] < 0.5 * model.history[0]
    assert model.transform(odd).count() == 3
    with pytest.raises(ValueError):
        D.DenseConfig(width=2, outputs=1)
