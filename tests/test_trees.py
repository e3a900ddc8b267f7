
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftline.operators import trees as T


def plain_boost(x, y, w, c, edges, classes):
    """The same boosting in plain loops."""
    n, m = x.shape
    z = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(m)], 1)
    if c.loss == "softmax":
        base = np.log([max(w[y == k].sum() / w.sum(), 1e-12) for k in range(classes)])
    else:
        base = np.array([(y * w).sum() / w.sum()])
    margin, out = np.tile(base, (n, 1)), []
    for _ in range(c.rounds):
        g, h = T.gradients(c.loss, c.alpha, y, margin)
        grown = []
        for k in range(len(base)):
            gk, hk, nodes = g[:, k] * w, h[:, k] * w, [(0, np.arange(n), None)]
            shape, at = {}, {0: np.arange(n)}
            value, level, fresh = {0: 0.0}, [0], 1
            for _ in range(c.depth):
                following = []
                for node in level:
                    rows, best = at[node], None
                    score = lambda r: gk[r].sum() ** 2 / (hk[r].sum() + c.l2)
                    for f in range(m):
                        for b in range(len(edges[f])):
                            left, right = rows[z[rows, f] <= b], rows[z[rows, f] > b]
                            if min(len(left), len(right)) < c.least_rows:
                                continue
                            gain = round(score(left) + score(right) - score(rows), 9)
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, f, b, left, right)
                    if best:
                        _, f, b, left, right = best
                        shape[node] = (f, edges[f][b], fresh, fresh + 1)
                        for child, r in ((fresh, left), (fresh + 1, right)):
                            at[child], value[child] = r, -c.rate * gk[r].sum() / (hk[r].sum() + c.l2)
                            following.append(child)
                        fresh += 2
                level = following
            for node, r in at.items():
                if node not in shape:
                    margin[r, k] += value[node]
            grown.append((shape, value))
        out.append(grown)
    return out, margin


def table(spark, x, y, w, sparse):
    rows = [(i, Vectors.sparse(x.shape[1], {j: float(v) for j, v in enumerate(r) if v}) if sparse else Vectors.dense(r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["row_id", "features", "label", "weight"])


@pytest.mark.parametrize("loss, sparse", [("softmax", True), ("softmax", False), ("l2", True)])
def test_boosting_equals_plain_code(spark, loss, sparse):
    r = np.random.default_rng(3)
    x = r.normal(size=(160, 4)) * (r.random((160, 4)) < (0.5 if sparse else 1))
    y = (x[:, 0] + x[:, 1] > 0.2).astype(float) + (x[:, 2] > 1) if loss == "softmax" else x[:, 0] ** 2 - x[:, 3]
    w = np.where(r.random(160) < 0.3, 2.0, 1.0)
    c = T.BoostConfig(loss=loss, rounds=5, depth=3, bins=16, least_rows=5, rate=0.3, refresh=2)
    df = table(spark, x, y, w, sparse)
    got = T.boost(df.repartition(3), c, weight="weight")
    edges = T.bin_edges(T.entries(df, "features"), c.bins)
    want, margin = plain_boost(x, y, w, c, edges, 3)
    assert len(got.trees) == 5
    for a, b in zip(got.trees, want):
        for tree, (shape, value) in zip(a, b):
            found = {n: (tree.feature[n], tree.threshold[n], tree.left[n], tree.right[n]) for n in range(len(tree.feature)) if tree.feature[n] >= 0}
            assert found == shape
            assert np.allclose([tree.value[n] for n in value], list(value.values()), atol=1e-9)
    again = T.Boosted.from_json(got.to_json())
    out = {x["row_id"]: x for x in again.transform(df).collect()}
    assert np.allclose([out[i]["margins"] for i in range(160)], margin, atol=1e-9)
    if loss == "softmax":
        assert np.mean([out[i]["prediction"] == y[i] for i in range(160)]) > 0.9


def test_quantiles_cover(spark):
    d = spark.range(20_000).select(F.col("id").alias("row_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("u"))
    d = d.select("row_id", F.array("a", "b").alias("features"), (3 * F.col("a") + (1 + 2 * F.col("b")) * F.col("u")).alias("label"))
    for alpha in (0.1, 0.9):
        model = T.boost(d.where("row_id % 4 <> 0"), T.BoostConfig(loss="quantile", alpha=alpha, rounds=10, depth=3, rate=0.5, bins=32, least_rows=50))
        held = d.where("row_id % 4 = 0")
        p = model.transform(held)
        share = p.agg(F.avg((F.col("label") <= F.col("prediction")).cast("int"))).first()[0]
        assert abs(share - alpha) < 0.02
        width = p.agg(F.corr("prediction", F.col("features")[0])).first()[0]
        assert width > 0.8  # it follows the features


def test_boosting_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (2, [1.0, float("nan")], None), (3, [], 0.0), (4, [2.0, 0.0], float("nan"))], "row_id long, features array<double>, label double")
    model = T.boost(rows, T.BoostConfig(rounds=2, least_rows=1))
    assert {x["row_id"] for x in model.transform(rows).collect()} == {1, 2, 3, 4}
    assert T.boost(rows.limit(0), T.BoostConfig(loss="l2", rounds=2)).transform(rows).count() == 4
    with pytest.raises(ValueError):
        T.BoostConfig(loss="hinge")


def test_extra_trees(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6)) * (r.random((400, 6)) < 0.7)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    df = table(spark, x, y, np.ones(400), True)
    c = T.ExtraConfig(trees=12, depth=6, share=0.6, together=5)
    a = T.extra_trees(df.repartition(4), c)
    b = T.extra_trees(df.orderBy(F.rand(7)).coalesce(1), c)
    assert [vars(t) for t in a.trees] == [vars(t) for t in b.trees]  # whatever the partitioning
    out = {q["row_id"]: q for q in a.transform(df).collect()}
    assert np.mean([out[i]["prediction"] == y[i] for i in range(400)]) > 0.85
    for t, tree in enumerate(a.trees):  # thresholds lie at the drawn share between the node's least and greatest value
        node = {0: np.arange(400)}
        for n in range(len(tree.feature)):
            f = tree.feature[n]
            if f >= 0:
                v = x[node[n], f]
                share = T.hashed_share(c.seed + 1, t, np.array([n]), np.array([f]))[0]
                assert T.hashed_share(c.seed, t, np.array([n]), np.array([f]))[0] < 0.6
                assert np.isclose(tree.threshold[n], v.min() + (v.max() - v.min()) * share)
                node[tree.left[n]], node[tree.right[n]] = node[n][v <= tree.threshold[n]], node[n][v > tree.threshold[n]]
                assert min(len(node[tree.left[n]]), len(node[tree.right[n]])) >= 2
        for n, rows in node.items():
            assert np.allclose(tree.value[n], np.bincount(y[rows], minlength=3) / len(rows))


def test_queries_on_tables(spark):
    import os

    from weftline import queries

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    got = queries.Q["ml_gbm_reg"][0](spark, d)
    n, low, high, order = got.agg(F.count("*"), F.avg((F.col("label") <= F.col("q10")).cast("int")), F.avg((F.col("label") <= F.col("q90")).cast("int")), F.avg((F.col("q10") <= F.col("q90")).cast("int"))).first()
    assert n == spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 4 = 0").count()
    assert abs(low - 0.1) < 0.02 and abs(high - 0.9) < 0.02 and order > 0.99
    for name in ("ml_gbm", "ml_extra"):
        p = queries.Q[name][0](spark, d)
        assert p.count() == 100 and {x["prediction"] for x in p.collect()} <= set(map(float, range(10)))


def test_sums_of_close_and_far_codes(monkeypatch):
    rng = np.random.default_rng(2)
    for top in (5, 3000, 1 << 40):
        code, x = rng.integers(0, top, 2000), rng.normal(size=2000)
        want, back = np.unique(code, return_inverse=True)
        if top < 1 << 40:
            monkeypatch.setattr(np, "unique", lambda *a, **k: pytest.fail("sorted"))
        got = T.summed(code, x)
        monkeypatch.undo()
        assert (got[0] == want).all() and (got[1] == np.bincount(back, x)).all()
    assert [len(a) for a in T.summed(np.zeros(0, np.int64), np.zeros(0))] == [0, 0]


def test_packed_rows_come_back(spark):
    df = spark.range(25_000).selectExpr("id", "sequence(0, id % 4) AS v").repartition(3)
    back = T.packed(df, "packs").mapInArrow(T.unpacked, df.schema)
    assert T.packed(df, "packs").count() < 30 and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
