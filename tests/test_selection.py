import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.selection import quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0)


def percentiles(df, keys=()):
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    out = df.groupBy(*keys).agg(F.count(finite).alias("n"), F.percentile(finite, list(SHARES)).alias("q"))
    return {tuple(r[k] for k in keys): (r["n"], r["q"]) for r in out.collect()}


@pytest.mark.parametrize("held, bins", [(100_000, 4096), (20, 16), (1, 2)])
def test_equals_percentile(spark, held, bins):
    r = random.Random(held)
    rows = [("skewed", r.lognormvariate(0, 3)) for _ in range(700)] + [("tied", float(r.choice([1, 1, 1, 2, 7]))) for _ in range(500)] + [("distinct", r.gauss(0, 1e6)) for _ in range(400)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 4.5), ("none", None), ("none", float("nan")), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 3.0), ("odd", float("inf")), ("odd", -1.0)]
    if held > 1:
        rows += [("tiny", 5e-324 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, x double")
    got = {(x["c"],): (x["n"], x["q"]) for x in quantiles(df, "x", SHARES, ("c",), held, bins).collect()}
    want = percentiles(df, ("c",))
    assert got.keys() == want.keys()
    for c in want:
        n, q = want[c]
        assert got[c][0] == n and (got[c][1] == q if n else got[c][1] == [None] * len(SHARES)), c


def test_whole_tables(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 1000 / 7.0).alias("x"))
    one = quantiles(df, "x", SHARES, held=50, bins=32).first()
    assert (one["n"], one["q"]) == percentiles(df)[()]
    assert quantiles(df.limit(0), "x", (0.5,)).collect()[0]["q"] == [None]
    assert quantiles(df.limit(0).withColumn("c", F.lit(1)), "x", (0.5,), ("c",)).count() == 0


def test_shrunk_centroids(spark):
    import numpy as np

    from weftline.operators import models

    r = random.Random(8)
    rows = [(i, [r.gauss(c, 1) for c in ((0, 3, 0), (0, 0, 2), (0.1, 0, 0))[i % 3]], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x, y = np.array([v for _, v, _ in rows]), np.array([c for _, _, c in rows])
    mean = x.mean(0)
    d = np.stack([x[y == c].mean(0) for c in range(3)]) - mean
    want = mean + np.sign(d) * np.maximum(np.abs(d) - 0.8 * np.median(np.abs(d[d != 0])), 0)
    known = models.centroids(df, "embedding", "label")
    overall = models.centroids(df.withColumn("all", F.lit(0)), "embedding", "all")
    got = {q["label"]: q["c"] for q in models.shrunk(known, overall, 0.8).collect()}
    assert all(np.allclose(got[c], want[c]) for c in range(3))
