"""The model zoo: baselines as plans, linear and tree models by pyspark.ml, a registry by name."""

from __future__ import annotations

import ast
from collections.abc import Callable
from typing import Any

from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, hash32, norm
from . import dense, linear, trees
from .selection import quantiles


def majority(train: DataFrame, rows: DataFrame, y: str = "category") -> DataFrame:
    one = train.agg(F.mode(y, True).alias("y_pred"))
    return rows.join(F.broadcast(one))


def stratified(train: DataFrame, rows: DataFrame, key: str, y: str = "category", seed: int = 42) -> DataFrame:
    """Labels drawn by class share from a hash of the row's id: a table of cumulative shares, a range lookup by one array search."""
    c = train.groupBy(y).agg(F.count("*").alias("n"))
    shares = c.agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("label"), "n"))).alias("cs"), F.sum("n").alias("total"))
    u = hash32(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))) / float(1 << 32)
    pick = F.aggregate("cs", F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("string").alias("label")), lambda s, x: F.when(s["label"].isNotNull(), s).otherwise(F.struct((s["cum"] + x["n"] / F.col("total")).alias("cum"), F.when(F.col("_u") < s["cum"] + x["n"] / F.col("total"), x["label"]).alias("label"))))
    return rows.withColumn("_u", u).join(F.broadcast(shares)).withColumn("y_pred", F.coalesce(pick["label"], F.element_at("cs", -1)["label"])).drop("cs", "total", "_u")


def constant(train: DataFrame, rows: DataFrame, y: str, how: str = "median") -> DataFrame:
    one = train.agg((F.median(y) if how == "median" else F.avg(y)).alias("p"))
    return rows.join(F.broadcast(one))


def group_median(train: DataFrame, rows: DataFrame, key: str, y: str) -> DataFrame:
    """The median of the row's group in training, else the global one."""
    groups = train.groupBy(key).agg(F.median(y).alias("g"))
    return constant(train, rows.join(groups, key, "left"), y).withColumn("p", F.coalesce("g", "p")).drop("g")


def keyword_weights(train: DataFrame, text: str, y: str, least: int = 3) -> DataFrame:
    """(token, label, weight): share of the class among rows with the token, for tokens of `least` rows or more."""
    tokens = train.select(F.col(y).alias("label"), F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))).alias("token"))
    by = tokens.groupBy("token", "label").agg(F.count("*").alias("n"))
    total = by.groupBy("token").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    return by.join(total, "token").select("token", "label", (F.col("n") / F.col("total")).alias("weight"))


def keyword(train: DataFrame, rows: DataFrame, key: str, text: str, y: str, least: int = 3) -> DataFrame:
    """(key, y_pred): the label of the highest summed weight, ties to the smallest; without known tokens the most common label."""
    weights = keyword_weights(train, text, y, least)
    tokens = rows.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))).alias("token"))
    sums = tokens.join(weights, "token").groupBy(key, "label").agg(F.round(F.sum("weight"), 9).alias("s"))
    best = sums.groupBy(key).agg(F.min_by("label", F.struct(-F.col("s"), "label")).alias("best"))
    return majority(train, rows.select(key).join(best, key, "left"), y).select(key, F.coalesce("best", "y_pred").alias("y_pred"))


def centroids(train: DataFrame, vector: str, y: str) -> DataFrame:
    """(label, c): mean vector of each class, dimension by dimension, partial sums before the shuffle."""
    d = train.select(F.col(y).alias("label"), F.posexplode(vector).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def shrunk(table: DataFrame, overall: DataFrame, threshold: float) -> DataFrame:
    """Centroids (label, c) drawn towards the overall mean (c): each difference loses `threshold` times the median size of the differences that aren't
    zero, and smaller ones vanish, so a component that tells a class from the others little tells nothing."""
    both = table.select("label", F.posexplode("c").alias("i", "x")).join(overall.select(F.posexplode("c").alias("i", "m")), "i")
    moved = both.select("label", "i", "m", (F.col("x") - F.col("m")).alias("d"))
    cut = quantiles(moved.where("d <> 0"), F.abs("d"), (0.5,)).select(F.coalesce(threshold * F.col("q")[0], F.lit(0.0)).alias("cut"))
    kept = moved.join(F.broadcast(cut)).select("label", "i", (F.col("m") + F.signum("d") * F.greatest(F.abs("d") - F.col("cut"), F.lit(0.0))).alias("x"))  # one row
    return kept.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))


def nearest_centroid(train: DataFrame, rows: DataFrame, key: str, vector: str, y: str, threshold: float = 0.0) -> DataFrame:
    """(key, y_pred): the class whose centroid has the largest cosine; centroids are a row per class, shrunk by a threshold if there is one."""
    known = centroids(train, vector, y)
    if threshold:
        known = shrunk(known, centroids(train.withColumn("_all", F.lit(0)), vector, "_all"), threshold)
    table = known.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("cs"))
    scored = F.transform("cs", lambda s: F.struct((-F.round(dot(vector, s["c"]) / norm(s["c"]), 9)).alias("s"), s["label"].alias("label")))
    return rows.join(F.broadcast(table)).select(key, F.array_min(scored)["label"].alias("y_pred"))


def nearest_rows(train: DataFrame, queries: DataFrame, key: str, vector: str, k: int, blocks: int = 16) -> DataFrame:
    """(query, key, score, rank): exact cosine neighbours by blocks.

    Queries and rows are dealt into `blocks` blocks each (to be set so that a block fits a task), pairs of blocks are compared as
    matrices, and only k + 1 rows per query and block come out; ties go to the smaller key.
    """
    import numpy as np
    import pandas as pd

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name))  # of the type of the other side's numbers, by which rows are dealt

    q, r = packed(queries, "qb"), packed(train, "rb")
    spread = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["query", "id", "score"])
        unit = lambda x: (m := np.array(x["v"].tolist(), float)) / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
        ub, ids, out = unit(b), b["id"].to_numpy(), []
        for query, row in zip(a["id"], unit(a)):
            s = np.round(ub @ row, 9)
            top = np.lexsort((ids, -s))[: k + 1]
            out += [(query, int(ids[i]), float(s[i])) for i in top]
        return pd.DataFrame(out, columns=["query", "id", "score"])

    found = spread.groupBy("rb", "qb").cogroup(r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("rb", "qb")).applyInPandas(compare, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.where("query <> id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(train: DataFrame, queries: DataFrame, key: str, vector: str, y: str, k: int = 5) -> DataFrame:
    """(key, y_pred): distance-weighted vote of the k nearest; ties to the smallest label."""
    votes = nearest_rows(train, queries, key, vector, k).join(train.select(F.col(key).alias("id"), F.col(y).alias("label")), "id")
    sums = votes.groupBy("query", "label").agg(F.round(F.sum(1 / F.greatest(1 - F.col("score"), F.lit(1e-9))), 6).alias("s"))
    return sums.groupBy("query").agg(F.min_by("label", F.struct(-F.col("s"), "label")).alias("y_pred")).withColumnRenamed("query", key)


def _linear(**p: Any) -> GrownEstimator:
    return GrownEstimator(linear.fit_linear, linear.LinearConfig(**p))


class GrownEstimator:
    """A model of operators.trees or operators.linear as an estimator of (features, label[, weight]); unknown parameters are errors."""

    def __init__(self, grow: Callable, config: Any, weight: str | None = None):
        self.grow, self.config, self.weight = grow, config, weight

    def setWeightCol(self, name: str) -> GrownEstimator:
        return GrownEstimator(self.grow, self.config, name)

    def fit(self, train: DataFrame):
        return self.grow(train, self.config, weight=self.weight)


def _boost(**p: Any) -> GrownEstimator:
    return GrownEstimator(trees.boost, trees.BoostConfig(**p))


def _calibrated(train: DataFrame, config: linear.LinearConfig, weight: str | None = None):
    """Folds by a hash of features and label, so that copies stay together."""
    return linear.fit_calibrated(train.withColumn("_key", F.xxhash64(F.to_json(F.struct(F.col("label"), trees.stored(train, "features").alias("f"))))), config, "_key", weight=weight)


class DenseEstimator:
    """The dense head as an estimator of (features, label[, weight]); a tenth of the rows, by a hash, stops it. Width and classes are read from the rows."""

    def __init__(self, weight: str | None = None, **parameters: Any):
        dense.DenseConfig(**({"width": 1, "outputs": 2} | parameters))  # unknown parameters are errors
        self.weight, self.parameters = weight, parameters

    def setWeightCol(self, name: str) -> DenseEstimator:
        return DenseEstimator(name, **self.parameters)

    def fit(self, train: DataFrame):
        keyed = train.withColumn("_id", F.xxhash64(F.to_json(F.struct(F.col("label"), trees.stored(train, "features").alias("f")))))
        held = keyed.withColumn("_held", F.pmod(F.col("_id"), F.lit(10)) == 0)
        size = trees.entries(train, "features", "label").agg(F.max(F.array_max("index")).alias("f"), F.max("label").alias("y")).first()
        found = {"width": (size["f"] or 0) + 1, "outputs": max(2, int(size["y"] or 0) + 1)} if self.parameters.get("loss") != "smooth_l1" else {"width": (size["f"] or 0) + 1, "outputs": 1}
        return dense.train_dense(held, dense.DenseConfig(**(found | self.parameters)), key="_id", held="_held", weight=self.weight)


# Registry: name -> factory of an unfitted estimator over (features, label[, weight]).
CLASSIFIERS: dict[str, Callable[..., Any]] = {
    "logreg": lambda **p: LogisticRegression(**({"maxIter": 100, "regParam": 1e-3, "family": "multinomial"} | p)),
    "svm": lambda **p: _linear(**({"loss": "squared_hinge", "c": 1.0} | p)),
    "svm_plain": lambda **p: _linear(**({"loss": "squared_hinge", "c": 1.0} | p)),
    "nb": lambda **p: NaiveBayes(**({"modelType": "complement", "smoothing": 1.0} | p)),
    "sgd": lambda **p: _linear(**({"loss": "hinge", "alpha": 1e-4} | p)),
    "svm_calibrated": lambda **p: GrownEstimator(_calibrated, linear.LinearConfig(**({"loss": "squared_hinge", "c": 0.5} | p))),
    "rf": lambda **p: RandomForestClassifier(**({"numTrees": 100, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 2, "maxDepth": 10, "seed": 42} | p)),
    "rf100": lambda **p: RandomForestClassifier(**({"numTrees": 100, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 2, "maxDepth": 8, "seed": 42} | p)),
    "extra": lambda **p: GrownEstimator(trees.extra_trees, trees.ExtraConfig(**p)),
    "gbt": lambda **p: _boost(**({"loss": "softmax", "rounds": 100, "rate": 0.3, "depth": 6, "columns": 0.3} | p)),
    "dense": lambda **p: DenseEstimator(**p),
}
REGRESSORS: dict[str, Callable[..., Any]] = {
    "linreg": lambda **p: LinearRegression(**({"regParam": 0.0} | p)),
    "ridge": lambda **p: LinearRegression(**({"regParam": 0.01, "elasticNetParam": 0.0} | p)),
    "gbt": lambda **p: _boost(**({"loss": "l1", "rounds": 200, "rate": 0.1, "depth": 6, "columns": 0.6} | p)),
    "gbt_q10": lambda **p: _boost(**({"loss": "quantile", "alpha": 0.1, "rounds": 200, "rate": 0.1, "depth": 6, "columns": 0.6} | p)),
    "gbt_q90": lambda **p: _boost(**({"loss": "quantile", "alpha": 0.9, "rounds": 200, "rate": 0.1, "depth": 6, "columns": 0.6} | p)),
}


def build(name: str, regression: bool = False, **overrides: Any):
    """An estimator of the registry with overrides; unknown names and parameters are errors."""
    table = REGRESSORS if regression else CLASSIFIERS
    if name not in table:
        raise KeyError(f"unknown model {name}; known: {', '.join(sorted(table))}")
    try:
        return table[name](**overrides)
    except TypeError as e:
        raise KeyError(f"{name}: {e}") from None


#: Models of the registry that weigh classes alike, by a column `weight` of the rows.
BALANCED = ("logreg", "svm", "svm_calibrated", "sgd", "rf", "rf100", "extra", "gbt", "dense")


def balanced(train: DataFrame, label: str = "label") -> DataFrame:
    """Rows with `weight`: rows / (classes * rows of the class)."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row
    return train.join(weights, label)


def fit(name: str, train: DataFrame, regression: bool = False, **overrides: Any):
    """A fitted model of the registry; those in BALANCED on rows with class weights."""
    estimator = build(name, regression, **overrides)
    if regression or name not in BALANCED:
        return estimator.fit(train)
    return estimator.setWeightCol("weight").fit(balanced(train))


def parse_overrides(items: list[str]) -> dict[str, Any]:
    """KEY=VALUE pairs; values are literals where they parse as such, else text."""
    out: dict[str, Any] = {}
    for item in items:
        key, sign, value = item.partition("=")
        if not sign or not key:
            raise ValueError(f"{item!r} is not KEY=VALUE")
        try:
            out[key] = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            out[key] = value
    return out


def model_label(name: str, overrides: dict[str, Any]) -> str:
    return f"{name}({', '.join(f'{k}={v}' for k, v in overrides.items())})" if overrides else name
