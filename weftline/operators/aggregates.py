"""Descriptive statistics as single aggregations (quantiles are exact)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import filled
from .selection import quantiles

QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, rate) in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(filled(c)).alias(c) for c in columns))
    return one.unpivot(["n"], columns, "column", "filled").select("column", "filled", F.round(F.col("filled") / F.col("n"), 6).alias("rate"))


def sample_skew(c: str) -> Column:
    """Skewness with the correction for samples."""
    n, g = F.count(c), F.skewness(c)
    return g * F.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(c: str) -> Column:
    n, g = F.count(c), F.kurtosis(c)
    return ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3))


def describe(df: DataFrame, c: str, thresholds: tuple[float, ...] = (50.0, 100.0)) -> DataFrame:
    stats = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), sample_skew(c).alias("skew"), sample_kurtosis(c).alias("kurtosis"), F.min(c).alias("low"), F.max(c).alias("high"), *(F.count_if(F.col(c) >= t).alias(f"over_{int(t)}") for t in thresholds)).join(F.broadcast(quantiles(df, c, QUANTILES).select("q")), how="left")  # one row
    q = {p: F.col("q")[i] for i, p in enumerate(QUANTILES)}
    iqr = q[0.75] - q[0.25]
    r = lambda x: F.round(x, 4)
    return stats.select("n", *(r(F.col(x)).alias(x) for x in ("mean", "sd", "skew", "kurtosis", "low", "high")), *(r(v).alias(f"p{int(100 * p)}") for p, v in q.items()), r(iqr).alias("iqr"), r(q[0.25] - 1.5 * iqr).alias("fence_low"), r(q[0.75] + 1.5 * iqr).alias("fence_high"), *(f"over_{int(t)}" for t in thresholds))


def per_category(df: DataFrame, category: str = "category", value: str = "salary_mid", disclosed: str = "salary_disclosed") -> DataFrame:
    v = F.when(F.col(disclosed) == 1, F.col(value))
    out = df.groupBy(category).agg(F.count("*").alias("n"), F.sum(disclosed).alias("n_disclosed"), F.max(v).alias("high"))
    cut = quantiles(df, v, (0.5, 0.25, 0.75, 0.95), (category,)).select(F.col(category).alias("_class"), *(F.col("q")[i].alias(name) for i, name in enumerate(("median", "p25", "p75", "p95"))))
    out = out.join(cut, F.col(category).eqNullSafe(F.col("_class")), "left").drop("_class")
    total = out.agg(F.sum("n").alias("total"))
    r = lambda x: F.round(x, 4)
    return out.join(F.broadcast(total)).select(category, "n", r(F.col("n") / F.col("total")).alias("share"), "n_disclosed", r(F.col("n_disclosed") / F.col("n")).alias("rate"), *(r(F.col(x)).alias(x) for x in ("median", "p25", "p75", "p95", "high")), r(F.col("p75") - F.col("p25")).alias("iqr"))


def sizes(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, category: str) -> DataFrame:
    """Rank by size: windows over class counts, a handful of rows."""
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), category)))


def value_counts(df: DataFrame, category: str) -> DataFrame:
    c = sizes(df, category)
    total = c.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"))
    return c.join(F.broadcast(total)).select(category, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(F.col("most") / F.col("least"), 6).alias("imbalance"))


def gini(df: DataFrame, category: str) -> DataFrame:
    x = sizes(df, category).withColumn("i", F.row_number().over(Window.orderBy("n", category)))
    n = F.count("*")
    return x.agg(F.round(F.sum((2 * F.col("i")) * F.col("n")) / (n * F.sum("n")) - (n + 1) / n, 6).alias("gini"))


def zipf_slope(df: DataFrame, category: str) -> DataFrame:
    return ranked(sizes(df, category), category).agg(F.round(F.regr_slope(F.ln("n"), F.ln("rank")), 6).alias("slope"))


def top_share(df: DataFrame, category: str, k: int = 4) -> DataFrame:
    x = ranked(sizes(df, category), category)
    t = x.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.avg("n").alias("mean_size"), F.median("n").alias("median_size"))
    y = x.join(F.broadcast(t))
    return y.agg(*(F.round(e, 6).alias(a) for a, e in (("top", F.sum(F.when(F.col("rank") <= k, F.col("n"))) / F.max("total")), ("bottom", F.sum(F.when(F.col("rank") > F.col("k") - k, F.col("n"))) / F.max("total")), ("mean_size", F.max("mean_size")), ("median_size", F.max("median_size")))), F.count_if(F.col("n") < F.col("total") / F.col("k")).alias("below_uniform"))


def average_rank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Ranks with ties averaged."""
    w = Window.orderBy(c)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, by the incomplete beta function's continued fraction."""
    import math

    if n <= 2 or abs(r) >= 1:
        return 0.0 if n > 2 else 1.0
    df = n - 2
    x, a, b = 1 - r * r, df / 2, 0.5  # df / (df + t^2) = 1 - r^2
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if 0 < x < 1 else 0.0
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    value = front * (f - 1)
    return 1 - value if swap else value


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation over n pairs, for result rows."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if a != a else student_p(float(a), int(b)) for a, b in zip(r, n)])

    return p(r, n)


def eta_squared(df: DataFrame, category: str, c: str) -> DataFrame:
    """Share of variance between categories."""
    g = df.groupBy(category).agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.sum(F.col(c) * F.col(c)).alias("s2"), F.median(c).alias("med"))
    grand = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    return g.join(F.broadcast(grand)).agg(F.round(F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))) / (F.sum("s2") - F.sum("n") * F.max("grand") * F.max("grand")), 6).alias("eta2"), F.min_by(category, F.struct("med", category)).alias("lowest"), F.max_by(category, F.struct("med", category)).alias("highest"))


def histogram(df: DataFrame, c: str, width: float, bins: int) -> DataFrame:
    """Fixed bins, values beyond the last one in it."""
    return df.where(F.col(c).isNotNull()).groupBy(F.least(F.floor(F.col(c) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def truncation(df: DataFrame, c: str, limits: tuple[int, ...]) -> DataFrame:
    """For each limit: share of rows that are longer, and share of length kept."""
    one = df.agg(*(e.alias(f"{k}_{m}") for m in limits for k, e in (("cut", F.avg((F.col(c) > m).cast("int"))), ("kept", F.sum(F.least(F.col(c), F.lit(m))) / F.sum(c)))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("most"), F.round(f"cut_{m}", 6).alias("cut"), F.round(f"kept_{m}", 6).alias("kept")) for m in limits))))


def document_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def class_weights(df: DataFrame, category: str) -> DataFrame:
    """Balanced: rows / (classes * rows of the class)."""
    c = sizes(df, category)
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.join(F.broadcast(t)).select(category, F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))
