"""Evaluation: from confusion cells and one-pass aggregates, never from collected rows."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import back_transform, hash32, relative_error
from .selection import quantiles


def confusion(pred: DataFrame, grid: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(true, pred, n); with `grid` zero cells too, over the labels that occur (two label lists, a handful of rows each)."""
    cells = pred.groupBy(*keys, F.col("y_true").alias("true"), F.col("y_pred").alias("pred")).agg(F.count("*").alias("n"))
    if not grid:
        return cells
    labels = pred.select(F.explode(F.array("y_true", "y_pred")).alias("l")).distinct()
    pairs = labels.agg(F.array_sort(F.collect_set("l")).alias("ls")).select("ls", F.explode("ls").alias("true")).select("true", F.explode("ls").alias("pred"))
    return pairs.join(cells, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(cells: DataFrame, keys: tuple[str, ...] = (), weight: str = "n") -> DataFrame:
    """label, tp, support, predicted, precision, recall, f1 of true and predicted labels; 0 where a denominator is 0."""
    w = F.col(weight)
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col("true").alias("label"), w.alias("t"), F.lit(0).cast("double").alias("p"), F.when(F.col("true") == F.col("pred"), w).otherwise(0).cast("double").alias("tp")), F.struct(F.col("pred").alias("label"), (w * 0).alias("t"), w.cast("double").alias("p"), F.lit(0.0).alias("tp")))).alias("s")).select(*keys, "s.*")
    c = sides.groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return c.select(*keys, "label", "tp", "support", "predicted", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def classification(cells: DataFrame, keys: tuple[str, ...] = (), weight: str = "n", digits: int | None = 6) -> DataFrame:
    """accuracy, macro-F1 over labels that occur, balanced accuracy over true labels, weighted F1."""
    c = per_class(cells, keys, weight)
    true = F.col("support") > 0
    r = (lambda e: F.round(e, digits)) if digits else (lambda e: e)
    return c.groupBy(*keys).agg(r(F.sum("tp") / F.sum("support")).alias("accuracy"), r(F.avg("f1")).alias("f1_macro"), r(F.avg(F.when(true, F.col("recall")))).alias("balanced_accuracy"), r(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def macro_without(cells: DataFrame, junk: str) -> DataFrame:
    """Macro-F1 on rows whose true label isn't the catch-all, over the real labels."""
    c = per_class(cells.where(F.col("true") != junk)).where(F.col("label") != junk)
    return c.agg(F.round(F.avg("f1"), 6).alias("f1_macro_no_junk"))


def top_confusions(cells: DataFrame, k: int = 10) -> DataFrame:
    return cells.where((F.col("true") != F.col("pred")) & (F.col("n") > 0)).orderBy(F.desc("n"), "true", "pred").limit(k)


def top_k_hit(scores: DataFrame, k: int = 3) -> DataFrame:
    """Share of rows whose true label is among the k best scores; rows: row_id, label, score, y_true."""
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "label")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.groupBy("row_id").agg(F.max((F.col("label") == F.col("y_true")).cast("int")).alias("hit")).agg(F.round(F.avg("hit"), 6).alias(f"top{k}"))


#: Ranges of scores that cumulative counts are split into.
RANGES = 1024


def binary(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ROC-AUC by Mann-Whitney ranks, average precision, F1 and accuracy at the threshold; all exact.

    Counts run over distinct scores. They are cut into RANGES equal ranges between the least and the largest score: each range is cumulated by itself, and
    what lies below and above it comes from the ranges' totals, so no task sees all scores.
    """
    s = pred.groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ends = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    share = (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
    s = s.join(F.broadcast(ends)).withColumn("range", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int"))  # one row
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    totals = s.groupBy("range").agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    starts = totals.select("range", F.coalesce(F.sum("all_n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("all_pos").over(before), F.lit(0)).alias("pos_before"))
    grand = s.agg(F.sum("n").alias("all_rows"), F.sum("pos").alias("all_hits"))
    up = Window.partitionBy("range").orderBy("score")
    c = s.join(F.broadcast(starts), "range").join(F.broadcast(grand))  # RANGES rows, one row
    below = F.col("n_before") + F.sum("n").over(up) - F.col("n")
    below_pos = F.col("pos_before") + F.sum("pos").over(up) - F.col("pos")
    c = c.select("score", "pos", "n", below.alias("below"), (F.col("all_hits") - below_pos).alias("tp"), (F.col("all_rows") - below).alias("above"))
    p, n = F.sum("pos"), F.sum("n")
    rank_sum = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    yes = F.col("score") >= threshold
    hits, said = F.sum(F.when(yes, F.col("pos")).otherwise(0)), F.sum(F.when(yes, F.col("n")).otherwise(0))
    out = c.agg(
        ((rank_sum - p * (p + 1) / 2) / (p * (n - p))).alias("roc_auc"), (F.sum(F.col("pos") * F.col("tp") / F.col("above")) / p).alias("average_precision"),
        (2 * hits / (said + p)).alias("f1"), ((n - p - said + 2 * hits) / n).alias("accuracy"),
    )
    return out.select(*(F.round(x, 6).alias(x) for x in out.columns))


def regression(pred: DataFrame, keys: tuple[str, ...] = (), logged: bool = True, least: int = 0) -> DataFrame:
    """MAE, MedAE, RMSE, MAPE, R2 raw and log, hits within 10 and 20 % and within 3, after back-transformation."""
    y, p = (back_transform(F.col(c), 0.0 if c == "y" else 0.5) if logged else F.col(c) for c in ("y", "p"))
    x = pred.select(*keys, y.alias("y"), p.alias("p"), F.log1p(y).alias("ly"), F.log1p(p).alias("lp"))
    e, ape = F.abs(F.col("y") - F.col("p")), relative_error(F.col("y"), F.col("p"))
    r2 = lambda a, b: 1 - F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) / (F.var_pop(a) * F.count("*"))
    out = x.groupBy(*keys).agg(F.count("*").alias("n"), *(F.round(v, 6).alias(k) for k, v in (("mae", F.avg(e)), ("rmse", F.sqrt(F.avg(e * e))), ("mape", F.avg(ape)), ("r2", r2("y", "p")), ("r2_log", r2("ly", "lp")), ("within_10", F.avg((ape <= 0.1).cast("int"))), ("within_20", F.avg((ape <= 0.2).cast("int"))), ("within_3", F.avg((e <= 3).cast("int"))))))
    middle = quantiles(x.withColumn("_e", e), "_e", (0.5,), keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.round(F.col("q")[0], 6).alias("medae"))
    out = out.join(middle, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left").drop(*(f"_{k}" for k in keys)) if keys else out.join(F.broadcast(middle), how="left")  # one row
    return out.where(F.col("n") >= least) if least else out


def tail_error(pred: DataFrame, threshold: float = 30.0) -> DataFrame:
    e = F.abs(F.col("y") - F.col("p"))
    return pred.agg(F.round(F.avg(F.when(F.col("y") >= threshold, e)), 6).alias("mae_above"), F.round(F.avg(F.when(F.col("y") < threshold, e)), 6).alias("mae_below"))


def poisson_steps(most: int = 11) -> list[float]:
    """The Poisson(1) distribution function at 0, 1, 2, ..."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(1, most + 1):
        total += term
        term /= k
        out.append(round(total, 12))
    return out


#: A prime below 2 ** 31, so squares of remainders fit a long in any engine.
PRIME = (1 << 31) - 1


def resample_share(h: Column, boot: Column) -> Column:
    """A share in (0, 1) for a row's hash and a resample: squares of remainders, so a row is hashed once however many resamples there are."""
    x = (h + boot * 1_000_003) % PRIME
    x = (x * x + boot + 1) % PRIME
    return ((x * x + h) % PRIME + 0.5) / float(PRIME)


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) draw from a share."""
    first, *rest = ((u > c).cast("int") for c in poisson_steps())
    return sum(rest, first)


def bootstrap_cells(pred: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """Weighted confusion cells of n_boot resamples: (boot, true, pred, w). Each row draws a Poisson(1) weight per resample from a hash.

    The same weights serve every model of a paired comparison, as they depend on (row, boot, seed) only; the sample size varies as
    sqrt(n), which vanishes against n at scale, and no index matrix has to exist.
    """
    rows = pred.select("y_true", "y_pred", hash32(F.concat_ws(":", F.col("row_id").cast("string"), F.lit(str(seed)))).alias("_h"))
    boots = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot")).withColumn("_u", resample_share(F.col("_h"), F.col("boot").cast("long")))
    return boots.groupBy("boot", F.col("y_true").alias("true"), F.col("y_pred").alias("pred")).agg(F.sum(poisson_weight(F.col("_u"))).alias("w")).where("w > 0")


def hashed_cells(pred: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """As bootstrap_cells, with a hash of its own for every row and resample."""
    boots = pred.select("row_id", "y_true", "y_pred", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot"))
    u = (hash32(F.concat_ws(":", F.col("row_id").cast("string"), F.col("boot").cast("string"), F.lit(str(seed)))) + 0.5) / float(1 << 32)
    return boots.withColumn("_u", u).groupBy("boot", F.col("y_true").alias("true"), F.col("y_pred").alias("pred")).agg(F.sum(poisson_weight(F.col("_u"))).alias("w")).where("w > 0")


def boot_scores(pred: DataFrame, n_boot: int = 100, seed: int = 7) -> DataFrame:
    return classification(hashed_cells(pred, n_boot, seed), ("boot",), "w", None)


def boot_summary(scores: DataFrame, metric: str) -> DataFrame:
    q = F.expr(f"percentile({metric}, array(0.025, 0.975))")
    return scores.agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"), q[0].alias("ci_lo"), q[1].alias("ci_hi"))


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Delta of two models over the same resamples: mean, sd, interval and P(a > b), ties by half; differing resamples are an error."""
    d = a.select("boot", F.col(metric).alias("a")).join(b.select("boot", F.col(metric).alias("b")), "boot", "full")
    d = d.withColumn("d", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("resamples differ"))).otherwise(F.col("a") - F.col("b")))
    q = F.expr("percentile(d, array(0.025, 0.975))")
    return d.agg(F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"), q[0].alias("ci_lo"), q[1].alias("ci_hi"), F.avg(F.when(F.col("d") > 0, 1.0).when(F.col("d") == 0, 0.5).otherwise(0.0)).alias("p_better"))


def decision(p: Column) -> Column:
    return F.when((p > 0.975) | (p < 0.025), "clear").otherwise("open")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on which two runs disagree about which rows there are or what is true: must be none."""
    x, y = a.select("row_id", F.col("y_true").alias("ya")), b.select("row_id", F.col("y_true").alias("yb"))
    return x.join(y, "row_id", "full").where(~F.col("ya").eqNullSafe(F.col("yb")))
