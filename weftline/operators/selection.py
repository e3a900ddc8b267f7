"""Exact quantiles of any number of values: ranges that hold the wanted places are narrowed pass by pass, so no state holds all distinct values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, written

#: Bins that a range is cut into, and values that one state may hold in the end.
BINS, HELD = 4096, 100_000


def quantiles(df: DataFrame, value: str | Column, shares: tuple[float, ...], keys: tuple[str, ...] = (), held: int = HELD, bins: int = BINS) -> DataFrame:
    """(keys, n, q): for each class, the number of values and their quantiles at the shares, linear between neighbours, as percentile() gives them.

    Null and non-finite values play no part; a class of such values only has n = 0 and null quantiles. A class may be null. The least
    and the greatest value of a range always fall into different bins, so ranges shrink to what `held` values or one value fill.
    """
    x = F.col(value) if isinstance(value, str) else value
    own, keys = keys, tuple(f"_k{i}" for i in range(len(keys)))  # whatever the classes' columns are called
    named = df.select(*(F.col(c).alias(k) for c, k in zip(own, keys)), x.cast("double").alias("_x"))
    rows = written(named.select(*keys, F.when(F.abs("_x") < float("inf"), F.col("_x")).alias("_x")), "values")
    stats = written(rows.groupBy(*keys).agg(F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")), "value-counts")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)))
    places = stats.where("n > 0").select(*keys, "n", "lo", "hi", F.inline(wanted)).withColumn("at", (F.col("n") - 1) * F.col("p"))
    sides = F.array(F.floor("at"), F.ceil("at"))
    # a target is a place from 0; `below` values are less than its range, which holds `inside`
    targets = places.withColumn("place", F.explode(F.array_distinct(sides))).select(*keys, "place", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct()
    targets = written(targets, "targets")
    while targets.where((F.col("inside") > held) & (F.col("lo") < F.col("hi"))).limit(1).count():
        last, targets = targets, written(_narrowed(rows, targets, keys, held, bins), "targets")
        forget(last)
    found = written(_values(rows, targets, keys), "found")
    ends = places.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    at = lambda side: found.select(*keys, F.col("place").alias(side), F.col("x").alias(f"x_{side}"))
    both = _joined(_joined(ends, at("low"), (*keys, "low")), at("high"), (*keys, "high"))
    value = F.when(F.col("low") == F.col("high"), F.col("x_low")).otherwise((F.col("high") - F.col("at")) * F.col("x_low") + (F.col("at") - F.col("low")) * F.col("x_high"))
    q = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))).alias("q")).withColumn("q", F.transform("q", lambda s: s["x"]))
    none = F.array(*(F.lit(None).cast("double") for _ in shares))
    out = _joined(stats.select(*keys, "n"), q, keys, "left").select(*keys, "n", F.coalesce(F.when(F.size("q") > 0, F.col("q")), none).alias("q"))
    out = written(out.select(*(F.col(k).alias(c) for c, k in zip(own, keys)), "n", "q"), "quantiles")
    forget(rows, stats, targets, found)
    return out


def _joined(a: DataFrame, b: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Rows with equal keys, null to null; columns of b beyond the keys come behind."""
    if not on:
        return a.join(b, how=how) if how == "inner" else a.join(b, F.lit(True), how)  # one row each
    same = reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on))
    return a.alias("a").join(b.alias("b"), same, how).select(*(F.col(f"a.{c}") for c in a.columns), *(F.col(f"b.{c}") for c in b.columns if c not in a.columns))


def _narrowed(rows: DataFrame, targets: DataFrame, keys: tuple[str, ...], held: int, bins: int) -> DataFrame:
    """Each target with the bin of its range that it falls into, as its new range; small ranges stay."""
    small = (F.col("inside") <= held) | (F.col("lo") >= F.col("hi"))
    open_ = targets.where(~small)
    ranges = open_.select(*keys, "lo", "hi").distinct()
    inside = _within(rows, ranges, keys)
    wide = F.col("hi") - F.col("lo")
    share = F.when(wide < float("inf"), (F.col("_x") - F.col("lo")) / wide).otherwise((F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
    cells = inside.withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1))).groupBy(*keys, "lo", "hi", "bin").agg(F.count("*").alias("c"), F.min("_x").alias("first"), F.max("_x").alias("last"))
    before = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # bins of a range
    cells = cells.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    met = _joined(open_, cells, (*keys, "lo", "hi"))
    own = met.where((F.col("place") >= F.col("below") + F.col("before")) & (F.col("place") < F.col("below") + F.col("before") + F.col("c")))
    return targets.where(small).unionByName(own.select(*keys, "place", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("inside")))


def _within(rows: DataFrame, ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with each range of their class that they fall into."""
    x, low, high = F.col("r._x"), F.col("t.lo"), F.col("t.hi")
    on = reduce(and_, (F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys), (x >= low) & (x <= high))
    ranges = ranges if keys else F.broadcast(ranges)  # two ranges for each share
    return rows.alias("r").join(ranges.alias("t"), on).select(*(F.col(f"r.{c}") for c in keys), "_x", "lo", "hi")


def _values(rows: DataFrame, targets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, place, x): ranges of one value give it; the few values of others are sorted."""
    one = targets.where("lo = hi").select(*keys, "place", F.col("lo").alias("x"))
    open_ = targets.where("lo < hi")
    lists = _within(rows, open_.select(*keys, "lo", "hi").distinct(), keys).groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list("_x")).alias("xs"))  # `held` values at most
    return one.unionByName(_joined(open_, lists, (*keys, "lo", "hi")).select(*keys, "place", F.element_at("xs", (F.col("place") - F.col("below") + 1).cast("int")).alias("x")))
