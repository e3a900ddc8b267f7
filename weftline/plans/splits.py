"""Leak-proof splits: groups stay whole, strata keep their shares."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash32
from ..sources.scratch import written


def shuffled(df: DataFrame, key: str, within: str, seed: int, ranges: int = 256) -> DataFrame:
    """Rows with `place`, from 1: a seeded order of the rows of each class, by a hash of the key, ties by the key.

    Hashes are cut into ranges that are counted first and ordered each by itself, so a class of any size is spread over tasks.
    """
    h = hash32(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("_h", h).withColumn("_range", F.floor(F.col("_h") * ranges / float(1 << 32)).cast("int"))
    counts = rows.groupBy(within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # `ranges` rows of a class
    starts = counts.select(within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(within, "_range").orderBy("_h", key))
    return rows.join(starts, [within, "_range"]).withColumn("place", (F.col("_start") + own).cast("int")).drop("_h", "_range", "_start")


def group_stats(df: DataFrame, key: str = "group_id", stratum: str = "category") -> DataFrame:
    """Per group: rows and the most frequent stratum, ties to the smallest."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.mode(stratum, True).alias("stratum"))


def places(df: DataFrame, within: list[str], order: list[str | Column], name: str = "place", rows: int = 200_000) -> DataFrame:
    """df with each row's place, from 1, in its class by an order without ties, as a written table.

    Rows are dealt by ranges of (class, order), about `rows` to a range, and numbered in each; a range's counts by class give where the next one
    begins. So a class of any size is spread over as many tasks as it needs.
    """
    count = df.count()
    sorted_ = df.repartitionByRange(max(1, -(-count // rows)), *within, *order).sortWithinPartitions(*within, *order).withColumn("_id", F.monotonically_increasing_id())
    dealt = written(sorted_.withColumn("_range", F.shiftright("_id", 33)), "places")
    starts = dealt.groupBy(*within, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ranges that a class has rows in
    starts = starts.select(*within, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*within, "_range")]  # a class may be null
    return dealt.alias("d").join(starts.alias("s"), reduce(and_, same)).select(*(F.col(f"d.{c}") for c in df.columns), (F.col("_id") + F.col("_start")).cast("long").alias(name))


def phases(left: list[Fraction], n: int, count: int) -> tuple[list[tuple[int, list[int]]], list[Fraction]]:
    """Who gets `count` groups of n rows one after another, each the split that lacks most rows, ties to the first; and what the splits lack then.

    A split that lacks more than all others gets groups until the next one lacks as much, then they take turns, and so on: each phase is (the place
    that it begins at, from 1, and the splits that take turns in it).
    """
    size, out, place = len(left), [], 0
    lacks = list(left)
    while place < count:
        order = sorted(range(size), key=lambda j: (-lacks[j], j))
        top = order[0]
        # those who get a group before the first one's turn comes again
        turn = [j for j in order if j == top or (lacks[j], -j) > (lacks[top] - n, -top)]
        rest = [j for j in order if j not in turn]
        rounds = -(-(count - place) // len(turn))
        for j in rest:  # until another one lacks more than the first of the turn has left
            i = max(0, int((lacks[top] - lacks[j]) // n) - 1)
            while (lacks[top] - i * n, -top) > (lacks[j], -j):
                i += 1
            rounds = min(rounds, max(1, i - 1))
        out.append((place + 1, turn))
        given = min(count - place, rounds * len(turn))
        for k, j in enumerate(turn):
            lacks[j] -= n * (given // len(turn) + (k < given % len(turn)))
        place += given
    return out, lacks


def greedy_split(groups: DataFrame, shares: dict[str, float], seed: int, key: str = "group_id") -> DataFrame:
    """(key, split): in each stratum the largest groups first, in seeded order among equals, each to the split that lacks most rows.

    Groups of one size are a run: what the splits lack at its start says who gets which place, so the fold goes over a stratum's
    distinct sizes, of which there are at most the root of twice its rows, and groups find their place in a run by ranges.
    """
    names, want = list(shares), [Fraction(str(w)) for w in shares.values()]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n", ascending=False)
        left, out = [w * int((frame["n"] * frame["count"]).sum()) for w in want], []
        for n, count in zip(frame["n"].tolist(), frame["count"].tolist()):
            found, left = phases(left, n, count)
            out.append([{"since": a, "turn": [names[j] for j in turn]} for a, turn in found])
        return pd.DataFrame({"stratum": frame["stratum"], "n": frame["n"], "phases": out})

    placed = places(groups.withColumn("_order", F.xxhash64(F.col(key), F.lit(seed))).select(key, "stratum", "n", "_order"), ["stratum", "n"], ["_order", key])
    runs = groups.groupBy("stratum", "n").count().groupBy("stratum").applyInPandas(fold, "stratum string, n long, phases array<struct<since:long,turn:array<string>>>")
    own = F.element_at(F.filter("phases", lambda x: x["since"] <= F.col("place")), -1)
    split = F.get(own["turn"], ((F.col("place") - own["since"]) % F.size(own["turn"])).cast("int"))
    same = F.col("p.stratum").eqNullSafe(F.col("r.stratum")) & (F.col("p.n") == F.col("r.n"))
    return placed.alias("p").join(runs.alias("r"), same).select(key, split.alias("split"))


def two_stage_split(df: DataFrame, seed: int = 42, key: str = "group_id", stratum: str = "category") -> DataFrame:
    """Rows with split: 80 % pool and 20 % test, then 90 % train and 10 % dev of the pool."""
    groups = group_stats(df, key, stratum)
    first = greedy_split(groups, {"pool": 0.8, "test": 0.2}, seed, key)
    pool = groups.join(first.where("split = 'pool'").select(key), key)
    second = greedy_split(pool, {"train": 0.9, "dev": 0.1}, seed + 1, key)
    final = first.join(second.withColumnRenamed("split", "stage2"), key, "left").select(key, F.coalesce("stage2", "split").alias("split"))
    return df.join(final, key, "left")


def hash_split(df: DataFrame, key: str = "group_id", salt: str = "") -> DataFrame:
    """Rows with split by a hash of their group: 72 / 8 / 20 %; no shuffle at all, and the same for any subset of the rows."""
    h = hash32(F.concat(F.col(key).cast("string"), F.lit(salt))) % 100
    return df.withColumn("split", F.when(h < 20, "test").when(h < 28, "dev").otherwise("train"))


def split_counts(df: DataFrame, key: str = "group_id") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(key).alias("groups"), F.sum("salary_disclosed").alias("disclosed"), F.count_distinct("category").alias("categories"))


def straddling(df: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups in more than one split: must be none."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
