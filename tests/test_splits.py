import random
from fractions import Fraction

from pyspark.sql import functions as F

from weftline.plans import splits


def fold(groups, shares, order):
    """The fold over groups, one by one."""
    names, out = list(shares), {}
    for stratum in {g[1] for g in groups}:
        own = sorted((g for g in groups if g[1] == stratum), key=lambda g: (-g[2], order[g[0]], g[0]))
        left = [Fraction(str(w)) * sum(g[2] for g in own) for w in shares.values()]
        for key, _, n in own:
            i = max(range(len(left)), key=lambda j: (left[j], -j))
            left[i] -= n
            out[key] = names[i]
    return out


def test_phases_equal_single_steps():
    r = random.Random(1)
    for _ in range(3000):
        size, n, count = r.randint(1, 4), r.randint(1, 7), r.randint(1, 60)
        left = [Fraction(r.randint(-60, 600), r.choice([1, 2, 5])) for _ in range(size)]
        found, after = splits.phases(left, n, count)
        plain, want = list(left), []
        for _ in range(count):
            i = max(range(size), key=lambda j: (plain[j], -j))
            plain[i] -= n
            want.append(i)
        got = []
        for (a, turn), z in zip(found, [*(p[0] for p in found[1:]), count + 1]):
            got += [turn[(i - a) % len(turn)] for i in range(a, z)]
        assert got == want and after == plain
        assert len(found) <= 3 * size + 2  # not with the count


def test_greedy_split_equals_the_fold(spark):
    r = random.Random(2)
    rows = [(f"g{i}", r.choice(["a", "b", None]) if i % 50 else "rare", r.choice([1, 1, 1, 1, 2, 2, 3, 5, 17])) for i in range(700)]
    df = spark.createDataFrame(rows, "group_id string, stratum string, n long")
    order = {x[0]: x[1] for x in df.select("group_id", F.xxhash64("group_id", F.lit(42))).collect()}
    for shares in ({"pool": 0.8, "test": 0.2}, {"x": 0.5, "y": 0.25, "z": 0.25}):
        got = {x["group_id"]: x["split"] for x in splits.greedy_split(df, shares, 42).collect()}
        assert got == fold(rows, shares, order)
    assert splits.greedy_split(df.limit(0), {"pool": 0.8, "test": 0.2}, 1).count() == 0


def test_places_over_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.choice("aaaaaaaab"), r.randint(0, 9)) for i in range(900)] + [(900 + i, None, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, c string, n int")
    got = {x["id"]: x["place"] for x in splits.places(df, ["c"], [F.desc("n"), F.col("id")], rows=70).collect()}
    for c in ("a", "b", None):
        own = sorted((x for x in rows if x[1] == c), key=lambda x: (-x[2], x[0]))
        assert [got[x[0]] for x in own] == list(range(1, len(own) + 1))


def test_no_task_grows_with_a_class(spark):
    """Ten times the groups of one class and size are ten times the ranges."""
    for n in (2_000, 20_000):
        df = spark.range(n).select(F.col("id").cast("string").alias("group_id"), F.lit("a").alias("stratum"), F.lit(1).cast("long").alias("n"))
        placed = splits.places(df, ["stratum"], ["group_id"], rows=500)
        tasks = placed.select(F.floor((F.col("place") - 1) / 500)).distinct().count()
        assert tasks == n // 500
    got = splits.greedy_split(df, {"pool": 0.8, "test": 0.2}, 7).groupBy("split").count().collect()
    assert {x["split"]: x["count"] for x in got} == {"pool": 16_000, "test": 4_000}
