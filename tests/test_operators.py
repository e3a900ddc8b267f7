import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import aggregates as A
from weftline.operators import metrics as M
from weftline.operators.models import build
from weftline.plans import splits
from weftline.sources import tables as S
from weftline.streaming.rows import windowed_counts


@pytest.fixture(scope="module")
def pred(spark):
    return spark.range(300).select(F.col("id").alias("row_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("y_true")).withColumn("y_pred", F.when(F.col("row_id") % 4 == 0, "a").otherwise(F.col("y_true")))


def test_perfect_model(pred):
    perfect = pred.withColumn("y_pred", F.col("y_true"))
    row = M.classification(M.confusion(perfect)).first()
    assert set(row) == {1.0}
    boots = M.boot_scores(perfect, 20)
    s = M.boot_summary(boots, "f1_macro").first()
    assert s["mean"] == 1.0 and s["sd"] == 0.0
    d = M.paired(boots, M.boot_scores(pred, 20), "f1_macro").first()
    assert d["p_better"] == 1.0 and d["ci_lo"] > 0


def test_bootstrap_is_seeded(pred):
    a, b = M.boot_scores(pred, 10).orderBy("boot").collect(), M.boot_scores(pred, 10).orderBy("boot").collect()
    assert a == b
    tie = M.paired(M.boot_scores(pred, 10), M.boot_scores(pred, 10), "accuracy").first()
    assert tie["mean"] == 0 and tie["p_better"] == 0.5


def test_paired_needs_equal_resamples(pred):
    with pytest.raises(Exception, match="resamples differ"):
        M.paired(M.boot_scores(pred, 10), M.boot_scores(pred, 9), "accuracy").collect()


def test_splits(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 400).cast("string").alias("group_id"), (F.col("id") % 5).cast("string").alias("category"), F.lit(1).alias("salary_disclosed"))
    for split in (splits.two_stage_split(rows), splits.hash_split(rows)):
        assert splits.straddling(split).count() == 0
        assert split.where("split IS NULL").count() == 0
    n = {r["split"]: r["rows"] for r in splits.split_counts(splits.two_stage_split(rows)).collect()}
    assert abs(n["test"] - 400) <= 25 and abs(n["dev"] - 160) <= 25
    assert splits.two_stage_split(rows).where("split = 'train'").select("category").distinct().count() == 5


def test_write_and_read_splits(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("group_id"), F.lit("x").alias("category"))
    path = str(tmp_path / "splits")
    manifest = S.write_splits(splits.hash_split(rows), path)
    assert sum(v["rows"] for v in manifest["splits"].values()) == 100
    assert S.read_split(spark, path, "test", manifest).count() == manifest["splits"]["test"]["rows"]
    with pytest.raises(ValueError):
        S.read_split(spark, path, "test", manifest | {"columns": {"a": "int"}})
    with pytest.raises(ValueError):
        S.write_splits(rows.withColumn("group_id", F.lit("g")).withColumn("split", (F.monotonically_increasing_id() % 2).cast("string")), path)


def test_raw_csv_keeps_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n"line\none ""q""",nan\n,2\n')
    rows = S.read_raw_csv(spark, str(tmp_path / "x.csv"), ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [('line\none "q"', "nan"), (None, "2")]


def test_registry():
    with pytest.raises(KeyError):
        build("nope")
    with pytest.raises(KeyError):
        build("logreg", nonsense=1)


def test_student_p():
    assert abs(A.student_p(0.5, 20) - 0.0248) < 2e-3 and A.student_p(0.0, 10) == pytest.approx(1.0)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(200).select((F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("w").collect()) == key(windowed_counts(events).collect())


def test_resample_weights(spark):
    """Poisson(1) in each resample, and apart between resamples and rows."""
    rows = spark.range(4000).select(M.hash32(F.concat(F.col("id"), F.lit(":7"))).alias("h"), "id")
    w = lambda b: M.poisson_weight(M.resample_share(F.col("h"), F.lit(b).cast("long")))
    x = rows.select("id", *(w(b).alias(f"w{b}") for b in range(6)))
    means = x.agg(*(F.avg(f"w{b}") for b in range(6)), *(F.var_samp(f"w{b}") for b in range(6))).first()
    assert all(abs(v - 1) < 0.1 for v in means)
    between = x.agg(*(F.corr(f"w{a}", f"w{b}") for a in range(6) for b in range(a))).first()
    assert all(abs(v) < 0.08 for v in between)
    zeros = x.agg(F.avg((F.col("w0") == 0).cast("int")), F.avg((F.col("w3") >= 3).cast("int"))).first()
    assert abs(zeros[0] - math.exp(-1)) < 0.03 and abs(zeros[1] - 0.0803) < 0.02
