from weftline.operators import features as E
from weftline.plans import cleaning


def test_exact_copies_go_whatever_their_ids_are(spark):
    rows = [(5, "Kỹ sư", "Hà Nội", "it", "raw"), (3, "Kỹ sư", "Hà Nội", "it", "again"), (4, "Kỹ sư", None, "it", "raw"), (6, "Kỹ sư", None, "it", "raw"), (7, "Kế toán", "Hà Nội", "tài chính", "raw")]
    raw = spark.createDataFrame(rows, "doc_id long, job_title string, location string, category string, note string")
    assert sorted(r["doc_id"] for r in cleaning.clean(raw, extra=("doc_id",)).collect()) == [3, 4, 7]
    assert cleaning.clean(raw).count() == 3 and cleaning.clean(raw, dedup=False).count() == 5


def test_values_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(E, "VALUES", 2)
    df = spark.createDataFrame([(v,) for v in "aaabbcccd"], "place string")
    plan = E.FeaturePlan((), categorical=("place",), floor=1)
    rows = plan.fit(df).transform(plan.prepared(df)).select("place", "features").distinct().collect()
    hot = {r["place"]: r["features"].toArray().tolist() for r in rows}
    assert hot["a"] == [1, 0, 0] and hot["c"] == [0, 1, 0] and hot["b"] == hot["d"] == [0, 0, 1]
