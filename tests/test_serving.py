"""Stored models: fitted on the assembled features of every scope, loaded again, applied to a batch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import features as E
from weftline.operators import metrics as M
from weftline.plans import cleaning, serving, splits


@pytest.fixture(scope="module")
def postings(spark):
    r = random.Random(1)
    kinds = {"it": "kỹ sư phần mềm máy chủ dữ liệu", "sale": "nhân viên bán hàng khách hàng doanh số"}
    rows = []
    for i in range(160):
        kind = "it" if i % 2 else "sale"
        words = kinds[kind].split()
        text = " ".join(r.choice(words) for _ in range(12))
        pay = (15 if kind == "it" else 8) + i % 5
        rows.append((i, text, f"{text} lương {pay} triệu", text, kind, str(pay) if i % 4 else "", str(pay + 5) if i % 4 else "", "['Python', 'SQL']", "hà nội" if i % 3 else "cần thơ", "2 năm"))
    names = "doc_id long, job_title string, description string, requirements_text string, category string, salary_min string, salary_max string, technical_skills string, location string, experience_required string"
    return spark.createDataFrame(rows, names)


def test_stored_models_predict_a_batch(spark, postings, tmp_path):
    path = str(tmp_path)
    clean = cleaning.clean(postings, extra=("doc_id",))
    clean.write.parquet(f"{path}/rows")
    few = {"maxIter": 15}
    serving.fit_served(spark.read.parquet(f"{path}/rows"), path, "full", {"category": few, "disclosed": few})
    got = serving.predict(cleaning.clean(postings, targets=False, extra=("doc_id",)), "doc_id", path, "full").collect()
    first = {r["doc_id"]: r for r in got if r["rank"] == 1}
    assert len(first) == 160 and len(got) == 320
    assert sum(r["label"] == ("it" if i % 2 else "sale") for i, r in first.items()) >= 155
    assert all(0 <= r["disclosed"] <= 1 and r["salary"] >= 0.5 for r in got)
    pay = [(r["salary"], (15 if i % 2 else 8) + i % 5 + 2.5) for i, r in first.items() if i % 4]
    assert sum(abs(math.log(a / b)) for a, b in pay) / len(pay) < 0.25


def test_pay_tasks_read_masked_text_only():
    for task in ("salary", "disclosed"):
        plan = serving.feature_plan(task)
        assert not set(plan.texts) & set(cleaning.FORBIDDEN) and "description_masked" in plan.texts
    assert len(serving.feature_plan("category").texts) == 8 and len(serving.feature_plan("category").numeric) == 14 and len(serving.feature_plan("category").categorical) == 3


def test_binary_metrics_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGES", 7)
    r = random.Random(2)
    rows = [(y := r.randrange(2), round(min(1.0, max(0.0, r.gauss(0.4 + 0.2 * y, 0.2))), 2)) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = sum(sum(q >= p for q in pos) / sum(s >= p for _, s in rows) for p in pos) / len(pos)
    tp, said = sum(s >= 0.5 for s in pos), sum(s >= 0.5 for _, s in rows)
    got = M.binary(spark.createDataFrame(rows, "y long, score double")).first()
    assert (got["roc_auc"], got["average_precision"], got["f1"]) == (pytest.approx(auc, abs=1e-6), pytest.approx(ap, abs=1e-6), pytest.approx(2 * tp / (said + len(pos)), abs=1e-6))
    assert got["accuracy"] == pytest.approx(sum((s >= 0.5) == (y == 1) for y, s in rows) / 400, abs=1e-6)


def test_shuffled_places(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("c"))
    got = splits.shuffled(rows, "id", "c", 7, ranges=16).collect()
    for c in range(3):
        own = sorted((r["place"], r["id"]) for r in got if r["c"] == c)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [i for _, i in own] != sorted(i for _, i in own)
    assert sorted(map(tuple, got)) == sorted(map(tuple, splits.shuffled(rows, "id", "c", 7, ranges=3).collect()))
