import pytest
from pyspark.sql import functions as F

from weftline import queries as Q
from weftline.functions import text as X
from weftline.operators.models import model_label, parse_overrides
from weftline.plans import cleaning


def run(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


@pytest.mark.parametrize(
    "pairs, f",
    [
        ([("- Vận hành hằng ngày\r\n  * Kiểm tra   thiết bị\n\n• Báo cáo", "Vận hành hằng ngày Kiểm tra thiết bị Báo cáo"), (None, ""), ("  ", ""), ("N/A", ""), ("NaN", ""), ("ế", "ế")], X.normalize_unicode),
        (Q.TONE, X.normalize_tone),
        (Q.CTX + Q.SIMPLE, X.expand_abbreviations),
        ([("Nhân Viên Kinh Doanh", "Nhan Vien Kinh Doanh"), ("Đà Nẵng", "Da Nang"), ("đường", "duong"), (None, "")], X.fold_accents),
        (Q.PLACES, X.normalize_province),
        (Q.MASKS + [("từ 10-15 triệu/tháng", "từ <SALARY> /tháng"), ("500 triệu đồng doanh thu mỗi tháng", "500 triệu đồng doanh thu mỗi tháng"), (None, "")], X.mask_salary),
        (Q.MONTHS, X.experience_months),
        (Q.LISTS, lambda c: F.array_join(X.parse_list(c), "|")),
    ],
)
def test_golden(spark, pairs, f):
    assert run(spark, [a for a, _ in pairs], f) == [b for _, b in pairs]


def test_group_key_ignores_case_and_accents(spark):
    a, b, c = run(spark, ["Nhân viên  Kinh doanh!", "nhan vien kinh doanh", "khác"], X.group_key)
    assert a == b != c and len(a) == 16


def test_idempotent(spark):
    once = run(spark, ["hòa NV", "TP.HCM", "x  y"], X.preprocess)
    assert run(spark, once, X.preprocess) == once


def test_resolver_and_leaks():
    assert cleaning.resolve_column("description", "salary", True) == "description_masked_seg"
    assert cleaning.resolve_column("description", "category") == "description"
    for task in cleaning.MASKED_TASKS:
        for scope in ("title", "structured", "full"):
            for segmented in (False, True):
                cleaning.check_leak(cleaning.source_columns(task, scope, segmented), task)
    with pytest.raises(ValueError):
        cleaning.check_leak(["salary_mid"], "salary")
    with pytest.raises(PermissionError):
        cleaning.gate("test", False)


def test_overrides():
    assert parse_overrides(["a=63", "b=0.3", "c=log2", "d=None", "e=True"]) == {"a": 63, "b": 0.3, "c": "log2", "d": None, "e": True}
    with pytest.raises(ValueError):
        parse_overrides(["a"])
    assert model_label("svm", {"C": 0.02}) == "svm(C=0.02)" and model_label("svm", {}) == "svm"


def test_clean_and_serve_agree(spark):
    row = {"job_title": "Tuyển NV Kinh doanh SEO", "description": "Mức lương 18 triệu/tháng", "benefits": "['Thưởng 5tr']", "location": "hà đông, bắc ninh", "languages_required": "Tiếng Anh", "experience_required": "2 năm", "salary_min": "15", "salary_max": "10"}
    raw = spark.createDataFrame([row, row])
    full, served = cleaning.clean(raw), cleaning.clean(raw, targets=False)
    assert len(full.columns) == 50 and full.count() == 1 and served.count() == 2
    a, b = full.first().asDict(), served.first().asDict()
    assert all(a[c] == b[c] for c in b)
    assert "18" not in a["description_masked"] and "18" in a["description"]
    assert (a["province"], a["is_major_city"], a["requires_english"], a["experience_months"], a["salary_mid"], a["n_acronyms"]) == ("hà nội", 1, 1, 24.0, 12.5, 2)
    assert not {"salary_mid"} & cleaning.read_attributes(full.select("description_masked"))


def test_encoder_text(spark):
    df = spark.createDataFrame([("t 20 triệu", "d", "r", "t", "d", "r")], "job_title string, description string, requirements_text string, job_title_masked string, description_masked string, requirements_masked string")
    assert cleaning.encoder_text(df, "salary").first()["text"] == "t . d . r"
    with pytest.raises(KeyError):
        cleaning.encoder_text(df.drop("description_masked"), "salary")
