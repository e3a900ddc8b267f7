"""Raw posting -> clean posting: one projection shared by the batch build and by serving, so the two can't drift apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..functions.numeric import salary_columns

LISTS = ("qualifications", "technical_skills", "soft_skills", "benefits")
TEXTS = {"job_title": "job_title", "description": "description", "requirements_text": "requirements"}
SEGMENTED = {
    "job_title": "job_title_seg", "description": "description_seg", "requirements_text": "requirements_seg", "job_title_masked": "job_title_masked_seg", "description_masked": "description_masked_seg",
    "requirements_masked": "requirements_masked_seg", "benefits_masked": "benefits_masked_seg", "technical_skills_text": "technical_skills_seg", "qualifications_text": "qualifications_seg",
}
#: Columns that only hold text with pay masked; tasks about pay may read no other text.
MASKED_TASKS = ("salary", "disclosed")
FORBIDDEN = ("job_title", "description", "requirements_text", "benefits_text", "job_title_seg", "description_seg", "requirements_seg", "salary_min", "salary_max", "salary_mid", "salary_mid_log", "salary_is_range", "salary_extreme")


#: The columns of a raw posting.
RAW = (*TEXTS, *LISTS, "location", "country", "languages_required", "experience_required", "contract_type", "working_hours", "category", "salary", "salary_min", "salary_max", "salary_avg")


def distinct_rows(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row of each group of exact copies in the raw columns, whatever else the rows carry; of `extra` columns the smallest value.

    A filter that all groups pass stands behind the grouping: the optimizer would else make what is selected from it one with it, and its Python functions
    would be called for each place where a value is used, on rows that hold their texts dozens of times.
    """
    have = [c for c in RAW if c in raw.columns]
    return raw.groupBy(*have).agg(F.count("*").alias("_copies"), *(F.min(c).alias(c) for c in extra)).where("_copies > 0").select(*extra, *have)


def clean(raw: DataFrame, targets: bool = True, lexicon: list[str] | None = None, dedup: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """18 raw columns -> 50 clean ones (without targets and group_id for serving); missing input columns are empty.

    One select over the scan after dropping exact copies; base texts are computed once, and masks and segments from them.
    """
    have = set(raw.columns)
    raw = distinct_rows(raw, extra) if dedup and targets else raw
    col = lambda c: F.col(c) if c in have else F.lit("")
    base = raw.select(*extra, *(X.preprocess(col(c)).alias(c) for c in TEXTS), X.normalize_unicode(col("job_title")).alias("_title"), *(col(c).alias(f"_{c}") for c in (*LISTS, "location", "country", "languages_required", "experience_required", "contract_type", "working_hours")), *(col(c).alias(f"_{c}") for c in ("category", "salary_min", "salary_max")))
    listed = base.select("*", *(X.parse_list(f"_{c}").alias(f"_l_{c}") for c in LISTS), X.split_list("_location").alias("_places"), X.normalize_province("_location").alias("province"), X.split_languages("_languages_required").alias("_langs"), X.normalize_unicode("_working_hours").alias("working_hours"), X.normalize_unicode("_contract_type").alias("_contract"))
    out: dict[str, Column] = {c: F.col(c) for c in TEXTS}
    out |= {f"{name}_masked": X.mask_salary(c) for c, name in TEXTS.items()}
    for c in LISTS:
        out[f"{c}_text"] = F.lower(F.array_join(f"_l_{c}", " ; "))
        out[f"n_{c}"] = F.size(f"_l_{c}")
    out["benefits_masked"] = X.mask_salary(out["benefits_text"])
    out |= {
        "location_raw": F.coalesce(F.try_element_at("_places", F.lit(1)), F.lit("unknown")), "province": F.col("province"), "n_locations": F.size("_places"), "is_major_city": F.col("province").isin(*V.MAJOR_CITIES).cast("int"),
        "country": X.normalize_unicode("_country"), "languages_text": F.array_join("_langs", " "), "n_languages": F.size("_langs"), "requires_english": F.exists("_langs", lambda x: x.contains("anh")).cast("int"),
        "experience_months": X.experience_months("_experience_required"), "experience_raw": X.normalize_unicode("_experience_required"), "contract_type": F.when(F.col("_contract") == "", "unknown").otherwise(F.col("_contract")),
        "working_hours": F.col("working_hours"), "has_working_hours": (F.col("working_hours") != "").cast("int"), "desc_len": F.length("description"), "req_len": F.length("requirements_text"), "title_len": F.length("job_title"), "n_acronyms": X.n_acronyms("_title", assume_nfc=True),
    }
    if targets:
        out["category"] = X.normalize_unicode("_category")
        out |= salary_columns("_salary_min", "_salary_max")
        out["group_id"] = X.group_key(*TEXTS, assume_nfc=True)
    plain = listed.select(*extra, *(c.alias(n) for n, c in out.items()))
    return plain.select("*", *(X.segment(c, lexicon).alias(n) for c, n in SEGMENTED.items()))


def resolve_column(field: str, task: str, segmented: bool = False) -> str:
    """The one door from a logical text field to its column: tasks about pay get the masked mirror."""
    name = {"requirements": "requirements_text"}.get(field, field)
    if task in MASKED_TASKS and name in (*TEXTS, "benefits_text"):
        name = f"{TEXTS.get(name, 'benefits')}_masked"
    return SEGMENTED.get(name, name) if segmented else name


def categorical_columns(province: bool) -> list[str]:
    return ["province" if province else "location_raw", "contract_type", "country"]


NUMERIC = "experience_months n_qualifications n_technical_skills n_soft_skills n_benefits n_locations n_languages requires_english is_major_city has_working_hours desc_len req_len title_len n_acronyms".split()


def source_columns(task: str, scope: str = "full", segmented: bool = False, province: bool = True) -> list[str]:
    """Columns that a feature plan reads, by scope: title, structured or full."""
    texts = {"title": ["job_title"], "structured": [], "full": ["job_title", "description", "requirements", "benefits_text", "technical_skills_text", "qualifications_text"]}[scope]
    found = [resolve_column(f, task, segmented) for f in texts]
    if scope == "full":
        found += ["soft_skills_text", "languages_text"]
    return found + ([] if scope == "title" else [*NUMERIC, *categorical_columns(province)])


def check_leak(columns: list[str], task: str) -> None:
    if task in MASKED_TASKS and (bad := sorted(set(columns) & set(FORBIDDEN))):
        raise ValueError(f"{task} must not read {bad}")


def read_attributes(df: DataFrame) -> set[str]:
    """Columns that a plan's scans really read after pruning: what a leak check has to see."""
    names: set[str] = set()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        out = leaves.apply(i).output()
        names |= {out.apply(j).name() for j in range(out.size())}
    return names


def encoder_text(df: DataFrame, task: str, name: str = "text") -> DataFrame:
    """title . description . requirements for an encoder, from the mirrors that the task may read; a missing column is an error."""
    columns = [resolve_column(f, task) for f in ("job_title", "description", "requirements")]
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing {missing}")
    return df.withColumn(name, X.collapse(F.concat_ws(" . ", *(F.trim(X.text(c)) for c in columns))))


def task_rows(df: DataFrame, task: str) -> DataFrame:
    """Rows and target of a task: category and disclosed use all rows, salary the disclosed ones."""
    target = {"category": "category", "disclosed": "salary_disclosed", "salary": "salary_mid_log"}[task]
    rows = df.where("salary_disclosed = 1") if task == "salary" else df
    return rows.withColumn("target", F.col(target))


def gate(evaluate: str, confirmed: bool) -> None:
    """The test split is read only on purpose."""
    if evaluate == "test" and not confirmed:
        raise PermissionError("evaluating on test needs confirmation")
