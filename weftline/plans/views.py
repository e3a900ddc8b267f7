"""Role views: the harness tables seen as postings, predictions and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import hash32, salary_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, category, location, group_id and the salary columns, from orders and their line items."""
    t = lambda n: table(spark, sf_dir, n)
    pay = t("lineitem").groupBy("l_orderkey").agg((F.min("l_extendedprice") / 1000).alias("mn"), (F.max("l_extendedprice") / 1000).alias("mx"))
    k = F.col("o_orderkey")
    raw = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(pay, k == F.col("l_orderkey"))
    low = F.when((k % 7 == 0) | (k % 11 == 0), 0.0).otherwise(F.col("mn"))
    high = F.when(k % 11 == 0, 0.0).when((k % 13 == 0) & (k % 7 != 0), F.col("mn") / 2).otherwise(F.col("mx"))
    view = raw.select(k.alias("posting_id"), F.col("o_orderpriority").alias("category"), F.lower("n_name").alias("location"), F.col("o_custkey").cast("string").alias("group_id"), low.alias("raw_min"), high.alias("raw_max"))
    return view.select("posting_id", "category", "location", "group_id", *(c.alias(n) for n, c in salary_columns("raw_min", "raw_max").items()))


POSTINGS = """
raw AS (
  SELECT o.o_orderkey AS posting_id, o.o_orderpriority AS category, lower(n.n_name) AS location, CAST(o.o_custkey AS VARCHAR) AS group_id,
         CASE WHEN o.o_orderkey % 7 = 0 OR o.o_orderkey % 11 = 0 THEN 0.0e0 ELSE b.mn END AS a,
         CASE WHEN o.o_orderkey % 11 = 0 THEN 0.0e0 WHEN o.o_orderkey % 13 = 0 AND o.o_orderkey % 7 <> 0 THEN b.mn / 2 ELSE b.mx END AS b
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN (SELECT l_orderkey, min(l_extendedprice)/1000 AS mn, max(l_extendedprice)/1000 AS mx FROM lineitem GROUP BY l_orderkey) b ON b.l_orderkey = o.o_orderkey
), bounds AS (
  SELECT posting_id, category, location, group_id, CASE WHEN least(a, b) = 0 AND greatest(a, b) > 0 THEN greatest(a, b) ELSE least(a, b) END AS lo, greatest(a, b) AS hi FROM raw
), postings AS (
  SELECT posting_id, category, location, group_id, lo AS salary_min, hi AS salary_max, (lo + hi) / 2 AS salary_mid, CAST((lo + hi) / 2 > 0 AS INT) AS salary_disclosed,
         CAST(hi > lo AND lo > 0 AS INT) AS salary_is_range, CASE WHEN (lo + hi) / 2 > 0 THEN ln(1 + (lo + hi) / 2) END AS salary_mid_log, CAST((lo + hi) / 2 >= 100 AS INT) AS salary_extreme
  FROM bounds
)"""


def labels_of(run: int):
    """Predictions of run number `run` for orders: every (run + 3)rd row gets the next status."""
    return F.when(F.col("o_orderkey") % (run + 3) == 0, F.when(F.col("o_orderpriority") == "1-URGENT", "2-HIGH").when(F.col("o_orderpriority") == "2-HIGH", "3-MEDIUM").when(F.col("o_orderpriority") == "3-MEDIUM", "4-NOT SPECIFIED").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "5-LOW").otherwise("1-URGENT")).otherwise(F.col("o_orderpriority"))


def predictions(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """row_id, y_true, y_pred of a made-up run."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("y_true"), labels_of(run).alias("y_pred"))


def predictions_sql(run: int = 0, name: str = "predictions") -> str:
    return f"""{name} AS (SELECT o_orderkey AS row_id, o_orderpriority AS y_true, CASE WHEN o_orderkey % {run + 3} = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '3-MEDIUM'
  WHEN '3-MEDIUM' THEN '4-NOT SPECIFIED' WHEN '4-NOT SPECIFIED' THEN '5-LOW' ELSE '1-URGENT' END ELSE o_orderpriority END AS y_pred FROM orders)"""


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosed postings with a made-up prediction of the log of pay."""
    p = postings(spark, sf_dir).where("salary_disclosed = 1")
    return p.select("posting_id", "category", "location", F.col("salary_mid_log").alias("y"), (F.col("salary_mid_log") * (1 + (F.col("posting_id") % 21 - 10) / 100)).alias("p"))


REGRESSIONS = POSTINGS + """, regressions AS (SELECT posting_id, category, location, salary_mid_log AS y, salary_mid_log * (1 + (posting_id % 21 - 10) / 100.0e0) AS p FROM postings WHERE salary_disclosed = 1),
back AS (SELECT *, greatest(exp(y) - 1, 0.0e0) AS ty, greatest(exp(p) - 1, 0.5e0) AS tp FROM regressions)"""


def binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosure with a made-up score of 1,000 steps."""
    p = postings(spark, sf_dir)
    return p.select("posting_id", F.col("salary_disclosed").cast("long").alias("y"), ((hash32(F.col("posting_id").cast("string")) % 700 + 300 * F.col("salary_disclosed")) / 1000.0).alias("score"))


BINARIES = POSTINGS + ", binaries AS (SELECT posting_id, salary_disclosed AS y, (CAST('0x' || substring(sha1(CAST(posting_id AS VARCHAR)), 1, 8) AS BIGINT) % 700 + 300 * salary_disclosed) / 1000.0e0 AS score FROM postings)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, first line as title, whole text, language as class, source as location."""
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("category"), F.col("source").alias("location"))


TITLES = "titles AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS text, lang AS category, source AS location FROM documents)"


#: What raw postings say about pay behind their text, by doc_id; the last counts something else.
STATED = ("", " Thu nhập 15 - 22 triệu", " Lương: 8.000.000đ", " 40 triệu người dùng")


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw postings of 18 text columns, with made-up fields that exercise every parser."""
    d, k = titles(spark, sf_dir), F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    return d.select(
        k.alias("doc_id"), F.col("title").alias("job_title"), F.concat("text", pick(*STATED)).alias("description"), F.col("title").alias("requirements_text"),
        pick("['Cao đẳng', 'Đại học']", "[]", "nan", "Python, SQL").alias("qualifications"), pick("['Python', 'SQL', 'Excel']", "", "Java").alias("technical_skills"), pick("['Giao tiếp']", "[]").alias("soft_skills"), pick("['Thưởng 5tr mỗi quý', 'BHXH']", "[]").alias("benefits"),
        pick("hà đông, bắc ninh", "TP.HCM", "Đà Nẵng", "", "cầu giấy").alias("location"), F.lit("Việt Nam").alias("country"), pick("Tiếng Anh", "UNK", "tiếng anh, tiếng nhật").alias("languages_required"), pick("2 năm", "6 tháng", "Không yêu cầu", "1,5 năm").alias("experience_required"),
        pick("Toàn thời gian", "").alias("contract_type"), pick("8h - 17h", "").alias("working_hours"), F.col("category"), F.lit("").alias("salary"), pick("10", "0", "", "25").alias("salary_min"), pick("15", "20", "", "5").alias("salary_max"), F.lit("").alias("salary_avg"),
    )
