"""Sources and sinks: raw CSV, frozen splits with a manifest, embeddings, predictions, run logs, files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The raw columns, all text.
RAW_COLUMNS = "job_title description requirements_text qualifications technical_skills soft_skills benefits location country languages_required experience_required contract_type working_hours category salary salary_min salary_max salary_avg".split()


def read_raw_csv(spark: SparkSession, path: str, columns: Iterable[str] = RAW_COLUMNS) -> DataFrame:
    """All columns as text; only an empty field is missing. The schema is stated, never inferred."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footers alone."""
    return spark.read.parquet(path).columns


def write_splits(df: DataFrame, path: str, key: str = "group_id", split: str = "split") -> dict:
    """Write by split, check that no group straddles, then publish by renaming; return the manifest."""
    spark = df.sparkSession
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    df.write.partitionBy(split).parquet(draft)
    written = spark.read.schema(df.schema).parquet(draft)
    straddling = written.groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1").count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if straddling:
        store.delete(hadoop(draft), True)
        raise ValueError(f"{straddling} groups straddle splits")
    store.delete(hadoop(path), True)
    store.rename(hadoop(draft), hadoop(path))
    counts = {r[split]: {"rows": r["rows"], "groups": r["groups"]} for r in spark.read.schema(df.schema).parquet(path).groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("groups")).collect()}
    return {"splits": counts, "straddling": 0, "columns": dict(df.dtypes)}


def read_split(spark: SparkSession, path: str, name: str, manifest: dict) -> DataFrame:
    """One split (a pruned partition), its columns checked against the manifest."""
    df = spark.read.parquet(path).where(F.col("split") == name)
    if extra := set(df.columns) ^ set(manifest["columns"]):
        raise ValueError(f"columns differ from the manifest: {sorted(extra)}")
    return df


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files, on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def stream_sha256(path: str, step: int = 1 << 20) -> str:
    """SHA-256 of a file on the driver, a MiB at a time: for files beyond a row's 2 GB."""
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(step):
            out.update(data)
    return out.hexdigest()


def read_embeddings(spark: SparkSession, path: str, family: str, split: str) -> DataFrame:
    """Vectors of one family (raw or masked) and split: both are partition columns, so families never mix."""
    return spark.read.parquet(path).where((F.col("family") == family) & (F.col("split") == split))


def check_family(task: str, family: str) -> None:
    if task in ("salary", "disclosed") and family != "masked":
        raise ValueError(f"{task} may read masked vectors only")


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of all runs below a root, run_id from the folders."""
    return spark.read.option("basePath", root).parquet(f"{root}/run_id=*")


def append_log(df: DataFrame, path: str) -> None:
    """Rows of the results log; text never holds the table's separator."""
    df.select(*(F.translate(F.col(c), "|", "·").alias(c) if k == "string" else F.col(c) for c, k in df.dtypes)).write.mode("append").parquet(path)


def render_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """One markdown row per log row."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns)), F.lit(" |")).alias("line"))


def resource_words(df: DataFrame, column: str = "value") -> DataFrame:
    """Words of a resource file: # starts a comment; a word with spaces also comes with underscores."""
    words = df.select(F.lower(F.trim(column)).alias("word")).where(~F.col("word").startswith("#") & (F.col("word") != ""))
    return words.union(words.where(F.col("word").contains(" ")).select(F.replace("word", F.lit(" "), F.lit("_")))).distinct()


def history_lines(epochs: DataFrame) -> DataFrame:
    """A JSON line per epoch."""
    return epochs.select(F.to_json(F.struct(*epochs.columns)).alias("value"))


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c.cast("string")) != "")
