"""Columns by their exact names, where others differ from them by case only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact(df: DataFrame, **names: str) -> DataFrame:
    """The columns of these names under new ones; where no name is exactly the same, one that differs by case does."""
    own, low = df.columns, [c.lower() for c in df.columns]
    at = {new: own.index(name) if name in own else low.index(name.lower()) for new, name in names.items()}
    return df.toDF(*(f"c{i}" for i in range(len(own)))).select(*(F.col(f"c{i}").alias(new) for new, i in at.items()))


def exact_docs(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id and text, whatever else there is."""
    return exact(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
