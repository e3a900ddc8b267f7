"""From documents to token ids: drop low quality, keep one of each group of near copies, drop what holds test items, encode.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, extra ones with any names included.

In every stage an empty table gives an empty one, very long texts are read whole, and only doc_id and text are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe_codec import encode_decode
from weftline.llm.common import forget, table, written
from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.ngram_join import one_of_each
from weftline.llm.quality import keep_quality
from weftline.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores the classifier's threshold or more. Null and empty texts score as a text without words; copies go or stay together."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id (nulls last). Null and empty texts have no copies and stay; a repeated id is told apart by its text."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget. Null and empty texts and items hold nothing; an empty benchmark drops nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with their number and digests of ids and decoded text. Null and empty texts have no ids."""
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json"), keep=("ids",))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: No stage before the last has an SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents one after another, each written to the shared folder; the table a stage has read is deleted once the next is written."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
            if last is not None:
                forget(last)
            last = docs
    return docs
