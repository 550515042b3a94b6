"""A training-data pipeline: quality, rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
its output is written as Parquet and read back as the next stage's ``docs``.

Edge cases, in every stage: a null text is an empty one (it stays null where rows go through); a null
id is a value like others, without a label, and names a group of near copies only if the group has no
other; empty texts fail the rules of stage 2, and where it doesn't run they are linked with nothing,
hold no personal data and pack as one separator token; texts of any length are taken whole; of rows that
repeat id and words near duplicates keep one, other stages treat each by itself; ties go to the smaller id, then
to the smaller key of the words; an empty table gives an empty table; extra columns go through
the first four stages unchanged, whatever their names, and the last ignores them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import common, near_dedup, packing, pii, quality_classifier, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy v1."""
    return quality_rules.apply_policy(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more)."""
    return near_dedup.drop_near_duplicates(docs, threshold=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences by source."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]

#: No SQL: the classifier's and the sketches' arithmetic isn't SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
