"""A corpus from raw documents to packed sequences, each stage one operator over all that the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathval.folders import remove, shared_folder
from pathval.llm import jaccard_join, line_dedup, packing, quality_model, quality_rules
from pathval.llm.common import made, remove_staged
from pathval.llm.queries import quality_weights, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more, by the labels of ``sf_dir``.

    Null and empty texts score as the share of good labels; repeated rows score alike and stay
    or go together; without labels all score one half and stay.  No rows give none; columns
    stay as they are, whatever their names.
    """
    weights = quality_weights(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_model.score(F.col("text"), weights, spark) >= 0.3)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go, so do all of under 50 words; repeated rows stay or
    go together.  No rows give none; columns stay as they are, whatever their names.
    """
    return docs.where(quality_rules.repetition(F.col("text"))["kept"])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without chunks of lines that stand earlier in the corpus.

    Earlier is by id, a null one first, then by place.  A document that has no word left, since all
    its lines stand earlier, goes with them; null and empty texts stay as they are; rows equal in
    id and text count as one.  ``n_chars``, if there, follows the new text; other columns stay
    as they are.  No rows give none.
    """
    out = line_dedup.deduplicated(docs, drop_emptied=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Texts without words, null and empty ones link with nothing and all stay; of rows equal in id
    and text one stays; a null id stays only if its group has no other.  No rows give none;
    columns stay as they are, whatever their names.
    """
    return jaccard_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 tokens.

    Null and empty texts are a piece of the end id alone; repeated rows give pieces each; other
    columns than id and text are not carried.  No rows give none.
    """
    return packing.production(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("line dedup", deduplicated),
    ("n-gram Jaccard join", distinct),
    ("best-fit packing", packed),
]

#: The classifier, the shingle sets and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next.

    What a stage wrote on its way, and what it read, is removed when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = len(made)
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        remove_staged(spark, before)
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
