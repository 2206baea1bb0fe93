"""The training-data pipeline: quality rules, quality classifier, near-dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir) with ``docs`` the stage before's table, which ``run`` writes to the shared
checkpoint folder and reads again. All but the last return whole rows of ``docs``; rows are told apart by id and
text, so rows with one id and different texts are decided each on their own, and rows equal in both stay or go
together, but for near-dedup, which keeps one row of a group. Null texts are empty and fail the quality rules;
empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skucast.llm import dart, mil, packing, rules
from skucast.llm.common import free_name, table, written

#: No SQL twin: the classifier is trained. Stages are tested against brute-force versions.
ORACLE_SQL = None


def _rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_hash) is in ``chosen``."""
    name = free_name(docs, "_hash")
    mine = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit("")))).alias("mine")
    picked = chosen.select("doc_id", "text_hash").alias("picked")
    same = (F.col(f"mine.{name}") == F.col("picked.text_hash")) & F.col("mine.doc_id").eqNullSafe(F.col("picked.doc_id"))
    return mine.join(picked, same, "left_semi").drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdicts = rules.quality_verdicts(docs, table(spark, sf_dir, "labels"))
    return _rows_of(docs, verdicts.where("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mil.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_score")
    return mil.score(docs, model, name).where(F.col(name) >= mil.THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one of smallest id, then smallest text hash; of equal rows one."""
    best = dart.near_duplicates(docs).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best"))
    return _rows_of(docs, best.select("best.doc_id", "best.text_hash")).dropDuplicates(["doc_id", "text"])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                  added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier),
          ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
