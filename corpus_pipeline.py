"""A corpus pipeline: each stage reads what its predecessor kept, the last packs what is left.

Language ID drops documents without a recognised language (no text, no letter; neither the learned label nor its score drops any), exact dedup keeps the row with the largest doc_id
of equal texts, near dedup one document of each class, decontamination drops documents that hold a benchmark item. Between
stages the documents are written to the shared folder and read again, so a lost executor costs its own tasks only.

A row is dropped for itself, not for its id: the first stage numbers the rows, and the number is stored with them, so repeated
rows, rows without an id and several texts under one id are told apart. Of equal or near rows one with an id stays if there is any.

Empty tables pass through all stages; extra columns of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bagminhash, decontam, exact, langid, packing
from riskweave.llm.common import bound_batches
from riskweave.llm.queries import TOKENIZER
from riskweave.session import pin

ROW = "_corpus_row"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = docs.withColumn(ROW, F.monotonically_increasing_id())
    net = langid.fit(docs)
    if net is None:  # no labels to learn from: nothing tells languages apart, but letters do tell text
        return docs.where(langid.has_letter(F.col("text")))
    labelled = langid.predict(docs, net)
    return labelled.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with their row number; those that come without one are stored with a new one."""
    return docs if ROW in docs.columns else pin(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose row is not in ``dropped``. It is stored first, so Spark knows its size when it picks the join."""
    return docs.join(pin(dropped.select(ROW).distinct(), "dropped"), ROW, "left_anti").select(*docs.columns)


def _by_row(docs: DataFrame) -> DataFrame:
    """Row number as doc_id, and text: each row is a document of its own."""
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = _numbered(docs)
    return _without(docs, exact.exact_groups(docs, key=ROW).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = _numbered(docs)
    classes = bagminhash.near_duplicate_classes(_by_row(docs)).where("class_size > 1").select(F.col("doc_id").alias(ROW), "class_id")
    members = pin(docs.select("doc_id", ROW).join(classes, ROW), "near-members")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("first")
    kept = members.groupBy("class_id").agg(smallest).select(F.col(f"first.{ROW}").alias(ROW))
    return _without(docs, members.join(kept, ROW, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = _numbered(docs)
    found = decontam.contaminated(_by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select(F.col("doc_id").alias(ROW)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack_documents(docs.drop(ROW), TOKENIZER)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination), ("best_fit_packing", best_fit_packing),
]

#: Trained labels and subword ids can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
