"""From raw documents to packed sequences: four stages, each written as Parquet and reread by the next.

A stage is (spark, docs, sf_dir) -> DataFrame. The first three return the columns of documents they were given:

1. language ID drops documents in which no language can be determined: null texts and texts without a letter.
2. n-gram Jaccard join keeps one document of each group of near duplicates, that with the smallest doc_id.
3. benchmark decontamination drops documents that hold a window of a benchmark item.
4. best-fit packing returns the pieces of the documents left and their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poseflow import tables
from poseflow.llm import decontaminate, language, packing, similarity
from poseflow.tables import Scratch


def beside(docs: DataFrame, *named: Column) -> DataFrame:
    """A stage's own columns, and the document's in one struct, which no operator's columns can clash with."""
    return docs.select(*named, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__document"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language, as learned from those that are not held out."""
    found = language.learn_and_identify(beside(docs, F.col("doc_id"), F.col("text"), F.col("lang")))
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select("__document.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest doc_id (a null one counts as the largest), of equal
    ones that with the smallest MD5 of its text. Rows that repeat both stay once. Documents without words are in no group, and stay all.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.unhex(F.md5("text")).alias("md5"))
    classes = similarity.similar_classes(docs.where(worded).select(key.alias("key"), "text"), "key")
    kept = classes.where(F.col("key") == F.col("component_id")).select("key").distinct()
    # Copies with one key are reduced within the tasks that read them, before the shuffle that the join then uses.
    named = beside(docs.where(worded), key.alias("key")).dropDuplicates(["key"]).join(kept, "key", "left_semi")
    return named.select("__document.*").unionByName(docs.where(~worded))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a window of a benchmark item."""
    found = decontaminate.decontaminate(beside(docs, F.col("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select("__document.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Language sets by expectation-maximisation and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. What a stage needed is deleted once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        mark = tables.held(spark)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{k}")
            tables.release(spark, mark)
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
