"""The corpus pipeline: five stages over documents, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from augury.llm import decontam, lines, mixing, near_dups, toxicity
from augury.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Null and empty texts, and all repeats of a clean row, stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines. Copies of a page vote once, so that near_duplicates still has their text."""
    return lines.dedup(docs, copies=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each near-duplicate group; of rows with that doc_id, the one whose text sorts first.

    Texts without words are in no group and stay, as do rows without a doc_id."""
    gone = near_dups.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)
    twice = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice")), "twice")
    if twice.isEmpty():
        return left
    again = left.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi")
    first = again.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("_n = 1").select(*docs.columns)
    return left.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti").unionByName(first)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without a doc_id or text stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the blocks and epochs of the mixture; each stands in epoch 0, empty ones there alone."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]
#: A trained model, MinHash links and seeded permutations have no SQL form; tests/llm/test_corpus_pipeline.py holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of ``documents`` after all stages; each stage reads what the one before wrote. An empty table gives no rows, and
    nulls in any column are carried as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
