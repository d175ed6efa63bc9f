"""A corpus pipeline: each stage reads what the one before has kept and written.

Defined results: documents with NULL or empty text pass the filters and are packed as empty ones; repeated rows pass or go
together; documents with a NULL id pass, as no decision can name them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from staffmart.llm.text import DOCUMENT_COLUMNS, table
from staffmart.operators.joins import lookup
from staffmart.session import materialise

NEAR = ngram_join.Rule(words=5, percent=80)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; extra ones, whatever their names, are not carried through the pipeline."""
    return docs.select(*DOCUMENT_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    docs = documents(docs)
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, classifier).where(f"toxic_score < {toxicity.THRESHOLD}").drop("toxic_score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-equal lines one stays; documents keep the rest of their text, those left without a word go."""
    docs = documents(docs)
    kept = line_dedup.dedup_lines(docs).where("n_removed = 0 OR text RLIKE '\\\\S'")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicate documents (five-word shingles, similarity 0.8) the one with the least id stays."""
    docs = documents(docs)
    groups = ngram_join.near_duplicates(docs, rule=NEAR).where("component_id <> id").select(F.col("id").alias("duplicate")).distinct()
    return lookup(docs, materialise(groups, "duplicates"), [("doc_id", "duplicate")], how="left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = documents(docs)
    found = decontamination.contained_items(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    return lookup(docs, materialise(found, "leaks"), [("doc_id", "leak")], how="left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences."""
    return packing.pack(docs, packing.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
# Classifiers, scores and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
ORACLES: dict[str, str] = {}
