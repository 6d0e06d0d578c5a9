"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
documents.  Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import exact, jaccard, packing, suffix, toxicity
from sylvan.llm.frames import stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels that aren't held out, doesn't reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space aside, the one of the least id."""
    return exact.drop_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word Jaccard similarity 0.8 or more connect, the document of the least id."""
    return jaccard.drop_similar(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters whose 100-byte surroundings stand earlier; n_chars follows the text."""
    return suffix.remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("jaccard join", dissimilar), ("suffix dedup", unrepeated), ("packing", packed)]

#: SQL can express neither the classifier nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
