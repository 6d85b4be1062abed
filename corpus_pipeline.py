"""A corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, documents
with benchmark passages go, and what is left is mixed to target weights of its sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from tabulon.llm.common import cut, discard


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labelled ones among docs, holds to be toxic. A null or empty
    text has no words and gets the classifier's bias; rows that repeat a text go or stay together; rows without an id are
    scored like any other, but teach nothing. Without labels of both classes all rows stay, or, with toxic ones alone, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model).where("predicted = 0").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document with a smaller doc_id has; texts and n_chars change, no document goes. A null text
    stays null; a row without an id acts as the one with the largest; rows that repeat an id are one document."""
    out = line_dedup.dedup_lines(docs)
    return with_length(out.select(*(F.col(f"`{c}`") for c in docs.columns)), docs)


def with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates. Null and empty texts are no
    duplicates; rows that repeat that doc_id stay; rows without an id stay."""
    return near_dup.keep_one(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item. Null and empty texts hold none; rows that repeat an id go
    together; rows without an id go by their own texts."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.clean(docs, items).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how many of their words the mix takes (`taken`; 0: none of them). Null texts have no words, null
    sources are one source, the last."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup_join", keep_one_of_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]

#: The classifier can't be expressed in SQL; the tests hold each stage, and run(), against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents. Each stage's result is written and read again; one that nothing reads any more is deleted. An
    empty documents table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done, docs = docs, cut(stage(spark, docs, sf_dir), name)
        discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)
