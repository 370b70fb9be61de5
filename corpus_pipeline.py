"""The corpus pipeline: documents in, encoded training rows out.

Five stages over the table documents, each written as Parquet and read again as the next
one's input. A stage judges its own input only; all but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import table, written
from loomdoc.llm.exact_dedup import exact_dedup
from loomdoc.llm.mixing import mix
from loomdoc.llm.pieces import default_model, encode_decode
from loomdoc.llm.simhash import near_dedup
from loomdoc.llm.toxicity import toxicity


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name = "_" + name
    return name


def _on_id(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """docs joined with decided on the id, which goes under a free name there; null ids match each other."""
    at = _free(docs, "at_id")
    return docs.join(decided.withColumnRenamed("doc_id", at), F.col("doc_id").eqNullSafe(F.col(at)), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Rows of an id with several texts go if one is toxic."""
    bad = toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id")
    return _on_id(docs, bad, "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return _on_id(docs, exact_dedup(docs).where("kept").select("doc_id").distinct(), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return _on_id(docs, near_dedup(docs).where("doc_id <=> component_id").select("doc_id").distinct(), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as its source's target takes it."""
    times, copy = _free(docs, "times"), _free(docs, "copy")
    taken = mix(docs).where("repeats > 0").groupBy("doc_id").agg(F.max("repeats").cast("int").alias(times))
    rows = _on_id(docs, taken, "inner")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, and the text they decode to: doc_id, n_tokens, ids, decoded."""
    return encode_decode(docs, default_model()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Label models, fingerprints and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
