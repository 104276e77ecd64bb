"""Corpus pipeline: documents -> filtered, deduplicated, encoded documents.

Stages are (name, function) pairs; every function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of documents.

Rows with nulls, empty texts and repeated rows follow the rules that the
operators' docstrings state; an empty table runs through all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamsift.llm.common import durable, table
from streamsift.llm.decontam import drop_leaked
from streamsift.llm.exact_dedup import dedup, split_in_two
from streamsift.llm.minhash import near_duplicates
from streamsift.llm.pieces import encode, model_path
from streamsift.llm.toxicity import CATEGORIES, THRESHOLD, drop_flagged, fit_chain, label_columns


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    chain = fit_chain(docs, label_columns(table(spark, sf_dir, "labels")), CATEGORIES)
    return drop_flagged(docs, chain, "toxic", THRESHOLD)


#: Column that names one row of a stage's table.
ROW = "row of the table"


def numbered(docs: DataFrame, has_id: Column) -> DataFrame:
    """Adds ROW: (has_id, doc_id, file, place in the file), which names one row
    also where rows repeat a doc_id or all columns. A stage's ``docs`` is a
    Parquet table, whose files give the names without a copy; anything else is
    written first."""
    def add(df: DataFrame) -> DataFrame:
        place = F.col("_metadata")
        return df.select("*", F.struct(has_id.alias("known"), F.col("doc_id"), F.unhex(F.md5(place["file_path"].cast("binary"))).alias("file"),
                                       place["row_index"].alias("place")).alias(ROW))
    try:
        return add(docs)
    except AnalysisException:
        return add(durable(docs))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of numbered ``docs`` that ``kept`` names."""
    names = kept.where("kept").select(F.col(f"`{ROW}`").alias("kept row"))
    return docs.join(names, docs[f"`{ROW}`"].eqNullSafe(names["`kept row`"]), "left_semi").drop(ROW)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id (null is the
    smallest; of rows that repeat it, one)."""
    rows = numbered(docs, F.col("doc_id").isNotNull())
    return only(rows, dedup(split_in_two(rows), key=ROW))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate class one row stays, that with the smallest
    doc_id (null is the largest; of rows that repeat it, one)."""
    rows = numbered(docs, F.col("doc_id").isNull())
    return only(rows, near_duplicates(rows, key=ROW))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of the documents that are left."""
    return encode(docs, model_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Learned models, similarities and Viterbi segmentation are beyond SQL; the
#: pipeline is tested against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the given documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
