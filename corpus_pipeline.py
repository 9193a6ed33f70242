"""The corpus pipeline: toxicity, near copies, secrets, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before kept; `run` writes each
stage's result as Parquet into the shared folder and gives the next stage what it reads back. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisphere.llm.common import materialize, read_table
from lattisphere.llm.ngram_join import one_of_each
from lattisphere.llm.packing import cut_documents, pack
from lattisphere.llm.queries import tokenizer
from lattisphere.llm.secrets import redact_secrets
from lattisphere.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted classifier scores at 0.5 or above go; the others stay as they are."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.75 or more, the one with the smallest doc_id stays."""
    return one_of_each(docs, percent=75, size=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret becomes its kind in brackets, and n_chars follows the new text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = cut_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return pack(pieces, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("n-gram join", near_copies), ("secrets", secrets), ("packing", packing)]

#: A fitted classifier and token ids of a vocabulary file are no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
