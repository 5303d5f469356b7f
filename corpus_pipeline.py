"""A corpus pipeline: quality rules, near-dedup, secret scan, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.graph import written
from lexiloom.llm.mixing import mixed, training_order
from lexiloom.llm.order_minhash import survivors
from lexiloom.llm.pieces import encode
from lexiloom.llm.quality_rules import judged
from lexiloom.llm.queries import tokenizer
from lexiloom.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null or empty text has too few words and goes; a null id,
    source or any other column does not matter; repeated rows stay or go together; very long texts are
    judged whole; an empty table gives an empty one; further columns come along."""
    return judged(docs, carry=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (of the least content
    hash where ids tie; of any id before a null one). Null and empty texts are one text; unrelated
    texts under one id both stay; rows that repeat id and text are one document; an empty table gives
    an empty one; further columns come along."""
    return survivors(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every row stays, repeated ones too. A null text stays null
    and so does its n_chars; ids are not looked at; an empty table gives an empty one."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come once for each copy that their source's target asks for, in training order. Null
    sources are a source, null texts have no words, rows under one id or none are told apart by all
    their columns, repeated rows count each time; an empty table gives an empty one."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's ids, its place in training order (train_order, unique and ascending as the files of
    the stage before have it) and a digest of what the ids decode to. A null text is the ids of begin
    and end; null ids stay null; repeated rows give as many rows; an empty table gives an empty one."""
    ordered = training_order(docs, "train_order")
    return encode(ordered, tokenizer("piece_bpe_32k.model"), columns=("ids", "decoded_sha256"), place_col="train_order")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("secret scan", secrets),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: No SQL: near-dedup and the piece model can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next.
    Sorted by train_order, the rows are the training sequence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs
