"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, oracles, order_minhash
from .classifier import classify, fit
from .embedding_dedup import near_copies
from .hard_negatives import mine
from .html_extract import extract
from .mixing import mix
from .pieces import encode
from .quality_rules import judged
from .secrets import scan
from .sharding import shards
from .spelling import variants
from .token_counts import histogram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read(spark, sf_dir, "labels")))


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "embeddings"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of all copies as text, in thousand-millionths."""
    plan = mix(read(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))
    return plan.withColumn("positions", F.array_join(F.transform("positions", lambda x: F.round(x * 1_000_000_000).cast("long").cast("string")), " "))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_copies(read(spark, sf_dir, "documents"))


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), columns=("ids_sha256", "decoded_sha256"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents")).withColumn("p_good", F.round("p_good", 9))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"), damage=97)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label moved on by one, components in whole 256ths."""
    table = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.floor(256 * x).cast("double")))
    return mine(table.withColumns({"label": moved, "embedding": whole}), anchor=F.col("vec_id") % 100 == 0)


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(read(spark, sf_dir, "documents"), digest=True)


ORACLES |= {
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_exact_dedup": oracles.EXACT_DEDUP,
    "op2_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op3_mixing": oracles.MIXING,
    "op10_quality_rules": oracles.QUALITY_RULES,
}
