"""Token counts from an exact histogram of encoded lengths.

Every document is encoded; only its length is kept, and documents are counted by length. Sums from
the long end (suffix sums) over that table answer, for any context limit: how many documents are
longer, how many tokens there are in all, how many are left if every document is cut at the limit,
and which length a given share of the documents stays within. The table has one row per distinct
length, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import portions

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The vocabulary file of byte ranks as an encoder, one for each worker."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def lengths(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Rows (n_tokens, n_docs), not yet added up over tasks: documents by encoded length. A null
    text counts as empty, of length 0. Texts are encoded whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(vocabulary)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts):
                n = [len(x) for x in tool.encode_ordinary_batch([x if isinstance(x, str) else "" for x in texts[part]], num_threads=1)]
                counts = pd.Series(n).value_counts()
                yield pd.DataFrame({"n_tokens": counts.index, "n_docs": counts.to_numpy()})

    return df.select(F.col(text_col).alias("text")).mapInPandas(run, "n_tokens long, n_docs long")


def histogram(df: DataFrame, vocabulary: str, text_col: str = "text", block: int = 128) -> DataFrame:
    """One row per distinct encoded length: n_tokens, n_docs, docs_at_least and tokens_at_least (of
    documents of that length or more), docs_shorter and tokens_shorter, tokens_within (what is left
    of all documents if each is cut at n_tokens) and share_within (of documents up to that length).

    Suffix sums are taken within blocks of lengths and over the blocks' totals, so no task needs the
    whole table. Null and empty texts have length 0; an empty table gives no rows; repeated rows
    count each time; other columns are ignored."""
    table = lengths(df, vocabulary, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    table = table.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    from .graph import written

    table = written(table, "lengths")
    blocks = table.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    suffix = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = F.sum("n_docs").over(suffix) + F.col("docs_after")
    tokens_at_least = F.sum("tokens").over(suffix) + F.col("tokens_after")
    return (
        table.join(blocks, "block")
        .withColumn("docs_at_least", at_least)
        .withColumn("tokens_at_least", tokens_at_least)
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("all_docs") - F.col("docs_at_least")).alias("docs_shorter"),
            (F.col("all_tokens") - F.col("tokens_at_least")).alias("tokens_shorter"),
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_within"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_within"),
        )
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: docs_over, docs_total, tokens_total and tokens_within (tokens left if
    documents are cut at the limit), from a table made by histogram(); none from an empty one."""
    spark = table.sparkSession
    want = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    over = F.col("n_tokens") > F.col("context_limit")
    kept = F.least("n_tokens", "context_limit") * F.col("n_docs")
    return (
        table.join(F.broadcast(want))  # as many rows as there are limits
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum("n_docs").alias("docs_total"),
            F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens_total"),
            F.sum(kept).alias("tokens_within"),
        )
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least `share` of the documents stay within: one row, n_tokens,
    null for an empty table."""
    return table.filter(F.col("share_within") >= share).agg(F.min("n_tokens").alias("n_tokens"))
