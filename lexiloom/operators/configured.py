"""Operators that take their limits, weights and thresholds from Settings (see config)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from . import align
from .chunking import pack_paragraphs, pack_sentences


def chunks(df: DataFrame, settings: Settings, text_col: str = "text") -> DataFrame:
    """Adds `chunks`: the text, less lines that settings.remove_patterns begin, packed as sentences (or,
    without sentence_split, as lines) to max_tokens with overlap; chunks shorter than min_chunk_size
    characters are left out, unless that leaves none."""
    text = F.col(text_col)
    for pattern in settings.remove_patterns:
        text = F.array_join(T.without(T.lines(text), pattern), "\n")
    if settings.sentence_split:
        packed = pack_sentences(T.sentences_terminal(text), settings.max_tokens, settings.overlap)
    else:
        packed = pack_paragraphs(F.filter(F.transform(T.lines(text), T.strip), lambda x: x != ""), settings.max_tokens)
    long = lambda c: F.filter(c, lambda x: F.length(x) >= settings.min_chunk_size)
    return df.withColumn("_packed", packed).withColumn("chunks", F.when(F.size(long(F.col("_packed"))) > 0, long(F.col("_packed"))).otherwise(F.col("_packed"))).drop("_packed")


def blended(string_score: Column, vector_score: Column, settings: Settings) -> Column:
    return align.blend(string_score, vector_score, settings.string_weight, settings.embed_weight)


def matched(score: Column, settings: Settings) -> Column:
    """exact, partial or poor."""
    return T.match_type(score, settings.exact, settings.partial)


def full_map(a: DataFrame, b: DataFrame, matches: DataFrame, key: str, settings: Settings) -> DataFrame:
    return align.full_map(a, b, matches, key, settings.exact, settings.partial)


def aligned(pairs: DataFrame, key: str, a: str, b: str, settings: Settings, vectors: tuple[str, str] | None = None) -> DataFrame:
    """align.align_texts() with the settings' gap cost and thresholds."""
    return align.align_texts(pairs, key, a, b, -settings.gap, settings.exact, settings.partial, vectors)
