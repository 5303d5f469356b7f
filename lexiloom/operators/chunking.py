"""Packing of sentences or paragraphs into chunks, and removal of repeated chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap as overlap_coefficient
from ..functions.text import sentences_terminal, token_estimate, word_set
from ..session import written


def pack(parts: Column, limit: int, overlap: int = 0, joiner: str = " ", split: Callable[[Column], Column] | None = None) -> Column:
    """Array of chunks from an array of parts, by one fold: a part that would take the chunk over
    `limit` estimated tokens starts a new one, which begins with the longest tail of the last chunk
    of at most `overlap` tokens. A part over the limit is a chunk of its own, or with `split` closes
    the chunk before it and becomes the chunks that `split` makes of it."""
    text, zero = "array<string>", F.lit(0).cast("long")
    state = f"struct<cur:{text},n:bigint,done:{text}>"
    start = F.struct(F.array().cast(text).alias("cur"), zero.alias("n"), F.array().cast(text).alias("done")).cast(state)

    def tokens(a: Column) -> Column:
        return F.aggregate(F.transform(a, token_estimate), zero, lambda s, x: s + x)

    def tail(cur: Column) -> Column:
        if not overlap:
            return F.array().cast(text)
        starts = F.filter(F.sequence(F.lit(1), F.size(cur) + 1), lambda j: tokens(F.slice(cur, j, F.size(cur))) <= overlap)
        return F.slice(cur, F.array_min(starts), F.size(cur))

    def step(s: Column, x: Column) -> Column:
        t = token_estimate(x)
        over = (s["n"] + t > limit) & (F.size(s["cur"]) > 0)
        fresh = F.struct(
            F.concat(tail(s["cur"]), F.array(x)).alias("cur"),
            (tokens(tail(s["cur"])) + t).alias("n"),
            F.concat(s["done"], F.array(F.array_join(s["cur"], joiner))).alias("done"),
        )
        same = F.struct(F.concat(s["cur"], F.array(x)).alias("cur"), (s["n"] + t).alias("n"), s["done"].alias("done"))
        packed = F.when(over, fresh.cast(state)).otherwise(same.cast(state))
        if split is None:
            return packed
        apart = F.struct(F.array().cast(text).alias("cur"), zero.alias("n"), F.concat(finish(s), split(x)).alias("done"))
        return F.when(t > limit, apart.cast(state)).otherwise(packed)

    def finish(s: Column) -> Column:
        return F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(F.array_join(s["cur"], joiner)))).otherwise(s["done"])

    return F.aggregate(parts, start, step, finish)


def pack_sentences(sentences: Column, limit: int, overlap: int = 0) -> Column:
    return pack(sentences, limit, overlap, " ")


def pack_paragraphs(paragraphs: Column, limit: int, overlap: int = 0, joiner: str = "\n") -> Column:
    """Packing of paragraphs; one over the limit is split into sentences, and these are packed."""
    return pack(paragraphs, limit, 0, joiner, lambda x: pack_sentences(sentences_terminal(x), limit, overlap))


def distinct_chunks(chunks: DataFrame, by: list[str], place: list[str] | None = None) -> DataFrame:
    """The first of equal chunks, by place (the columns `place`, chunk_index alone unless given), in
    each group of `by`."""
    place = place or ["chunk_index"]
    keep = chunks.groupBy(*by, "content_hash").agg(F.min(F.struct(*place)).alias("_first")).select(*by, "content_hash", "_first.*")
    return chunks.join(keep, list(dict.fromkeys([*by, "content_hash", *place])), "left_semi")


def similar_chunk_pairs(chunks: DataFrame, by: list[str], above: float = 0.9, small: int = 64) -> DataFrame:
    """Pairs (i < j) of chunks of a group whose word sets overlap by more than `above` of the smaller.

    Sets are made once, of 64-bit hashes of words, and written. In groups of up to `small` chunks each is
    compared with each. In larger ones, with words in one order, the group's rare ones first, the smaller
    set has a word in common with the other among all but `above` of its own; so each set is joined by
    these first words with all words of the others, which common words seldom are, and only pairs that
    meet are compared."""
    # Bound by a lambda: as a column, the words would be split anew for each use.
    hashed = F.transform(F.array(word_set(F.col("text"))), lambda w: F.transform(w, lambda x: F.xxhash64(x)))[0]
    sets = written(chunks.select(*by, "chunk_index", hashed.alias("w")).withColumn("n", F.size("w")), "chunk-sets")
    large = sets.groupBy(*by).agg(F.count("*").alias("_size")).filter(F.col("_size") > small).drop("_size")
    side = lambda k, rows: rows.select(*by, F.col("chunk_index").alias(k), F.col("w").alias(f"w_{k}"))
    few = sets.join(large, by, "left_anti")
    both = side("i", few).join(side("j", few), by).filter("i < j")
    alike = overlap_coefficient(F.col("w_i"), F.col("w_j")) > above
    found = both.filter(alike).select(*by, "i", "j")
    large = written(large, "chunk-large")
    if large.limit(1).count() == 0:
        return found
    many = sets.join(large, by, "left_semi")
    both = _meeting(many, by, above).join(side("i", many), [*by, "i"]).join(side("j", many), [*by, "j"])
    return found.unionByName(both.filter(alike).select(*by, "i", "j"))


def _meeting(sets: DataFrame, by: list[str], above: float) -> DataFrame:
    """Pairs (i, j) of chunks of a group of which the smaller has one of its first words in the other."""
    words = sets.select(*by, "chunk_index", "n", F.explode("w").alias("word"))
    common = words.groupBy(*by, "word").agg(F.count("*").alias("of")).filter("of > 1")
    shared = written(words.join(common, [*by, "word"]), "chunk-words")
    ranked = shared.groupBy(*by, "chunk_index", "n").agg(F.sort_array(F.collect_list(F.struct("of", "word"))).alias("s"))
    # Words of one chunk alone come before all and need not be listed.
    first = F.col("n") - F.floor(F.col("n") * above) - (F.col("n") - F.size("s"))
    prefix = F.slice("s", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    few = ranked.select(*by, F.col("chunk_index").alias("x"), F.col("n").alias("n_x"), F.explode(F.transform(prefix, lambda v: v["word"])).alias("word"))
    other = shared.select(*by, "word", F.col("chunk_index").alias("y"), F.col("n").alias("n_y"))
    met = few.join(other, [*by, "word"]).filter((F.col("x") != F.col("y")) & (F.col("n_x") <= F.col("n_y")))
    return met.select(*by, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()


def near_dedup(chunks: DataFrame, by: list[str], above: float = 0.9) -> DataFrame:
    """Chunks kept by the greedy rule: in order, one goes if it resembles one already kept. The
    decision over a group's pairs is a fold over its indexes, with the kept ones carried along."""
    exact = distinct_chunks(chunks, by)
    pairs = similar_chunk_pairs(exact, by, above).groupBy(*by, "j").agg(F.collect_list("i").alias("like"))
    told = exact.select(*by, "chunk_index").join(pairs.withColumnRenamed("j", "chunk_index"), [*by, "chunk_index"], "left")
    order = told.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", F.coalesce("like", F.array().cast("array<bigint>")).alias("like")))).alias("all")
    )
    kept = F.aggregate(
        "all",
        F.array().cast("array<bigint>"),
        lambda s, x: F.when(F.arrays_overlap(s, x["like"]), s).otherwise(F.array_append(s, x["chunk_index"].cast("bigint"))),
    )
    return exact.join(order.select(*by, F.explode(kept).alias("chunk_index")), [*by, "chunk_index"], "left_semi")


__all__ = ["pack", "pack_sentences", "pack_paragraphs", "distinct_chunks", "similar_chunk_pairs", "near_dedup", "overlap_coefficient"]
