"""Exact dedup by progressive refinement, in DataFrame expressions only.

Texts are equal if they are identical once every run of white space is one space. The first scan
keeps two numbers of each such text, its length and a hash of its first characters. Lengths that occur
once are done with; rows of the other lengths are grouped by length and prefix hash; what occurs once
there is done with as well. The second scan takes the full hash, SHA-256, of the rows that are left and
groups them by all three. No text is ever shuffled: what travels are numbers, and of rows that are done
with not even those.

What is left is told by a bit map over the surviving groups, of a fixed size whatever the input. A bit
shared with another group sends a row on that needn't go, never one back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Fixed value: white space whose runs become one space. A single space is left as it is.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++"
#: Bits of a bit map: 2^18 words of 64, so at most so many rows are broadcast.
MAP_BITS = 24
#: Groups of over one part in so many of all rows, of which there can't be more, are broadcast.
HOT = 1000


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def bit_map(keys: DataFrame, h: str) -> DataFrame:
    """Rows (word, bits) that mark the numbers in column `h`: at most 2^18, of however many keys."""
    place = F.pmod(F.col(h), F.lit(1 << MAP_BITS))
    marks = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 AS int))").alias("bit"))
    return marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def marked(rows: DataFrame, h: Column, bits: DataFrame) -> DataFrame:
    """`rows` with `maybe`: whether the map has the number `h`. The map is bounded, so it is broadcast."""
    place = F.pmod(h, F.lit(1 << MAP_BITS))
    found = rows.withColumn("place", place).withColumn("word", F.shiftright("place", 6)).join(F.broadcast(bits), "word", "left")
    hit = F.coalesce(F.getbit("bits", F.col("place").bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return found.withColumn("maybe", hit).drop("word", "place", "bits")


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest: bool = False) -> DataFrame:
    """One row per row of `df`: id, keep_id (the smallest id of the rows with an equal text), group_size
    (the number of these rows) and kept (id is keep_id); with `digest` also text_sha256 of every
    normalised text, which takes the full hash of texts that need none for their groups.

    A null text counts as empty. Texts of white space alone are one space: equal to one another, not to
    the empty text. Null ids are larger than none: keep_id is null only if all
    rows of the group lack an id, and then all are kept. Rows that repeat id and text are marked alike.
    Texts are used whole, of any length; an empty table gives no rows; other columns, whatever their
    names, are not read."""
    found = grouped(df, id_col, text_col, prefix, digest)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), *(["text_sha256"] if digest else []))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, less copies: of each group the row with the smallest id stays, one
    of them where several repeat it. Rows without id stay if their group has none with one. Columns may
    have any name; an empty table gives no rows."""
    found = grouped(df, id_col, text_col, digest=True, **options)
    keep = written(found.groupBy(F.col("text_sha256").alias("__sha")).agg(F.first("keep_id").alias("__keep"), F.count("*").alias("__n")), "exact-keep")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    rows = df.select(F.sha2(normal(F.col(text_col)), 256).alias("__sha"), F.col(id_col).alias("__id"), whole)
    # Of large groups, which are few, only rows under the id that stays travel at all.
    limit = (keep.agg(F.sum("__n")).first()[0] or 0) // HOT
    hot = F.broadcast(keep.filter(F.col("__n") > limit).select("__sha", F.col("__keep").alias("__hot"), "__n"))
    rows = rows.join(hot, "__sha", "left").filter(F.col("__n").isNull() | F.col("__id").eqNullSafe(F.col("__hot"))).drop("__hot", "__n")
    kept = keep.select(F.col("__sha").alias("__k"), "__keep")
    return rows.join(kept, (F.col("__sha") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__keep")), "left_semi").dropDuplicates(["__sha"]).select("__row.*")


def grouped(df: DataFrame, id_col: str, text_col: str, prefix: int = 64, digest: bool = False) -> DataFrame:
    """Rows id, keep_id, group_size and, with `digest`, text_sha256."""
    rows = df.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("text"))
    keys = {"n": F.length("text"), "p": F.xxhash64(F.left("text", F.lit(prefix)))}
    first = written(rows.withColumns(keys).select("n", "p"), "exact-prefixes")
    # Lengths that occur more than once; then prefixes that do among rows of these lengths.
    lengths = first.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1")
    some = marked(first, F.col("n"), bit_map(lengths, "n")).filter("maybe")
    prefixes = some.groupBy("n", "p").agg(F.count("*").alias("c")).filter("c > 1")
    both = F.xxhash64("n", "p")
    bits = written(bit_map(prefixes.select(both.alias("h")), "h"), "exact-map")
    full = F.sha2("text", 256)
    hashed = marked(rows.withColumns(keys), both, bits).select("id", "n", "p", "maybe", (full if digest else F.when(F.col("maybe"), full)).alias("text_sha256"))
    hashed = written(hashed, "exact-rows")
    some, key = hashed.filter("maybe"), ["n", "p", "text_sha256"]
    groups = written(some.groupBy(*key).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    limit = hashed.count() // HOT
    hot = F.broadcast(groups.filter(F.col("group_size") > limit))
    shown = ["id", "keep_id", "group_size", *(["text_sha256"] if digest else [])]
    large = some.join(hot, key).select(*shown)
    small = some.join(hot, key, "left_anti").join(groups.filter(F.col("group_size") <= limit), key).select(*shown)
    alone = hashed.filter("not maybe").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")}).select(*shown)
    return alone.unionByName(large).unionByName(small)
