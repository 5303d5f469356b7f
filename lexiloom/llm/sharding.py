"""Sharding by extendible hashing.

Documents are dealt into buckets by the leading bits of a hash. A directory starts at depth 0, and
only buckets over the byte limit are split on one more bit, until every bucket fits. A shard is a
leaf of that tree: a depth and a prefix of so many bits.

The tree is grown without passing over documents once for each bit: bytes are added up by prefixes
of some depth, summed again for every shorter prefix, and the leaf of a document is the shortest
prefix whose bytes fit. Buckets that are still too large at that depth (hot keys, or more bytes
than foreseen) are refined the same way, a number of bits further down, alone. The hash has 128
bits, 64 of the id and 64 of the content, so that rows that share an id part too; what then still
lies together are identical rows, which are dealt to overflow pages of the bucket by number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered, written

BITS = 128


def _hash(df: DataFrame, id_col: str, text_col: str) -> Column:
    """128 bits, 64 of the id and 64 of the content, as text of 0 and 1."""
    return F.concat(_bits(F.xxhash64(F.lit(11), F.col(id_col))), _bits(F.xxhash64(F.lit(12), F.col(id_col), F.col(text_col))))


def shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 8 << 20,
    step: int = 8,
) -> DataFrame:
    """One row per row of `df`: id, n_bytes (of the text in UTF-8), depth and prefix (the shard's
    bits, as text of 0 and 1), page (0 unless the bucket overflows), shard (name of the shard:
    prefix, or prefix and page) and shard_bytes.

    Every shard holds `limit` bytes or less, unless it is one single row that is larger on its own.
    A null text has no bytes; a null id is hashed like any other value; identical rows are dealt to
    pages by number; an empty table gives no rows. Other columns are ignored. The same rows get the
    same shards in every run."""
    found = _leaves(df, id_col, text_col, limit, step)
    rows = numbered(found, "bits", "rows")
    page = F.when(_over(limit), F.floor(F.col("number") / _room(limit))).otherwise(0).cast("long")
    on_page = F.least(_room(limit), F.col("rows") - page * _room(limit)) * F.col("n_bytes")
    return rows.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "depth",
        "prefix",
        page.alias("page"),
        _name(limit, page).alias("shard"),
        F.when(_over(limit), on_page).otherwise(F.col("shard_bytes")).alias("shard_bytes"),
    )


def _over(limit: int) -> Column:
    return F.col("shard_bytes") > limit


def _room(limit: int) -> Column:
    """Rows to a page of a bucket of identical rows beyond the limit: as many as fit, one at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")


def _name(limit: int, page: Column) -> Column:
    return F.when(_over(limit), F.concat_ws("-", "prefix", page.cast("string"))).otherwise(F.col("prefix"))


def _leaves(df: DataFrame, id_col: str, text_col: str, limit: int, step: int) -> DataFrame:
    """Rows of the same id and text as one, with the leaf they fall in: id, n_bytes, bits, rows,
    depth, prefix, shard_bytes."""
    hashed = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        _hash(df, id_col, text_col).alias("bits"),
    )
    # Identical rows as one with their number.
    rows = written(hashed.groupBy("id", "n_bytes", "bits").agg(F.count("*").alias("rows")), "shard-rows")
    total = rows.agg(F.sum(F.col("n_bytes") * F.col("rows"))).first()[0] or 0
    reach = min(BITS, math.ceil(math.log2(max(1, total / limit))) + 3)
    open_rows, start, leaves = rows, 0, []
    while True:
        # Bytes by prefix of the deepest level, then of every level above down from `start`.
        deepest = written(
            open_rows.groupBy(F.substring("bits", 1, reach).alias("deep")).agg(F.sum(F.col("n_bytes") * F.col("rows")).alias("bytes")),
            "shard-deepest",
        )
        levels = (
            deepest.select("deep", "bytes", F.explode(F.sequence(F.lit(start), F.lit(reach))).alias("depth"))
            .groupBy("depth", F.expr("substring(deep, 1, depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        # The shortest prefix that fits is a leaf; at full depth a bucket is one whatever it holds.
        fits = levels.filter((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        fits = written(fits, "shard-levels")
        of = (
            deepest.select("deep", F.explode(F.sequence(F.lit(start), F.lit(reach))).alias("depth"))
            .withColumn("prefix", F.expr("substring(deep, 1, depth)"))
            .join(fits, ["depth", "prefix"])
            .groupBy("deep")
            .agg(F.min(F.struct("depth", "prefix", F.col("bytes").alias("shard_bytes"))).alias("leaf"))
        )
        of = written(of, "shard-leaves")
        placed = open_rows.withColumn("deep", F.substring("bits", 1, reach)).join(of, "deep", "left")
        leaves.append(placed.filter("leaf is not null").select("id", "n_bytes", "bits", "rows", "leaf.*"))
        if reach == BITS:
            break
        over = deepest.select("deep").join(of, "deep", "left_anti")
        if over.limit(1).count() == 0:
            break
        open_rows = written(placed.filter("leaf is null").select("id", "n_bytes", "bits", "rows"), "shard-open")
        start, reach, step = reach + 1, min(BITS, reach + step), 2 * step
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    return found


def directory(assigned: DataFrame) -> DataFrame:
    """The directory of the shards of shards(), a row for each bucket: prefix, depth, first and last (the
    entries, numbers of as many bits as the deepest bucket has, that point to it, as text of 0 and 1),
    shard (its first page) and pages. Entries that point to one bucket are neighbours, so they are one
    range, whatever the depth. Entries under which no row lies are in no range; a table without rows has
    no entries."""
    buckets = assigned.groupBy("prefix", "depth").agg(F.min_by("shard", "page").alias("shard"), (F.max("page") + 1).alias("pages"))
    bits = buckets.agg(F.max("depth").alias("bits"))
    spread = buckets.join(F.broadcast(bits))  # one row
    ends = [F.rpad("prefix", F.col("bits"), F.lit(x)) for x in "01"]
    return spread.select("prefix", "depth", ends[0].alias("first"), ends[1].alias("last"), "shard", "pages")


def located(df: DataFrame, entries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `df` with the bucket of a directory() that their hash leads to: prefix, shard and pages, null
    where no bucket has its entry. Buckets are looked up by each depth that occurs (129 at most), so by
    equal prefixes."""
    depths = F.broadcast(entries.select("depth").distinct())
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    bits = df.select(_hash(df, id_col, text_col).alias("__bits"), whole)
    tried = bits.select("__bits").distinct().join(depths).withColumn("prefix", F.expr("substring(__bits, 1, depth)"))
    found = tried.join(entries.select("prefix", "depth", "shard", "pages"), ["prefix", "depth"]).select("__bits", "prefix", "shard", "pages")
    return bits.join(found, "__bits", "left").select("__row.*", "prefix", "shard", "pages")


def _bits(number: Column) -> Column:
    """64 bits of a long as text of 0 and 1."""
    return F.lpad(F.bin(number), 64, "0")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 8 << 20, step: int = 8) -> None:
    """Writes the rows of `df`, all columns, under one folder shard=<name> for each of its shards.

    Rows are placed by id and content as shards() does it, so that rows with a null id, a null text
    or a shared id are written, each where it belongs; rows that repeat id and text fill the pages of
    their bucket in turn. A column named shard comes along as it is in the rows' `row` column; an
    empty table writes no folder. Rows are written as they are, whole."""
    leaves = written(_leaves(df, id_col, text_col, limit, step), "shard-of")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(_hash(df, id_col, text_col).alias("bits"), whole)
    placed = rows.join(leaves.drop("id"), "bits")
    plain = placed.filter(~_over(limit)).select(F.col("prefix").alias("shard"), "row")
    # Rows of overflowing buckets are numbered task by task, from where the tasks before end.
    over = written(placed.filter(_over(limit)).withColumn("task", F.spark_partition_id()), "shard-over")
    counts = over.groupBy("bits", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bits").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bits", "task", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("bits", "task").orderBy(F.lit(0))) - 1
    numbers = over.withColumn("within", within).join(starts, ["bits", "task"])
    paged = numbers.select(_name(limit, F.floor((F.col("start") + F.col("within")) / _room(limit)).cast("long")).alias("shard"), "row")
    named = plain.unionByName(paged).withColumn("shard", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")))
    named.select("shard", *([F.col("row")] if "shard" in df.columns else [F.col("row.*")])).repartition("shard").write.partitionBy("shard").parquet(path)
