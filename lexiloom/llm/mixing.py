"""Mixing sources to target weights, with weights that vary over training.

Each source gets a target in words: all sources share `total` of the words of the table by weight,
and none more than `most` times its own. A source with a target of r times its words repeats every
document floor(r) times and a part of them once more, in an order fixed by a hash.

When each copy comes up in training follows from the source's weight schedule: its weight moves
linearly from (1 + tilt) to (1 - tilt) times its average over training time 0 to 1, so the
demand up to time x is target * ((1 + tilt) x - tilt x^2). The copies of a source, laid end to end in
the hash order, use up that demand; the middle of each copy, as a share of the demand, is inverted
to the time at which it is due. So every copy has a position of its own, the repeats of a source
come once it has been gone through, and a source lasts as long as its schedule gives it weight.
Copies are then range-sorted by position.

Sums along a source's order are taken in two steps, within blocks of a source and over the blocks'
totals, so that a source with a third of all rows is no single task's work; identical rows are
counted first and numbered afterwards, in parts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered, written

#: White space of the word definition, and the weights that sources take in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds source_size-based targets to rows (source, source_size), one per source.

    With every source at the same level per unit of weight, those whose limit lies lowest in
    proportion to their weight reach it first; sorted that way, source k is at its limit if filling
    the first k-1 and sharing the rest by weight would put it there or above. Sources are a table of
    their own (one row each), whatever the number of documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    ranked = sizes.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.lit(total) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("rest", rest).withColumn("left", left)
    full = F.col("rest") * F.col("weight") >= F.lit(most) * F.col("source_size") * F.col("left")
    # Once a source stays below its limit all later ones do, at the level found there.
    first = F.min(F.when(~full, F.struct(F.col("source_size") / F.col("weight"), "rank", "rest", "left"))).over(everything)
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        "rank",
        F.when(full, F.lit(most) * F.col("source_size"))
        .otherwise(F.col("first.rest") * F.col("weight") / F.col("first.left"))
        .cast("double")
        .alias("target"),
    )


def _order(number: Column, text: Column) -> Column:
    """What orders the documents of a source: MD5 of id and content."""
    return F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("-")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    total: float = 1.5,
    most: float = 2.0,
    tilt: float = 0.5,
    rows_in_block: int = 2000,
    key: Column | None = None,
) -> DataFrame:
    """One row per row of `df`: id, size (words), source_size, target (of its source, in words),
    copies, taken (size * copies, the words the mix takes), positions (training times 0 to 1 of all
    copies, ascending) and position (the first of them; null without copies), range-sorted by it.

    Copies are whole documents: a document is taken once more if the middle of it, in its source's
    order, lies below what is left of the target, so a source's taken words differ from its target
    by half a document at most. Documents of over 1/200 of the target come first in that order, so
    that the one at the end is small. The order within a source follows MD5 of id and text: reruns and
    other partitionings give the same rows. Rows with a null source are a source of their own, last
    in order; a null or empty text has size 0 and is taken 0 words in floor(r) copies; null ids are
    ordered by their text; repeated rows, and rows that share an id, are taken each on its own; no
    rows give no rows. Columns of other names are ignored, whatever they are called. With `key`, a
    column over `df`, its values come along as `key`, and the rows are not sorted."""
    spark = df.sparkSession
    own = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        _order(F.col(id_col), F.col(text_col)).alias("h"),
        (F.lit(None).cast("binary") if key is None else key).alias("key"),
    )
    # Identical rows as one with their number.
    rows = written(own.groupBy("id", "source", "size", "h", "key").agg(F.count("*").alias("n")), "mix-rows")
    width = F.col("size") * F.col("n")
    sizes = rows.groupBy("source").agg(F.sum(width).alias("source_size"), F.count("*").alias("rows"))
    goal = targets(sizes.drop("rows"), weights, total, most)
    goal = written(
        goal.join(sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_in_block)).cast("int"))
        .select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "rank", "target", "whole", "extra", "blocks"),
        "mix-goal",
    )
    # The block of a row is the leading part of its place in the order: large documents first, then by hash.
    share = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = (
        rows.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
        .join(goal, ["s", "none"])
        .withColumn("late", (F.col("size") * 200 <= F.col("target")).cast("int"))
        .withColumn("block", F.col("late") * F.col("blocks") + F.floor(share * F.col("blocks")).cast("int"))
    )
    by_block = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        placed.groupBy("rank", "block").agg(F.sum(width).alias("words")).withColumn("start", F.coalesce(F.sum("words").over(by_block), F.lit(0))).drop("words"),
        "mix-blocks",
    )
    within = Window.partitionBy("rank", "block").orderBy("h", "id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum(width).over(within), F.lit(0))
    counted = placed.join(starts, ["rank", "block"]).withColumn("first", first)
    taken = (
        numbered(counted, "h")
        .withColumn("before", F.col("first") + F.col("number") * F.col("size"))
        .withColumn("more", (F.col("before") + F.col("size") / 2 < F.col("extra")).cast("int"))
        .withColumn("copies", F.col("whole") + F.col("more"))
    )
    # Extra copies are due first, then the whole ones, one after the other.
    slope = F.when(F.pmod("rank", F.lit(2)) == 1, F.lit(tilt)).otherwise(F.lit(-tilt))

    def time(copy: Column) -> Column:
        """Solves (1 + slope) x - slope x^2 = demand for x in 0..1."""
        laid = F.when((F.col("more") == 1) & (copy == 0), F.col("before")).otherwise(
            F.col("extra") + (copy - F.col("more")) * F.col("source_size") + F.col("before")
        )
        demand = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (laid + F.col("size") / 2) / F.col("target")))
        root = F.sqrt((1 + slope) * (1 + slope) - 4 * slope * demand)
        return F.when(F.abs(slope) < 1e-12, demand).otherwise((1 + slope - root) / (2 * slope))

    none = F.array().cast("array<double>")
    some = (F.col("copies") > 0) & (F.col("target") > 0)
    positions = F.when(some, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), time)).otherwise(none)
    out = taken.withColumn("positions", positions).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.get("positions", F.lit(0)).alias("position"),
        "positions",
        *([] if key is None else ["key"]),
    )
    if key is not None:
        return out
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.repartitionByRange(parts, "position", id_col).sortWithinPartitions("position", id_col)


#: More positions than this of identical rows are joined to several copies of the row.
HOT = 4096


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", position_col: str | None = None, **options) -> DataFrame:
    """The rows of `df`, all columns, once for each copy that the mix takes, range-sorted by the time
    at which the copy is due; with `position_col`, that time too. Written to files, their order is the
    training order (see training_order()).

    Rows are told apart by all their columns, so rows that share an id or have none are mixed each on
    its own, and rows that are alike in every column come as often as the mix takes them together.
    Rows that the mix doesn't take are absent; a null or empty text counts no words and comes as often
    as its source is gone through as a whole; an empty table gives no rows."""
    spark = df.sparkSession
    rest = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), 16, "0")
    every = F.unhex(F.concat(F.md5(F.coalesce(F.col(text_col), F.lit(""))), rest))
    plan = mix(df, id_col, text_col, source_col, **options, key=every)
    plan = written(plan.select(F.col("key").alias("__key"), F.explode("positions").alias("__position")), "mix-plan")
    # The row as one column, so that its own columns may have any name.
    one = df.select(every.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")).dropDuplicates(["__key"])
    hot = written(plan.groupBy("__key").agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT), "mix-hot")
    if hot.limit(1).count() == 0:
        taken = one.join(plan, "__key")
    else:  # a row of which there are very many copies is dealt to several tasks
        salts = F.ceil(F.col("__n") / HOT).cast("int")
        few = one.join(plan.join(hot, "__key", "left_anti"), "__key")
        left = one.join(hot, "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__n")
        right = plan.join(hot, "__key").withColumn("__salt", F.pmod(F.xxhash64("__position"), salts.cast("long")).cast("int")).drop("__n")
        taken = few.unionByName(left.join(right, ["__key", "__salt"]).drop("__salt"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = taken.repartitionByRange(parts, "__position", "__key").sortWithinPartitions("__position", "__key")
    return ordered.select("__row.*", *([] if position_col is None else [F.col("__position").alias(position_col)]))


def training_order(df: DataFrame, name: str) -> DataFrame:
    """Adds the place in training order of the rows of files written from mixed(): the number of the
    part file, the number of the file within the part (a task may write several), then the number of
    the row in it, in one long that is unique and ascends with the position. The longs are as wide as
    the largest of these numbers, which the files' footers tell, ask for; files in which they don't fit
    raise. A frame that isn't read straight from files has its rows' order as Spark numbers them."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())
    part, file = (F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), x, 1).try_cast("long"), F.lit(0)) for x in (r"part-(\d+)", r"-c(\d+)"))
    row = F.col("_metadata.row_index")
    most = df.select(part.alias("part"), file.alias("file"), row.alias("row")).agg(F.max("part"), F.max("file"), F.max("row")).first()
    bits = [int(x or 0).bit_length() for x in most]
    if sum(bits) > 63:
        raise ValueError(f"{name} takes {sum(bits)} bits: write fewer or smaller files")
    return df.withColumn(name, F.shiftleft(part, bits[1] + bits[2]) + F.shiftleft(file, bits[2]) + row)
