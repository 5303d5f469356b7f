"""Bookmarks (doc, ord, title, level, page): built from headings and sections, checked, mended, merged,
compared, and written as tables that a PDF writer takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import structure


def scanned(outline: DataFrame, most: int = 200) -> DataFrame:
    """Entries of a document's own outline: titles trimmed, empty and very long ones dropped, level and
    page one at least."""
    title = T.strip(F.col("title"))
    return outline.filter(F.length(title).between(1, most)).withColumns({"title": title, "level": F.greatest("level", F.lit(1)), "page": F.greatest("page", F.lit(1))})


def build(headings: DataFrame, last_page: str = "last_page", deepest: int = 6) -> DataFrame:
    """Bookmarks of headings (doc, ord, title, level, page, last_page): with a title and on a page that
    the document has, levels 1 to `deepest`, numbered in order of page."""
    title = T.strip(F.col("title"))
    some = headings.filter((title != "") & (F.col("page") >= 1) & (F.col("page") <= F.col(last_page)))
    level = F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(deepest))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord"))
    return some.select("doc", place.cast("long").alias("ord"), title.alias("title"), level.alias("level"), "page")


def from_sections(sections: DataFrame) -> DataFrame:
    """Bookmarks of sections (doc, ord, title, level, page) in order of page."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord"))
    title = F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.lit("Untitled Section"))
    return sections.select("doc", place.cast("long").alias("ord"), title.alias("title"), "level", "page", F.lit("detected_section").alias("source"))


def issues(bookmarks: DataFrame) -> DataFrame:
    """What is wrong, one row an issue: doc, ord, issue. A level may be one deeper than the one before
    at most (the first: 1), pages start at 1, titles are not empty."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy("doc").orderBy("ord")), F.lit(0))
    found = bookmarks.withColumn("_before", before).select(
        "doc",
        "ord",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("level") > F.col("_before") + 1, F.concat(F.lit("level jump from "), F.col("_before").cast("string"), F.lit(" to "), F.col("level").cast("string"))),
                    F.when(F.col("page") < 1, F.lit("page below one")),
                    F.when(T.strip(F.coalesce("title", F.lit(""))) == "", F.lit("empty title")),
                )
            )
        ).alias("issue"),
    )
    return found


def optimized(bookmarks: DataFrame) -> DataFrame:
    """Mended bookmarks: those without a title or page dropped, the rest in order of page, no level
    more than one deeper than the one before: doc, ord, title, level, page."""
    title = T.strip(F.coalesce("title", F.lit("")))
    good = bookmarks.filter((title != "") & (F.col("page") >= 1)).withColumn("title", title)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord"))
    placed = good.withColumn("ord", place)
    # A level before the first: 0.
    clamped = structure.clamp_levels(placed, ["doc"], 1, first=1)
    return placed.drop("level").join(clamped, ["doc", "ord"]).select("doc", F.col("ord").cast("long").alias("ord"), "title", F.greatest("level", F.lit(1)).alias("level"), "page")


def navigation(bookmarks: DataFrame, by: str = "page") -> DataFrame:
    """doc, the page (or level), n and the titles there, in order."""
    g = bookmarks.groupBy("doc", by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ord", "title"))).alias("t"))
    return g.select("doc", by, "n", F.transform("t", lambda x: x["title"]).alias("titles"))


def merged(old: DataFrame, new: DataFrame, share: float = 0.7) -> DataFrame:
    """Of each document the old bookmarks if they are more than `share` of the new ones, else the new:
    adds origin."""
    n_old, n_new = old.groupBy("doc").agg(F.count("*").alias("_old")), new.groupBy("doc").agg(F.count("*").alias("_new"))
    counts = n_old.join(n_new, "doc", "full").select("doc", (F.coalesce("_old", F.lit(0)) > share * F.coalesce("_new", F.lit(0))).alias("_keep"))
    one = old.join(counts, "doc").filter("_keep").drop("_keep").withColumn("origin", F.lit("old"))
    two = new.join(counts, "doc").filter("not _keep").drop("_keep").withColumn("origin", F.lit("new"))
    return one.unionByName(two)


def with_differences(bookmarks: DataFrame, mappings: DataFrame, below: float = 70.0) -> DataFrame:
    """Bookmarks followed by a node for the differences and one for each section mapping (doc, ord,
    title, score from 0 to 1) less similar than `below` per cent: part (1, 2, 3), ord, level, title, page."""
    low = mappings.filter(F.col("score") * 100 < below)
    label = F.concat("title", F.lit(" ("), F.format_string("%.1f", F.col("score") * 100), F.lit(" % similar)"))
    one = bookmarks.select("doc", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("level").cast("int").alias("level"), "title", F.col("page").cast("int").alias("page"))
    root = low.select("doc").distinct().select("doc", F.lit(2).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(1).alias("level"), F.lit("Differences").alias("title"), F.lit(1).alias("page"))
    three = low.select("doc", F.lit(3).alias("part"), F.col("ord").cast("long").alias("ord"), F.lit(2).alias("level"), label.alias("title"), F.lit(1).alias("page"))
    return one.unionByName(root).unionByName(three)


def write(bookmarks: DataFrame, path: str) -> None:
    """Bookmarks as JSON, one document a row: doc and entries [level, title, page] in order, which is
    what PDF libraries take as an outline."""
    entries = F.sort_array(F.collect_list(F.struct("ord", "level", "title", "page")))
    outline = F.transform(entries, lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("page")))
    bookmarks.groupBy("doc").agg(outline.alias("entries")).write.mode("overwrite").json(path)


def linked(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks (doc, ord, title, level, page; ord unique in its document) as the nodes of an outline:
    adds parent, first, last (its first and last child), prev, next (its neighbours under the same
    parent), all as ord or null, and count (the nodes below it, of any depth). A level that jumps hangs
    under the last node of a smaller one."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("ord"))
    total = F.count("*").over(Window.partitionBy("doc"))
    rows = bookmarks.withColumns({"_k": place, "_n": total})
    below = structure.following(rows, ["doc"], "_k")
    count = F.coalesce(F.col("_near"), F.col("_n") + 1) - F.col("_k") - 1
    nodes = structure.parents(below.withColumn("count", count.cast("long")).drop("_near", "_k", "_n"), ["doc"])
    order = Window.partitionBy("doc", "parent").orderBy("ord")
    nodes = written(nodes.withColumns({"prev": F.lag("ord").over(order), "next": F.lead("ord").over(order)}), "outline-nodes")
    ends = nodes.filter("parent IS NOT NULL").groupBy("doc", F.col("parent").alias("ord")).agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    return nodes.join(ends, ["doc", "ord"], "left")


def outline_objects(nodes: DataFrame, first_object: int = 1000) -> DataFrame:
    """Nodes of linked() as the objects of a PDF outline, one text a node: doc, ord, object. Node k of a
    document (from 1, in order) is object first_object + k; first_object itself is the outline's root,
    which is the parent of nodes without one. Titles are UTF-16 with a mark, as hexadecimal text, and
    destinations are pages counted from 0, shown whole."""
    k = nodes.select("doc", F.col("ord").alias("_ord"), (F.row_number().over(Window.partitionBy("doc").orderBy("ord")) + first_object).alias("_id"))
    out = nodes
    for name in ("ord", "parent", "first", "last", "prev", "next"):
        number = k.select("doc", F.col("_ord").alias(name), F.col("_id").alias(f"_{name}"))
        out = out.join(number, ["doc", name], "left")
    link = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" /{key} "), F.col(c).cast("string"), F.lit(" 0 R"))).otherwise("")
    title = F.concat(F.lit("<FEFF"), F.hex(F.encode("title", "UTF-16BE")), F.lit(">"))
    parent = F.concat(F.lit(" /Parent "), F.coalesce("_parent", F.lit(first_object)).cast("string"), F.lit(" 0 R"))
    count = F.when(F.col("count") > 0, F.concat(F.lit(" /Count "), F.col("count").cast("string"))).otherwise("")
    page = F.concat(F.lit(" /Dest ["), (F.col("page") - 1).cast("string"), F.lit(" /Fit] >>\nendobj"))
    links = [link("Prev", "_prev"), link("Next", "_next"), link("First", "_first"), link("Last", "_last")]
    text = F.concat(F.col("_ord").cast("string"), F.lit(" 0 obj\n<< /Title "), title, parent, *links, count, page)
    return out.select("doc", "ord", text.alias("object"))


def write_outlines(nodes: DataFrame, path: str, documents_a_file: int = 64) -> None:
    """Nodes of linked() as JSON lines, a document a line with its nodes in order, `documents_a_file`
    documents to a file, through the source document_files: all files or, if a task fails, none."""
    node = F.struct("ord", "title", "level", "page", "parent", "first", "last", "prev", "next", "count")
    lines = nodes.groupBy("doc").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    lines = lines.select("doc", F.to_json(F.struct("doc", "nodes")).alias("line"), F.pmod(F.xxhash64("doc"), F.lit(1 << 62)).alias("h"))
    lines = written(lines, "outline-lines")
    shares = F.broadcast(lines.agg(F.ceil(F.count("*") / documents_a_file).alias("files")))
    files = lines.join(shares).groupBy((F.col("h") % F.greatest("files", F.lit(1))).alias("file"))
    whole = files.agg(F.sort_array(F.collect_list(F.struct("doc", "line"))).alias("l"))
    text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    named = whole.select(F.concat(F.lit("outlines-"), F.lpad(F.col("file").cast("string"), 8, "0"), F.lit(".json")).alias("name"), text.alias("content"))
    named.write.format("document_files").mode("append").save(path)
