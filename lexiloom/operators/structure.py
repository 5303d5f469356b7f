"""Headings, numbered chapters, tables of contents, sections and outlines.

Lines are rows (doc, page, line_no, line); spans are rows (doc, page, y, text, size, bold). Every
operator keeps documents apart, so work is dealt by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

#: Heading patterns in order, with level and confidence.
HEADINGS = (
    (r"^第\d+章\s*(.*)$", 1, 0.9),
    (r"^第\d+節\s*(.*)$", 1, 0.9),
    (r"^第\d+項\s*(.*)$", 1, 0.9),
    (r"^第\d+条\s*(.*)$", 1, 0.9),
    (r"^(\d+)[\.\s](.+)$", 2, 0.9),
    (r"^(\d+)[-\s](\d+)[\.\s](.+)$", 2, 0.9),
    (r"^(\d+)\.(\d+)[\.\s](.+)$", 2, 0.9),
    (r"^(\d+)\.(\d+)\.(\d+)[\.\s](.+)$", 2, 0.9),
    (r"^[〇一二三四五六七八九十]+[\.\s](.*)$", 2, 0.9),
    (r"^(\d+\.?\d*\.?\d*)\s+(.+)$", 2, 0.8),
    (r"^([A-Z]+\.)\s+(.+)$", 2, 0.8),
    (r"^([IVXLCDM]+\.)\s+(.+)$", 2, 0.8),
    (r"^(Chapter\s+\d+)\s*(.*)$", 1, 0.8),
    (r"^(Section\s+\d+)\s*(.*)$", 2, 0.8),
)
#: Words that make a line a heading.
KEYWORDS = (
    "はじめに",
    "概要",
    "まとめ",
    "結論",
    "背景",
    "目的",
    "課題",
    "解決策",
    "提案",
    "検証",
    "評価",
    "考察",
    "今後の課題",
    "参考文献",
    "付録",
    "introduction",
    "overview",
    "summary",
    "conclusion",
    "background",
    "objective",
    "methodology",
    "results",
    "discussion",
    "references",
    "appendix",
    "abstract",
)
#: Headings by font and in plain text.
FONT_HEADING = r"^(\d+[.\s]|[A-Z][A-Z\s]+$|\d+[.]\d+|[IVXLCDM]+[.]|[A-Z][.])"
PLAIN_HEADINGS = (
    (r"^(\d+\.?\d*\.?\d*)\s+(.+)$", 1),
    (r"^([A-Z]+\.)\s+(.+)$", 2),
    (r"^([IVXLCDM]+\.)\s+(.+)$", 2),
    (r"^(第\d+章)\s*(.*)$", 1),
    (r"^(第\d+節)\s*(.*)$", 2),
    (r"^(\d+\.\d+)\s+(.+)$", 2),
    (r"^([A-Z][A-Z\s]+)$", 2),
)
#: Words of a page with contents, and what starts a page of content.
TOC_WORDS = ("目次", "もくじ", "総目次", "索引", "contents", "table of contents", "index", "一覧", "list", "概要", "overview")
STARTS = (r"^第?\d+章", r"^\d+[\.\-]\d+", r"^第?\d+節", "^はじめに", "^序章", "^introduction", "^序論")
#: Numbered headings, longest first: three numbers, two, one; a separator must follow the number.
NUMBERED = (
    r"^(\d+)[-\s](\d+)[-\s](\d+)[\.\s]+(.+)$",
    r"^(\d+)\.(\d+)\.(\d+)[\.\s]+(.+)$",
    r"^(\d+)[-\s](\d+)[\.\s]+(.+)$",
    r"^(\d+)\.(\d+)[\.\s]+(.+)$",
    r"^(\d+)[\.\s]+(.+)$",
)


def has_keyword(c: Column, words: tuple[str, ...] = KEYWORDS) -> Column:
    return F.lower(c).rlike("|".join(words))


def pattern_headings(lines: DataFrame) -> DataFrame:
    """Lines that a pattern or keyword makes headings, with level and confidence of the first that fits."""
    told = lambda n, c: F.struct(F.lit(n).alias("level"), F.lit(c).alias("confidence"))
    found = F.when(has_keyword(F.col("line")), told(2, 0.7))
    for pattern, n, c in reversed(HEADINGS):
        found = F.when(F.col("line").rlike(pattern), told(n, c)).otherwise(found)
    # Exploded, so that a line is matched once for its level, its confidence and whether it has them.
    matched = F.explode(F.filter(F.array(found), lambda x: x.isNotNull()))
    return lines.withColumn("_h", matched).select(*lines.columns, "_h.level", "_h.confidence")


def position_headings(lines: DataFrame, by: list[str]) -> DataFrame:
    """Short lines with a keyword before a long line: level 2, confidence .6."""
    n = F.length("line")
    # Found before the window: of other lines only the length goes there.
    short = F.when((n >= 3) & (n < 80) & has_keyword(F.col("line")), F.col("line"))
    following = F.lead("_n").over(Window.partitionBy(*by).orderBy("line_no"))
    told = lines.withColumn("_n", n).withColumn("line", short).withColumn("_following", following)
    return told.filter("line IS NOT NULL AND _following > 50").drop("_n", "_following").withColumns({"level": F.lit(2), "confidence": F.lit(0.6)})


def plain_headings(lines: DataFrame) -> DataFrame:
    """Lines of up to 150 characters that a pattern of plain text makes headings, with its level."""
    line = T.strip(F.col("line"))
    level = F.lit(None).cast("int")
    for pattern, n in reversed(PLAIN_HEADINGS):
        level = F.when(line.rlike(pattern), n).otherwise(level)
    found = lines.withColumns({"line": line, "level": level})
    return found.filter((F.length("line") > 0) & (F.length("line") <= 150) & F.col("level").isNotNull())


def font_headings(spans: DataFrame, by: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """Spans (text, size, bold) in a size half a deviation above their page's mean, or bold, that look
    like headings: 4 to 149 characters, no full stop, a number, a letter or capitals in front."""
    page = Window.partitionBy(*by)
    large = F.col("size") >= F.avg("size").over(page) + 0.5 * F.stddev_pop("size").over(page)
    n = F.length("text")
    fits = (n > 3) & (n < 150) & ~F.col("text").rlike(r"[.]$") & F.col("text").rlike(FONT_HEADING)
    return spans.withColumn("_large", large | F.col("bold")).filter(F.col("_large") & fits).drop("_large")


def document_font_headings(spans: DataFrame) -> DataFrame:
    """Rows of spans (doc, page, x, y, x1, y1, text, size, bold) that stand out in their document: in a
    size a deviation above the mean and no less than three quarters of the sizes, or bold; spans at
    one height are one heading: doc, page, row_y, text (from left to right), size, bold, and its box."""
    stats = spans.groupBy("doc").agg(F.avg("size").alias("_m"), F.stddev_pop("size").alias("_s"), F.percentile("size", F.lit(0.75)).alias("_p"))
    big = spans.join(stats, "doc").filter((F.col("size") >= F.greatest(F.col("_m") + F.col("_s"), F.col("_p"))) | F.col("bold"))
    g = big.groupBy("doc", "page", F.floor("y").cast("int").alias("row_y")).agg(
        F.sort_array(F.collect_list(F.struct("x", "text"))).alias("t"),
        F.max("size").alias("size"),
        F.max("bold").alias("bold"),
        *[f(c).alias(c) for f, c in ((F.min, "x"), (F.min, "y"), (F.max, "x1"), (F.max, "y1"))],
    )
    return g.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), " ")).drop("t")


def font_levels(spans: DataFrame) -> DataFrame:
    """Adds level: the rank of the size among the document's sizes, one less if bold, from 1 to 6."""
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size")))
    return spans.withColumn("level", F.least(F.greatest(rank - F.col("bold").cast("int"), F.lit(1)), F.lit(6)))


def combined_headings(*found: DataFrame) -> DataFrame:
    """Headings of several detectors (page, ord, text, confidence, level) in one: repeated ones of a page
    once, the surest of them, then those that are valid, numbered by page and falling confidence."""
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    together = written(together, "headings")  # detected once
    distinct = dedup_headings(together.select("page", "ord", "text", "confidence"), ["page"])
    levels = together.groupBy("page", "ord").agg(F.first("level").alias("level"))
    kept = valid_headings(distinct.join(levels, ["page", "ord"]))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("confidence"), "ord")).cast("long"))


def flattened(outline: DataFrame) -> DataFrame:
    """An outline (doc, ord, level, title) as indented lines in order: adds label and n_before
    (entries before it)."""
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return outline.withColumns({"label": F.concat(F.expr("repeat('  ', level - 1)"), F.col("title")), "n_before": F.count("*").over(before)})


def font_confidence(size: Column, bold: Column, fits: Column) -> Column:
    score = 0.5 + F.when(size > 14, 0.2).otherwise(0.0) + F.when(bold, 0.2).otherwise(0.0) + F.when(fits, 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def dedup_headings(headings: DataFrame, by: list[str], above: float = 0.8) -> DataFrame:
    """In order (ord), a heading whose letters resemble one kept on the page goes, or takes its place
    if it is the more confident. A fold over each page's headings."""
    row = "struct<ord:bigint,text:string,confidence:double,chars:array<string>>"
    item = F.struct(F.col("ord").cast("bigint").alias("ord"), "text", F.col("confidence").cast("double").alias("confidence"), T.char_set(F.col("text")).alias("chars"))
    pages = headings.groupBy(*by).agg(F.sort_array(F.collect_list(item.cast(row))).alias("all"))

    def alike(a: Column, b: Column) -> Column:
        return T.jaccard(a["chars"], b["chars"]) > above

    def step(kept: Column, x: Column) -> Column:
        twin = F.get(F.filter(kept, lambda y: alike(y, x)), F.lit(0))
        swapped = F.concat(F.filter(kept, lambda y: y["ord"] != twin["ord"]), F.array(x))
        return F.when(twin.isNull(), F.concat(kept, F.array(x))).when(x["confidence"] > twin["confidence"], swapped).otherwise(kept)

    kept = F.aggregate("all", F.array().cast(f"array<{row}>"), step)
    return pages.select(*by, F.explode(kept).alias("h")).select(*by, "h.ord", "h.text", "h.confidence")


def valid_headings(headings: DataFrame) -> DataFrame:
    n = F.length("text")
    sentence = (n > 50) & F.col("text").rlike(r"[.。]$")
    return headings.withColumn("text", T.strip(F.col("text"))).filter(n.between(2, 200) & ~sentence & (F.col("confidence") >= 0.4)).withColumn("text", T.collapse(F.col("text")))


#: What any of these begins with: most lines are ruled out by it alone.
NUMBER_FIRST = r"^\d+[-.\s]"


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of 5 to 150 characters with a number: chapter, section, subsection, title, level, numbering.
    The first of the patterns that fits is looked for once a line, and its groups are read off it."""

    def found(line: Column) -> Column:
        parts = F.lit(None).cast("array<string>")
        for pattern in reversed(NUMBERED):
            n = pattern.count("(") - 1
            groups = [F.regexp_extract(line, pattern, k) for k in range(1, n + 1)]
            none = [F.lit(None).cast("string")] * (3 - n)
            parts = F.when(line.rlike(pattern), F.array(*groups, *none, F.trim(F.regexp_extract(line, pattern, n + 1)))).otherwise(parts)
        return parts

    def told(x: Column) -> Column:
        numbers = [x[k].try_cast("int").alias(name) for k, name in enumerate(("chapter", "section", "subsection"))]
        return F.struct(*numbers, x[3].alias("title"))

    some = lines.filter(F.length("line").between(5, 150) & F.col("line").rlike(NUMBER_FIRST))
    # Exploded, so that no later filter or column works the match out again.
    matched = F.explode(F.transform(F.filter(F.transform(F.array("line"), found), lambda x: x.isNotNull()), told))
    out = some.withColumn("_n", matched).filter("_n.chapter IS NOT NULL").select(*lines.columns, "_n.*")
    level = F.when(F.col("subsection").isNotNull(), 3).when(F.col("section").isNotNull(), 2).otherwise(1)
    label = F.concat_ws("-", F.col("chapter").cast("string"), F.col("section").cast("string"), F.col("subsection").cast("string"))
    return out.withColumns({"level": level, "numbering": label})


def placed(headings: DataFrame, *order: str, by: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Adds place: the number of each heading in its document in the order of columns; a minus in front
    means falling."""
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return headings.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("long"))


def sort_key(numbering: Column, digits: int = 10) -> Column:
    """Numeric order of hierarchical numbers as text: each number with zeros in front, or as it is if it
    is longer than `digits`."""
    pad = lambda x: F.lpad(x, F.greatest(F.length(x), F.lit(digits)), F.lit("0"))
    return F.array_join(F.transform(F.regexp_extract_all(numbering, F.lit(r"(\d+)"), 1), pad), ".")


def valid_sequence(chapters: DataFrame, by: list[str]) -> DataFrame:
    """First occurrence of each numbering, within bounds; the very first row is exempt from them."""
    order = ("page", "line_no")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    bounded = (F.col("chapter") <= 50) & (F.coalesce("section", F.lit(0)) <= 20) & (F.coalesce("subsection", F.lit(0)) <= 20)
    kept = chapters.withColumn("first", first).filter(bounded | (F.col("first") == 1))
    seen = F.row_number().over(Window.partitionBy(*by, "numbering").orderBy(*order))
    return kept.withColumn("seen", seen).filter("seen = 1").drop("first", "seen")


def _nearest(rows: DataFrame, by: list[str], value: str, backwards: bool) -> DataFrame:
    """Adds _near: `value` of the nearest row before of a smaller level, or, backwards, of the nearest
    row after of no greater level. One fold over a group's rows in order, with a stack of the rows that
    can still be nearest, one a level at most."""
    kind = rows.schema[value].dataType.simpleString()
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    items = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("level").cast("int").alias("level"), F.col(value).alias("value"), row.alias("row"))), not backwards).alias("all"))
    whole = rows.select(row.alias("row")).schema["row"].dataType.simpleString()
    state = f"struct<stack:array<struct<level:int,value:{kind}>>,out:array<struct<row:{whole},near:{kind}>>>"
    none = F.struct(F.array().cast(f"array<struct<level:int,value:{kind}>>").alias("stack"), F.array().cast(f"array<struct<row:{whole},near:{kind}>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = F.filter(s["stack"], lambda y: y["level"] <= x["level"] if backwards else y["level"] < x["level"])
        kept = F.filter(s["stack"], lambda y: y["level"] < x["level"])
        own = F.struct(x["level"].alias("level"), x["value"].alias("value"))
        told = F.struct(x["row"].alias("row"), F.get(fits, F.lit(0))["value"].alias("near"))
        return F.struct(F.concat(F.array(own), kept).alias("stack"), F.array_append(s["out"], told).alias("out")).cast(state)

    return items.select(F.explode(F.aggregate("all", none.cast(state), step)["out"]).alias("o")).select("o.row.*", F.col("o.near").alias("_near"))


def intervals(headings: DataFrame, last_page: str = "last_page") -> DataFrame:
    """Adds page_end: the page before the next heading of the same or a higher level, else the last
    page; never before the heading's own."""
    found = _nearest(headings, ["doc"], "page", backwards=True)
    return found.withColumn("page_end", F.greatest("page", F.coalesce(F.col("_near") - 1, F.col(last_page)))).drop("_near")


def following(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds _near: `value` of the next row (in order of ord) of the same or a smaller level."""
    return _nearest(rows, by, value, backwards=True)


def clamp_levels(rows: DataFrame, by: list[str], jump: int, first: int | None = None) -> DataFrame:
    """Levels at most `jump` deeper than the one before, as it came out itself (the first one at most
    `first`): a fold in order."""
    items = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "level"))).alias("all"))
    state = "struct<last:int,out:array<struct<ord:int,level:int>>>"
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<ord:int,level:int>>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        free = x["level"] if first is None else F.least(x["level"], F.lit(first))
        level = F.when(s["last"].isNull(), free).otherwise(F.least(x["level"], s["last"] + jump))
        return F.struct(level.alias("last"), F.array_append(s["out"], F.struct(x["ord"].alias("ord"), level.alias("level"))).alias("out")).cast(state)

    return items.select(*by, F.explode(F.aggregate("all", start, step)["out"]).alias("r")).select(*by, "r.ord", "r.level")


def parents(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds parent: order number of the last earlier row of a smaller level, of any depth."""
    return _nearest(rows, by, "ord", backwards=False).withColumnRenamed("_near", "parent")
