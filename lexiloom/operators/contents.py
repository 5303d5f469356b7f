"""Tables of contents, chapters and the text of sections, from lines of documents.

Lines are rows (doc, page, line_no, line); entries of a table of contents are rows (doc, ord, title,
page, level, ...). Rows of different documents never meet: every join has doc among its keys, and
titles are compared only with lines of their page or of the pages beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking
from .structure import STARTS, TOC_WORDS

#: What makes a page one with contents, lines of contents, chapters in titles.
TOC_PAGE_WORDS = ("目次", "contents", "table of contents", "索引", "index")
TOC_DOTS = r"[^\n]\.\.\.\s*\d+"
TOC_NUMBER = r"[^\n]\s+\d+$"
TOC_LINES = (r"^(.+?)\.{3,}\s*(\d+)$", r"^(.+?)\s+(\d+)$")
#: A line of contents that begins with a number of one part or more.
TOC_NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+.+?(?:\.{3,}\s*|\s)\d+$"
CHAPTER_IN_TITLE = (r"^第?(\d+)章", r"^(\d+)[.\s]", r"^Chapter\s*(\d+)")
#: Words in section titles and the chapter titles that they stand for.
THEMES = (
    ("安全", "安全管理"),
    ("操作", "操作方法"),
    ("運転", "運転操作"),
    ("保守", "保守・点検"),
    ("メンテナンス", "メンテナンス"),
    ("設定", "設定・調整"),
    ("トラブル", "トラブルシューティング"),
    ("故障", "故障対応"),
    ("仕様", "仕様・性能"),
    ("構造", "構造・機能"),
)


def bare(c: Column) -> Column:
    """Lower case without punctuation, as titles and lines are compared."""
    return F.regexp_replace(T.strip(F.lower(c)), r"[^\p{L}\p{N}_\s]", "")


def alike(a: Column, b: Column) -> Column:
    """Word Jaccard of two bare texts; 0 if either is empty."""
    # Sets and what they share are bound by lambdas: as columns they would be made anew wherever they are named.
    sets = F.array(F.struct(F.array_distinct(T.words(a)).alias("a"), F.array_distinct(T.words(b)).alias("b")))
    shared = lambda w: F.transform(F.array(F.size(F.array_intersect(w["a"], w["b"]))), lambda n: T.jaccard_of(F.size(w["a"]), F.size(w["b"]), n))[0]
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.transform(sets, shared)[0])


def is_heading_line(line: Column, title: Column, above: float = 0.8) -> Column:
    """Whether the line holds the title or has nearly the same words. Either is made bare once."""
    both = F.array(F.struct(bare(line).alias("x"), bare(title).alias("y")))
    return F.exists(both, lambda p: F.contains(p["x"], p["y"]) | (alike(p["x"], p["y"]) > above))


# Tables of contents ----------------------------------------------------------------------------


def toc_pages(lines: DataFrame, first: int = 10) -> DataFrame:
    """Pages (doc, page) among the `first` of each document that hold contents: by a word, or by more
    than five lines that end in a page number."""
    line = F.col("line")
    word = F.lower(line).rlike("|".join(TOC_PAGE_WORDS))
    listed = line.rlike(TOC_DOTS).cast("int") + line.rlike(TOC_NUMBER).cast("int")
    by_page = lines.filter(F.col("page") <= first).groupBy("doc", "page").agg(F.max(word).alias("word"), F.sum(listed).alias("n"))
    return by_page.filter("word or n > 5").select("doc", "page")


def toc_lines(lines: DataFrame) -> DataFrame:
    """Entries that lines of contents hold: doc, ord (place in the document), title, page, level. The
    level is the number of parts of the number in front (1.2 has two), 1 without a number; the title
    keeps its number. Lines of fewer than five characters are none."""
    line = T.strip(F.col("line"))
    title, page = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern in reversed(TOC_LINES):
        fits = line.rlike(pattern)
        title = F.when(fits, T.strip(F.regexp_extract(line, pattern, 1))).otherwise(title)
        page = F.when(fits, F.regexp_extract(line, pattern, 2)).otherwise(page)
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    found = lines.withColumns({"_line": line, "_title": title, "_page": page}).filter((F.length("_line") >= 5) & F.col("_page").isNotNull())
    parts = F.size(F.split(F.regexp_extract("_line", TOC_NUMBERED, 1), r"\."))
    level = F.when(F.col("_line").rlike(TOC_NUMBERED), parts).otherwise(1)
    return found.select("doc", F.row_number().over(order).cast("long").alias("ord"), F.col("_title").alias("title"), F.expr("try_cast(_page AS INT)").alias("page"), level.alias("level"))


def chapter_of_title(title: Column) -> Column:
    """Number of the chapter that a title names, or null; a number too large for one (a telephone's, say)
    names none."""
    found = [F.nullif(F.regexp_extract(T.strip(title), p, 1), F.lit("")) for p in CHAPTER_IN_TITLE]
    return F.coalesce(*found).try_cast("int")


def integrate(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """Entries with the text's sections of their chapter below them: doc, ord, section, subsection, level,
    title, page. Sections of chapters that the contents don't name are dropped.

    sections: doc, chapter, section, subsection (or null), title, page."""
    own = entries.withColumn("chapter", chapter_of_title(F.col("title")))
    zero = F.lit(0)
    heads = own.select("doc", "ord", zero.alias("section"), zero.alias("subsection"), "level", "title", "page")
    s = sections.filter("section is not null").withColumnsRenamed({"title": "s_title", "page": "s_page"})
    label = F.concat(F.concat_ws("-", F.col("chapter").cast("string"), F.col("section").cast("string"), F.col("subsection").cast("string")), F.lit(". "), F.col("s_title"))
    level = F.when(F.col("subsection").isNull(), 2).otherwise(3)
    below = own.select("doc", "ord", "chapter").join(s, ["doc", "chapter"]).select(
        "doc", "ord", "section", F.coalesce("subsection", zero).alias("subsection"), level.alias("level"), label.alias("title"), F.col("s_page").alias("page")
    )
    return heads.unionByName(below)


def best_source(entries: DataFrame, order: tuple[str, ...] = ("bookmark", "toc_text", "text_header")) -> DataFrame:
    """The entries of each document's best source, by `order`; other sources come last."""
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(order)], F.lit(len(order)))
    ranked = entries.withColumn("_rank", rank)
    return ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy("doc"))).filter("_rank = _best").drop("_rank", "_best")


def with_heading_text(bookmarks: DataFrame, lines: DataFrame, above: float = 0.7) -> DataFrame:
    """Bookmarks (doc, ord, title, page) with heading_text and line_no of the first line of their page
    that holds the title or has nearly its words, and text_match (.9, null without one)."""
    b = bookmarks.withColumnRenamed("page", "_page")
    near = b.join(lines.select(F.col("doc").alias("_doc"), F.col("page").alias("_p"), "line_no", "line"), (F.col("doc") == F.col("_doc")) & (F.col("_page") == F.col("_p")))
    first = near.filter(is_heading_line(F.col("line"), F.col("title"), above)).groupBy("doc", "ord").agg(F.min(F.struct("line_no", "line")).alias("hit"))
    hit = first.select("doc", "ord", F.col("hit.line_no").alias("line_no"), T.strip(F.col("hit.line")).alias("heading_text"), F.lit(0.9).alias("text_match"))
    return bookmarks.join(hit, ["doc", "ord"], "left")


def supplementary(headings: DataFrame, entries: DataFrame, above: float = 0.7, factor: float = 0.8) -> DataFrame:
    """Detected headings (doc, page, text, confidence) that add to the entries (doc, page, title): on
    pages without one, and unlike those of the pages beside; their confidence times `factor`."""
    pages = entries.select("doc", "page").distinct()
    alone = headings.join(pages, ["doc", "page"], "left_anti")
    beside = entries.select("doc", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"), F.col("title").alias("_title"))
    x, y = bare(F.col("text")), bare(F.col("_title"))
    same = (alone["doc"] == beside["doc"]) & (alone["page"] == beside["page"]) & (alike(x, y) > above)
    kept = alone.join(beside, same, "left_anti")
    return kept.withColumn("confidence", F.col("confidence") * factor)


def content_start(lines: DataFrame) -> DataFrame:
    """doc, start_page: the page after the last one with contents, at the first page without that has
    three long lines and among the first five of these one that starts content; else a tenth of the
    pages, five at least, or page 1 of a document that has fewer."""
    order = Window.partitionBy("doc", "page").orderBy("line_no")
    line = T.strip(F.col("line"))
    ranked = lines.withColumn("_long", (F.length(line) > 10).cast("int")).withColumn("_k", F.sum("_long").over(order))
    starts = (F.col("_long") == 1) & (F.col("_k") <= 5) & line.rlike("|".join(STARTS))
    pages = ranked.groupBy("doc", "page").agg(
        F.max(F.lower(F.col("line")).rlike("|".join(TOC_WORDS))).alias("toc"), F.sum("_long").alias("n_long"), F.max(starts).alias("starts")
    )
    so_far = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("toc_end", F.greatest(F.lit(1), F.max(F.when(F.col("toc"), F.col("page"))).over(so_far)))
    first = F.min(F.when(~F.col("toc") & (F.col("n_long") >= 3) & F.col("starts"), F.struct("page", "toc_end")))
    found = pages.groupBy("doc").agg(first.alias("first"), F.count("*").alias("n"))
    fallback = F.greatest(F.lit(5), F.floor(F.col("n") / 10))
    start = F.when(F.col("first").isNull(), F.when(F.col("n") < fallback, 1).otherwise(fallback)).otherwise(F.greatest(F.col("first.toc_end") + 1, F.col("first.page")))
    return found.select("doc", start.cast("int").alias("start_page"))


def content_lines(lines: DataFrame) -> DataFrame:
    """The lines from where content starts."""
    return lines.join(content_start(lines), "doc").filter("page >= start_page").drop("start_page")


def choose_structure(candidates: DataFrame, order: tuple[str, ...] = ("numbered", "toc", "detected")) -> DataFrame:
    """Of rows (doc, kind, n) each document's first kind, by `order`, that has any."""
    place = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(place, "kind"))
    return candidates.filter("n > 0").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


# Sections and chapters -------------------------------------------------------------------------


def heading_places(lines: DataFrame, sections: DataFrame, above: float = 0.8) -> DataFrame:
    """doc, ord, page, at: the first line of a section's first page that holds its title or has nearly
    its words. Lines and titles are bared and cut into words before they meet, once each."""
    words = lambda c: F.array_distinct(T.words(F.col(c)))
    l = lines.select("doc", "page", "line_no", bare(F.col("line")).alias("_line")).withColumn("_in_line", words("_line"))
    s = sections.select("doc", "ord", "page", bare(F.col("title")).alias("_title")).withColumn("_in_title", words("_title"))
    shared, n, m = F.size(F.array_intersect("_in_line", "_in_title")), F.size("_in_line"), F.size("_in_title")
    # Numbers of words too far apart rule most pairs out before their words are looked at.
    near = (F.col("_line") != "") & (F.col("_title") != "") & (F.least(n, m) / F.greatest(n, m) > above)
    same = near & (shared / (n + m - shared) > above)
    hits = s.join(l, ["doc", "page"]).filter(F.contains("_line", "_title") | same)
    return hits.groupBy("doc", "ord", "page").agg(F.min("line_no").alias("at"))


def section_lines(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines of each section (doc, ord, title, page, page_end): on its first page those after the line
    that holds its title or has its words, on the pages after all: doc, ord, page, line_no, line."""
    first = lines.join(heading_places(lines, sections), ["doc", "page"]).filter(F.col("line_no") > F.col("at"))
    later = sections.filter("page_end > page").select("doc", "ord", F.explode(F.sequence(F.col("page") + 1, F.col("page_end"))).alias("page"))
    out = ["doc", "ord", "page", "line_no", "line"]
    return first.select(*out).unionByName(lines.join(later, ["doc", "page"]).select(*out))


def _joined(lines: DataFrame, *by: str) -> DataFrame:
    """The lines of each group as one text t, in order."""
    pages = lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return pages.select(*by, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("t"))


def section_text(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """doc, ord, full_text: a section's lines (see section_lines()), pages parted by an empty line. Pages
    are put together once each, not once for every section that they lie in."""
    first = lines.join(heading_places(lines, sections), ["doc", "page"]).filter(F.col("line_no") > F.col("at"))
    later = sections.filter("page_end > page").select("doc", "ord", F.explode(F.sequence(F.col("page") + 1, F.col("page_end"))).alias("page"))
    parts = _joined(first, "doc", "ord", "page").unionByName(_joined(lines, "doc", "page").join(later, ["doc", "page"]).select("doc", "ord", "page", "t"))
    whole = parts.groupBy("doc", "ord").agg(F.sort_array(F.collect_list(F.struct("page", "t"))).alias("p"))
    return whole.select("doc", "ord", T.strip(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("full_text"))


def innermost(lines: DataFrame, sections: DataFrame, width: int = 32) -> DataFrame:
    """Lines with `section`: the ord of the innermost section around them, the one of those that cover
    their page (doc, ord, page, page_end, line_no) that starts last, at or before the line; null outside
    of all.

    An interval join in bins of `width` pages: a line has one bin, a section as many as it reaches into,
    so a long section costs a row for each bin and multiplies no line but by sections around it."""
    bins = F.explode(F.sequence(F.floor(F.col("page") / width), F.floor(F.col("page_end") / width))).alias("bin")
    s = sections.select("doc", "ord", F.col("page").alias("_from"), F.col("line_no").alias("_line"), F.col("page_end").alias("_to"), bins)
    l = lines.withColumn("bin", F.floor(F.col("page") / width))
    started = (F.col("_from") < F.col("page")) | ((F.col("_from") == F.col("page")) & (F.col("_line") <= F.col("line_no")))
    near = l.select("doc", "bin", "page", "line_no").join(s, ["doc", "bin"]).filter(started & (F.col("page") <= F.col("_to")))
    best = near.groupBy("doc", "page", "line_no").agg(F.max(F.struct("_from", "_line", "ord"))["ord"].alias("section"))
    return lines.join(best, ["doc", "page", "line_no"], "left")


def chapter_ranges(chapters: DataFrame, lines: DataFrame) -> DataFrame:
    """Numbered chapters (doc, page, line_no, level, numbering, title) with page_end: the page before the
    next one of the same or a higher level that starts on a later page, else the last page."""
    last = lines.groupBy("doc").agg(F.max("page").alias("_last"))
    out = chapters.join(last, "doc")
    end = F.lit(None).cast("int")
    order = Window.partitionBy("doc").orderBy(F.col("page")).rangeBetween(1, Window.unboundedFollowing)
    for level in (3, 2, 1):
        following = F.min(F.when(F.col("level") <= level, F.col("page"))).over(order)
        end = F.when(F.col("level") == level, following).otherwise(end)
    return out.withColumn("page_end", F.coalesce(end - 1, F.col("_last"))).drop("_last")


def chapter_chunks(chapters: DataFrame, lines: DataFrame, limit: int = 800, overlap: int = 50, least: int = 1) -> DataFrame:
    """The text of each chapter's pages, cut into sentences and packed: doc, numbering, chunk_index,
    text."""
    ranged = chapter_ranges(chapters, lines).select("doc", "numbering", F.explode(F.sequence("page", F.greatest("page", "page_end"))).alias("page"))
    pages = lines.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    pages = pages.select("doc", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("t"))
    whole = ranged.join(pages, ["doc", "page"]).groupBy("doc", "numbering").agg(F.sort_array(F.collect_list(F.struct("page", "t"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    packed = whole.select("doc", "numbering", F.posexplode(chunking.pack_sentences(T.sentences_terminal(text), limit, overlap)).alias("chunk_index", "text"))
    return packed.filter(F.length("text") >= least)


def chapter_number(numbering: Column) -> Column:
    """What stands before the first separator, dashes before dots."""
    return F.when(F.contains(numbering, F.lit("-")), F.split(numbering, "-")[0]).otherwise(F.split(numbering, r"\.")[0])


def level_of(numbering: Column) -> Column:
    """1 for chapters, 2 and 3 by separators; a plain number over 20 is a section."""
    n = F.regexp_replace(F.trim(numbering), r"\.+$", "")
    dashes, dots = F.length(n) - F.length(F.replace(n, F.lit("-"))), F.length(n) - F.length(F.replace(n, F.lit(".")))
    late = n.rlike(r"^\d+$") & (F.regexp_extract(n, r"^(\d+)$", 1).cast("double") > 20)
    plain = F.when(late, 2).otherwise(1)
    by_dots = F.when(dots >= 2, 3).when(dots == 1, 2).otherwise(plain)
    return F.when(F.coalesce(numbering, F.lit("")) == "", 1).when(dashes >= 2, 3).when(dashes == 1, 2).otherwise(by_dots)


def hierarchy(headings: DataFrame, by: str = "doc") -> DataFrame:
    """Chapters of headings (doc, ord, numbering, title, page), those that only their sections tell of
    included: doc, chapter, title, page, n_sections, n_subsections, is_virtual.

    A chapter without a heading of its own takes its title from the first word of THEMES in the
    titles of its first three sections, else from the beginning of the first of these."""
    h = headings.withColumns({"level": level_of(F.col("numbering")), "chapter": chapter_number(F.col("numbering"))}).filter("chapter <> ''")
    own = lambda k, c: F.min(F.when(F.col("level") == k, F.struct("ord", c)))[c]
    sections = F.sort_array(F.collect_list(F.when(F.col("level") == 2, F.struct("ord", "title"))))
    g = h.groupBy(by, "chapter").agg(
        own(1, "title").alias("named"),
        F.max(F.col("level") == 1).alias("explicit"),
        own(1, "page").alias("page_1"),
        own(2, "page").alias("page_2"),
        F.count_if(F.col("level") == 2).alias("n_sections"),
        F.count_if(F.col("level") == 3).alias("n_subsections"),
        F.transform(F.slice(sections, 1, 3), lambda x: x["title"]).alias("titles"),
    )
    prefix = F.concat(F.lit("第"), F.col("chapter"), F.lit("章"))
    told = lambda word: F.exists("titles", lambda t: F.contains(t, F.lit(word)))
    theme = F.coalesce(*[F.when(told(w), F.lit(name)) for w, name in THEMES])
    clean = F.regexp_replace(F.get("titles", F.lit(0)), r"^[\d\-.]+\s*", "")
    hint = F.concat(F.left(F.split(F.split(clean, "・")[0], "、")[0], F.lit(10)), F.lit("..."))
    guess = F.when(theme.isNotNull(), F.concat(prefix, F.lit(" "), theme)).when(F.coalesce(clean, F.lit("")) != "", F.concat(prefix, F.lit(" "), hint)).otherwise(prefix)
    some = g.filter("explicit or n_sections > 0")
    return some.select(
        by, "chapter", F.when(F.col("explicit"), F.col("named")).otherwise(guess).alias("title"), F.coalesce("page_1", "page_2", F.lit(1)).alias("page"), "n_sections", "n_subsections", (~F.col("explicit")).alias("is_virtual")
    )


def belongs(child: Column, parent: Column, empty: bool = False) -> Column:
    """Whether a subsection's number lies under a section's: the same separator and two equal leading
    numbers. `empty` is the answer where either is missing."""
    dash = F.contains(child, F.lit("-")) & F.contains(parent, F.lit("-"))
    dot = F.contains(child, F.lit(".")) & F.contains(parent, F.lit(".")) & ~dash
    def two(sep: str) -> Column:
        x, y = F.split(child, sep), F.split(parent, sep)
        return (F.size(x) >= 3) & (F.size(y) >= 2) & (x[0] == y[0]) & (F.get(x, F.lit(1)) == F.get(y, F.lit(1)))

    missing = (F.coalesce(child, F.lit("")) == "") | (F.coalesce(parent, F.lit("")) == "")
    return F.when(missing, F.lit(empty)).when(dash, two("-")).when(dot, two(r"\.")).otherwise(False)


def children(headings: DataFrame) -> DataFrame:
    """Pairs doc, parent, child of numberings: chapters with their sections, sections with their
    subsections. Joined by document and chapter."""
    h = headings.select("doc", "numbering").distinct().withColumns({"level": level_of(F.col("numbering")), "chapter": chapter_number(F.col("numbering"))})
    up = h.select("doc", "chapter", F.col("numbering").alias("parent"), (F.col("level") + 1).alias("level"))
    both = h.withColumnRenamed("numbering", "child").join(up, ["doc", "chapter", "level"])
    return both.filter((F.col("level") == 2) | belongs(F.col("child"), F.col("parent"))).select("doc", "parent", "child")


def missed_sections(headings: DataFrame, chapters: DataFrame) -> DataFrame:
    """Headings (doc, numbering) whose number starts with a chapter's (doc, chapter) and something that
    is no digit, and that are no chapters themselves."""
    lead = F.regexp_extract(F.col("numbering"), r"^(\d+)[^\d]", 1)
    h = headings.withColumn("chapter", F.nullif(lead, F.lit(""))).filter(level_of(F.col("numbering")) > 1)
    c = chapters.select("doc", F.col("chapter").cast("string").alias("chapter")).distinct()
    return h.join(c, ["doc", "chapter"])


def by_level(headings: DataFrame) -> DataFrame:
    """level, n and the distinct leading numbers, in numeric order."""
    lead = F.nullif(chapter_number(F.col("numbering")), F.lit(""))
    g = headings.withColumn("_x", lead).groupBy("level").agg(F.count("*").alias("n"), F.collect_set("_x").alias("s"))
    number = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    ordered = F.transform(F.sort_array(F.transform("s", lambda x: F.struct(number(x).alias("k"), x.alias("x")))), lambda y: y["x"])
    return g.select("level", "n", ordered.alias("prefixes"))


def toc_counts(entries: DataFrame) -> DataFrame:
    """Entries by source and level, with the numbered kinds: source, level, n, n_numbered."""
    numbered = F.col("title").rlike(r"^\d")
    return entries.groupBy("source", "level").agg(F.count("*").alias("n"), F.count_if(numbered).alias("n_numbered"))


def with_chapter(rows: DataFrame, chapter: Column, order: list[str]) -> DataFrame:
    """Rows with the chapter that was last named at or before them, in order: adds chapter."""
    so_far = Window.partitionBy("doc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chapter", F.last(chapter, ignorenulls=True).over(so_far))


def contents_of_sections(sections: DataFrame) -> DataFrame:
    """A node for each chapter of sections (doc, chapter, section, page, line_no): doc, chapter, page (of
    its first section, in order), n."""
    first = F.min(F.struct("section", "page", "line_no"))["page"]
    return sections.filter("section is not null").groupBy("doc", "chapter").agg(first.alias("page"), F.count("*").alias("n"))
