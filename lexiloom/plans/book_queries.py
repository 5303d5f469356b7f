"""Queries over books made of the documents (see books): contents, fonts, chapters, section texts, bookmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bookmarks as B
from ..operators import contents as C
from ..operators import structure as S
from .books import D_BOOK, D_SPANS, book, d_numbered, spans
from .registry import query
from .text_queries import D_SP, d_strip


def d_bare(x: str) -> str:
    return rf"regexp_replace({d_strip(f'lower({x})')}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')"


def d_alike(a: str, b: str) -> str:
    """Word Jaccard of two bare texts."""
    x, y = (rf"list_distinct(list_filter(string_split_regex({v}, '{D_SP}+'), lambda w: w <> ''))" for v in (a, b))
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END)"


# Fonts -----------------------------------------------------------------------------------------


@query(
    rf"""SELECT doc, page, y, text, size, bold FROM (SELECT s.*, m.m, m.s FROM {D_SPANS} s JOIN (SELECT doc, page, avg(size) AS m, stddev_pop(size) AS s FROM {D_SPANS} GROUP BY doc, page) m USING (doc, page))
    WHERE (bold OR size >= m + s / 2) AND length(text) BETWEEN 4 AND 149 AND right(text, 1) <> '.' AND regexp_matches(text, '{S.FONT_HEADING}')"""
)
def headings_font(spark, sf_dir):
    return S.font_headings(spans(spark, sf_dir)).select("doc", "page", "y", "text", "size", "bold")


@query(
    f"""SELECT doc, page, floor(y)::INTEGER AS row_y, string_agg(text, ' ' ORDER BY x) AS text, max(size) AS size, bool_or(bold) AS bold, min(x) AS x, min(y) AS y, max(x1) AS x1, max(y1) AS y1 FROM {D_SPANS}
    JOIN (SELECT doc, greatest(avg(size) + stddev_pop(size), quantile_cont(size, 0.75)) AS least_size FROM {D_SPANS} GROUP BY doc) USING (doc) WHERE bold OR size >= least_size GROUP BY doc, page, floor(y)"""
)
def headings_font_document(spark, sf_dir):
    return S.document_font_headings(spans(spark, sf_dir))


@query(
    f"""SELECT doc, page, x, y, least(6, greatest(1, k - bold::INTEGER))::INTEGER AS level FROM {D_SPANS} JOIN (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY size DESC) AS k
    FROM (SELECT DISTINCT doc, size FROM {D_SPANS})) USING (doc, size)"""
)
def heading_levels(spark, sf_dir):
    return S.font_levels(spans(spark, sf_dir)).select("doc", "page", "x", "y", "level")


@query(
    "SELECT doc, page, line_no, level FROM (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {n}" for p, n in S.PLAIN_HEADINGS)
    + f" END AS level FROM (SELECT doc, page, line_no, {d_strip('line')} AS line FROM {D_BOOK})) WHERE length(line) BETWEEN 1 AND 150 AND level IS NOT NULL"
)
def headings_plain(spark, sf_dir):
    """Headings of plain text by seven patterns."""
    return S.plain_headings(book(spark, sf_dir)).select("doc", "page", "line_no", "level")


# Contents --------------------------------------------------------------------------------------

_WORDS = "|".join(C.TOC_PAGE_WORDS)


@query(
    rf"""SELECT doc, page FROM {D_BOOK} WHERE page <= 10 GROUP BY doc, page
    HAVING bool_or(regexp_matches(lower(line), '{_WORDS}')) OR count(*) FILTER (WHERE regexp_matches(line, '.[.][.][.]\s*\d+')) + count(*) FILTER (WHERE regexp_matches(line, '.\s+\d+$')) > 5"""
)
def toc_pages(spark, sf_dir):
    return C.toc_pages(book(spark, sf_dir))


_ENTRY = r"CASE WHEN dots THEN regexp_extract(line, '^(.+?)[.][.][.]+\s*(\d+)$', 1) ELSE regexp_extract(line, '^(.+?)\s+(\d+)$', 1) END"
D_TOC = rf"""(SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, line_no) AS ord, {d_strip(_ENTRY)} AS title,
  try_cast(regexp_extract(line, '(\d+)$', 1) AS INTEGER) AS page, CASE WHEN number <> '' THEN len(string_split(number, '.')) ELSE 1 END::INTEGER AS level FROM (SELECT doc, page, line_no, line, regexp_extract(line, '^(\d+(?:[.]\d+)*)[.]?\s+.+?(?:[.][.][.]+\s*|\s)\d+$', 1) AS number, regexp_matches(line, '^.+?[.][.][.]+\s*\d+$') AS dots FROM (SELECT doc, page, line_no, {d_strip('line')} AS line FROM {D_BOOK}))
  WHERE length(line) >= 5 AND (dots OR regexp_matches(line, '^.+\s+\d+$')))"""


@query(f"SELECT * FROM {D_TOC}")
def toc_lines(spark, sf_dir):
    return C.toc_lines(book(spark, sf_dir))


D_NUMBERED = d_numbered(D_BOOK)
#: As numbered() names them, first of each number.
D_CHAPTER = r"coalesce(nullif(regexp_extract(title, '^第?(\d+)章', 1), ''), nullif(regexp_extract(title, '^(\d+)[.\s]', 1), ''), nullif(regexp_extract(title, '^Chapter\s*(\d+)', 1), ''))::INTEGER"


def numbered(spark, sf_dir) -> DataFrame:
    return S.numbered(book(spark, sf_dir))


TITLES = "VALUES (1,'第1章 Scope'),(2,'2. Methods'),(3,'Chapter 3 Results'),(4,'Afterword'),(5,'12章'),(6,'7 up'),(7,'Chapter x')"


@query(f"SELECT doc, ord, {D_CHAPTER} AS chapter FROM (SELECT doc, ord, title FROM {D_TOC} UNION ALL SELECT 0, ord, title FROM ({TITLES}) v(ord, title))")
def toc_chapter_number(spark, sf_dir):
    toc = C.toc_lines(book(spark, sf_dir)).select("doc", "ord", "title")
    more = spark.sql(f"SELECT CAST(0 AS BIGINT) AS doc, CAST(ord AS BIGINT) AS ord, title FROM ({TITLES}) v(ord, title)")
    return toc.unionByName(more).select("doc", "ord", C.chapter_of_title(F.col("title")).alias("chapter"))


@query(
    f"""WITH t AS (SELECT *, {D_CHAPTER} AS chapter FROM {D_TOC}), s AS (SELECT * FROM {D_NUMBERED} WHERE section IS NOT NULL)
    SELECT doc, ord, 0 AS section, 0 AS subsection, level, title, page FROM t UNION ALL SELECT t.doc, t.ord, s.section, coalesce(s.subsection, 0), s.level,
    concat(concat_ws('-', s.chapter, s.section, s.subsection), '. ', s.title), s.page FROM t JOIN s ON s.doc = t.doc AND s.chapter = t.chapter"""
)
def toc_integrated(spark, sf_dir):
    return C.integrate(C.toc_lines(book(spark, sf_dir)), numbered(spark, sf_dir))


def sources(spark, sf_dir) -> DataFrame:
    """Entries of three sources: outlines of every third document, lists of contents, numbered lines."""
    toc = C.toc_lines(book(spark, sf_dir)).select("doc", "title", "page", "level", F.lit("toc_text").alias("source"))
    n = numbered(spark, sf_dir).select("doc", "title", "page", "level")
    return toc.unionByName(n.filter("doc % 3 = 0 AND level = 1").withColumn("source", F.lit("bookmark"))).unionByName(n.withColumn("source", F.lit("text_header")))


D_SOURCES = f"(SELECT doc, title, page, level, 'toc_text' AS source FROM {D_TOC} UNION ALL SELECT doc, title, page, level, 'bookmark' FROM {D_NUMBERED} WHERE doc % 3 = 0 AND level = 1 UNION ALL SELECT doc, title, page, level, 'text_header' FROM {D_NUMBERED})"


@query(
    f"""SELECT s.* FROM {D_SOURCES} s JOIN (SELECT doc, CASE WHEN bool_or(source = 'bookmark') THEN 'bookmark' WHEN bool_or(source = 'toc_text') THEN 'toc_text' ELSE 'text_header' END AS source FROM {D_SOURCES} GROUP BY doc) b
    ON b.doc = s.doc AND b.source = s.source"""
)
def toc_fallback(spark, sf_dir):
    return C.best_source(sources(spark, sf_dir))


@query(f"SELECT source, level, count(*) AS n, count(*) FILTER (WHERE regexp_matches(title, '^\\d')) AS n_numbered FROM {D_SOURCES} GROUP BY source, level")
def toc_counts(spark, sf_dir):
    return C.toc_counts(sources(spark, sf_dir))


_TOCW, _STARTS = "|".join(S.TOC_WORDS), "|".join(S.STARTS)
D_START = rf"""(SELECT doc, coalesce(arg_min(greatest(toc_end + 1, page), page) FILTER (WHERE NOT toc AND len(long) >= 3 AND len(list_filter(long[1:5], lambda x: regexp_matches(x, '{_STARTS}'))) > 0), CASE WHEN count(*) < greatest(5, count(*) // 10) THEN 1 ELSE greatest(5, count(*) // 10) END)::INTEGER AS start_page FROM
  (SELECT *, (SELECT coalesce(max(q.page), 1) FROM (SELECT doc, page FROM {D_BOOK} WHERE regexp_matches(lower(line), '{_TOCW}')) q WHERE q.doc = p.doc AND q.page <= p.page) AS toc_end FROM
    (SELECT doc, page, bool_or(regexp_matches(lower(line), '{_TOCW}')) AS toc, list(line ORDER BY line_no) FILTER (WHERE length(line) > 10) AS long FROM (SELECT doc, page, line_no, {d_strip('line')} AS line FROM {D_BOOK}) GROUP BY doc, page) p) GROUP BY doc)"""


@query(f"SELECT * FROM {D_START}")
def content_start(spark, sf_dir):
    return C.content_start(book(spark, sf_dir))


@query(f"SELECT b.doc, count(*) AS n FROM {D_BOOK} b JOIN {D_START} s ON s.doc = b.doc WHERE b.page >= s.start_page GROUP BY b.doc")
def content_pages(spark, sf_dir):
    """Lines from the start of the content on, by document."""
    return C.content_lines(book(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("n"))


@query(
    f"""SELECT doc, CASE WHEN numbered > 0 THEN 'numbered' WHEN toc > 0 THEN 'toc' ELSE 'detected' END AS kind, CASE WHEN numbered > 0 THEN numbered WHEN toc > 0 THEN toc ELSE detected END AS n FROM
    (SELECT doc, (SELECT count(*) FROM {D_NUMBERED} x WHERE x.doc = d.doc AND x.level > 1) AS numbered, (SELECT count(*) FROM {D_TOC} x WHERE x.doc = d.doc) AS toc,
      (SELECT count(*) FROM {D_BOOK} x WHERE x.doc = d.doc AND x.line_no = 2) AS detected FROM (SELECT doc_id AS doc FROM documents) d) WHERE numbered + toc + detected > 0"""
)
def structure_choice(spark, sf_dir):
    b = book(spark, sf_dir)
    count = lambda df, kind: df.groupBy("doc").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    found = count(numbered(spark, sf_dir).filter("level > 1"), "numbered").unionByName(count(C.toc_lines(b), "toc")).unionByName(count(b.filter("line_no = 2"), "detected"))
    return C.choose_structure(found).select("doc", "kind", "n")


# Headings beside contents ----------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT doc, page, title FROM {D_NUMBERED} WHERE level = 1), h AS (SELECT doc, page, line_no, title AS text, 0.5::DOUBLE + level * 0.125 AS confidence FROM {D_NUMBERED} WHERE level > 1)
    SELECT doc, page, line_no, text, confidence * 0.8 AS confidence FROM h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = h.doc AND t.page = h.page)
    AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc = h.doc AND abs(t.page - h.page) <= 1 AND {d_alike(d_bare('h.text'), d_bare('t.title'))} > 0.7)"""
)
def supplementary_headings(spark, sf_dir):
    n = numbered(spark, sf_dir)
    detected = n.filter("level > 1").select("doc", "page", "line_no", F.col("title").alias("text"), (F.col("level") * 0.125 + 0.5).alias("confidence"))
    return C.supplementary(detected, n.filter("level = 1").select("doc", "page", "title"))


@query(
    f"""WITH b AS (SELECT doc, line_no AS ord, page, regexp_replace(title, 'e', '-', 'g') AS title FROM {D_NUMBERED} WHERE level = 1 UNION ALL SELECT doc, 100 + line_no, page, title FROM {D_NUMBERED} WHERE level = 2)
    SELECT b.doc, b.ord, b.page, b.title, arg_min(l.line_no, l.line_no) AS line_no, arg_min({d_strip('l.line')}, l.line_no) AS heading_text FROM b LEFT JOIN (SELECT b.doc, b.ord, b.page, l.line_no, l.line FROM b JOIN {D_BOOK} l ON l.doc = b.doc AND l.page = b.page
    WHERE contains({d_bare('l.line')}, {d_bare('b.title')}) OR {d_alike(d_bare('b.title'), d_bare('l.line'))} > 0.7) l ON l.doc = b.doc AND l.ord = b.ord AND l.page = b.page GROUP BY b.doc, b.ord, b.page, b.title"""
)
def bookmark_lines(spark, sf_dir):
    """Lines that bookmarks point to; the titles of chapters are disturbed."""
    n = numbered(spark, sf_dir)
    one = n.filter("level = 1").select("doc", F.col("line_no").alias("ord"), "page", F.regexp_replace("title", "e", "-").alias("title"))
    two = n.filter("level = 2").select("doc", (F.col("line_no") + 100).alias("ord"), "page", "title")
    marks = one.unionByName(two).withColumn("ord", F.col("page") * 1000 + F.col("ord"))
    found = C.with_heading_text(marks, book(spark, sf_dir)).drop("text_match")
    return found.withColumn("ord", F.col("ord") - F.col("page") * 1000).select("doc", "ord", "page", "title", "line_no", "heading_text")


# Sections and chapters -------------------------------------------------------------------------


def sections(spark, sf_dir) -> DataFrame:
    """Numbered lines as sections with the pages they cover."""
    b = book(spark, sf_dir)
    last = b.groupBy("doc").agg(F.max("page").alias("last_page"))
    n = S.numbered(b).join(last, "doc").withColumn("ord", F.col("page") * 16 + F.col("line_no"))
    return S.intervals(n.select("doc", "ord", "level", "title", "page", "last_page"))


D_SECTIONS = f"""(SELECT a.doc, a.ord, a.level, a.title, a.page, a.last_page, greatest(a.page, coalesce(min_by(b.page, b.ord) - 1, a.last_page)) AS page_end FROM
  (SELECT n.*, n.page * 16 + n.line_no AS ord, m.last_page FROM {D_NUMBERED} n JOIN (SELECT doc, max(page) AS last_page FROM {D_BOOK} GROUP BY doc) m ON m.doc = n.doc) a
  LEFT JOIN (SELECT doc, level, page, page * 16 + line_no AS ord FROM {D_NUMBERED}) b ON b.doc = a.doc AND b.ord > a.ord AND b.level <= a.level GROUP BY a.doc, a.ord, a.level, a.title, a.page, a.last_page)"""


@query(f"SELECT * FROM {D_SECTIONS}")
def section_pages(spark, sf_dir):
    """Pages that each numbered section covers."""
    return sections(spark, sf_dir)


@query(
    f"""WITH l AS (SELECT s.doc, s.ord, b.page, b.line_no, b.line, b.page = s.page AS is_first, contains({d_bare('b.line')}, {d_bare('s.title')}) OR {d_alike(d_bare('b.line'), d_bare('s.title'))} > 0.8 AS head FROM {D_SECTIONS} s JOIN {D_BOOK} b ON b.doc = s.doc AND b.page BETWEEN s.page AND s.page_end),
    h AS (SELECT doc, ord, page, min(line_no) AS at FROM l WHERE head AND is_first GROUP BY doc, ord, page),
    p AS (SELECT l.doc, l.ord, l.page, string_agg(l.line, chr(10) ORDER BY l.line_no) AS t FROM l LEFT JOIN h ON h.doc = l.doc AND h.ord = l.ord AND h.page = l.page WHERE NOT l.is_first OR l.line_no > h.at GROUP BY l.doc, l.ord, l.page)
    SELECT doc, ord, md5({d_strip("string_agg(t, chr(10) || chr(10) ORDER BY page)")}) AS text_md5 FROM p GROUP BY doc, ord"""
)
def section_text(spark, sf_dir):
    return C.section_text(book(spark, sf_dir), sections(spark, sf_dir)).select("doc", "ord", F.md5("full_text").alias("text_md5"))


@query(
    f"""SELECT a.doc, a.numbering, a.line_no, a.page, coalesce((SELECT min(b.page) FROM {D_NUMBERED} b WHERE b.doc = a.doc AND b.level <= a.level AND b.page > a.page) - 1, (SELECT max(c.page) FROM {D_BOOK} c WHERE c.doc = a.doc)) AS page_end FROM {D_NUMBERED} a"""
)
def chapter_ranges(spark, sf_dir):
    return C.chapter_ranges(numbered(spark, sf_dir), book(spark, sf_dir)).select("doc", "numbering", "line_no", "page", "page_end")


@query()
def chapter_chunks(spark, sf_dir):
    """Chunks of the text of each numbered chapter."""
    b = book(spark, sf_dir)
    found = C.chapter_chunks(S.valid_sequence(S.numbered(b), ["doc"]), b, 200, 50)
    return found.select("doc", "numbering", "chunk_index", F.md5("text").alias("text_md5"))


NUMBERS = """VALUES (1,1,'1.2','x',3),(1,2,'1-3','y',3),(1,3,'1.2.3','Summary of it',4),(1,4,'4','Four',6),(1,5,'2-1','Results so far, in short',5),(1,6,'25','late',9),(1,7,'4-1-2','deep',7),(1,8,'','none',8),(2,1,'1','One',1),(2,2,'1-1','安全 first',1),(2,3,'2-1','運転 and 保守',2),
(2,4,'3.1','3.1 ・x',4),(2,5,'10-1','ten',9),(2,6,'10-1-1','ten a',9),(2,7,'10.1.1','ten b',9),(2,8,'5.','five',5)"""
NB = f"(SELECT * FROM ({NUMBERS}) v(doc, ord, numbering, title, page))"


def outline(spark, sf_dir) -> DataFrame:
    """The numbers of the books' sections, chapters left out of every second, and odd ones by hand."""
    n = numbered(spark, sf_dir).filter("doc % 2 = 0 OR level > 1")
    own = n.select("doc", (F.col("page") * 16 + F.col("line_no")).alias("ord"), "numbering", "title", "page")
    by_hand = spark.sql(f"SELECT -CAST(doc AS BIGINT) AS doc, ord, numbering, title, page FROM {NB}")
    return own.unionByName(by_hand)


D_OUTLINE = f"(SELECT doc, page * 16 + line_no AS ord, numbering, title, page FROM {D_NUMBERED} WHERE doc % 2 = 0 OR level > 1 UNION ALL SELECT -doc, ord, numbering, title, page FROM {NB})"
D_LEVEL = r"""(CASE WHEN numbering = '' THEN 1 WHEN len(string_split(n, '-')) > 2 THEN 3 WHEN len(string_split(n, '-')) = 2 THEN 2 WHEN len(string_split(n, '.')) > 2 THEN 3 WHEN len(string_split(n, '.')) = 2 THEN 2
 WHEN regexp_full_match(n, '\d+') AND n::BIGINT > 20 THEN 2 ELSE 1 END)"""
D_TREE = f"(SELECT *, {D_LEVEL} AS level, CASE WHEN contains(numbering, '-') THEN split_part(numbering, '-', 1) ELSE split_part(numbering, '.', 1) END AS chapter FROM (SELECT *, rtrim(trim(numbering), '.') AS n FROM {D_OUTLINE}))"
_THEME = "CASE " + " ".join(f"WHEN len(list_filter(titles, lambda t: contains(t, '{w}'))) > 0 THEN '{name}'" for w, name in C.THEMES) + " END"


@query(
    rf"""SELECT doc, chapter, CASE WHEN explicit THEN named WHEN theme IS NOT NULL THEN concat('第', chapter, '章 ', theme) WHEN clean <> '' THEN concat('第', chapter, '章 ', left(split_part(split_part(clean, '・', 1), '、', 1), 10), '...')
      ELSE concat('第', chapter, '章') END AS title, page, n_sections, n_subsections, NOT explicit AS is_virtual FROM
    (SELECT *, {_THEME} AS theme, regexp_replace(titles[1], '^[\d\-.]+\s*', '') AS clean FROM (SELECT doc, chapter, bool_or(level = 1) AS explicit, arg_min(title, ord) FILTER (WHERE level = 1) AS named,
      coalesce(arg_min(page, ord) FILTER (WHERE level = 1), arg_min(page, ord) FILTER (WHERE level = 2), 1) AS page, count(*) FILTER (WHERE level = 2) AS n_sections, count(*) FILTER (WHERE level = 3) AS n_subsections,
      coalesce(list(title ORDER BY ord) FILTER (WHERE level = 2), [])[1:3] AS titles FROM {D_TREE} WHERE chapter <> '' GROUP BY doc, chapter)) WHERE explicit OR n_sections > 0"""
)
def chapter_hierarchy(spark, sf_dir):
    return C.hierarchy(outline(spark, sf_dir))


@query(
    f"""SELECT level, count(*) AS n, list_transform(list_sort(list(DISTINCT {{'k': coalesce(try_cast(regexp_extract(chapter, '(\\d+)', 1) AS BIGINT), 0), 'x': chapter}}) FILTER (WHERE chapter <> '')), lambda y: y.x) AS prefixes FROM {D_TREE} GROUP BY level"""
)
def level_summary(spark, sf_dir):
    return C.by_level(outline(spark, sf_dir).withColumn("level", C.level_of(F.col("numbering"))))


@query(
    f"""WITH t AS (SELECT DISTINCT doc, numbering, level, chapter FROM {D_TREE}) SELECT a.doc, a.numbering AS parent, b.numbering AS child FROM t a JOIN t b ON a.doc = b.doc AND a.chapter = b.chapter AND b.level = a.level + 1
    WHERE b.level = 2 OR (contains(a.numbering, '-') AND contains(b.numbering, '-') AND string_split(a.numbering, '-')[1:2] = string_split(b.numbering, '-')[1:2])
      OR (NOT (contains(a.numbering, '-') AND contains(b.numbering, '-')) AND contains(a.numbering, '.') AND contains(b.numbering, '.') AND len(string_split(b.numbering, '.')) >= 3 AND string_split(a.numbering, '.')[1:2] = string_split(b.numbering, '.')[1:2])"""
)
def sections_of_chapter(spark, sf_dir):
    return C.children(outline(spark, sf_dir))


@query(
    rf"""SELECT t.doc, t.numbering, t.ord FROM {D_TREE} t JOIN (SELECT DISTINCT doc, chapter FROM {D_TREE}) c ON c.doc = t.doc AND c.chapter <> '' AND (starts_with(t.numbering, concat(c.chapter, '.')) OR starts_with(t.numbering, concat(c.chapter, '-')) OR regexp_matches(t.numbering, concat('^', c.chapter, '[^\d]')))
    WHERE t.level > 1"""
)
def missed_sections(spark, sf_dir):
    h = outline(spark, sf_dir)
    return C.missed_sections(h, h.select("doc", C.chapter_number(F.col("numbering")).alias("chapter")).filter("chapter <> ''")).select("doc", "numbering", "ord")


@query(rf"SELECT doc, ord, array_to_string(list_transform(regexp_extract_all(numbering, '\d+'), lambda x: lpad(x, greatest(10, length(x))::INTEGER, '0')), '.') AS sort_key FROM {D_OUTLINE}")
def numbering_sort_key(spark, sf_dir):
    """Numeric order of hierarchical numbers as a text key."""
    return outline(spark, sf_dir).select("doc", "ord", S.sort_key(F.col("numbering")).alias("sort_key"))


@query(
    f"SELECT b.doc, b.page, b.line_no, max(n.chapter) AS chapter FROM (SELECT doc, page, line_no, page * 16 + line_no AS at FROM {D_BOOK}) b ASOF LEFT JOIN (SELECT doc, page * 16 + line_no AS at, chapter FROM {D_NUMBERED} WHERE level = 1) n ON n.doc = b.doc AND b.at >= n.at GROUP BY ALL"
)
def section_carry(spark, sf_dir):
    """The chapter that each line stands in."""
    b = book(spark, sf_dir)
    heads = S.numbered(b).filter("level = 1").select("doc", "page", "line_no", F.col("chapter").alias("own"))
    return C.with_chapter(b.join(heads, ["doc", "page", "line_no"], "left"), F.col("own"), ["page", "line_no"]).select("doc", "page", "line_no", "chapter")


@query(f"SELECT doc, chapter, page, n FROM (SELECT doc, chapter, page, row_number() OVER (PARTITION BY doc, chapter ORDER BY section, page, line_no) AS k, count(*) OVER (PARTITION BY doc, chapter) AS n FROM {D_NUMBERED} WHERE section IS NOT NULL) WHERE k = 1")
def toc_from_sections(spark, sf_dir):
    return C.contents_of_sections(numbered(spark, sf_dir))


@query(
    f"""SELECT b.doc, s.ord AS section, count(*) AS n_lines, min(b.page * 16 + b.line_no) AS first_line, max(b.page * 16 + b.line_no) AS last_line FROM
    (SELECT doc, page, line_no, page * 16 + line_no AS at FROM {D_BOOK}) b LEFT JOIN (SELECT b.doc, b.page, b.line_no, max(s.ord) AS ord FROM {D_BOOK} b JOIN {D_SECTIONS} s
      ON s.doc = b.doc AND s.page <= b.page AND b.page <= s.page_end AND s.ord <= b.page * 16 + b.line_no GROUP BY b.doc, b.page, b.line_no) s ON s.doc = b.doc AND s.page = b.page AND s.line_no = b.line_no GROUP BY b.doc, s.ord"""
)
def section_of_lines(spark, sf_dir):
    """Lines by the innermost section that they stand in."""
    s = sections(spark, sf_dir).withColumn("line_no", F.col("ord") - F.col("page") * 16)
    at = F.col("page") * 16 + F.col("line_no")
    return C.innermost(book(spark, sf_dir), s).groupBy("doc", "section").agg(F.count("*").alias("n_lines"), F.min(at).alias("first_line"), F.max(at).alias("last_line"))


# Outlines and bookmarks ------------------------------------------------------------------------


def marks(spark, sf_dir) -> DataFrame:
    """Bookmarks with faults: empty titles, pages and levels out of bounds."""
    n = numbered(spark, sf_dir)
    ord_ = F.col("page") * 16 + F.col("line_no")
    title = F.when(ord_ % 5 == 0, " ").otherwise(F.concat(F.lit("  "), F.col("title")))
    level = F.when(ord_ % 3 == 0, F.col("level") + 4).when(ord_ % 7 == 0, 0).otherwise(F.col("level"))
    page = F.when(ord_ % 11 == 0, 0).otherwise(F.col("page"))
    last = book(spark, sf_dir).groupBy("doc").agg((F.max("page") - 1).alias("last_page"))
    return n.select("doc", ord_.cast("long").alias("ord"), title.alias("title"), level.cast("int").alias("level"), page.cast("int").alias("page")).join(last, "doc")


D_MARKS = f"""(SELECT n.doc, o AS ord, CASE WHEN o % 5 = 0 THEN ' ' ELSE concat('  ', title) END AS title, (CASE WHEN o % 3 = 0 THEN level + 4 WHEN o % 7 = 0 THEN 0 ELSE level END)::INTEGER AS level, (CASE WHEN o % 11 = 0 THEN 0 ELSE page END)::INTEGER AS page, last_page FROM
  (SELECT *, (page * 16 + line_no)::BIGINT AS o FROM {D_NUMBERED}) n JOIN (SELECT doc, max(page) - 1 AS last_page FROM {D_BOOK} GROUP BY doc) m ON m.doc = n.doc)"""
_BT = d_strip("title")


@query(f"SELECT doc, ord, concat(repeat('  ', level - 1), title) AS label, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS n_before FROM {D_SECTIONS}")
def outline_flatten(spark, sf_dir):
    return S.flattened(sections(spark, sf_dir)).select("doc", "ord", "label", "n_before")


@query(f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, ord) AS ord, {_BT} AS title, least(6, greatest(1, level)) AS level, page FROM {D_MARKS} WHERE {_BT} <> '' AND page BETWEEN 1 AND last_page")
def bookmarks_build(spark, sf_dir):
    return B.build(marks(spark, sf_dir))


@query(f"SELECT doc, ord, {_BT} AS title, greatest(1, level) AS level, greatest(1, page) AS page FROM {D_MARKS} WHERE length({_BT}) BETWEEN 1 AND 200")
def outline_scan(spark, sf_dir):
    return B.scanned(marks(spark, sf_dir)).drop("last_page")


@query(
    f"""WITH m AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY doc ORDER BY ord), 0) AS up FROM {D_MARKS}) SELECT doc, ord, concat('level jump from ', up, ' to ', level) AS issue FROM m WHERE level - up > 1
    UNION ALL SELECT doc, ord, 'page below one' FROM m WHERE page < 1 UNION ALL SELECT doc, ord, 'empty title' FROM m WHERE {_BT} = ''"""
)
def bookmarks_validate(spark, sf_dir):
    return B.issues(marks(spark, sf_dir))


@query(
    f"""WITH RECURSIVE g AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, ord) AS ord, {_BT} AS title, level, page FROM {D_MARKS} WHERE {_BT} <> '' AND page >= 1),
    r AS (SELECT doc, ord, title, least(level, 1) AS raw, page FROM g WHERE ord = 1 UNION ALL SELECT g.doc, g.ord, g.title, least(g.level, r.raw + 1), g.page FROM r JOIN g ON g.doc = r.doc AND g.ord = r.ord + 1)
    SELECT doc, ord, title, greatest(1, raw) AS level, page FROM r"""
)
def bookmarks_optimize(spark, sf_dir):
    return B.optimized(marks(spark, sf_dir))


@query(f"SELECT 'page' AS kind, doc, page AS place, count(*) AS n, array_to_string(list(title ORDER BY ord), '|') AS titles FROM {D_MARKS} GROUP BY doc, page UNION ALL SELECT 'level', doc, level, count(*), array_to_string(list(title ORDER BY ord), '|') FROM {D_MARKS} GROUP BY doc, level")
def bookmarks_nav(spark, sf_dir):
    m = marks(spark, sf_dir)
    shown = lambda by: B.navigation(m, by).select(F.lit(by).alias("kind"), "doc", F.col(by).alias("place"), "n", F.array_join("titles", "|").alias("titles"))
    return shown("page").unionByName(shown("level"))


@query(
    f"""WITH o AS (SELECT * FROM {D_MARKS} WHERE ord % 3 <> 0), n AS (SELECT * FROM {D_MARKS} WHERE ord % 2 = 0), c AS (SELECT doc, (SELECT count(*) FROM o WHERE o.doc = d.doc) > 0.7 * (SELECT count(*) FROM n WHERE n.doc = d.doc) AS keep FROM (SELECT DISTINCT doc FROM {D_MARKS}) d)
    SELECT o.doc, ord, title, 'old' AS origin FROM o JOIN c ON c.doc = o.doc AND keep UNION ALL SELECT n.doc, ord, title, 'new' FROM n JOIN c ON c.doc = n.doc AND NOT keep"""
)
def bookmarks_merge(spark, sf_dir):
    m = marks(spark, sf_dir)
    return B.merged(m.filter("ord % 3 <> 0"), m.filter("ord % 2 = 0")).select("doc", "ord", "title", "origin")


@query(
    f"""WITH d AS (SELECT doc, ord, title, (ord % 10) / 10.0::DOUBLE AS score FROM {D_MARKS}) SELECT doc, 1 AS part, ord, level, title, page FROM {D_MARKS}
    UNION ALL SELECT DISTINCT doc, 2, 0, 1, 'Differences', 1 FROM d WHERE score * 100 < 70 UNION ALL SELECT doc, 3, ord, 2, concat(title, ' (', printf('%.1f', score * 100), ' % similar)'), 1 FROM d WHERE score * 100 < 70"""
)
def bookmarks_diff(spark, sf_dir):
    m = marks(spark, sf_dir)
    return B.with_differences(m, m.select("doc", "ord", "title", (F.col("ord") % 10 / 10.0).alias("score")))


@query(f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, ord) AS ord, title, level, page, 'detected_section' AS source FROM {D_SECTIONS}")
def bookmarks_from_sections(spark, sf_dir):
    return B.from_sections(sections(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT DISTINCT doc, numbering, chapter FROM {D_TREE}) SELECT a.doc, a.numbering AS parent, b.numbering AS child, b.numbering = '' OR a.numbering = ''
      OR (contains(a.numbering, '-') AND contains(b.numbering, '-') AND len(string_split(b.numbering, '-')) >= 3 AND string_split(a.numbering, '-')[1:2] = string_split(b.numbering, '-')[1:2])
      OR (NOT (contains(a.numbering, '-') AND contains(b.numbering, '-')) AND contains(a.numbering, '.') AND contains(b.numbering, '.') AND len(string_split(b.numbering, '.')) >= 3 AND string_split(a.numbering, '.')[1:2] = string_split(b.numbering, '.')[1:2]) AS inside
    FROM t a JOIN t b ON a.doc = b.doc AND a.chapter = b.chapter AND a.numbering <> b.numbering"""
)
def section_membership(spark, sf_dir):
    """Whether one number of a chapter lies under another."""
    t = outline(spark, sf_dir).select("doc", "numbering", C.chapter_number(F.col("numbering")).alias("chapter")).distinct()
    both = t.withColumnRenamed("numbering", "parent").join(t.withColumnRenamed("numbering", "child"), ["doc", "chapter"]).filter("parent <> child")
    return both.select("doc", "parent", "child", C.belongs(F.col("child"), F.col("parent"), empty=True).alias("inside"))


@query(
    f"""SELECT doc, page, line_no, row_number() OVER (PARTITION BY doc ORDER BY page, line_no) AS by_line, row_number() OVER (PARTITION BY doc ORDER BY page, level DESC, line_no) AS by_confidence FROM {D_NUMBERED}"""
)
def headings_ordered(spark, sf_dir):
    """Headings in order of page and line, and of page and falling confidence."""
    n = numbered(spark, sf_dir).withColumn("confidence", F.col("level") / 4)
    one = S.placed(n, "page", "line_no").withColumnRenamed("place", "by_line")
    return S.placed(one, "page", "-confidence", "line_no").select("doc", "page", "line_no", "by_line", F.col("place").alias("by_confidence"))
