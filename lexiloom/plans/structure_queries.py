"""Queries of headings, numbered chapters, sections and outlines, over books made of the documents (see
books); patterns in other scripts read the books' headings in many styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import structure as S
from ..sources.readers import chapters_from_json
from .book_queries import D_MARKS, D_OUTLINE, marks, outline
from .books import D_BOOK, D_SPANS, D_STYLED, book, d_numbered, spans, styled
from .registry import query
from .text_queries import d_char_set


def cascade(value) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {value(n, c)}" for p, n, c in S.HEADINGS) + f" WHEN regexp_matches(lower(line), '{'|'.join(S.KEYWORDS)}') THEN {value(2, 0.7)} END"


D_PATTERN = f"(SELECT * FROM (SELECT *, CAST({cascade(lambda n, c: n)} AS INTEGER) AS level, CAST({cascade(lambda n, c: c)} AS DOUBLE) AS confidence FROM {D_STYLED}) WHERE level IS NOT NULL)"
D_POSITION = f"""(SELECT doc, page, line_no, line, 2 AS level, CAST(0.6 AS DOUBLE) AS confidence FROM (SELECT *, lead(length(line)) OVER (PARTITION BY doc, page ORDER BY line_no) AS following FROM {D_STYLED})
    WHERE regexp_matches(lower(line), '{'|'.join(S.KEYWORDS)}') AND length(line) >= 3 AND length(line) < 80 AND following > 50)"""


@query(f"SELECT doc, page, line_no, md5(line) AS line_md5, level, confidence FROM {D_PATTERN}")
def headings_pattern(spark, sf_dir):
    return S.pattern_headings(styled(spark, sf_dir)).select("doc", "page", "line_no", F.md5("line").alias("line_md5"), "level", "confidence")


@query(f"SELECT * FROM {D_POSITION}")
def headings_position(spark, sf_dir):
    return S.position_headings(styled(spark, sf_dir), ["doc", "page"])


@query(
    f"""SELECT doc, page, y, text, round(least(1.0, 0.5 + CASE WHEN size > 14 THEN 0.2 ELSE 0 END + CASE WHEN bold THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '{S.FONT_HEADING}') THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS confidence FROM {D_SPANS}"""
)
def heading_confidence(spark, sf_dir):
    c = S.font_confidence(F.col("size"), F.col("bold"), F.col("text").rlike(S.FONT_HEADING))
    return spans(spark, sf_dir).select("doc", "page", "y", "text", F.round(c, 6).alias("confidence"))


def twins(spark, sf_dir) -> DataFrame:
    """Headings that patterns find among the books' own, each with one of nearly the same letters beside it."""
    h = S.pattern_headings(styled(spark, sf_dir)).filter("line_no % 2 = 1")
    other = h.select("doc", "page", (F.col("line_no") * 2 + 1).alias("ord"), F.concat(F.lower("line"), F.lit(".")).alias("text"), F.when(F.col("doc") % 2 == 0, 0.95).otherwise(0.35).alias("confidence"))
    return h.select("doc", "page", (F.col("line_no") * 2).alias("ord"), F.col("line").alias("text"), "confidence").unionByName(other)


D_TWINS = f"""(WITH h AS (SELECT * FROM {D_PATTERN} WHERE line_no % 2 = 1) SELECT doc, page, line_no * 2 AS ord, line AS text, confidence FROM h
    UNION ALL SELECT doc, page, line_no * 2 + 1, concat(lower(line), '.'), (CASE WHEN doc % 2 = 0 THEN 0.95 ELSE 0.35 END)::DOUBLE FROM h)"""


@query(
    f"""WITH RECURSIVE h AS (SELECT doc, page, ord, text, confidence, {d_char_set('text')} AS c, row_number() OVER (PARTITION BY doc, page ORDER BY ord) AS k FROM {D_TWINS}),
    r AS (SELECT doc, page, 0::BIGINT AS k, []::STRUCT(ord BIGINT, text VARCHAR, confidence DOUBLE, c VARCHAR[])[] AS kept FROM (SELECT DISTINCT doc, page FROM h)
      UNION ALL SELECT doc, page, k, CASE WHEN twin IS NULL THEN list_append(kept, x) WHEN x.confidence > twin.confidence THEN list_append(list_filter(kept, lambda y: y.ord <> twin.ord), x) ELSE kept END FROM
      (SELECT *, list_filter(kept, lambda y: len(list_intersect(y.c, x.c))::DOUBLE / len(list_distinct(list_concat(y.c, x.c))) > 0.8)[1] AS twin FROM
        (SELECT r.doc, r.page, h.k, r.kept, {{'ord': h.ord::BIGINT, 'text': h.text, 'confidence': h.confidence, 'c': h.c}} AS x FROM r JOIN h ON h.doc = r.doc AND h.page = r.page AND h.k = r.k + 1)))
    SELECT doc, page, x.ord AS ord, x.text AS text, x.confidence AS confidence FROM (SELECT doc, page, unnest(kept) AS x FROM (SELECT *, max(k) OVER (PARTITION BY doc, page) AS last FROM r) WHERE k = last)"""
)
def headings_dedup(spark, sf_dir):
    return S.dedup_headings(twins(spark, sf_dir), ["doc", "page"])


@query(rf"SELECT doc, page, ord, regexp_replace(trim(text), '\s+', ' ', 'g') AS text, confidence FROM {D_TWINS} WHERE length(trim(text)) BETWEEN 2 AND 200 AND NOT (length(text) > 50 AND regexp_matches(text, '[.。]$')) AND confidence >= 0.4")
def headings_valid(spark, sf_dir):
    return S.valid_headings(twins(spark, sf_dir))


D_NUM = d_numbered(D_BOOK)


@query(f"SELECT * FROM {D_NUM}")
def chapters_numbered(spark, sf_dir):
    return S.numbered(book(spark, sf_dir))


D_SEQ = f"""(SELECT * EXCLUDE (first) FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, line_no) AS first FROM {D_NUM})
 WHERE (chapter <= 50 AND coalesce(section, 0) <= 20 AND coalesce(subsection, 0) <= 20) OR first = 1 QUALIFY row_number() OVER (PARTITION BY doc, numbering ORDER BY page, line_no) = 1)"""


def sequence(spark, sf_dir) -> DataFrame:
    return S.valid_sequence(S.numbered(book(spark, sf_dir)), ["doc"])


@query(f"SELECT * FROM {D_SEQ}")
def chapters_sequence(spark, sf_dir):
    return sequence(spark, sf_dir)


@query(f"SELECT doc, chapter, count(*) AS n, count(*) FILTER (WHERE level = 3) AS n_sub, array_to_string(list_sort(list(numbering)), ' ') AS numberings FROM {D_SEQ} WHERE level > 1 GROUP BY doc, chapter")
def sections_by_chapter(spark, sf_dir):
    s = sequence(spark, sf_dir).filter("level > 1")
    return s.groupBy("doc", "chapter").agg(F.count("*").alias("n"), F.count_if(F.col("level") == 3).alias("n_sub"), F.array_join(F.sort_array(F.collect_list("numbering")), " ").alias("numberings"))


@query(
    f"""WITH h AS (SELECT doc, ord, greatest(1, level) AS level, page, last_page FROM {D_MARKS})
    SELECT a.*, greatest(a.page, coalesce((SELECT min_by(b.page, b.ord) FROM h b WHERE b.doc = a.doc AND b.ord > a.ord AND b.level <= a.level) - 1, a.last_page)) AS page_end FROM h a"""
)
def section_intervals(spark, sf_dir):
    """Pages of headings whose levels jump and whose pages fall back."""
    return S.intervals(marks(spark, sf_dir).select("doc", "ord", F.greatest(F.lit(1), F.col("level")).alias("level"), "page", "last_page"))


@query(f"SELECT doc, numbering, title, page::BIGINT AS page_start, (page + 1)::BIGINT AS page_end FROM {D_SEQ} WHERE level = 1")
def chapter_json_scan(spark, sf_dir):
    """Each book's chapters as one JSON object, read back."""
    one = F.struct("title", F.col("page").alias("page_start"), (F.col("page") + 1).alias("page_end"))
    whole = F.to_json(F.map_from_entries(F.collect_list(F.struct("numbering", one))))
    chapters = sequence(spark, sf_dir).filter("level = 1").groupBy("doc").agg(whole.alias("json"))
    return chapters_from_json(chapters, "json", "doc")


@query(rf"SELECT doc, ord, numbering, regexp_replace(numbering, '\.', '-', 'g') AS shown FROM {D_OUTLINE}")
def display_numbers(spark, sf_dir):
    return outline(spark, sf_dir).select("doc", "ord", "numbering", F.regexp_replace("numbering", r"\.", "-").alias("shown"))


# Outlines and bookmarks ------------------------------------------------------------------------


@query(f"SELECT a.doc, a.ord, a.level, (SELECT max(b.ord) FROM {D_MARKS} b WHERE b.doc = a.doc AND b.ord < a.ord AND b.level < a.level) AS parent FROM {D_MARKS} a")
def outline_tree(spark, sf_dir):
    return S.parents(marks(spark, sf_dir).select("doc", "ord", "level"), ["doc"])


@query(
    f"""WITH RECURSIVE m AS (SELECT doc, ord, level, row_number() OVER (PARTITION BY doc ORDER BY ord) AS k FROM {D_MARKS}), r AS (SELECT doc, ord, k, level FROM m WHERE k = 1
    UNION ALL SELECT o.doc, o.ord, o.k, least(o.level, r.level + 2) FROM r JOIN m o ON o.doc = r.doc AND o.k = r.k + 1) SELECT doc, ord::INTEGER AS ord, level FROM r"""
)
def level_clamp(spark, sf_dir):
    return S.clamp_levels(marks(spark, sf_dir).select("doc", F.col("ord").cast("int").alias("ord"), "level"), ["doc"], 2)


@query()
def headings_combined(spark, sf_dir):
    """Headings of two detectors in one, repeated ones once."""
    lines = styled(spark, sf_dir)
    shape = lambda df: df.select(F.concat_ws("-", "doc", "page").alias("page"), F.col("line_no").cast("int").alias("ord"), F.col("line").alias("text"), F.col("confidence").cast("double").alias("confidence"), "level")
    return S.combined_headings(shape(S.pattern_headings(lines)), shape(S.position_headings(lines, ["doc", "page"])))
