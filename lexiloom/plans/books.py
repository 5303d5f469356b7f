"""Books made of the documents, for queries of headings, contents, sections, outlines and bookmarks.

A book is a document's lines, whole, as pages of eight; lines of a document have even numbers. In front
of every sixth stands a heading (a chapter's every 24 lines, else a section's) and in front of every
twelfth of the others a subsection's, made of the first 40 characters of the line. Every fifth document
starts with a list of contents, its entries in front of its first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure as S
from .registry import read


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("k", "x"))
    k, head = F.col("k"), F.trim(F.left(F.col("x"), F.lit(40)))
    chapter, section = F.floor(k / 24) + 1, F.floor(k / 6) % 4
    numbers = lambda *n: F.concat_ws("-", *[c.cast("string") for c in n])
    listed = (F.col("doc") % 5 == 0) & (k <= 6)
    entry = F.concat(F.floor((k + 2) / 3).cast("string"), F.when(k % 3 == 1, ".").when(k % 3 == 2, ".1").otherwise(".1.1"))
    heading = (
        F.when(listed & (k == 0), "Contents")
        .when(listed, F.concat(entry, F.lit(" "), head, F.lit(" ..... "), (k * 3).cast("string")))
        .when(k % 24 == 0, F.concat(numbers(chapter), F.lit(". "), head))
        .when(k % 6 == 0, F.concat(numbers(chapter, section), F.lit(". "), head))
        .when(k % 12 == 9, F.concat(numbers(chapter, section, F.lit(1)), F.lit(". "), head))
    )
    both = F.filter(F.array(F.struct(F.lit(1).alias("n"), heading.alias("line")), F.struct(F.lit(2).alias("n"), F.col("x").alias("line"))), lambda y: y["line"].isNotNull())
    d = d.select("doc", "k", F.explode(both).alias("y"))
    return d.select("doc", (F.floor(k / 8) + 1).cast("int").alias("page"), (k % 8 * 2 + F.col("y.n")).alias("line_no"), F.col("y.line").alias("line"))


D_BOOK = """(SELECT doc, k // 8 + 1 AS page, k % 8 * 2 + n AS line_no, line FROM (SELECT doc, k, n, CASE WHEN n = 2 THEN x WHEN doc % 5 = 0 AND k = 0 THEN 'Contents'
  WHEN doc % 5 = 0 AND k <= 6 THEN concat((k + 2) // 3, ['.1.1', '.', '.1'][k % 3 + 1], ' ', trim(left(x, 40)), ' ..... ', k * 3)
  WHEN k % 24 = 0 THEN concat(k // 24 + 1, '. ', trim(left(x, 40))) WHEN k % 6 = 0 THEN concat(k // 24 + 1, '-', k // 6 % 4, '. ', trim(left(x, 40)))
  WHEN k % 12 = 9 THEN concat(k // 24 + 1, '-', k // 6 % 4, '-1. ', trim(left(x, 40))) END AS line
  FROM (SELECT doc_id AS doc, unnest(range(len(l)))::INTEGER AS k, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), (VALUES (1), (2)) v(n)) WHERE line IS NOT NULL)"""


#: Beginnings of headings in other styles, and a line without any.
FORMS = ("第3章 ", "第12節 ", "4. ", "一. ", "A. ", "Chapter 4 ", "IV. ", "Section 2 ", "1.2.3 ", "2-1. ", "Overview: ", "付録 ", "")


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of books in many styles, text lines as they are."""
    b = book(spark, sf_dir)
    form = F.get(F.array(*[F.lit(x) for x in FORMS]), ((F.col("doc") + F.col("page") * 5 + F.col("line_no") * 3) % len(FORMS)).cast("int"))
    own = F.concat(form, F.regexp_replace("line", r"^[\d\-. ]+", ""))
    return b.withColumn("line", F.when(F.col("line_no") % 2 == 1, own).otherwise(F.col("line")))


D_STYLED = rf"""(SELECT doc, page, line_no, CASE WHEN line_no % 2 = 1 THEN concat([{', '.join(f"'{x}'" for x in FORMS)}][(doc + page * 5 + line_no * 3) % {len(FORMS)} + 1], regexp_replace(line, '^[\d\-. ]+', '')) ELSE line END AS line FROM {D_BOOK})"""


def d_numbered(table: str) -> str:
    def pick(k: int) -> str:
        out = "CASE"
        for p in S.NUMBERED:
            n = p.count("(") - 1
            value = f"trim(regexp_extract(line, '{p}', {n + 1}))" if k == 4 else f"try_cast(regexp_extract(line, '{p}', {k}) AS INTEGER)" if k <= n else "NULL"
            out += f" WHEN regexp_matches(line, '{p}') THEN {value}"
        return out + " END"

    return f"""(SELECT *, CASE WHEN subsection IS NOT NULL THEN 3 WHEN section IS NOT NULL THEN 2 ELSE 1 END AS level, concat_ws('-', chapter::VARCHAR, section::VARCHAR, subsection::VARCHAR) AS numbering
      FROM (SELECT *, {pick(1)} AS chapter, {pick(2)} AS section, {pick(3)} AS subsection, {pick(4)} AS title FROM {table} WHERE length(line) BETWEEN 5 AND 150) WHERE chapter IS NOT NULL)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the books as spans, long ones as two at about one height."""
    b = book(spark, sf_dir)
    size = F.when(F.col("line").rlike(r"^\d+\. "), 20.0).when(F.col("line").rlike(r"^\d+-\d+"), 16.5).when(F.col("line_no") == 10, 10.5).otherwise(10.0)
    both = F.array(F.struct(F.lit(0).alias("n"), F.left("line", F.lit(20)).alias("text")), F.struct(F.lit(1).alias("n"), F.substr("line", F.lit(21)).alias("text")))
    s = b.select("doc", "page", "line_no", size.alias("size"), (F.col("line_no") == 6).alias("bold"), F.explode(F.filter(both, lambda x: x["text"] != "")).alias("s"))
    y = F.col("line_no") * 12.0 + F.col("s.n") * 0.25
    x = F.col("s.n") * 100.0
    return s.select("doc", "page", x.alias("x"), y.alias("y"), (x + F.length("s.text") * 5.0).alias("x1"), (y + F.col("size")).alias("y1"), F.col("s.text").alias("text"), "size", "bold")


D_SPANS = rf"""(SELECT doc, page, n * 100.0::DOUBLE AS x, (line_no * 12.0 + n * 0.25)::DOUBLE AS y, n * 100.0::DOUBLE + length(text) * 5.0::DOUBLE AS x1, (line_no * 12.0 + n * 0.25)::DOUBLE + size AS y1, text, size, bold FROM
  (SELECT doc, page, line_no, line_no = 6 AS bold, n, CASE n WHEN 0 THEN left(line, 20) ELSE substr(line, 21) END AS text,
    (CASE WHEN regexp_matches(line, '^\d+\. ') THEN 20.0 WHEN regexp_matches(line, '^\d+-\d+') THEN 16.5 WHEN line_no = 10 THEN 10.5 ELSE 10.0 END)::DOUBLE AS size FROM {D_BOOK}, range(2) r(n)) WHERE text <> '')"""

