"""Queries of scans and sinks: written to the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bookmarks, embedding, pairwise, report, scoring
from ..session import shared_folder
from ..sources import documents, readers
from .book_queries import D_MARKS, D_SECTIONS, marks, sections
from .registry import query, read, sql
from .table_queries import D_ALIGN, D_SIM, alignments, overall_scores, section_scores, similarities


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS category, CAST(o_orderkey % 50 AS INTEGER) AS units, CAST(floor(o_totalprice / 100) AS INTEGER) AS unit_price, o_orderstatus AS region,
    'web' AS sales_channel, 'all' AS customer_segment, CAST(floor(o_totalprice) AS INTEGER) AS revenue FROM orders"""
)
def csv_scan(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderdate AS DATE) AS date", "o_orderpriority AS category", "CAST(o_orderkey % 50 AS INT) AS units", "CAST(floor(o_totalprice / 100) AS INT) AS unit_price",
        "o_orderstatus AS region", "'web' AS sales_channel", "'all' AS customer_segment", "CAST(floor(o_totalprice) AS INT) AS revenue",
    )
    path = place(spark, "sales")
    report.write_csv(o, path)
    return readers.read_sales(spark, path)


@query("SELECT doc_id, md5(text) AS content_hash, length(text) AS char_count FROM documents")
def json_chunks_scan(spark, sf_dir):
    """Chunks to JSON and back."""
    path = place(spark, "chunks")
    report.write_json(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = readers.read_chunks(spark, path, "doc_id BIGINT, text STRING")
    return back.select("doc_id", F.md5("text").alias("content_hash"), F.length("text").cast("long").alias("char_count"))


@query("SELECT doc_id, generate_subscripts(p, 1) AS page, length(unnest(p)) AS n FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS p FROM documents)")
def pages_from_formfeed(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return readers.pages_from_text(d).select("doc_id", F.col("page").cast("long").alias("page"), F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, page FROM (SELECT doc_id, generate_subscripts(p, 1) AS page FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS p FROM documents)) WHERE page <= 3")
def page_cap(spark, sf_dir):
    """At most three pages of each document."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return readers.pages_from_text(d, most=3).select("doc_id", F.col("page").cast("long").alias("page"))


@query(
    """SELECT doc_id, CASE WHEN length(trim(a)) < 50 AND length(trim(b)) > length(trim(a)) THEN b ELSE a END AS line, CASE WHEN length(trim(a)) < 50 AND length(trim(b)) > length(trim(a)) THEN 'ocr' ELSE 'text' END AS extraction_method
    FROM (SELECT doc_id, string_split(text, chr(10))[1] AS a, coalesce(string_split(text, chr(10))[2], '') AS b FROM documents)"""
)
def sparse_page_rescue(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("line"), F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")).alias("b"))
    return readers.rescue_sparse(d, "line", "b").drop("b")


@query(
    """SELECT doc_id, coalesce(one, two, three) AS text_len, CASE WHEN one IS NOT NULL THEN 'one' WHEN two IS NOT NULL THEN 'two' WHEN three IS NOT NULL THEN 'three' ELSE 'failed' END AS extraction_method FROM
    (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS one, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 END AS two, CASE WHEN doc_id % 5 = 0 THEN n_chars + 2 END AS three FROM documents)"""
)
def engine_fallback(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 2 = 0 THEN n_chars END AS one", "CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 END AS two", "CASE WHEN doc_id % 5 = 0 THEN n_chars + 2 END AS three"
    )
    return readers.first_engine(d, "one", "two", "three").select("doc_id", F.col("text").alias("text_len"), "extraction_method")


@query(
    """SELECT page, block, line, span, text, size FROM (SELECT doc_id AS page, b AS block, l AS line, generate_subscripts(w, 1) - 1 AS span, unnest(w) AS text, (8 + b % 4)::DOUBLE AS size FROM
      (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS b, 0 AS l, string_split(unnest(lines), ', ') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"""
)
def span_flatten(spark, sf_dir):
    """Documents as layouts: each line a block of one line, cut into spans at commas."""
    size = lambda k: (8 + k % 4).cast("double").alias("size")
    line = lambda x, k: F.struct(F.transform(F.split(x, ", "), lambda t: F.struct(t.alias("text"), size(k))).alias("spans"))
    blocks = F.transform(F.split("text", "\n"), lambda x, k: F.struct(F.array(line(x, k)).alias("lines")))
    return readers.flatten_spans(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), blocks.alias("blocks")))


@query("SELECT p_partkey, p_name FROM part")
def document_files(spark, sf_dir):
    """Text files of documents, one for each part, scanned as binary files."""
    path = place(spark, "files")
    read(spark, sf_dir, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name").alias("value")).write.text(path)
    pages = readers.read_documents(spark, path + "/part-*")
    lines = pages.select(F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line"))
    parts = F.split("line", "\t")
    return lines.select(parts[0].cast("long").alias("p_partkey"), parts[1].alias("p_name"))


def _layout(content: bytes) -> list[dict]:
    """A stand-in for a layout engine: pages part at form feeds, a line is a span; files of scans fail."""
    text = content.decode("utf-8")
    if text.startswith("scan"):
        raise ValueError("no text layer")
    return [
        {"text": p, "spans": [{"text": t, "x0": 0.0, "y0": 12.0 * k, "x1": 5.0 * len(t), "y1": 12.0 * k + 10, "font": "plain", "size": 10.0, "bold": False} for k, t in enumerate(p.split("\n"))]}
        for p in text.split("\f")
    ]


def _seen(content: bytes, page: int) -> str:
    """A stand-in for character recognition: pages of scans in capitals; the second of each fails."""
    text = content.decode("utf-8").split("\f")[page - 1]
    if page == 2:
        raise ValueError("blurred")
    return text.upper() + " (read from the picture of the page, at twice its size)"


@query(
    """SELECT s_suppkey, page, CASE WHEN s_suppkey % 2 = 0 AND page = 2 THEN '' WHEN s_suppkey % 2 = 0 OR page = 1 THEN concat(upper(t), ' (read from the picture of the page, at twice its size)') ELSE t END AS text,
    CASE WHEN s_suppkey % 2 = 0 AND page = 2 THEN 'ocr_failed' WHEN s_suppkey % 2 = 0 OR page = 1 THEN 'ocr' ELSE 'layout' END AS extraction_method, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS n_spans FROM
    (SELECT s_suppkey, unnest([1, 2]) AS page, unnest([concat(CASE WHEN s_suppkey % 2 = 0 THEN 'scan ' ELSE 'file ' END, s_suppkey), concat(s_name, ' is the name of a supplier, on a page with enough text')]) AS t FROM supplier)"""
)
def document_engines(spark, sf_dir):
    """Files that a layout engine reads, or fails on, with recognition of sparse pages and of scans."""
    path = place(spark, "engines")
    content = "concat(CASE WHEN s_suppkey % 2 = 0 THEN 'scan ' ELSE 'file ' END, s_suppkey, '\f', s_name, ' is the name of a supplier, on a page with enough text\n') AS content"
    # A folder a task, not one a document: the driver moves folders, and lists what a pattern names, one by one.
    documents.register(spark)
    read(spark, sf_dir, "supplier").selectExpr("concat('s_suppkey=', s_suppkey, '.txt') AS name", content).write.format("document_files").mode("append").save(path)
    pages = readers.read_documents(spark, path + "/part-*", {"broken": lambda content: 1 / 0, "layout": _layout}, _seen)
    lines = lambda c: F.rtrim(F.regexp_replace(c, r"\n", ""))
    key = F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long")
    n = F.size(F.filter(F.coalesce("spans", F.array().cast(f"array<{readers.SPAN}>")), lambda x: x["text"] != ""))
    spans = F.when(F.col("spans").isNull(), 0).otherwise(n)
    return pages.select(key.alias("s_suppkey"), "page", lines("text").alias("text"), "extraction_method", spans.alias("n_spans"))


@query("SELECT s_suppkey, s_name FROM supplier")
def report_json_roundtrip(spark, sf_dir):
    """One report of all rows in a JSON envelope, written and read back."""
    path = place(spark, "report")
    report.envelope(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "lexiloom", "1").write.text(path)
    kind = "metadata struct<generator: string, version: string>, data array<struct<s_suppkey: bigint, s_name: string>>"
    return spark.read.schema(kind).json(path).select(F.explode("data").alias("d")).select("d.*")


@query("SELECT n_regionkey::VARCHAR AS report, n_nationkey, n_name FROM nation")
def report_json_by_key(spark, sf_dir):
    """A report for each region."""
    path = place(spark, "reports")
    report.envelope(read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"), "lexiloom", "1", "n_regionkey").write.text(path)
    kind = "metadata struct<generator: string, version: string, report: string>, data array<struct<n_nationkey: int, n_name: string>>"
    return spark.read.schema(kind).json(path).select("metadata.report", F.explode("data").alias("d")).select("report", "d.*")


_CELL = "concat('<tr><td>Section ', section, '</td><td>', printf('%.2f', round(similarity, 2)), '</td></tr>')"
_HEAD, _REST = report.PAGE.replace("{title}", "Comparison").split("{overall}")
_MID, _TAIL = _REST.split("{grade}")
_AFTER, _FOOT = _TAIL.split("{rows}")


@query(
    f"""SELECT t.pair_id, md5(concat('{_HEAD}', printf('%.2f', round(t.similarity, 2)), '{_MID}', CASE WHEN t.similarity >= 90 THEN 'A' WHEN t.similarity >= 80 THEN 'B' WHEN t.similarity >= 70 THEN 'C' WHEN t.similarity >= 60 THEN 'D' ELSE 'F' END,
    '{_AFTER}', string_agg({_CELL.replace('similarity', 's.similarity').replace('section,', 's.section,')}, '' ORDER BY s.similarity DESC, s.section), '{_FOOT}')) AS html_md5
    FROM (SELECT pair_id, round({D_SIM}, 6) AS similarity FROM {D_ALIGN} GROUP BY pair_id) t JOIN (SELECT pair_id, section, round({D_SIM}, 6) AS similarity FROM {D_ALIGN} GROUP BY pair_id, section) s ON s.pair_id = t.pair_id GROUP BY t.pair_id, t.similarity"""
)
def html_report(spark, sf_dir):
    """The report pages of all document pairs."""
    label = lambda x: F.concat(F.lit("Section "), x["section"].cast("string"))
    rows = F.transform(pairwise.sections(), lambda x: F.struct(label(x).alias("label"), F.round(x["similarity"], 6).alias("similarity")))
    s = similarities(spark, sf_dir).select("pair_id", F.round("similarity", 6).alias("similarity"), rows.alias("rows"))
    page = report.html_page(F.col("similarity"), scoring.grade(F.col("similarity")), F.col("rows"))
    return s.select("pair_id", F.md5(page).alias("html_md5"))


@query(f"SELECT pair_id, section, round({D_SIM}, 6) AS similarity, count(*) AS n FROM {D_ALIGN} GROUP BY pair_id, section")
def scores_json(spark, sf_dir):
    """Section scores as packed JSON files, read back."""
    path = place(spark, "scores")
    report.export(section_scores(spark, sf_dir), path, ["json"], compression="gzip")
    return spark.read.schema("pair_id STRING, section BIGINT, similarity DOUBLE, n BIGINT").json(path + ".json")


@query("SELECT s_suppkey, s_name, 'Lieferant ü' AS note, true AS marked FROM supplier")
def sheet_csv(spark, sf_dir):
    """CSV with a byte order mark, read back."""
    path = place(spark, "sheet")
    report.write_csv_for_sheets(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit("Lieferant ü").alias("note")), path)
    # Spark's readers of text drop the mark, so it is looked for in the bytes.
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    marked = files.agg(F.every(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))
    back = spark.read.csv(path, schema="s_suppkey BIGINT, s_name STRING, note STRING", header=True, enforceSchema=True)
    return back.join(F.broadcast(marked))  # one row


@query(f"SELECT pair_id, ord, section, alignment_type, round(coalesce(score, 0), 6) AS score, true AS marked FROM {D_ALIGN} WHERE alignment_type <> 'match'")
def sheet_differences(spark, sf_dir):
    """What differs between documents, as packed CSV with a byte order mark, read back."""
    path = place(spark, "differences")
    rows = alignments(spark, sf_dir).filter("alignment_type <> 'match'").select("pair_id", "ord", "section", "alignment_type", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    report.write_csv_for_sheets(rows, path, compression="gzip", maxRecordsPerFile="4000000")
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    marked = files.agg(F.every(F.hex(report.first_bytes(F.col("path"), F.col("content"))) == "EFBBBF").alias("marked"))
    back = spark.read.csv(path, schema="pair_id STRING, ord BIGINT, section BIGINT, alignment_type STRING, score DOUBLE", header=True, enforceSchema=True)
    return back.join(F.broadcast(marked))  # one row


@query(f"SELECT format, pair_id, round(similarity, 4) AS similarity FROM (SELECT pair_id, round({D_SIM}, 6) AS similarity FROM {D_ALIGN} GROUP BY pair_id), (VALUES ('csv'), ('json'), ('parquet'), ('sheet.csv')) v(format)")
def export_formats(spark, sf_dir):
    """Scores of all pairs written in every format, texts packed, and read back from each."""
    path = place(spark, "exports")
    schema, out = "pair_id STRING, similarity DOUBLE", None
    # Made once: the other formats are written from the Parquet files.
    done = report.export(overall_scores(spark, sf_dir).select("pair_id", "similarity"), path, ["parquet"], compression="zstd")
    scores = spark.read.schema(schema).parquet(path + ".parquet")
    done |= report.export(scores, path, [k for k in (*report.FORMATS, "pdf") if k not in done], compression="gzip")
    for name in (k for k, good in done.items() if good):
        reader = spark.read.schema(schema)
        back = reader.csv(f"{path}.{name}", header=True, enforceSchema=True) if name.endswith("csv") else reader.format(name).load(f"{path}.{name}")
        one = back.select(F.lit(name).alias("format"), "pair_id", F.round("similarity", 4).alias("similarity"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN NULL ELSE o_totalprice END AS value, strftime(o_orderdate::DATE, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS inner_value FROM orders")
def json_safe_rows(spark, sf_dir):
    """Numbers that are none or infinite and dates, at two depths, as JSON read back."""
    path = place(spark, "safe")
    k, total = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    odd = F.when(k % 3 == 0, float("nan")).when((k % 3 == 1) & (F.col("o_custkey") % 2 == 0), float("-inf")).otherwise(total)
    deep = F.array(F.struct(F.when(k % 3 == 0, float("inf")).otherwise(total).alias("x")))
    report.write_json(read(spark, sf_dir, "orders").select("o_orderkey", odd.alias("value"), F.col("o_orderdate").cast("date").alias("date"), deep.alias("deep")), path)
    back = spark.read.schema("o_orderkey BIGINT, value DOUBLE, date STRING, deep ARRAY<STRUCT<x: DOUBLE>>").json(path)
    return back.select("o_orderkey", "value", "date", F.col("deep")[0]["x"].alias("inner_value"))


@query(f"SELECT doc, generate_subscripts(l, 1) AS ord, unnest(l) AS title FROM (SELECT doc, list(title ORDER BY ord) AS l FROM {D_SECTIONS} GROUP BY doc)")
def bookmarks_written(spark, sf_dir):
    """Outlines as JSON files, one document a row, read back."""
    path = place(spark, "outlines")
    bookmarks.write(sections(spark, sf_dir), path)
    back = spark.read.schema("doc BIGINT, entries ARRAY<STRUCT<level: INT, title: STRING, page: INT>>").json(path)
    return back.select("doc", F.posexplode("entries").alias("k", "e")).select("doc", (F.col("k") + 1).cast("long").alias("ord"), "e.title")


@query(
    """SELECT kind, doc_id, n FROM (SELECT 'new' AS kind, doc_id, length(text) AS n FROM documents UNION ALL SELECT 'kept', doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN length(text) ELSE -length(text) END FROM documents)"""
)
def cache_by_content(spark, sf_dir):
    """Vectors kept by content: made for every second document first, then for what is lacking."""
    path, d = place(spark, "cache"), read(spark, sf_dir, "documents").select("doc_id", "text")
    length = lambda sign: lambda: lambda texts: [[sign * len(t)] for t in texts]
    embedding.embed(d.filter("doc_id % 2 = 0"), make_model=length(1), cache=path).count()
    both = embedding.embed(d, make_model=length(-1), cache=path).select(F.lit("kept").alias("kind"), "doc_id", F.col("vector")[0].cast("long").alias("n"))
    alone = embedding.embed(d, make_model=length(1), cache=place(spark, "cache")).select(F.lit("new").alias("kind"), "doc_id", F.col("vector")[0].cast("long").alias("n"))
    return alone.unionByName(both)


def volumes(spark, sf_dir) -> str:
    """Files of up to 64 documents each, in order of doc_id and parted by form feeds, and where they are."""
    path = place(spark, "volumes")
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\f", " ").alias("text"))
    v = d.groupBy(F.floor(F.col("doc_id") / 64).alias("v")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    documents.register(spark)
    v.select(F.concat(F.lit("v"), F.col("v").cast("string"), F.lit(".txt")).alias("name"), F.array_join(F.transform("d", lambda x: x["text"]), "\f").alias("content")).write.format("document_files").mode("append").save(path)
    return path


D_VOLUMES = "(SELECT doc_id // 64 AS v, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id)::INTEGER AS page, translate(coalesce(text, ''), chr(12), ' ') AS text FROM documents)"


@query(f"SELECT concat('v', v, '.txt') AS name, page, length(text)::INTEGER AS char_count, md5(text) AS text_md5, 'text' AS extraction_method FROM {D_VOLUMES}")
def paged_files(spark, sf_dir):
    """Documents written as files of many pages and read back page by page, large files in shares."""
    path = volumes(spark, sf_dir)
    pages = spark.read.format("document_pages").option("rangeBytes", 100_000).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return pages.select(name.alias("name"), "page", "char_count", F.md5("text").alias("text_md5"), "extraction_method")


@query(f"SELECT concat('v', v, '.txt') AS name, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars FROM {D_VOLUMES} WHERE page <= 5 AND page >= 2 GROUP BY v")
def paged_files_capped(spark, sf_dir):
    """Pages 2 to 5 of every file; the bounds reach the read."""
    pages = spark.read.format("document_pages").option("pageCap", 20).load(volumes(spark, sf_dir)).filter("page <= 5 AND page >= 2")
    return pages.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("n_pages"), F.sum("char_count").alias("n_chars"))


def outline_nodes(spark, sf_dir):
    m = marks(spark, sf_dir).select("doc", "ord", "title", F.greatest("level", F.lit(1)).alias("level"), F.greatest("page", F.lit(1)).alias("page"))
    return bookmarks.linked(m)


D_NODES = f"""(WITH m AS (SELECT doc, ord, title, greatest(1, level) AS level, greatest(1, page) AS page FROM {D_MARKS}),
    p AS (SELECT *, (SELECT max(b.ord) FROM m b WHERE b.doc = a.doc AND b.ord < a.ord AND b.level < a.level) AS parent,
      (SELECT count(*) FROM m b WHERE b.doc = a.doc AND b.ord > a.ord AND b.ord < coalesce((SELECT min(c.ord) FROM m c WHERE c.doc = a.doc AND c.ord > a.ord AND c.level <= a.level), 1000000000)) AS count FROM m a)
    SELECT p.*, lag(ord) OVER s AS prev, lead(ord) OVER s AS next, (SELECT min(c.ord) FROM p c WHERE c.doc = p.doc AND c.parent = p.ord) AS first, (SELECT max(c.ord) FROM p c WHERE c.doc = p.doc AND c.parent = p.ord) AS last FROM p WINDOW s AS (PARTITION BY doc, parent ORDER BY ord))"""


@query(f"SELECT doc, ord, title, level, page, parent, first, last, prev, next, count FROM {D_NODES}")
def outline_links(spark, sf_dir):
    return outline_nodes(spark, sf_dir)


@query(f"SELECT doc, ord, title, level, page, parent, first, last, prev, next, count FROM {D_NODES}")
def outline_files(spark, sf_dir):
    """Outlines written as files, all or none, and read back."""
    path = place(spark, "outlines")
    documents.register(spark)
    bookmarks.write_outlines(outline_nodes(spark, sf_dir), path)
    node = "struct<ord: bigint, title: string, level: int, page: int, parent: bigint, first: bigint, last: bigint, prev: bigint, next: bigint, count: bigint>"
    back = spark.read.schema(f"doc BIGINT, nodes ARRAY<{node}>").option("recursiveFileLookup", "true").json(path)
    return back.select("doc", F.explode("nodes").alias("n")).select("doc", "n.*")


@query(
    f"""WITH d AS (SELECT doc, ord, title, (ord % 10) / 10.0::DOUBLE AS score FROM {D_MARKS}), r AS (SELECT doc, 1 AS part, ord, level, title FROM {D_MARKS}
      UNION ALL SELECT DISTINCT doc, 2, 0, 1, 'Differences' FROM d WHERE score * 100 < 70 UNION ALL SELECT doc, 3, ord, 2, concat(title, ' (', printf('%.1f', score * 100), ' % similar)') FROM d WHERE score * 100 < 70),
    k AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY part, ord) AS ord, title, greatest(1, level) AS level FROM r)
    SELECT doc, ord, title, level, (SELECT max(b.ord) FROM k b WHERE b.doc = k.doc AND b.ord < k.ord AND b.level < k.level) AS parent FROM k"""
)
def outline_differences_file(spark, sf_dir):
    """Outlines with a node for each difference, written as files and read back."""
    m, path = marks(spark, sf_dir), place(spark, "outlines")
    rows = bookmarks.with_differences(m, m.select("doc", "ord", "title", (F.col("ord") % 10 / 10.0).alias("score")))
    place_ = F.row_number().over(Window.partitionBy("doc").orderBy("part", "ord"))
    documents.register(spark)
    bookmarks.write_outlines(bookmarks.linked(rows.select("doc", place_.cast("long").alias("ord"), "title", F.greatest(F.lit(1), F.col("level")).alias("level"), "page")), path)
    node = "struct<ord: bigint, title: string, level: int, parent: bigint>"
    back = spark.read.schema(f"doc BIGINT, nodes ARRAY<{node}>").option("recursiveFileLookup", "true").json(path)
    return back.select("doc", F.explode("nodes").alias("n")).select("doc", "n.*")


@query(r"""SELECT page_id, generate_subscripts(h, 1) - 1 AS ord, substr(unnest(h), 3, 1)::INTEGER AS level, trim(regexp_replace(regexp_replace(unnest(h), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS h FROM pages)""")
def headings_html(spark, sf_dir):
    """Headings of pages, with the text of markup inside of them."""
    return readers.headings_from_html(read(spark, sf_dir, "pages"), "page_id")


sql("events_by_type", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY event_type", None, "events")
