"""Scans: CSV facts, chunk and chapter JSON, pages of text, layout spans, engine fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SALES_SCHEMA = "date DATE, category STRING, units INT, unit_price INT, region STRING, sales_channel STRING, customer_segment STRING, revenue INT"


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """CSV facts with a fixed schema; dates as yyyy-MM-dd."""
    return spark.read.csv(path, schema=SALES_SCHEMA, header=True, dateFormat="yyyy-MM-dd")


def read_chunks(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    """Chunks as JSON: one object a line, or, with `array`, one array of objects in a file."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=array)


def chapters_from_json(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows of a JSON object that maps chapter numbers to their title and pages, behind the columns `keys`."""
    kind = "map<string, struct<title: string, page_start: bigint, page_end: bigint>>"
    return df.select(*keys, F.explode(F.from_json(column, kind)).alias("numbering", "c")).select(*keys, "numbering", "c.title", "c.page_start", "c.page_end")


def pages_from_text(df: DataFrame, text_col: str = "text", most: int | None = None) -> DataFrame:
    """Pages of a text, parted at form feeds and numbered from 1, before any cleaning; at most `most`
    of each document, behind which the text is not cut up."""
    names = [c for c in df.columns if c != text_col]
    pages = F.slice(F.split(text_col, "\f", most + 1), 1, most) if most else F.split(text_col, "\f")
    return df.select(*names, F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def first_engine(df: DataFrame, *columns: str) -> DataFrame:
    """Adds text and extraction_method: of the first engine (a column each) that gave anything."""
    text = F.coalesce(*columns)
    method = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns], F.lit("failed"))
    return df.withColumns({"text": text, "extraction_method": method})


def rescue_sparse(df: DataFrame, text_col: str, other_col: str, least: int = 50) -> DataFrame:
    """A page with less text than `least` takes the other engine's if that is longer."""
    a, b = F.trim(F.col(text_col)), F.trim(F.col(other_col))
    use = (F.length(a) < least) & (F.length(b) > F.length(a))
    return df.withColumns({"extraction_method": F.when(use, "ocr").otherwise("text"), text_col: F.when(use, F.col(other_col)).otherwise(F.col(text_col))})


def flatten_spans(df: DataFrame, blocks_col: str = "blocks") -> DataFrame:
    """Spans of nested blocks and lines, one a row, in order."""
    b = df.select("page", F.posexplode(blocks_col).alias("block", "b"))
    li = b.select("page", "block", F.posexplode("b.lines").alias("line", "l"))
    return li.select("page", "block", "line", F.posexplode("l.spans").alias("span", "s")).select("page", "block", "line", "span", "s.*")


SPAN = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font:string,size:double,bold:boolean>"
PAGES = f"path string, page int, text string, spans array<{SPAN}>, char_count int, extraction_method string"


def _as_text(content: bytes) -> list[dict]:
    """The engine that is always there: UTF-8 with form feeds between pages."""
    return [{"text": t} for t in content.decode("utf-8").split("\f")]


def read_documents(
    spark: SparkSession,
    path: str,
    engines: dict[str, Callable[[bytes], list[dict]]] | None = None,
    ocr: Callable[[bytes, int], str] | None = None,
    least: int = 50,
    most_pages: int | None = None,
) -> DataFrame:
    """Files of documents as pages: path, page, text, spans, char_count, extraction_method.

    `engines` names functions from a file's bytes to its pages (dicts with text, and spans if the
    engine knows them), tried in order; the first that raises nothing is taken, and its name is the
    method. Without engines files are read as UTF-8 text with form feeds. `ocr`, from bytes and page
    number to text, is asked for pages with less than `least` characters and taken where it gives
    more (method ocr), and for whole files that no engine reads, page 1 on, until it raises
    IndexError. A page that it fails on is an empty one marked ocr_failed; a file that nothing reads
    is one empty page marked failed."""
    import pandas as pd

    tried = engines or {"text": _as_text}

    def recognised(content: bytes, page: int) -> tuple[str, str] | None:
        try:
            return ocr(content, page), "ocr"
        except IndexError:
            return None
        except Exception:  # noqa: BLE001  a page that can't be read is a row of the result
            return "", "ocr_failed"

    def of_file(content: bytes) -> list[tuple[str, list | None, str]]:
        for name, engine in tried.items():
            try:
                pages = engine(content)
            except Exception:  # noqa: BLE001  the next engine has its turn
                continue
            out = []
            for k, p in enumerate(pages):
                text, method = p.get("text") or "", name
                if ocr is not None and len(text.strip()) < least:
                    other = recognised(content, k + 1)
                    if other is not None and len(other[0].strip()) > len(text.strip()):
                        text, method = other
                out.append((text, p.get("spans"), method))
            return out
        out = []
        while ocr is not None and (most_pages is None or len(out) < most_pages):
            page = recognised(content, len(out) + 1)
            if page is None:
                break
            out.append((page[0], None, page[1]))
        return out or [("", None, "failed")]

    def pages(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                out += [(name, k + 1, t, s, len(t), m) for k, (t, s, m) in enumerate(of_file(content)[:most_pages])]
            yield pd.DataFrame(out, columns=["path", "page", "text", "spans", "char_count", "extraction_method"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, PAGES)


def headings_from_html(df: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """Headings of level 1 to 6 in order: key, ord, level, title, markup inside of them dropped and white
    space collapsed; empty ones are none."""
    whole = F.regexp_extract_all(html_col, F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), 1)
    h = df.select(key, F.posexplode(whole).alias("ord", "h"))
    title = T.strip(T.collapse(F.regexp_replace("h", r"<[^>]*>", "")))
    return h.select(key, F.col("ord").cast("long").alias("ord"), F.substring("h", 3, 1).cast("int").alias("level"), title.alias("title")).filter("title <> ''")
