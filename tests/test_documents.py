"""Documents as a data source, outlines in files, contents of short documents, sections of lines."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import bookmarks, contents, structure
from lexiloom.sources import documents
from lexiloom.sources.documents import FilesWriter, FormFeeds, PagesReader, Share


class Counting(FormFeeds):
    """Counts the pages whose text is made, and the bytes that are read."""

    made = read_bytes = 0
    chunk = 64

    def text(self, raw):
        Counting.made += 1
        return super().text(raw)

    def pages(self, stream, first, last):
        class Watched:
            def read(self, n):
                part = stream.read(n)
                Counting.read_bytes += len(part)
                return part

        return super().pages(Watched(), first, last)


class Failing(FormFeeds):
    name = "failing"

    def pages(self, stream, first, last):
        raise OSError("no such format")


class Halfway(FormFeeds):
    name = "halfway"

    def pages(self, stream, first, last):
        yield 1, "one"
        raise OSError("broken file")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("documents")
    (root / "sub").mkdir()
    (root / "a.txt").write_text("one\ftwo\fthree")
    (root / "sub" / "b.txt").write_text("\f".join(f"page {k} é" + "x" * 300 for k in range(1, 101)))
    (root / "empty.txt").write_text("")
    (root / "_hidden.txt").write_text("no")
    return str(root)


def read(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [64 << 20, 1000, 7000])
def test_every_page_once(folder, size):
    rows = read(PagesReader({"path": folder, "rangebytes": str(size)}))
    found = sorted((os.path.basename(r["path"]), r["page"], r["text"][:8]) for r in rows)
    assert found == sorted([("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, "three"), ("empty.txt", 1, ""), *(("b.txt", k, f"page {k} é"[:8]) for k in range(1, 101))])
    assert all(r["char_count"] == len(r["text"]) and r["extraction_method"] == "text" for r in rows)


def test_large_files_are_dealt_out(folder):
    shares = [s for s in PagesReader({"path": folder, "rangebytes": "1000"}).partitions() if s.parts > 1]
    assert [s.part for s in shares] == list(range(shares[0].parts)) and len(shares) > 10
    assert len(PagesReader({"path": folder}).partitions()) == 1


def test_a_cap_stops_the_parsing(folder):
    Counting.made = Counting.read_bytes = 0
    rows = read(PagesReader({"path": folder, "pagecap": "3", "engines": "tests.test_documents:Counting" if __name__.startswith("tests") else f"{__name__}:Counting"}))
    assert len(rows) == 7 and Counting.made == 7
    assert Counting.read_bytes < 1500  # of some 31,000


def test_filters_reach_the_read(spark, folder):
    documents.register(spark)
    df = spark.read.format("document_pages").load(folder)
    assert df.filter("page <= 3 AND page > 1").count() == 4
    assert df.filter("page = 50").select("text").first()[0].startswith("page 50 é")
    assert df.filter(F.col("path") == f"{folder}/a.txt").count() == 3
    assert df.filter("length(text) < 6").count() == 4
    assert spark.read.format("document_pages").option("pageCap", 2).load(folder).count() == 5
    reader = PagesReader({"path": folder})
    left = list(reader.pushFilters([documents.LessThan(("page",), 5), documents.GreaterThanOrEqual(("page",), 2), documents.EqualTo(("path",), f"{folder}/a.txt"), documents.EqualTo(("text",), "x")]))
    assert (reader.first, reader.last, reader.only) == (2, 4, {f"{folder}/a.txt"}) and len(left) == 1
    assert [f for s in reader.partitions() for f, _ in s.files] == [f"{folder}/a.txt"]


def test_engines_in_turn(folder):
    me = "tests.test_documents" if __name__.startswith("tests") else __name__
    rows = read(PagesReader({"path": f"{folder}/a.txt", "engines": f"{me}:Failing,{me}:FormFeeds"}))
    assert [r["extraction_method"] for r in rows] == ["text"] * 3
    rows = read(PagesReader({"path": f"{folder}/a.txt", "engines": f"{me}:Failing"}))
    assert [(r["page"], r["text"], r["extraction_method"]) for r in rows] == [(1, "", "failed")]
    rows = read(PagesReader({"path": f"{folder}/a.txt", "engines": f"{me}:Halfway"}))
    assert [(r["page"], r["extraction_method"]) for r in rows] == [(1, "halfway"), (2, "failed")]


def test_form_feeds_at_the_edges_of_chunks():
    rng = random.Random(3)
    for _ in range(200):
        pages = ["".join(rng.choice("aé") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 8))]
        raw = "\f".join(pages).encode()
        e = FormFeeds()
        e.chunk = rng.randrange(1, 9)
        assert e.count(io.BytesIO(raw)) == len(pages)
        first, last = rng.randrange(1, 5), rng.choice([None, 1, 3, 9])
        assert list(e.pages(io.BytesIO(raw), first, last)) == [(k, p) for k, p in enumerate(pages, 1) if k >= first and (last is None or k <= last)]


def test_files_all_or_none(spark, tmp_path):
    documents.register(spark)
    good = spark.createDataFrame([(f"f{k}.txt", f"text {k} é") for k in range(20)], "name string, content string").repartition(4)
    good.write.format("document_files").mode("append").save(f"{tmp_path}/out")
    found = {f: open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    assert found == {f"f{k}.txt": f"text {k} é" for k in range(20)}
    bad = good.withColumn("name", F.when(F.col("name") == "f7.txt", "no/name").otherwise(F.col("name")))
    with pytest.raises(Exception, match="no name of a file"):
        bad.write.format("document_files").mode("append").save(f"{tmp_path}/bad")
    assert not [f for _, _, fs in os.walk(tmp_path / "bad") for f in fs]
    good.limit(1).write.format("document_files").mode("overwrite").save(f"{tmp_path}/out")
    assert sum(len(fs) for _, _, fs in os.walk(tmp_path / "out")) == 1


def test_an_abort_leaves_nothing(tmp_path):
    w = FilesWriter(str(tmp_path / "x"), False)
    w.write(iter([{"name": "a", "content": b"1"}]))
    w.abort([None])
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs]
    assert Share([]).parts == 1


def outline(spark):
    levels = [1, 2, 2, 3, 1, 3, 2, 1]
    rows = [(1, k * 10, f"t{k}", lv, k) for k, lv in enumerate(levels, 1)] + [(2, 5, "é", 4, 3)]
    return spark.createDataFrame(rows, "doc long, ord long, title string, level int, page int")


def test_linked_nodes(spark):
    nodes = {(r["doc"], r["ord"]): r for r in bookmarks.linked(outline(spark)).collect()}
    get = lambda k, c: nodes[(1, k * 10)][c] and nodes[(1, k * 10)][c] // 10
    assert [get(k, "parent") for k in range(1, 9)] == [None, 1, 1, 3, None, 5, 5, None]
    assert [get(k, "next") for k in range(1, 9)] == [5, 3, None, None, 8, 7, None, None]
    assert [get(k, "first") for k in range(1, 9)] == [2, None, 4, None, 6, None, None, None]
    assert [nodes[(1, k * 10)]["count"] for k in range(1, 9)] == [3, 0, 1, 0, 2, 0, 0, 0]
    assert nodes[(2, 5)]["parent"] is None and nodes[(2, 5)]["count"] == 0


def test_outline_objects(spark):
    out = {(r["doc"], r["ord"]): r["object"] for r in bookmarks.outline_objects(bookmarks.linked(outline(spark))).collect()}
    assert out[(1, 10)] == "1001 0 obj\n<< /Title <FEFF00740031> /Parent 1000 0 R /Next 1005 0 R /First 1002 0 R /Last 1003 0 R /Count 3 /Dest [0 /Fit] >>\nendobj"
    assert out[(1, 40)] == "1004 0 obj\n<< /Title <FEFF00740034> /Parent 1003 0 R /Dest [3 /Fit] >>\nendobj"
    assert out[(2, 5)].startswith("1001 0 obj\n<< /Title <FEFF00E9> /Parent 1000 0 R /Dest")


def test_outlines_in_files(spark, tmp_path):
    documents.register(spark)
    bookmarks.write_outlines(bookmarks.linked(outline(spark)), f"{tmp_path}/o", 1)
    lines = [json.loads(x) for d, _, fs in os.walk(tmp_path / "o") for f in fs for x in open(os.path.join(d, f), encoding="utf-8")]
    assert sorted((x["doc"], len(x["nodes"])) for x in lines) == [(1, 8), (2, 1)]


LINES = "doc long, page int, line_no int, line string"


def test_content_of_short_documents(spark):
    """A document with fewer pages than the fallback starts at page 1; longer ones at page 5 or a tenth."""
    rows = [(1, p, k, f"plain words {p} {k}") for p in range(1, 4) for k in range(3)]
    rows += [(2, p, 1, "plain words") for p in range(1, 8)] + [(3, p, 1, "plain words") for p in range(1, 101)] + [(4, 1, 1, "x")]
    df = spark.createDataFrame(rows, LINES)
    assert {r["doc"]: r["start_page"] for r in contents.content_start(df).collect()} == {1: 1, 2: 5, 3: 10, 4: 1}
    assert contents.content_lines(df).filter("doc = 1").count() == 9


@pytest.mark.parametrize(
    "line,title,page,level",
    [
        ("1. Scope ..... 3", "1. Scope", 3, 1),
        ("1.2 Terms and words 14", "1.2 Terms and words", 14, 2),
        ("1.2.3 Deep.........15", "1.2.3 Deep", 15, 3),
        ("Afterword 99", "Afterword", 99, 1),
        ("Annex...120", "Annex", 120, 1),
        ("2.1. With a dot 7", "2.1. With a dot", 7, 2),
    ],
)
def test_levels_of_contents(spark, line, title, page, level):
    r = contents.toc_lines(spark.createDataFrame([(1, 1, 1, line), (1, 1, 2, "no entry"), (1, 1, 3, "x 1")], LINES)).collect()
    assert [(x["title"], x["page"], x["level"]) for x in r] == [(title, page, level)]


def test_innermost_sections(spark):
    """A chapter of 10,000 pages around sections of a few; lines are not multiplied by it."""
    sections = [(1, 1, 1, 1, 10_000), (1, 2, 3, 5, 7), (1, 3, 6, 2, 6), (1, 4, 9_999, 1, 10_000), (2, 5, 4, 1, 4)]
    s = spark.createDataFrame(sections, "doc long, ord long, page int, line_no int, page_end int")
    lines = [(1, p, k, "x") for p in (1, 2, 3, 5, 6, 7, 8, 500, 9_999, 10_000, 10_001) for k in (1, 3, 9)] + [(2, p, 1, "y") for p in (3, 4, 5)]
    out = contents.innermost(spark.createDataFrame(lines, LINES), s).collect()
    want = {}
    for d, p, k, _ in lines:
        around = [(a, b, o) for (sd, o, a, b, e) in sections if sd == d and (a, b) <= (p, k) and p <= e]
        want[(d, p, k)] = max(around)[2] if around else None
    assert {(r["doc"], r["page"], r["line_no"]): r["section"] for r in out} == want and len(out) == len(lines)


def test_numbers_are_matched_in_generated_code(spark):
    """The plan of numbered() compiles: the stage is not interpreted."""
    rows = [(1, 1, 1, "1-2-3. Deep title"), (1, 1, 2, "1.2 Two"), (1, 1, 3, "7. Seven"), (1, 1, 4, "words 1. x"), (1, 1, 5, "99999999999. big"), (1, 1, 6, "3-x")]
    out = structure.numbered(spark.createDataFrame(rows, LINES))
    got = {r["line_no"]: (r["chapter"], r["section"], r["subsection"], r["title"], r["level"], r["numbering"]) for r in out.collect()}
    assert got == {1: (1, 2, 3, "Deep title", 3, "1-2-3"), 2: (1, 2, None, "Two", 2, "1-2"), 3: (7, None, None, "Seven", 1, "7")}
    code = out._jdf.queryExecution().debug().codegenToSeq()
    assert all("regexp" not in str(code.apply(k)._2()).lower() or len(str(code.apply(k)._2())) < 200_000 for k in range(code.size()))
