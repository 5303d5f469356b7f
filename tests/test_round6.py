"""Findings of the third round that were left open, each on a small table."""

import gzip
import tracemalloc
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from lexiloom.functions import text as T
from lexiloom.operators import align, contents, embedding, near, report, structure
from lexiloom.plans import registry, source_queries
from lexiloom.sources.documents import BatchesWriter, DocumentFiles


def test_near_copies_meet_in_blocks(spark):
    """All pairs of copies and near copies, in order of ids, with what is told of two texts made once a node."""
    words = [f"w{k}" for k in range(40)]
    one, two, far = " ".join(words), " ".join([*words[:-3], "x", "y", "z"]), "nothing like the others at all here"
    texts = {k: (one, two)[k % 2] for k in range(1, 81)} | {90: far, 91: "", 92: None, 93: "  \n", 94: one + "  "}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near.compared(d, lambda a, b: (a, b, uuid.uuid4().hex), "a string, b string, made string").collect()
    alike = sorted(k for k in texts if k <= 80 or k == 94)
    assert sorted((r["a_id"], r["b_id"]) for r in found) == [(a, b) for a in alike for b in alike if a < b]
    assert all((r["a"], r["b"]) == (texts[r["a_id"]], texts[r["b_id"]]) for r in found)
    assert len({r["made"] for r in found}) <= 25 < len(found)


def test_optimal_assignment_of_vectors(spark):
    """As that of a table of scores, in total and number; odd vectors find none."""
    rng = np.random.default_rng(3)
    sides = [[(label, k, rng.normal(size=4).tolist()) for label in (1, 2) for k in range(100 * label, 100 * label + n)] for n in (9, 14)]
    a, b = (spark.createDataFrame(s + [(3, 300, x)], f"label long, {k} long, {v} array<double>") for s, k, v, x in zip(sides, "ij", "xy", ([1.0, 0.0, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0])))
    b = b.unionByName(spark.createDataFrame([(1, 199, None)], b.schema))
    scores = a.join(b, "label").filter("y IS NOT NULL AND label < 3").select("label", "i", "j", F.round(T.cosine(F.col("x"), F.col("y")), 4).alias("score"))
    given = {(r["label"], r["i"], r["j"]): r["score"] for r in scores.collect()}
    found = [(r["label"], r["i"], r["j"], r["score"]) for r in align.assign_optimal_by_cosine(a, b, "label", 0.3).collect()]
    want = align.assign_optimal(scores, "label", 0.3).collect()
    assert len(found) == len(want) == len({x[:2] for x in found}) == len({(x[0], x[2]) for x in found})
    assert all(given[x[:3]] == pytest.approx(x[3]) for x in found)
    assert sum(x[3] for x in found) == pytest.approx(sum(r["score"] for r in want))


def test_lines_are_made_bare_once(spark):
    """A line and a title pass the patterns once, however often the comparison names them."""
    lines = spark.createDataFrame([(1, "1. The Scope!", "scope"), (2, "a b c d", "D, c b a."), (3, "a b c d", "a b x y"), (4, "!", "?"), (5, None, "x")], "k long, line string, title string")
    found = lines.filter(contents.is_heading_line(F.col("line"), F.col("title"), 0.7))
    assert sorted(r["k"] for r in found.collect()) == [1, 2, 4]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2


def test_lines_are_matched_once_for_headings(spark):
    """Level and confidence come of one match, and of lines that can't be headings no text is shuffled."""
    rows = [(1, k, x) for k, x in enumerate(["1. One", "an overview of it", "w " * 50, "Chapter 3 on", "abstract", "short"], 1)]
    lines = spark.createDataFrame(rows, "page long, line_no long, line string")
    found = structure.pattern_headings(lines)
    assert {r["line_no"]: (r["level"], r["confidence"]) for r in found.collect()} == {1: (2, 0.9), 2: (2, 0.7), 4: (1, 0.8), 5: (2, 0.7)}
    assert found.columns == ["page", "line_no", "line", "level", "confidence"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [(r["line_no"], r["line"], r["level"], r["confidence"]) for r in structure.position_headings(lines, ["page"]).collect()] == [(2, rows[1][2], 2, 0.6)]


def test_files_are_written_out_of_batches(spark, tmp_path):
    """A batch of long contents is never held as strings, nulls are empty files."""
    assert isinstance(DocumentFiles({"path": str(tmp_path)}).writer(spark.createDataFrame([], "name string, content string").schema, False), DataSourceArrowWriter)
    writer = BatchesWriter(str(tmp_path / "x"), False)
    long = pa.record_batch({"name": [f"f{k}" for k in range(40)] + ["none"], "content": ["é" * 500_000] * 40 + [None]})
    tracemalloc.start()
    writer.commit([writer.write(iter([long]))])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10_000_000
    found = {f.name: f.read_bytes() for f in (tmp_path / "x").rglob("*") if f.is_file()}
    assert found["f7"].decode() == "é" * 500_000 and found["none"] == b"" and len(found) == 41


def test_all_cosines_come_by_score(spark):
    """A block's rows in order of their score, which files hold in a third of the bytes; none is left out."""
    x = np.random.default_rng(5).normal(size=(60, 8))
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    found = [(r["a_id"], r["b_id"], r["score"]) for r in embedding.search(e.filter("id % 20 = 0"), e, digits=2).collect()]
    assert [s for *_, s in found] == sorted(s for *_, s in found)
    assert sorted((a, b) for a, b, _ in found) == [(a, b) for a in (0, 20, 40) for b in range(60) if a != b]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(s == pytest.approx(unit[a] @ unit[b], abs=0.0051) for a, b, s in found)


def test_packed_sheets_start_with_a_mark(spark, sf_dir, tmp_path):
    rows = spark.createDataFrame([(f"{k}-ü", k) for k in range(50)], "pair_id string, n long").coalesce(1)
    for name, more in (("plain", {}), ("packed", {"compression": "gzip", "maxRecordsPerFile": "20"})):
        path = str(tmp_path / name)
        report.write_csv_for_sheets(rows, path, **more)
        files = spark.read.format("binaryFile").load(path).select("path", F.hex(report.first_bytes(F.col("path"), F.col("content"))).alias("h")).collect()
        assert len(files) == (3 if more else 1) and all(f["h"] == "EFBBBF" and f["path"].endswith(".gz") == bool(more) for f in files)
        assert sorted(map(tuple, spark.read.csv(path, schema="pair_id string, n long", header=True, enforceSchema=True).collect())) == sorted(map(tuple, rows.collect()))
    empty = spark.createDataFrame([("a.csv", b""), ("b.csv.gz", gzip.compress(b""))], "path string, content binary")
    assert [r[0] for r in empty.select(report.first_bytes(F.col("path"), F.col("content"))).collect()] == [None, None]
    before = {f for f in Path(source_queries.shared_folder(spark).removeprefix("file://")).glob("differences-*")}
    assert registry.QUERIES["sheet_differences"](spark, sf_dir).filter("marked").count() > 0
    new = {f for f in Path(source_queries.shared_folder(spark).removeprefix("file://")).glob("differences-*")} - before
    assert new and all(f.name.endswith(".csv.gz") for d in new for f in d.glob("part-*"))
