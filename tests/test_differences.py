"""Differences, token shares, blended alignment, blocks, settings and caches against plain versions."""

import difflib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import config
from lexiloom.functions import kernels
from lexiloom.operators import align, blocks, diffing, embedding
from lexiloom.plans import registry
from lexiloom.sources import cache, readers

ROWS = [
    (1, 0, "match", "one two  three", "one two  three"),
    (1, 1, "partial", "a b c d <e>", "a b x d <e>"),
    (1, 2, "delete", "gone & away", None),
    (1, 3, "insert", None, "new line\nof two"),
    (1, 4, "replace", "", "only b"),
    (1, 5, "match", "only a", ""),
    (1, 6, "replace", None, ""),
    (1, 7, "strange", "x", "y"),
    (2, 0, "replace", "alpha beta", "gamma delta"),
]
KIND = "pair_id long, ord int, alignment_type string, text_a string, text_b string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3)


def test_differences_by_type(rows):
    out = {(r["pair_id"], r["ord"]): r["diff"] for r in diffing.diffed(rows).collect()}
    assert len(out) == len(ROWS)
    assert [out[1, k]["diff_type"] for k in range(8)] == ["comparison", "comparison", "delete", "insert", "insert", "delete", "empty", "empty"]
    assert out[1, 2]["html_a"] == '<span class="delete">gone &amp; away</span>' and out[1, 2]["html_b"] == ""
    assert (out[1, 2]["total"], out[1, 2]["delete"], out[1, 3]["insert"], out[1, 6]["total"]) == (3, 3, 4, 0)
    assert out[1, 0]["similarity"] == 1.0 and out[1, 3]["similarity"] == 0.0
    left, right, counts = kernels.marked(kernels.split_tokens(ROWS[1][3], "word"), kernels.split_tokens(ROWS[1][4], "word"))
    assert (out[1, 1]["html_a"], out[1, 1]["html_b"]) == (left, right)
    assert out[1, 1]["similarity"] == counts["match"] / counts["total"]


def test_unified_text(rows):
    out = {r["pair_id"]: r["unified"].split("\n") for r in diffing.unified(rows, "pair_id").collect()}
    assert out[2] == ["--- Document A", "+++ Document B", "-alpha beta", "+gamma delta"]
    assert out[1][2:] == [" one two  three", "-a b c d <e>", "+a b x d <e>", "-gone & away", "+new line", "+of two", "-", "+only b", " only a", "-", "+"]


@pytest.mark.parametrize("by", ["word", "character", "sentence", "paragraph"])
def test_token_shares(rows, by):
    cut = {
        "word": str.split,
        "character": list,
        "sentence": lambda t: [s.strip() for s in re.split(r"[.!?]+", t) if s.strip()],
        "paragraph": lambda t: [p.strip() for p in t.split("\n\n") if p.strip()],
    }[by]
    total = match = 0
    for *_, a, b in ROWS:
        x, y = cut(a or ""), cut(b or "")
        total += len(x) + len(y)
        match += sum(2 * (i2 - i1) for t, i1, i2, _, _ in difflib.SequenceMatcher(None, x, y).get_opcodes() if t == "equal")
    told = diffing.token_matches(rows, by=by)
    r = diffing.token_similarity(told).first()
    assert (r["n_match"], r["n_total"]) == (match, total) and r["similarity"] == pytest.approx(100 * match / total)
    assert {x["pair_id"] for x in diffing.token_similarity(told, "pair_id").collect()} == {1, 2}
    assert diffing.token_similarity(told.limit(0)).first()["similarity"] == 0.0


def test_blended_alignment(spark):
    rng = np.random.default_rng(3)
    x, y = ["one two", "three four", "five"], ["one two!", "five", "six"]
    va, vb = rng.standard_normal((3, 8)), rng.standard_normal((3, 8))
    df = spark.createDataFrame([(1, x, y, va.tolist(), vb.tolist()), (2, [], ["a"], [], [[1.0]]), (3, ["b"], [], [[1.0]], [])], "k long, a array<string>, b array<string>, va array<array<double>>, vb array<array<double>>")
    out = align.align_texts(df, "k", "a", "b", vectors=("va", "vb")).collect()
    cos = (va / np.linalg.norm(va, axis=1)[:, None]) @ (vb / np.linalg.norm(vb, axis=1)[:, None]).T
    score = 0.7 * cos + 0.3 * np.array([[kernels.text_score(p, q) for q in y] for p in x])
    _, steps = kernels.global_alignment(score, -0.15)
    got = sorted(((r["ord"], r["i"], r["j"], r["align_score"]) for r in out if r["k"] == 1))
    assert [(i if i is not None else -1, j if j is not None else -1) for _, i, j, _ in got] == steps
    assert all(s == pytest.approx(score[i, j]) for _, i, j, s in got if i is not None and j is not None)
    assert [r["alignment_type"] for r in out if r["k"] == 2] == ["insert"] and [r["alignment_type"] for r in out if r["k"] == 3] == ["delete"]


def test_block_search(spark):
    df = spark.createDataFrame([(1, 0, "A ↔ B", "some <b>Text</b>", "match", 0.9), (1, 1, "C (deleted)", "text", "delete", 0.0), (2, 0, "D", "", "partial", 0.5)], "pair_id long, ord int, title string, html string, alignment_type string, similarity double")
    found = lambda d: sorted((r["pair_id"], r["ord"]) for r in d.collect())
    assert found(blocks.search(df, "TEXT")) == [(1, 0), (1, 1)]
    assert found(blocks.search(df, "text", least=0.1)) == [(1, 0)] and found(blocks.search(df, "↔")) == [(1, 0)]
    assert found(blocks.search(df, types=["delete", "partial"], title=["D"])) == [(2, 0)]
    assert [r["ord"] for r in blocks.ordered(df, falling=False, most=2).collect()] == [1, 0]
    assert found(blocks.of_pair(df, "A", "B")) == [(1, 0), (2, 0)]


def test_chapter_chunks(spark, sf_dir):
    from lexiloom.operators import contents, structure
    from lexiloom.plans.book_queries import book

    b = book(spark, sf_dir).cache()
    chapters = structure.valid_sequence(structure.numbered(b), ["doc"])
    lines = {}
    for r in b.collect():
        lines.setdefault(r["doc"], {}).setdefault(r["page"], []).append((r["line_no"], r["line"]))
    ranged = {(r["doc"], r["numbering"]): (r["page"], max(r["page"], r["page_end"])) for r in contents.chapter_ranges(chapters, b).collect()}
    found = {}
    for r in contents.chapter_chunks(chapters, b, 100, 0).orderBy("chunk_index").collect():
        found.setdefault((r["doc"], r["numbering"]), []).append(r["text"])
    for key, (start, end) in ranged.items():
        text = "\n\n".join("\n".join(x for _, x in sorted(p)) for n, p in sorted(lines[key[0]].items()) if start <= n <= end)
        sentences = [s for s in (x.strip() for x in re.split(r"[.!?。！？]+(?:\s+|$)", text)) if len(s) > 10]
        chunks, cur, n = [], [], 0
        for s in sentences:
            t = max(1, len(s) // 4)
            if n + t > 100 and cur:
                chunks.append(" ".join(cur))
                cur, n = [], 0
            cur.append(s)
            n += t
        assert found.get(key, []) == chunks + ([" ".join(cur)] if cur else []), key


def test_combined_headings(spark, sf_dir):
    out = registry.QUERIES["headings_combined"](spark, sf_dir).collect()
    assert all(2 <= len(r["text"]) <= 200 and r["confidence"] >= 0.4 for r in out)
    for page in {r["page"] for r in out}:
        own = sorted((r["place"], r["confidence"], r["text"]) for r in out if r["page"] == page)
        assert [c for _, c, _ in own] == sorted((c for _, c, _ in own), reverse=True)
        assert len({t for *_, t in own}) == len(own)


def test_settings(tmp_path):
    assert config.load([], {}) == config.Settings()
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"max_tokens": 400, "exact": "0.9", "remove_patterns": ["^x"], "unknown": 1}))
    found = config.load([str(tmp_path / "none.json"), str(file)], {"LEXILOOM_OVERLAP": "7", "LEXILOOM_SENTENCE_SPLIT": "no", "LEXILOOM_MAX_TOKENS": "300"})
    assert (found.max_tokens, found.exact, found.remove_patterns, found.overlap, found.sentence_split) == (300, 0.9, ("^x",), 7, False)


def test_cache_makes_each_content_once(spark, tmp_path):
    made = []

    def make(missing):
        made.append(sorted("-" if r["text"] is None else r["text"] for r in missing.collect()))
        return missing.select("content_hash", F.length("text").alias("n"))

    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None), (5, "")], "id long, text string")
    for part in (df.filter("id <= 2"), df, df):
        out = {r["id"]: r["n"] for r in cache.through(part, ["text"], str(tmp_path / "c"), make, "content_hash string, n int").collect()}
    assert made == [["aa"], ["", "-", "b"], []]
    assert out == {1: 2, 2: 2, 3: 1, 4: None, 5: 0}
    assert embedding.provider(None, lambda: 1 / 0, lambda: lambda texts: [[1.0] for _ in texts]) is not None
    assert embedding.provider(lambda: 1 / 0) is None


def test_engines_in_turn(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, content in (("a.txt", b"one\x0ctwo"), ("b.bin", b"\xff\xfe"), ("c.bin", b"\xff\xff")):
        (tmp_path / "f" / name).write_bytes(content)

    def ocr(content, page):
        if page > 2:
            raise IndexError
        if content == b"\xff\xff" and page == 2:
            raise ValueError
        return "seen " * page

    out = {(r["path"][-5:], r["page"]): (r["text"], r["extraction_method"]) for r in readers.read_documents(spark, str(tmp_path / "f"), {"none": lambda c: 1 / 0, "text": readers._as_text}, ocr, least=3).collect()}
    assert out == {("a.txt", 1): ("one", "text"), ("a.txt", 2): ("two", "text"), ("b.bin", 1): ("seen ", "ocr"), ("b.bin", 2): ("seen seen ", "ocr"), ("c.bin", 1): ("seen ", "ocr"), ("c.bin", 2): ("", "ocr_failed")}
    none = readers.read_documents(spark, str(tmp_path / "f" / "b.bin"), {"none": lambda c: 1 / 0}).collect()
    assert [(r["text"], r["extraction_method"]) for r in none] == [("", "failed")]
