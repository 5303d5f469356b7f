"""Findings of the fourth round, each on a small table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import kernels
from lexiloom.operators import align, pairwise
from lexiloom.plans import compare_queries, diff_queries, registry, text_queries


@pytest.fixture
def folder(spark, tmp_path):
    """Documents of about one length, with empty sentences, line ends, copies, texts of separators alone, and nulls."""
    words = "alpha beta gamma Section 2 the of and Über naïve x".split()
    rows = []
    for k in range(60):
        parts = [" ".join(words[(k * 7 + i * i + j * (k % 5 + 1)) % 11] for j in range(3 + (k + i) % 4)) for i in range(7 + k % 3)]
        parts[k % 4] = "" if k % 6 == 0 else parts[k % 4] + "\nnext <line>"
        rows.append((k, ". ".join(parts), "en" if k % 7 else "fr"))
    rows += [(60, rows[20][1], "en"), (61, None, "en"), (80, "", "en"), (100, "", "en"), (120, "one. two", None)]
    rows += [(140, ". . ", "de"), (141, "abcd", "de"), (143, "a. b", "de"), (160, "abcd", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def told(df, *columns):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


def above(df):
    """What stands above the step in which documents meet."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan[: plan.index("FlatMapCoGroupsInPandas")]


def test_steps_of_many_alignments_together():
    """F2: as those of one after the other, also where scores are equal."""
    rng = np.random.default_rng(4)
    for n in (1, 3, 9):
        scores = [rng.integers(-2, 4, (n, m)) / 10 for m in (5, 1, 12, 3)]
        at, i, j = kernels.aligned_beside(scores)
        for k, s in enumerate(scores):
            assert list(zip(i[at == k].tolist(), j[at == k].tolist())) == kernels.global_alignment(s)[1]


def test_blocks_are_dealt_by_number(spark, folder):
    """blocks of few bytes and much work are not put together into a few tasks."""
    d = text_queries.pair_documents(spark, folder, compare_queries.sentences)
    met = align.align_documents(d, counts=True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2
    many = pairwise.in_blocks(d, lambda a, b: a[["doc_id"]], "doc_id long", a_block=1, b_block=1, tasks=64)
    assert many.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_features_are_made_in_many_tasks(spark, folder):
    """a table in one file is not one task of features."""
    d = text_queries.pair_documents(spark, folder, compare_queries.sentences, spread=True)
    assert "hashpartitioning(doc_id" in d._jdf.queryExecution().executedPlan().toString()


def test_alignments_of_all_pairs_counted(spark, folder):
    """steps of all pairs of documents whatever their ids, those without sentences too, with no row
    a step and nothing shuffled but a row a task."""
    docs = [(r.doc_id, r.text, r.lang) for r in registry.read(spark, folder, "documents").collect() if r.text is not None and r.lang is not None]
    want: dict[str, list[int]] = {}
    for a, x, p in docs:
        for b, y, q in docs:
            if a != b and p == q and abs(len(x) - len(y)) * 20 <= len(x):
                left, right = ([s for s in t.split(". ") if s] for t in (x, y))
                score = kernels.text_scores(left, right) if left and right else np.zeros((len(left), len(right)))
                steps = kernels.global_alignment(score)[1] if left and right else [(i, -1) for i in range(len(left))] + [(-1, j) for j in range(len(right))]
                kinds = ["delete" if j < 0 else "insert" if i < 0 else "match" if score[i, j] >= 0.92 else "partial" if score[i, j] >= 0.75 else "replace" for i, j in steps]
                for k in set(kinds):
                    want[k] = [u + v for u, v in zip(want.get(k, [0, 0]), (kinds.count(k), 1))]
    df = registry.QUERIES["align_stats"](spark, folder)
    assert {r["alignment_type"]: [r["n"], r["n_pairs"]] for r in df.collect()} == want and len(want) >= 4
    assert "hashpartitioning" not in above(df)


def test_documents_without_sentences_are_aligned(spark, folder):
    """a text of separators alone meets others, whose sentences are insertions or deletions."""
    rows = registry.QUERIES["align_nw"](spark, folder).filter("pair_id LIKE '140-%' OR pair_id LIKE '160-140'").collect()
    assert sorted((r["pair_id"], r["ord"], r["alignment_type"]) for r in rows) == [("140-141", 0, "insert"), ("140-143", 0, "insert"), ("140-143", 1, "insert"), ("140-160", 0, "insert"), ("160-140", 0, "delete")]


def test_one_sided_where_documents_meet(spark, folder):
    """parts that one side has alone leave the task as rows; no pair, text or comparison is made for them."""
    df = registry.QUERIES["diff_one_sided"](spark, folder)
    rows = diff_queries.diffing.diffed(diff_queries.texts_aligned(spark, folder)).filter("diff.diff_type IN ('delete', 'insert')")
    html = F.md5(F.concat("diff.html_a", "diff.html_b")).alias("html_md5")
    want = rows.select("pair_id", "ord", "diff.diff_type", F.col("diff.total").alias("n_total"), F.col("diff.delete").alias("n_delete"), F.col("diff.insert").alias("n_insert"), html)
    assert df.columns == want.columns and told(df) == told(want) and df.select("diff_type").distinct().count() == 2
    assert "Exchange" not in above(df)


def test_token_similarity_where_documents_meet(spark, folder):
    """a row a pair leaves the task, and is that of the rows of alignments."""
    diffing = diff_queries.diffing
    df = registry.QUERIES["token_similarity"](spark, folder)
    want = diffing.token_similarity(diffing.token_matches(diff_queries.texts_aligned(spark, folder)), "pair_id").withColumn("similarity", F.round("similarity", 6))
    assert df.columns == want.columns and told(df) == told(want) and df.count() > 20
    assert "Exchange" not in above(df)


def test_whole_texts_where_documents_meet(spark, folder, monkeypatch):
    """texts are scored together where they meet, each pair as by itself."""
    df = registry.QUERIES["text_similarity"](spark, folder)
    p = text_queries.pairs(spark, folder)
    want = p.select("a_id", "b_id", F.round(kernels.text_similarity(F.col("a_text"), F.col("b_text")), 6).alias("score"))
    assert told(df) == told(want) and df.count() > 20
    assert "Exchange" not in above(df)
    d = text_queries.pair_documents(spark, folder, lambda c: c)
    assert told(align.text_scores_of_pairs(d, most=1).withColumn("score", F.round("score", 6))) == told(want)


def test_reports_are_written_packed(spark, folder, tmp_path, monkeypatch):
    """texts of scores are packed, and no table of them is written besides."""
    from pathlib import Path

    from lexiloom.plans import source_queries

    monkeypatch.setattr(source_queries, "place", lambda spark, name: str(tmp_path / name))
    before = set(Path(source_queries.shared_folder(spark).removeprefix("file://")).glob("scores-*"))
    scores = {r["pair_id"]: round(r["similarity"], 4) for r in registry.QUERIES["score_overall"](spark, folder).collect()}
    rows = registry.QUERIES["export_formats"](spark, folder).collect()
    assert sorted((r["format"], r["pair_id"]) for r in rows) == sorted((k, p) for k in ("csv", "json", "parquet", "sheet.csv") for p in scores)
    assert all(r["similarity"] == pytest.approx(scores[r["pair_id"]], abs=1.1e-4) for r in rows)
    assert told(registry.QUERIES["scores_json"](spark, folder)) == told(registry.QUERIES["score_sections"](spark, folder))
    files = [f.name for d in ("exports.csv", "exports.json", "exports.sheet.csv", "scores.json") for f in (tmp_path / d).glob("part-*")]
    assert files and all(f.endswith(".gz") for f in files)
    assert set(Path(source_queries.shared_folder(spark).removeprefix("file://")).glob("scores-*")) == before


def test_blocks_of_a_chapter_pair_by_array(spark, folder):
    """a pair's blocks are one row's array, so none of them is shuffled or sorted."""
    from lexiloom.operators import blocks
    from lexiloom.plans import table_queries

    df = registry.QUERIES["pair_filter"](spark, folder)
    want = blocks.of_pair(table_queries.blocks(spark, folder), "Section 1", "Section 9").select("pair_id", "ord")
    assert df.columns == want.columns and told(df) == told(want)
    assert {r["pair_id"] for r in df.filter("ord = 0").collect()} == {"80-100", "100-80", "160-141"}  # none belongs to it
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_blocks_without_texts(spark, folder):
    """what texts have of a word is told once a document, also of a word that goes on in the other text."""
    from lexiloom.operators import blocks

    texts = ["", "a tion 2 b", "xtio", "n 2", "t", "ion 2", "tion", " 2 tion ", "2", "tion 2", "n 2 t"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", "t", *blocks.marks(F.col("t"), "tion 2")).collect()
    for a in d:
        for b in d:
            if len(a["t"]) > 4 or len(b["t"]) > 4 or a["t"] + b["t"] != "":
                assert (a["has"] or b["has"] or a["begins"] & b["ends"] != 0) == ("tion 2" in a["t"] + b["t"])
    df = registry.QUERIES["block_filter_sort_limit"](spark, folder)
    t = diff_queries.texts_aligned(spark, folder).withColumn("section", F.col("ord") % 4)
    a, b, ord_ = F.length("text_a").cast("double"), F.length("text_b").cast("double"), F.col("ord")
    score = F.when(ord_ % 5 == 0, F.lit(None)).when(a.isNull() | b.isNull(), 0.0).otherwise(F.least(a, b) / F.greatest(a, b, F.lit(1.0)))
    name, html = F.concat(F.lit("Section "), F.col("section").cast("string")), F.concat(F.coalesce("text_a", F.lit("")), F.coalesce("text_b", F.lit("")))
    t = t.withColumn("score", score).withColumns({"similarity": diff_queries.scoring.alignment_score(), "title": blocks.title(F.col("alignment_type"), name, name), "html": html})
    want = blocks.ordered(blocks.search(t, "Tion 2", ["match", "partial", "replace"], 0.2, section=[0, 2]).select("pair_id", "ord", "title", "similarity"), most=200)
    assert list(map(tuple, df.collect())) == list(map(tuple, want.collect()))
    assert {r["ord"] % 4 for r in df.collect()} == {0, 2}
    assert "text" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


@pytest.mark.parametrize("name", ["blended_similarity", "diff_summary"])
def test_all_documents_are_compared(spark, folder, name):
    """pairs of all documents of a language and of about one length, whatever their ids."""
    docs = [(r.doc_id, len(r.text), r.lang) for r in registry.read(spark, folder, "documents").collect() if r.text is not None and r.lang is not None]
    want = sorted(f"{a}-{b}" for a, n, x in docs for b, m, y in docs if a != b and x == y and abs(n - m) * 20 <= n)
    df = registry.QUERIES[name](spark, folder)
    key = F.concat_ws("-", "a_id", "b_id") if "a_id" in df.columns else F.col("pair_id")
    assert sorted(r[0] for r in df.select(key).collect()) == want and any(a % 20 for a, *_ in docs)
    assert "doc_id % 20" not in registry.ORACLES[name]


def test_rows_of_reports_without_texts(spark, folder):
    """F8: what a row shows of a part is digested once a document, so pairs carry no texts."""
    t = diff_queries.texts_aligned(spark, folder).withColumn("score", F.lit(0.5))
    body_a = F.when(F.col("ord") % 3 == 0, F.left("text_a", F.lit(20))).when(F.col("ord") % 3 == 1, "")
    rows = align.projected(t.withColumns({"body_a": body_a, "body_b": F.when(F.col("ord") % 2 == 0, F.right("text_b", F.lit(5)))}))
    want = rows.select("pair_id", "ord", "alignment_type", F.md5("shown_a").alias("a_md5"), F.md5("shown_b").alias("b_md5"), "score")
    df = registry.QUERIES["alignment_rows"](spark, folder)
    assert df.columns == want.columns and told(df) == told(want) and df.count() > 100
    assert "md5(" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
