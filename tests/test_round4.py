"""Queries whose work must not grow faster than their input, and numbers and ties at their edges."""

import glob
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import align, contents, pairwise, report, scoring
from lexiloom.plans import compare_queries, registry, table_queries
from lexiloom.session import shared_folder


def test_chapter_numbers_beyond_integers(spark):
    rows = [("5551234567 is the number to call", None), ("7 up", 7), ("99999999999999999999章", None), ("第3章 Scope", 3), (None, None)]
    got = spark.createDataFrame(rows, "title string, want int").withColumn("got", contents.chapter_of_title(F.col("title"))).collect()
    assert [r.got for r in got] == [r.want for r in got]
    entries = spark.createDataFrame([(1, 1, "5551234567 is the number to call", 1, 1)], "doc long, ord long, title string, page int, level int")
    sections = spark.createDataFrame([(1, 7, 1, None, "x", 1)], "doc long, chapter int, section int, subsection int, title string, page int")
    assert contents.integrate(entries, sections).count() == 1


def test_names_meet_once(spark, tmp_path):
    """Ten parts of each name: the join takes distinct names, so its sides are as small as for one."""
    part = spark.createDataFrame([(k, 1 + k % 2, "brand", f"name {k % 3}") for k in range(60)], "p_partkey long, p_size int, p_brand string, p_type string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    pairs = compare_queries.name_pairs(spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [("name 0", "name 1"), ("name 0", "name 2"), ("name 1", "name 2")]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert below.count("Aggregate [p_size") == 2


def documents(spark, path, copies: int):
    """Documents of common lengths, every twentieth asked for."""
    rows = [(20 * c + k, "en", "s", ". ".join("x" * (3 + (k * j + c) % 7) for j in range(10 + k % 3)) + "y" * (60 - k)) for c in range(copies) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["score_overall", "score_statistics", "score_quality", "diff_totals", "diff_summary", "block_stats", "html_report"])
def test_pairs_are_not_shuffled(spark, tmp_path, name):
    """A row a pair leaves the task where its documents meet; nothing is shuffled after that."""
    df = registry.QUERIES[name](spark, documents(spark, tmp_path, 3))
    assert df.count() == df.select("pair_id").distinct().count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    top = plan[: plan.index("FlatMapCoGroupsInPandas")]
    assert "Exchange" not in top and "Join" not in top


def test_aligned_against_rows(spark, tmp_path):
    """The matrices against the operators on tables of alignments, in blocks of two and three documents."""
    path = documents(spark, tmp_path, 2)
    rows = table_queries.alignments(spark, path)
    lengths = F.transform(F.split("text", r"\. "), lambda x: F.length(x).cast("double"))
    d = registry.read(spark, path, "documents").select("doc_id", "lang", F.length("text").alias("n"), lengths.alias("v"), (F.col("doc_id") % 20 == 0).alias("asked"))
    d = d.withColumn("step", table_queries.length_step(F.col("n")))
    got = pairwise.compared(d, pairwise.statistics, pairwise.STATISTICS, a_block=2, b_block=3).withColumn("pair_id", table_queries.pair_key(F.col("a_id"), F.col("b_id"))).toPandas()
    want = scoring.statistics(rows, "pair_id").toPandas()
    got, want = (x.sort_values("pair_id", ignore_index=True) for x in (got, want))
    assert len(got) == len(want) > 5
    for c in want.columns.drop("pair_id"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=2e-6)


def test_shown_per_cent(spark):
    """Rounded as numbers: 1.005 * 100 is below the half, 0.125 * 100 is the half."""
    rows = spark.createDataFrame([(1.005, "1.00"), (0.125, "0.13"), (80.0, "80.00"), (2.675, "2.68")], "x double, want string")
    assert [r.got for r in rows.select(report.per_cent(F.col("x")).alias("got")).collect()] == ["1.00", "0.13", "80.00", "2.68"]


def test_distribution_by_exact_scores(spark, tmp_path, monkeypatch):
    """What is above a bound by less than its rounding is above it."""
    some = spark.createDataFrame([("p", 0, 80.0000001, 1), ("p", 1, 80.0, 1), ("p", 2, 40.0000001, 1)], "pair_id string, section long, similarity double, n long")
    cut = lambda spark, sf, digits=6: some if digits is None else some.withColumn("similarity", F.round("similarity", digits))
    monkeypatch.setattr(table_queries, "section_scores", cut)
    assert {r.bucket: r.n for r in registry.QUERIES["report_distribution"](spark, "").collect()} == {"high": 1, "medium": 2}


def test_blocks_searched_without_joins(spark, sf_dir):
    """Blocks and their texts come from one row a pair: documents meet once, and no rows are joined."""
    plan = registry.QUERIES["block_filter_sort_limit"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_shared_counts():
    """Sets in blocks, an empty one and some with elements of one side only, however few at a time."""
    import pandas as pd

    rng = np.random.default_rng(3)
    sets = [[str(x) for x in rng.choice(40, size=n, replace=False)] for n in (0, 1, 5, 30, 12, 40, 7)]
    left, right = pd.Series(sets[:4]), pd.Series(sets[4:])
    want = [[len(set(a) & set(b)) for b in right] for a in left]
    for most in (1, 7, 8192):
        assert pairwise.shared_counts(left, right, most).tolist() == want


@pytest.mark.parametrize("name", ["jaccard_words", "jaccard_chars", "overlap_coef", "blended_similarity"])
def test_sets_meet_in_blocks(spark, sf_dir, name):
    """Pairs are made in blocks by a product of matrices, not by a join that carries both sets."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "FlatMapCoGroupsInPandas" in plan


@pytest.mark.parametrize("most,strict", [(1, False), (2, True), (5, False)])
def test_greedy_by_cosine_in_rounds(spark, most, strict):
    """Short lists, so that many i go into later rounds, with ties and equal vectors; against all scores."""
    rng = np.random.default_rng(most)
    rows = [("xy"[k % 2], k, [float(v) for v in rng.integers(-1, 3, 3)]) for k in range(80)]
    df = spark.createDataFrame(rows, "key string, id long, v array<double>")
    a = df.filter("id % 4 < 2").selectExpr("key", "id AS i", "v AS x")
    b = df.filter("id % 4 >= 2").selectExpr("key", "id AS j", "v AS y")
    got = {(r.key, r.i): (r.j, r.score) for r in align.assign_greedy_by_cosine(a, b, "key", 0.2, strict, 2, most).collect()}
    cos = lambda x, y: 0.0 if not np.any(x) or not np.any(y) else round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 2)
    want = {}
    for key in "xy":
        used = set()
        for _, i, x in (r for r in rows if r[0] == key and r[1] % 4 < 2):
            free = [(-cos(x, y), j) for k, j, y in rows if k == key and j % 4 >= 2 and j not in used and (cos(x, y) > 0.2 if strict else cos(x, y) >= 0.2)]
            if free:
                s, j = min(free)
                used.add(j)
                want[key, i] = (j, -s)
    assert got == want


@pytest.mark.parametrize("name", ["mappings_ranked", "section_full_map"])
def test_best_pairs_leave_their_blocks(spark, sf_dir, name):
    """No row a pair of vectors: only the best of a block reach the window."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_replay_in_many_files(spark, sf_dir):
    """No task writes or reads all chunks: a step is several files, a document's part of it one of them."""
    tag = f"replay-{uuid.uuid4().hex}"
    chunks = compare_queries.chunk_table(spark, sf_dir)
    compare_queries.replayed(spark, chunks, tag, *compare_queries.IN_TURN[:1])
    folder = glob.glob(f"{shared_folder(spark).removeprefix('file://')}/{tag}*")[0]
    back = spark.read.parquet(folder).select("doc_id", F.input_file_name().alias("file")).distinct()
    assert back.select("file").distinct().count() > 1
    assert back.count() == back.select("doc_id").distinct().count()
