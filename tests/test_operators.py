"""Invariants and edge cases of the operators, with the decisions on known oddities by number."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import align, chunking, report, scoring, structure
from lexiloom.sources import readers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_token_estimate(spark):
    assert [one(spark, "x" * n, T.token_estimate) for n in (0, 3, 4, 3200)] == [1, 1, 1, 800]


def test_cleaning_keeps_sentence_ends(spark):  # X5
    assert one(spark, "  一つ。 二つ、\n\n a  b§ ", T.clean_text) == "一つ。 二つ、\na b"


def test_packing(spark):
    parts = ["x" * 32, "y" * 16, "z" * 48, "w" * 8]
    row = spark.createDataFrame([(parts,)], "p array<string>").select(chunking.pack(F.col("p"), 12).alias("c")).first()["c"]
    assert [c.split(" ") for c in row] == [parts[:2], [parts[2]], [parts[3]]]


def test_longest_number_first(spark):  # X1, X2
    rows = [(1, 1, i, x) for i, x in enumerate(["1.1.1. Foo bar", "3-2-1. Xyz", "2-3. Two", "1.12", "2024 report of it", "4.2. Four"])]
    out = structure.numbered(spark.createDataFrame(rows, "doc int, page int, line_no int, line string")).collect()
    assert {r["line"]: (r["chapter"], r["section"], r["subsection"]) for r in out if r["chapter"] <= 50} == {
        "1.1.1. Foo bar": (1, 1, 1),
        "3-2-1. Xyz": (3, 2, 1),
        "2-3. Two": (2, 3, None),
        "4.2. Four": (4, 2, None),
    }


def test_sections_by_chapter(spark):
    """Four chapters with 2, 4, 4 and 3 sections, one of them with two subsections."""
    lines = ["1-1. Alpha", "1-2. Beta", "2-1. Gamma", "2.2. Delta", "2-3. Epsilon", "2-4. Zeta", "3-1. Eta", "3-2. Theta", "3-2-1. Iota", "3-2-2. Kappa", "4-1. Mu", "4.2. Nu", "4-3. Xi"]
    rows = [(1, 1, i, x) for i, x in enumerate(lines)]
    out = structure.valid_sequence(structure.numbered(spark.createDataFrame(rows, "doc int, page int, line_no int, line string")), ["doc"])
    assert {r["chapter"]: r["n"] for r in out.groupBy("chapter").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 4, 3: 4, 4: 3}


def test_pages_are_parted_before_cleaning(spark):  # X4
    out = readers.pages_from_text(spark.createDataFrame([(1, "a\fb\fc")], "doc int, text string"))
    assert [(r["page"], r["text"]) for r in out.orderBy("page").collect()] == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("jump, levels", [(2, [1, 3, 2]), (1, [1, 2, 2])])
def test_level_clamp(spark, jump, levels):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 4), (1, 3, 2)], "doc int, ord int, level int")
    assert [r["level"] for r in structure.clamp_levels(rows, ["doc"], jump).orderBy("ord").collect()] == levels


def test_weighted_score(spark):
    kind = "pair_id int, alignment_type string, score double, len_a int, len_b int"
    rows = spark.createDataFrame([(1, "match", 1.0, 100, 100), (1, "delete", 0.0, 100, 0), (2, "insert", 0.0, 0, 0)], kind)
    assert {r["pair_id"]: r["similarity"] for r in scoring.overall(rows, "pair_id").collect()} == {1: 50.0, 2: 0.0}


def test_greedy_and_optimal(spark):  # X7: both keep scores at the threshold
    rows = [(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.85), (1, 1, 1, 0.1), (1, 2, 2, 0.5)]
    scores = spark.createDataFrame(rows, "pair_id int, i long, j long, score double")
    greedy = {(r["i"], r["j"]) for r in align.assign_greedy(scores, "pair_id", 0.5).collect()}
    best = {(r["i"], r["j"]) for r in align.assign_optimal(scores, "pair_id", 0.5).collect()}
    assert greedy == {(0, 0), (2, 2)}
    assert best == {(0, 1), (1, 0), (2, 2)}


def test_alignment_is_monotone(spark, sf_dir):
    from lexiloom.plans import registry

    rows = registry.QUERIES["align_nw"](spark, sf_dir).orderBy("pair_id", "ord").collect()
    assert rows
    for side in "ij":
        seen = {}
        for r in rows:
            if r[side] is not None:
                assert r[side] > seen.get(r["pair_id"], -1)
                seen[r["pair_id"]] = r[side]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert report.export(df, str(tmp_path / "out"), ["csv", "json", "docx"]) == {"csv": True, "json": True, "docx": False}
    assert spark.read.json(str(tmp_path / "out.json")).collect()[0]["s"] == "a"


def test_stream_and_table_agree(spark, sf_dir, tmp_path):
    from lexiloom.streaming.windows import run_once, windowed_counts

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = tmp_path / "events"
    table.write.parquet(str(source))
    stream = windowed_counts(spark.readStream.schema(table.schema).parquet(str(source)))
    run_once(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = {(r["start"], r["event_type"]): r["n"] for r in windowed_counts(table).collect()}
    found = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found and all(want[k] == n for k, n in found.items())


def test_both_ways_to_align_agree(spark):
    kind = "pair_id long, x array<string>, y array<string>"
    pairs = spark.createDataFrame([(1, ["a b", "c d", "e"], ["c d", "e f g", "h"]), (2, ["only one"], ["another"])], kind)
    x = pairs.select("pair_id", F.posexplode("x").alias("i", "s"))
    y = pairs.select("pair_id", F.posexplode("y").alias("j", "t"))
    scores = x.join(y, "pair_id").select("pair_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), T.jaccard(T.word_set(F.col("s")), T.word_set(F.col("t"))).alias("score"))
    one = align.align(scores, "pair_id").orderBy("pair_id", "ord").collect()
    two = align.align_texts(pairs, "pair_id", "x", "y").orderBy("pair_id", "ord").collect()
    assert [(r["i"], r["j"], r["alignment_type"]) for r in one] == [(r["i"], r["j"], r["alignment_type"]) for r in two]


def test_chapters_of_the_fixture(spark):
    """Sections by chapter, longest patterns first; chapters that only their sections tell of."""
    from lexiloom.operators import contents

    lines = ["1-1. Aims", "1-2. Scope", "2-1. Way", "2-2. Means", "2-3. Ends", "2-4. Rest", "3-1. Items", "3-2. More", "3-2-1. First", "3-2-2. Second", "4-1. Last", "4-2. Very last", "4-3. End of it"]
    df = spark.createDataFrame([(1, 1 + k // 4, k % 4 + 1, x) for k, x in enumerate(lines)], "doc long, page int, line_no int, line string")
    n = structure.valid_sequence(structure.numbered(df), ["doc"])
    counts = {r["chapter"]: r["n"] for r in n.groupBy("chapter").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 2, 2: 4, 3: 4, 4: 3}
    h = n.select("doc", (F.col("page") * 8 + F.col("line_no")).alias("ord"), "numbering", "title", "page")
    tree = {r["chapter"]: r for r in contents.hierarchy(h).collect()}
    assert {k: (r["n_sections"], r["n_subsections"], r["is_virtual"]) for k, r in tree.items()} == {"1": (2, 0, True), "2": (4, 0, True), "3": (2, 2, True), "4": (3, 0, True)}
    assert tree["1"]["title"] == "第1章 Aims..."
    pairs = {(r["parent"], r["child"]) for r in contents.children(h).collect()}
    assert pairs == {("3-2", "3-2-1"), ("3-2", "3-2-2")}


def test_pattern_cascade(spark):
    df = spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(["1-1. Aims", "2-1. Way", "3-2-1. First", "3-2-2. Second", "4.2. Dots"])], "doc long, page int, line_no int, line string")
    found = [tuple(x for x in (r["chapter"], r["section"], r["subsection"]) if x is not None) for r in structure.numbered(df).orderBy("line_no").collect()]
    assert found == [(1, 1), (2, 1), (3, 2, 1), (3, 2, 2), (4, 2)]


def test_trees_of_any_depth(spark):
    levels = [1, 3, 9, 12, 9, 2, 7, 1, 8, 8]
    df = spark.createDataFrame([(1, k, v, k // 2 + 1, 6) for k, v in enumerate(levels)], "doc int, ord int, level int, page int, last_page int")
    parent = {r["ord"]: r["parent"] for r in structure.parents(df, ["doc"]).collect()}
    end = {r["ord"]: r["page_end"] for r in structure.intervals(df).collect()}
    for k, v in enumerate(levels):
        assert parent[k] == max((i for i in range(k) if levels[i] < v), default=None)
        following = next((i for i in range(k + 1, len(levels)) if levels[i] <= v), None)
        assert end[k] == max(k // 2 + 1, following // 2 if following is not None else 6)


def test_levels_and_membership(spark):
    from lexiloom.operators import contents

    want = {"": 1, "1": 1, "20": 1, "21": 2, "1-1": 2, "1.1": 2, "1.1.": 2, "1-1-1": 3, "1.2.3": 3, "1-2.3": 2, "A": 1}
    rows = spark.createDataFrame([(x,) for x in want], "n string").select("n", contents.level_of(F.col("n")).alias("level")).collect()
    assert {r["n"]: r["level"] for r in rows} == want
    cases = {("1-1-1", "1-1"): True, ("1-2-1", "1-1"): False, ("1.1.1", "1.1"): True, ("1.1.1", "1-1"): False, ("1-1", "1-1"): False, ("", "1"): False}
    out = spark.createDataFrame(list(cases), "c string, p string").select("c", "p", contents.belongs(F.col("c"), F.col("p")).alias("x"), contents.belongs(F.col("c"), F.col("p"), empty=True).alias("y")).collect()
    assert {(r["c"], r["p"]): r["x"] for r in out} == cases and all(r["y"] for r in out if not r["c"])


def test_fuzzy_lines(spark):
    from lexiloom.operators import contents

    lines = spark.createDataFrame([(1, 3, 1, "Other words"), (1, 3, 2, "The SCOPE of: the work!"), (1, 3, 3, "scope of the work again"), (1, 4, 1, "one two three four five six seven eight")], "doc long, page int, line_no int, line string")
    marks = spark.createDataFrame([(1, 1, "scope of the work", 3), (1, 2, "two three four five six seven eight nine", 4), (1, 3, "nothing", 3)], "doc long, ord int, title string, page int")
    out = {r["ord"]: (r["line_no"], r["text_match"]) for r in contents.with_heading_text(marks, lines).collect()}
    assert out == {1: (2, 0.9), 2: (1, 0.9), 3: (None, None)}
    heads = spark.createDataFrame([(1, 2, "scope of work here", 0.5), (1, 3, "scope", 0.9), (1, 5, "scope of the work", 1.0)], "doc long, page int, text string, confidence double")
    kept = contents.supplementary(heads, marks.filter("ord = 1")).collect()
    assert [(r["page"], r["confidence"]) for r in kept] == [(2, 0.4), (5, 0.8)] or [(r["page"], r["confidence"]) for r in kept] == [(5, 0.8), (2, 0.4)]
