"""Queries against brute force over the whole of what they stand for."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import kernels
from lexiloom.operators import align, chunking
from lexiloom.plans import registry


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_document_pairs(spark, sf_dir):
    """The documents of the stated set against all others, in both directions."""
    docs = {r["doc_id"]: (r["lang"], len(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(a, b) for a, (x, n) in docs.items() if a % 20 == 0 for b, (y, m) in docs.items() if a != b and x == y and abs(n - m) * 20 <= n}
    assert {(r["a_id"], r["b_id"]) for r in registry.QUERIES["jaccard_words"](spark, sf_dir).collect()} == want
    assert any(a > b for a, b in want) and any(a < b for a, b in want)
    keys = {r["pair_id"] for r in registry.QUERIES["score_overall"](spark, sf_dir).collect()}
    assert keys == {f"{a}-{b}" for a, b in want}


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return {r["vec_id"]: (r["label"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}


def test_vector_search_against_all_rows(spark, sf_dir, vectors):
    unit = {k: v / np.linalg.norm(v) for k, (_, v) in vectors.items()}
    want = {(a, b): unit[a] @ unit[b] for a in unit if a % 20 == 0 for b in unit if a != b}
    found = {(r["a_id"], r["b_id"]): r["score"] for r in registry.QUERIES["cosine_pairs"](spark, sf_dir).collect()}
    assert found == pytest.approx(want, abs=1e-5)
    near = {}
    for r in registry.QUERIES["cosine_topk"](spark, sf_dir).collect():
        near.setdefault(r["a_id"], []).append((-r["score"], r["b_id"]))
    assert {a: sorted(x) for a, x in near.items()} == {a: sorted((-found[a, b], b) for b in unit if b != a)[:5] for a in unit if a % 20 == 0}


def test_optimal_assignment_takes_all_vectors(spark, sf_dir):
    rows = registry.QUERIES["assign_optimal"](spark, sf_dir).collect()
    used = [r["i"] for r in rows] + [r["j"] for r in rows]
    assert len(used) == len(set(used)) and all(r["i"] % 2 == 0 and r["j"] % 2 == 1 for r in rows)
    assert {x % 10 for x in used} == set(range(10))
    greedy = registry.QUERIES["assign_greedy"](spark, sf_dir).collect()
    assert sum(r["score"] for r in rows) >= sum(r["score"] for r in greedy)


def test_whole_texts_of_all_near_copies_are_diffed(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    words = {k: v.split() for k, v in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items() if w}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    ops = {}
    for r in registry.QUERIES["diff_opcodes"](spark, sf_dir).collect():
        ops.setdefault((r["a_id"], r["b_id"]), []).append((r["ord"], r["i1"], r["i2"], r["j1"], r["j2"]))
    assert set(ops) == want and any("\n" in texts[a] for a, _ in want)
    for (a, b), x in ops.items():
        _, _, i2, _, j2 = max(x)
        assert (i2, j2) == (len(kernels.split_tokens(texts[a], "word")), len(kernels.split_tokens(texts[b], "word")))


def test_all_headings_are_titles(spark, tmp_path):
    from lexiloom.plans.compare_queries import heading_sides

    long = "a long heading " * 20
    html = f'<h1>ab</h1><p>no heading at all</p><h2 class="x">{long}</h2><h3>third level</h3><h6>x</h6>'
    spark.createDataFrame([(2, "u", html), (3, "v", "<h4>other side</h4>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    a, b = heading_sides(spark, str(tmp_path))
    assert rows(a, "pair_id", "ord", "title") == [(1, 0, "ab"), (1, 1, long.strip()), (1, 2, "third level"), (1, 3, "x")]
    assert rows(b, "pair_id", "ord", "title") == [(1, 0, "other side")]
    assert registry.QUERIES["title_similarity"](spark, str(tmp_path)).count() == 4


def plain_packing(parts, limit):
    chunks, cur, n = [], [], 0
    for x in parts:
        t = max(1, len(x) // 4)
        if n + t > limit and cur:
            chunks.append(" ".join(cur))
            cur, n = [], 0
        cur.append(x)
        n += t
    return chunks + ([" ".join(cur)] if cur else [])


def test_chunk_paragraphs(spark, sf_dir):
    found = {r["doc_id"]: (r["n_chunks"], r["chunks_md5"]) for r in registry.QUERIES["chunk_paragraphs"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        chunks, cur, n = [], [], 0
        for x in (p.strip(" ") for p in r["text"].split("\n")):
            t = max(1, len(x) // 4)
            if not x:
                continue
            if t > 200 or (n + t > 200 and cur):
                chunks += ["\n".join(cur)] if cur else []
                cur, n = [], 0
            if t > 200:
                sentences = [s.strip() for s in re.split(r"[.!?。！？]+(?:\s+|$)", x)]
                chunks += plain_packing([s for s in sentences if len(s) > 10], 200)
            else:
                cur.append(x)
                n += t
        chunks += ["\n".join(cur)] if cur else []
        assert found[r["doc_id"]] == (len(chunks), hashlib.md5("|".join(chunks).encode()).hexdigest())


def test_long_paragraphs_are_split(spark):
    short, first, second = "x" * 40, "a" * 500, "b" * 450
    long = f"{first}. {second}! tiny. {'c' * 40}."
    parts = spark.createDataFrame([([short, long, short, short],), ([short, short],), ([long],)], "p array<string>")
    found = [r["c"] for r in parts.select(chunking.pack_paragraphs(F.col("p"), 200).alias("c")).collect()]
    split = [first, f"{second} {'c' * 40}"]
    assert found == [[short, *split, f"{short}\n{short}"], [f"{short}\n{short}"], split]


def test_alignment_scores_words_and_letters(spark):
    pairs = spark.createDataFrame([(1, ["alpha beta gamma delta"], ["delta gamma beta alpha"]), (2, ["one two three four five sixth"], ["one two three four five sixty"])], "k long, x array<string>, y array<string>")
    found = {r["k"]: (r["alignment_type"], r["align_score"]) for r in align.align_texts(pairs, "k", "x", "y").collect()}
    for r in pairs.collect():
        assert found[r["k"]][1] == pytest.approx(kernels.text_score(r["x"][0], r["y"][0]))
    assert found[1][0] != "match" and found[1][1] < 0.92
    assert found[2][0] == "partial"
