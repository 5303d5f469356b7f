"""Spelling variants, hard negatives and exact dedup against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import exact_dedup, hard_negatives, spelling
from lexiloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, word string, n long, maybe string, place int, root string, band int"


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "m", 2, "r", 3) for i, t in rows], DOCS).repartition(5)


# 11 Spelling variants ---------------------------------------------------------------------------


def plain_words(rows, damage):
    count = Counter()
    for i, text in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(y) + 32) if "A" <= y <= "Z" else y for y in x)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def apart_by_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(words):
    out = {}
    form = {}
    near = {w: [x for x in words if apart_by_one(w, x)] for w in words}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(11)
    base = ["letters", "banana", "années", "größe", "wonder", "aaaaa", "across", "ÀÉÎÕÜ", "strasse"]
    words = []
    for w in base:
        words += [w] * 40
        for _ in range(25):
            v = list(w)
            for _ in range(rng.choice((1, 1, 2, 3))):
                at = rng.randrange(len(v))
                rng.choice((lambda: v.pop(at), lambda: v.insert(at, rng.choice("abestüÿ")), lambda: v.__setitem__(at, rng.choice("abestüÿ"))))()
            words += ["".join(v)] * rng.choice((1, 3, 4, 9, 19, 20))
    words += ["kindlings"] * 5 + ["kindling"] * 12 + ["kindlin"] * 30
    words += ["x" * 3000] * 9 + ["x" * 3001] * 4 + ["Banana", "LETTERS", "ban4na", "ábcdef", "naïve×÷ÿ"] * 3
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return [*rows, rows[3], rows[3], (None, rows[5][1]), (7, rows[8][1]), (41, None), (42, ""), (43, " 12 \n.."), (None, None), (44, "banana-banan,banana")]


@pytest.mark.parametrize("damage,block", [(None, 4096), (97, 4096), (3, 7)])
def test_variants_are_those_of_all_pairs(spark, spelled, damage, block):
    """Damaged or not, in one block or in many."""
    out = spelling.variants(table(spark, spelled), damage=damage, block=block).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}
    want = plain_variants(plain_words(spelled, damage))
    assert len(out) == len(got) and got == want
    if damage != 3:
        assert got["kindlings"][:2] == ("kindling", "kindlin")  # a chain of two


def test_variants_of_nothing(spark, nothing):
    assert spelling.variants(nothing, damage=97).collect() == []
    assert spelling.variants(table(spark, [(1, None), (2, ""), (3, "four four four four")])).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(nothing, ratio=1)


def test_one_edit_flips_two_bits_at_most():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    for _ in range(500):
        a = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        b = list(a)
        at = rng.randrange(len(b))
        if rng.random() < 0.5:
            b[at] = rng.choice(letters)
        else:
            b.insert(at, rng.choice(letters))
        x, y = spelling.masks(["".join(a), "".join(b)])
        assert np.bitwise_count(x ^ y) <= 2
        assert any((int(x) ^ int(y)) & band == 0 for band in spelling.BAND)


def test_variants_query_on_given_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = plain_words(rows, 97)
    got = {r["word"]: r for r in QUERIES["op11_spelling_variants"](spark, sf_dir).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    by_less = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_less.setdefault(v, []).append(w)
    near = {w: set() for w in words}
    for some in by_less.values():
        for i, a in enumerate(some):
            for b in some[:i]:
                if apart_by_one(a, b):
                    near[a].add(b)
                    near[b].add(a)
    for w, r in got.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * words[w] else None
        assert (r["n_near"], r["form"], r["form_n"]) == (len(near[w]), form, words.get(form))
        root = w
        while got[root]["form"]:
            root = got[root]["form"]
        assert r["root"] == root


# 12 Hard negatives ------------------------------------------------------------------------------


VECTORS = "vec_id long, embedding array<double>, label int, query long, top double, row int, block string, vec string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, 0.5, 2, "b", "v") for i, v, k in rows], VECTORS).repartition(6)


def plain_negatives(rows, every):
    good = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)]

    def first(x):
        return (-x[0], x[1] is None, x[1] or 0)

    out = Counter()
    for a, (ai, av, al) in enumerate(good):
        if ai is None or ai % every:
            continue
        scored = [(float(av @ v), i, k) for b, (i, v, k) in enumerate(good) if b != a and len(v) == len(av)]
        for s, i, _ in sorted((x for x in scored if x[2] == al), key=first)[:5]:
            some = sorted((x for x in scored if x[2] != al and 80 * s <= 100 * x[0] <= 100 * s), key=first)[:5]
            for rank, (t, j, _) in enumerate(some, 1):
                out[(ai, i, rank, j, int(s), int(t))] += 1
    return out


def asked(spark, rows, every=5, **options):
    from pyspark.sql import functions as F

    out = hard_negatives.mine(vectors(spark, rows), anchor=F.col("vec_id") % every == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in out.collect())


def some_vectors(n, seed, spread=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8)) * 40
    return [(i, [float(np.floor(x)) for x in centres[rng.integers(6)] + rng.standard_normal(8) * spread], int(rng.integers(3))) for i in range(n)]


def test_negatives_are_those_of_all_pairs(spark):
    """Blocks of 16 rows: some 40 blocks, so that searches take several rounds."""
    rows = some_vectors(600, 1)
    want = plain_negatives(rows, 5)
    assert len(want) > 500
    assert asked(spark, rows, block=16) == want


def test_negatives_edges(spark):
    """Nulls, non-finite components, zero vectors, other lengths, shared ids, ties, a third of the rows alike."""
    rows = some_vectors(90, 2)
    rows += [(100 + i, [30.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(45)]
    rows += [(None, rows[3][1], 1), (None, rows[4][1], 2), (200, None, 1), (205, [], 1), (210, [1.0, None], 0), (215, [float("nan")] * 8, 1), (220, [float("inf")] * 8, 1)]
    rows += [(225, rows[5][1], None), (230, [0.0] * 8, 1), (10, rows[12][1], 0), (10, rows[13][1], 1), (300, [5.0, 5.0], 1), (301, [5.0, 6.0], 1), (302, [5.0, 5.5], 2)]
    assert asked(spark, rows, block=8) == plain_negatives(rows, 5)


def test_negatives_of_nothing(spark):
    assert not asked(spark, [])
    assert not asked(spark, [(5, [1.0, 2.0], 1)])
    assert not asked(spark, [(5, None, 1), (10, [1.0], None)])


def test_search_looks_at_few_blocks_where_vectors_lie_in_groups(spark):
    """What bounds rule out is not read: the number of block visits is far below all of them."""
    from pyspark.sql import functions as F

    rows = some_vectors(1500, 3, spread=1)
    df = spark.createDataFrame([(i, k, i % 10 == 0, v) for i, v, k in rows], "id long, label int, anchor boolean, vec array<double>")
    index = hard_negatives.Index.of(df, 32)
    blocks = index.directory.blocks[8]
    q = np.array([v for i, v, _ in rows if i % 10 == 0])
    _, low, high = hard_negatives.bounds(index.directory, 8, q)
    x = np.array([v for _, v, _ in rows])
    kth = np.sort(q @ x.T, axis=1)[:, -6]
    assert len(blocks) >= 1500 // 32
    assert (high >= kth[:, None]).mean() < 0.5
    scores = {r["row"]: r for r in index.table.collect()}
    for r in list(scores.values())[::7]:  # every row lies within its block's bounds
        at = list(blocks["block"]).index(r["block"])
        score = q @ np.frombuffer(r["vec"])
        assert (score <= high[:, at]).all() and (score >= low[:, at]).all()
    assert index.table.select(F.countDistinct("row")).first()[0] == len(rows)


# 13 Exact dedup ---------------------------------------------------------------------------------


def plain_copies(rows):
    text = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, text):
        groups.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, text))


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(13)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "délta", "\U0001f642"]) for _ in range(n)) for n in (0, 1, 2, 5, 30, 30, 30, 400, 40_000)]
    rows = []
    for t in base:
        for _ in range(rng.choice((1, 3, 6))):
            rows.append((None, "".join(rng.choice([" ", "  ", "\n", "\t \r\n"]) if c == " " else c for c in t)))
    rows += [(None, base[7][:70] + "a" + base[7][70:]), (None, base[7][:70] + "b" + base[7][70:])]  # one length and prefix
    rows += [(None, x) for x in (None, None, "", " ", "\n\n", "　", "\x0b", "a b", "a b", "a  b ", " a b", "a\x1cb")]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    return [*rows, rows[4], rows[4], (None, rows[9][1]), (None, "only without ids"), (None, "only  without\nids"), (3, "another text under id 3")]


def test_copies(spark, copied):
    out = exact_dedup.copies(table(spark, copied), digest=True).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out) == plain_copies(copied)
    short = exact_dedup.copies(table(spark, copied), prefix=3)
    assert short.columns == ["doc_id", "keep_id", "group_size", "kept"]
    assert Counter(tuple(r) for r in short.collect()) == Counter(x[:4] for x in plain_copies(copied).elements())


def test_one_group_of_copies_holds_most_rows(spark):
    rows = [(i, f"text {i}") for i in range(40)] + [(1000 + i, "the  same" if i % 2 else "the same") for i in range(3000)] + [(9000 + i, f"pair {i // 2}") for i in range(60)]
    out = exact_dedup.copies(table(spark, rows), digest=True).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out) == plain_copies(rows)


def test_survivors(spark, copied, nothing):
    df = table(spark, copied)
    out = exact_dedup.survivors(df)
    assert out.columns == df.columns
    kept = {(x[1], x[4]) for x in plain_copies(copied)}
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
    got = [(r["doc_id"], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(out.collect(), normal)]
    assert len(got) == len(kept) and set(got) == kept
    assert exact_dedup.survivors(nothing).count() == 0
    assert exact_dedup.copies(nothing, digest=True).count() == 0


def test_bit_map_forgets_nothing(spark):
    from pyspark.sql import functions as F

    keys = spark.range(-5000, 5000, 7).select((F.col("id") * 1_000_003).alias("h"))
    bits = exact_dedup.bit_map(keys, "h")
    assert exact_dedup.marked(keys, F.col("h"), bits).filter("not maybe").count() == 0
    others = spark.range(10_000).select((F.col("id") * 999_983 + 1).alias("h"))
    assert exact_dedup.marked(others, F.col("h"), bits).filter("maybe").count() < 100
    assert bits.count() <= 1 << 18


def test_native_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op13_exact_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# 8 HTML extraction: hostile and broken pages ----------------------------------------------------


@pytest.mark.parametrize(
    "piece",
    ["<script ", "<script>", "<a ", '<a "', "<a b='", '<a b="x>', "<!--", "<!", "<style><", "</", "<", "<div>", "</div>", "<div></span>", '<p class="', "<b \"'>", "a<b", "<svg><p>x", '<i "a" \'b\' ', "<div class=nav>x"],
)
def test_a_megabyte_of_one_piece_is_read_in_one_pass(piece):
    import time

    from lexiloom.llm import html_extract

    for page in (piece * (1_000_000 // len(piece)), "<p>words before it all here</p>" + piece * (1_000_000 // len(piece)) + "<p>and some after it</p>"):
        began = time.perf_counter()
        html_extract.content(page, html_extract.default_scores())
        assert time.perf_counter() - began < 8


def test_where_tags_end():
    """The table over all signs says what looking at them one by one does."""
    from lexiloom.llm.html_extract import Ends

    rng = random.Random(8)
    for _ in range(300):
        page = "".join(rng.choice(["'", '"', ">", "x", " ", "<a "]) for _ in range(40)) + rng.choice(["", ">"])
        for at in range(0, len(page), 5):
            m = re.compile("((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>").match(page, at)
            want = m.end() - 1 if m else page.find(">", at)
            assert Ends(page).of(at) == Ends(page, walk=1).of(at) == want


def test_pieces_of_a_page():
    from lexiloom.llm.html_extract import pieces_of

    page = "a<!-- <p> --><P Class='x>y'>b < c</p><script src=\">\">1<p>2</SCRIPT ><!doctype html><br/>d<scripts>e</scripts><textarea>f"
    assert [(x.text or ("/" if x.closing else "") + x.name + x.attributes) for x in pieces_of(page)] == ["a", "p Class='x>y'", "b ", "< c", "/p", '">1', "p", "2"][:5] + ["br/", "d", "scripts", "e", "/scripts"]


# 2 Embedding near-dedup: ids that clash ---------------------------------------------------------


def test_vectors_under_one_id_are_told_apart(spark):
    from lexiloom.llm import embedding_dedup

    x, y, z = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near_x = [1.0, 0.1, 0.0, 0.0]
    rows = [(5, x), (5, y), (8, near_x), (9, z), (None, z), (3, [0.0, 0.0, 1.0, 0.1]), (5, y)]
    out = embedding_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = Counter(tuple(r) for r in out)
    assert got == Counter([(5, 1, 5, True), (5, 1, 5, True), (5, 1, 5, True), (8, 1, 5, False), (9, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True)])


# 3 Mixing: places of files ----------------------------------------------------------------------


def test_training_order_over_several_files_a_task(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexiloom.llm import mixing

    rows = [(i, " ".join(["w"] * (i % 9 + 1)), f"s{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = f"file://{tmp_path}/mixed"
    mixing.mixed(df, position_col="at").write.option("maxRecordsPerFile", 20).parquet(path)
    out = mixing.training_order(spark.read.parquet(path), "order").select("order", "at").collect()
    assert len({r["order"] for r in out}) == len(out) > 400
    places = [r["at"] for r in sorted(out, key=lambda r: r["order"])]
    assert places == sorted(places)
    big = spark.read.parquet(path).select(F.lit(1))
    assert mixing.training_order(big, "order").select("order").distinct().count() == len(out)


# 6 Order MinHash: recall ------------------------------------------------------------------------


@pytest.mark.parametrize("words", [40, 80, 300, 1000])
def test_near_copies_with_changes_all_over(spark, words):
    """End to end: of pairs whose changed words are spread at random, nine in ten are found at 0.8 and up."""
    from lexiloom.llm import order_minhash

    rng = random.Random(words)
    for share, least in ((0.81, 0.85 if words < 80 else 0.88), (0.85, 0.9), (0.9, 0.97)):
        rows, pairs = [], 100
        for p in range(pairs):
            a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
            b = list(a)
            for at in rng.sample(range(words), int((1 - share) * words + 1e-9)):
                b[at] = f"w{rng.randrange(10**6)}"
            rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
        out = order_minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        found = sum(r["class_id"] == r["doc_id"] - 1 for r in out if r["doc_id"] % 2)
        assert not any(r["class_id"] != r["doc_id"] - r["doc_id"] % 2 and r["class_id"] != r["doc_id"] for r in out)
        assert found >= least * pairs
