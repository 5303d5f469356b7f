"""Assignments and alignments in parts, JSON-safe values, services, settings, the cache and streams."""

import json
import math
import random
import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import config
from lexiloom.functions import kernels
from lexiloom.operators import align, chunking, configured, embedding, report, scoring
from lexiloom.sources import cache
from lexiloom.streaming import dedup


def plain_greedy(scores, least, strict):
    out, used = {}, set()
    for i in sorted({i for i, _ in scores}):
        free = [(-s, j) for (x, j), s in scores.items() if x == i and j not in used and (s > least if strict else s >= least)]
        if free:
            s, j = min(free)
            used.add(j)
            out[i] = (j, -s)
    return out


@pytest.mark.parametrize("block,kind", [(1024, "random"), (4, "random"), (3, "alike"), (2, "few")])
def test_greedy_in_blocks(spark, block, kind):
    """Random scores with ties, all i of one taste (the longest chain of refusals), and few j."""
    rng = random.Random(block)
    rows, want = [], {}
    for key in ("x", "y", "z"):
        n, m = rng.randrange(10, 25), 4 if kind == "few" else rng.randrange(10, 25)
        taste = {j: round(rng.random(), 2) for j in range(m)}
        scores = {(i * 3, j): taste[j] if kind == "alike" else round(rng.random(), 1) for i in range(n) for j in range(m) if rng.random() < 0.9}
        rows += [(key, i, j, s) for (i, j), s in scores.items()]
        want[key] = plain_greedy(scores, 0.3, block == 4)
    df = spark.createDataFrame(rows, "pair string, i int, j long, score double").repartition(3)
    out = align.assign_greedy(df, "pair", 0.3, strict=block == 4, block=block)
    assert out.columns == ["pair", "i", "j", "score"] and dict(out.dtypes)["i"] == "int"
    got = {k: {r["i"]: (r["j"], r["score"]) for r in out.filter(F.col("pair") == k).collect()} for k in want}
    assert got == want


def test_greedy_of_nothing(spark):
    none = spark.createDataFrame([], "pair string, i int, j int, score double")
    assert align.assign_greedy(none, "pair", 0.5).collect() == []


def whole_matrix(score, gap):
    """Best total by the plain recursion."""
    n, m = score.shape
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + score[i - 1, j - 1], best[i - 1, j] + gap, best[i, j - 1] + gap)
    return best[n, m]


def test_alignment_in_strips():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (1, 9), (9, 1), (17, 23), (40, 33)):
        score = np.round(rng.random((n, m)), 1)
        asked = []

        def strip(a, b, score=score, asked=asked):
            asked.append(b - a)
            return score[a:b]

        total, steps, told = kernels.aligned_strips(n, m, strip, -0.15, cells=5 * m)
        assert max(asked) <= 5
        assert math.isclose(total, whole_matrix(score, -0.15))
        assert (total, steps) == kernels.global_alignment(score)
        assert [i for i, _ in steps if i >= 0] == list(range(n)) and [j for _, j in steps if j >= 0] == list(range(m))
        assert told == [score[i, j] if i >= 0 and j >= 0 else 0.0 for i, j in steps]
        assert math.isclose(sum(told) - 0.15 * sum(i < 0 or j < 0 for i, j in steps), total)


def test_long_alignment_in_little_memory():
    """20,000 chunks a side: a full matrix of doubles would be 3.2 GB; here it is 2 x 50 MB of bits."""
    import tracemalloc

    n = 6_000  # the same, at a size that a test can wait for: 288 MB against 9 MB of bits
    a = np.arange(n) % 997
    tracemalloc.start()
    total, steps, _ = kernels.aligned_strips(n, n, lambda x, y: (a[x:y, None] == a[None, :]).astype(float), cells=1_000_000)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert math.isclose(total, n) and len(steps) == n and most < 100_000_000


def test_pairs_of_large_groups_are_those_of_small_ones(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    rows = [(g, k, " ".join(rng.sample(words[:12] if k % 3 else words, rng.randrange(1, 9)))) for g in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "g long, chunk_index long, text string")
    for above in (0.4, 0.9):
        one, two = (set(map(tuple, chunking.similar_chunk_pairs(df, ["g"], above, small).collect())) for small in (64, 5))
        assert one == two and one


def test_json_safe(spark, tmp_path):
    kind = "a double, b date, c timestamp, d array<struct<x: float, y: string>>, e map<int, double>, f binary, g struct<h: double>"
    at = datetime(2024, 2, 29, 12, 30, 15, 250000)
    rows = [
        (float("nan"), date(2024, 2, 29), at, [(float("inf"), "é"), (1.5, None)], {1: float("-inf"), 2: 2.0}, b"\x00\xff", (float("nan"),)),
        (1.25, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    report.write_json(df, f"{tmp_path}/j")
    texts = [json.loads(r["value"], parse_constant=lambda x: pytest.fail(x)) for r in spark.read.text(f"{tmp_path}/j").collect()]
    first = next(x for x in texts if "b" in x)
    assert "a" not in first and first["b"] == "2024-02-29" and first["c"] == "2024-02-29T12:30:15.250000Z"
    assert first["d"] == [{"y": "é"}, {"x": 1.5}] and first["e"].get("2") == 2.0 and first["f"] == "00FF"
    assert [x for x in texts if "b" not in x] == [{"a": 1.25}]


class Service(BaseHTTPRequestHandler):
    calls = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.calls.append((self.headers.get("Authorization"), len(body["input"])))
        if len(Service.calls) % 3 == 1:  # the first of every three asks for patience
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        data = [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(body["input"])]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"data": data[::-1]}).encode())

    def log_message(self, *_):
        pass


def test_vectors_from_a_service(spark, monkeypatch):
    """Batches are sent again after an answer that says later; the key never leaves the environment."""
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    maker = embedding.remote(lambda: embedding.http_sender(url, "m", None), wait=0.01)
    texts = [(k, "x" * (k % 30)) for k in range(100)] + [(100, None)]
    out = embedding.embed(spark.createDataFrame(texts, "id long, text string"), make_model=maker, batch=8).collect()
    server.shutdown()
    assert {r["id"]: r["vector"] and r["vector"][0] for r in out} == {k: None if t is None else float(len(t)) for k, t in texts}
    assert all(n <= 8 for _, n in Service.calls) and len(Service.calls) > 4


def test_a_service_that_stays_away():
    asked = []

    def sender(texts):
        asked.append(len(texts))
        raise embedding.Retry("later", after=0.0)

    with pytest.raises(embedding.Retry):
        embedding.remote(lambda: sender, tries=4)()(["a"])
    assert asked == [1] * 4
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        embedding.remote(lambda: lambda texts: [[1.0]])()(["a", "b"])


def test_search_with_a_threshold(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.standard_normal(3)]) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    got = {(r["a_id"], r["b_id"]): r["score"] for r in embedding.search(df.filter("id < 20"), df, block=7, least=0.8).collect()}
    assert set(got) == {(a, b) for a in range(20) for b in range(120) if a != b and cos[a, b] >= 0.8}
    best = embedding.search(df.filter("id < 20"), df, most=3, digits=1, block=7).collect()
    for a in range(20):
        want = sorted((b for b in range(120) if b != a), key=lambda b: (-round(cos[a, b], 1), b))[:3]
        assert sorted(r["b_id"] for r in best if r["a_id"] == a) == sorted(want)


def test_settings_act(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"max_tokens": 20, "remove_patterns": ["Page \\d+"], "exact": 0.5}))
    s = config.load([str(path)], {"LEXILOOM_MIN_CHUNK_SIZE": "5", "LEXILOOM_PARTIAL": "0.25", "LEXILOOM_SENTENCE_SPLIT": "no", "LEXILOOM_GAP": "0.4"})
    df = spark.createDataFrame([("A first line of some words\nPage 12\nand a second line of words here",)], "text string")
    assert configured.chunks(df, s).first()["chunks"] == ["A first line of some words\nand a second line of words here"]
    whole = config.Settings(min_chunk_size=0)
    assert "Page 12" in configured.chunks(df, whole).first()["chunks"][0]
    scores = spark.createDataFrame([(0.6,), (0.3,), (0.1,)], "score double")
    assert [r[0] for r in scores.select(configured.matched(F.col("score"), s)).collect()] == ["exact", "partial", "poor"]
    pairs = spark.createDataFrame([(1, ["a b c d", "x"], ["x"])], "k long, a array<string>, b array<string>")
    assert [r["alignment_type"] for r in configured.aligned(pairs, "k", "a", "b", s).orderBy("ord").collect()] == ["delete", "match"]
    blend = scores.select(configured.blended(F.col("score"), F.lit(1.0), config.Settings(string_weight=0.5, embed_weight=0.5))).first()[0]
    assert math.isclose(blend, 0.8)


def test_scores_by_pair(spark):
    rows = [("p", "match", 10, 10, 1.0, 1), ("p", "delete", 5, 0, 0.0, 1), ("p", "replace", 4, 8, 0.5, 2), ("q", "insert", 0, 0, None, 1)]
    df = spark.createDataFrame(rows, "pair_id string, alignment_type string, len_a int, len_b int, score double, section int")
    totals = {r["pair_id"]: r for r in scoring.diff_totals(df, "pair_id").collect()}
    assert (totals["p"]["total"], totals["p"]["n_match"], totals["p"]["n_delete"], totals["p"]["n_replace"]) == (23, 10, 5, 8)
    assert totals["q"]["overall"] == 100.0
    assert {r["alignment_type"]: r["share"] for r in scoring.content(df.filter("pair_id = 'p'"), "pair_id").collect()} == dict.fromkeys(("match", "delete", "replace"), 33.333333)


HASHED = "content_hash string, v long"


def test_two_writers_lose_and_double_nothing(spark, tmp_path):
    """Writers that saw the same manifest commit at once; their keys overlap."""
    path = f"{tmp_path}/cache"
    seen = cache.manifest(spark, path)
    rows = [spark.createDataFrame([(f"k{k}", w) for k in range(w * 5, w * 5 + 10)], HASHED) for w in range(4)]
    errors = []

    def write(df):
        try:
            cache.put(df, path, seen)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(df,)) for df in rows]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    found = [r["content_hash"] for r in cache.stored(spark, path, HASHED).collect()]
    assert sorted(found) == sorted(f"k{k}" for k in range(25))
    assert cache.manifest(spark, path)[0] == 4
    assert cache.compact(spark, path, HASHED) and len(cache.manifest(spark, path)[1]) == 1
    assert sorted(r["content_hash"] for r in cache.stored(spark, path, HASHED).collect()) == sorted(found)
    assert cache.vacuum(spark, path, older_than=-60) > 0
    assert cache.stored(spark, path, HASHED).count() == 25


def test_each_content_is_made_once(spark, tmp_path):
    path, made = f"{tmp_path}/cache", spark.sparkContext.accumulator(0)

    def make(missing):
        def count(batches):
            for pdf in batches:
                made.add(len(pdf))
                yield pdf.assign(v=pdf["text"].str.len())[["content_hash", "v"]]

        return missing.filter("text IS NOT NULL").mapInPandas(count, HASHED)

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id long, text string")
    for _ in range(2):
        out = cache.through(df, ["text"], path, make, HASHED).collect()
        assert {r["id"]: r["v"] for r in out} == {1: 1, 2: 2, 3: 1, 4: None}
    assert made.value == 2


def test_state_of_streams_expires(spark, tmp_path):
    """A chunk seen again after `late` is new; within it, it is not."""
    at = 1_000_000_000
    batches = [[(1, 0, "one two three", at)], [(1, 1, "one two three", at + 10), (2, 5, "x", at + 200_000)], [(3, 9, "y", at + 200_001)], [(1, 2, "one two three", at + 200_010)]]
    path = f"{tmp_path}/in"
    schema = "g long, chunk_index long, text string, ts timestamp"
    for rows in batches:
        df = spark.createDataFrame(rows, "g long, chunk_index long, text string, s long").select("g", "chunk_index", "text", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)

    def drain(make, name):
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    near = drain(lambda s: dedup.near_dedup(s, "g", 0.9, late="1 hour", late_ms=3_600_000), "near_out")
    assert sorted((r["g"], r["chunk_index"]) for r in near) == [(1, 0), (1, 2), (2, 5), (3, 9)]
    exact = drain(lambda s: dedup.first_of_content(s, late="1 hour"), "exact_out")
    assert sorted((r["g"], r["chunk_index"]) for r in exact) == [(1, 0), (1, 2), (2, 5), (3, 9)]


def test_lines_that_patterns_remove(spark):
    from lexiloom.functions import text

    df = spark.createDataFrame([("Page 1\nwords here\n  DRAFT of it\nPages and more",)], "text string")
    kept = df.select(text.clean_text(F.col("text"), (r"Page \d+", "DRAFT|COPY"))).first()[0]
    assert kept == "words here\nPages and more"


def test_opcodes_against_the_plain_matcher():
    """On random sequences, long ones with popular tokens and ones of few kinds among them; and they turn a into b."""
    import difflib

    rng = random.Random(1)
    for t in range(400):
        n, m, k = rng.choice([0, 1, 5, 60, 250]), rng.choice([0, 1, 5, 60, 250]), rng.choice([2, 5, 30, 300])
        a = [str(rng.randrange(k)) for _ in range(n)]
        b = [str(rng.randrange(k)) for _ in range(m)] if t % 3 else [x if rng.random() > 0.1 else f"z{rng.randrange(9)}" for x in a][:m]
        got = kernels.opcodes(a, b)
        assert got == difflib.SequenceMatcher(None, a, b).get_opcodes()
        made = []
        for tag, i1, i2, j1, j2 in got:
            made += a[i1:i2] if tag == "equal" else b[j1:j2]
        assert made == b


def test_titles_are_assigned_in_order(spark, sf_dir):
    """Against the plain rule, scored title by title."""
    from lexiloom.plans import registry
    from lexiloom.plans.compare_queries import read, readers

    got = {}
    for r in registry.QUERIES["titles_assigned"](spark, sf_dir).collect():
        got.setdefault(r["pair_id"], {})[r["i"]] = (r["j"], r["score"])
    titles = {}
    for r in readers.headings_from_html(read(spark, sf_dir, "pages"), "page_id").collect():
        titles.setdefault(r["page_id"], {})[r["ord"]] = r["title"]
    for page, own in titles.items():
        other = {1_000_000 - k: "".join("u" if c in "aeo" else c for c in t) if k % 2 == 0 else t + " again" for k, t in own.items()}
        normal = {t: " ".join("".join(c for c in t.lower() if c.isalnum() or c in "_ ").split()) for t in (*own.values(), *other.values())}
        if any(not x.isascii() for x in normal):
            continue  # the normal form of other letters is tested elsewhere
        scores = {(i, j): round(1.0 if normal[a] == normal[b] else kernels.title_score(normal[a], normal[b]), 6) for i, a in own.items() for j, b in other.items() if normal[a] and normal[b]}
        assert got.get(page, {}) == plain_greedy(scores, 0.6, False)
    assert got
